"""Operators of a training-data pipeline over the ``documents`` and ``pages``
tables.  Nothing outside this subpackage imports it (``corpus_pipeline.py``
and the guarded import of ``__spark_entry__.py`` apart)."""
