"""ruleweave: rule-driven event analytics as Spark DataFrame operators.

Subpackages: ``sources`` (inputs), ``functions`` (column expressions),
``operators`` (DataFrame → DataFrame steps), ``plans`` (the query catalogue
and its SQL oracle), ``streaming`` (Structured Streaming jobs).
"""
