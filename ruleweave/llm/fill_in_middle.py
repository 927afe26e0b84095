"""Fill-in-the-middle transformation as a ``pyarrow.compute`` pipeline.

A text is cut into units: a word with the white space before it, and what white
space is left at the end.  Per batch, the units of all texts are list arrays;
they are flattened beside their parent indices, get their ordinals within the
parent, and are filtered by role (prefix, middle, suffix); each role's units
are built into lists again and joined into one piece per text.  The pieces are
put together in one of two orders, each piece after its sentinel:

* ``psm``: prefix, suffix, middle;
* ``spm``: suffix, prefix, middle;
* ``plain`` leaves the text as it is.

The cuts and the form of a document follow from a keyed hash of its doc_id, so
every run, in any order, gives the same result.  A text that holds a sentinel
stays plain; in any other text a sentinel's first character occurs once in it,
so no sentinel can begin in a piece and end in the next one, and ``restore``
rebuilds the exact text from output and form.

Edge cases: a null text counts as empty; an empty text is plain, with no unit;
white space alone is one unit; a null doc_id is hashed as an empty number;
equal rows are transformed alike; a text is never cut into parts, a batch holds
about ``SLICE_BYTES`` or one text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, byte_slices, map_arrow, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = "<[PSM]>"
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80   # of all texts; of those that are transformed
SLICE_BYTES = 8 << 20


def units(texts: pa.Array) -> pa.ListArray:
    """The units of each text, in order.  White space and words are split off
    separately; gap k of a text comes before its word k."""
    words, gaps = pc.split_pattern_regex(texts, f"{SPACE_CLASS}+"), pc.split_pattern_regex(texts, WORD_CLASS)
    word, gap = pc.list_flatten(words), pc.list_flatten(gaps)
    word = word.filter(pc.not_equal(word, ""))
    parent = pc.list_parent_indices(gaps).to_numpy()
    at = np.arange(len(gap))
    last = np.append(parent[1:] != parent[:-1], True)[:len(parent)]   # the gap after a text's last word
    after = word.take(pa.array(at - parent, mask=last))
    unit = pc.binary_join_element_wise(gap, pc.fill_null(after, ""), "")
    there = pc.not_equal(unit, "")
    return _lists(unit.filter(there), parent[there.to_numpy(zero_copy_only=False)], len(texts))


def _lists(values: pa.Array, parent: np.ndarray, n: int) -> pa.ListArray:
    """Values that lie in the order of their parents, as a list per parent."""
    ends = np.cumsum(np.bincount(parent, minlength=n)) if n else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values)


def pieces(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Number of units of each text, and its prefix, middle and suffix: up to
    unit ``first % (n + 1)`` or ``second % (n + 1)``, whichever is smaller, up to
    the larger, and the rest."""
    lists = units(texts)
    n = pc.list_value_length(lists).to_numpy()
    low, high = np.minimum(first % (n + 1), second % (n + 1)), np.maximum(first % (n + 1), second % (n + 1))
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    ordinal = np.arange(len(flat)) - lists.offsets.to_numpy()[parent]
    role = (ordinal >= low[parent]).astype(np.int8) + (ordinal >= high[parent])
    out = []
    for r in range(3):
        own = role == r
        out.append(pc.binary_join(_lists(flat.filter(pa.array(own)), parent[own], len(texts)), ""))
    return n, out


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in byte_slices(whole, "text", SLICE_BYTES):
            text, form = b.column("text"), b.column("form")
            n, (prefix, middle, suffix) = pieces(text, *(b.column(c).to_numpy() for c in ("h1", "h2")))
            plain = pc.equal(form, "plain")
            psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
            spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
            out = pc.if_else(plain, text, pc.if_else(pc.equal(form, "spm"), spm, psm))
            chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64()))
                     for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), form, *chars, out],
                                             names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in byte_slices(whole, "output", SLICE_BYTES):
            output, form = b.column("output"), b.column("form")
            plain = pc.equal(form, "plain")
            # a plain text may hold sentinels: in its place stands one that parts in four
            parts = pc.split_pattern_regex(pc.if_else(plain, PREFIX + SUFFIX + MIDDLE, output), SENTINELS)
            x, y, z = (pc.list_element(parts, i) for i in (1, 2, 3)) if len(b) else (output,) * 3
            text = pc.if_else(pc.equal(form, "spm"), pc.binary_join_element_wise(y, z, x, ""),
                              pc.binary_join_element_wise(x, z, y, ""))
            yield b.append_column("restored", pc.if_else(plain, output, text))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
              fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row."""
    doc_id = F.col(id_col).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       digest.alias("digest"))
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    whole = ((F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX)
             | F.col("text").contains(MIDDLE) | (h[2] % 100 >= fim_percent))
    form = F.when(whole, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    return map_arrow(rows, _transformed, "doc_id long, n long, form string, prefix_chars long, "
                                         "middle_chars long, output string")


def restore(transformed: DataFrame) -> DataFrame:
    """The rows of ``transform``, which may have columns of their own beside
    output and form, with the exact text rebuilt from these two (``restored``)."""
    schema = ", ".join(f"`{c}` {t}" for c, t in transformed.dtypes)
    return map_arrow(transformed, _restored, f"{schema}, restored string")


def op12_fill_in_middle(spark, sf_dir):
    back = restore(transform(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
cut AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM hashed),
formed AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
         greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m,
         array_to_string(list_slice(u, b + 1, n), '') AS s
  FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""
