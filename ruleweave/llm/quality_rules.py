"""Quality rules with a hashed n-gram log-likelihood ratio; DataFrame functions
only.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets.  Two
multinomials over the buckets are counted: one over trusted documents (labelled
of good quality and not toxic), one over all documents, both with add-one
smoothing.  A document's score is the sum of log(p_trusted / p_raw) over its
n-grams, divided by their number, so that length doesn't matter.  A document is
kept when it passes the base rules and its score reaches a threshold learned from
all trusted documents: the same text always gets the same verdict from the same
tables.  A trusted document's own n-grams are in the trusted counts, which lifts
its score in a small corpus; so the threshold is a low quantile of scores with
one trusted n-gram of each bucket held out, as a clean document without a label
would be scored.

* Bucket counts have map-side combine: what is shuffled is ``BUCKETS`` rows per
  task.  The ratios are a bounded array that becomes a literal of the plan.
* Only the count of trusted n-grams needs the labels; documents meet them in
  one join on doc_id.  Scores need no join.
* Repeated windows are found by sorting (hash, position) within the document,
  in O(n log n), and only where a window hash occurs twice.

Edge cases: a null text has no words and fails the base rules; a null
``doc_id`` meets no label; a doc_id labelled more than once is trusted when all
its labels trust it; with no trusted document every score is 0; documents
without words score 0; repeated rows are judged each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, staged, table

BUCKETS = 1 << 14
THRESHOLD = -0.2     # nats per n-gram, for callers that don't learn it
LOSS = 0.001          # share of the trusted documents that a learned threshold may miss
STEP, STEPS = 1 / 4096, 1 << 14
WINDOW = 8            # words of a repeated window
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    words = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(words, lambda w: w != "")


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found more than once."""
    windows = F.transform(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[hashes[i + k] for k in range(1, WINDOW)]))

    def covered(ws: Column) -> Column:
        placed = F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda x, j: p[j]["w"] == x["w"]
            twice = F.filter(p, lambda x, j: ((j > 0) & same(x, F.greatest(j - 1, F.lit(0))))
                             | ((j < F.size(p) - 1) & same(x, F.least(j + 1, F.size(p) - 1))))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def words(s: Column) -> Column:
            # each start covers up to the next one, at most a window
            return F.aggregate(s, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")),
                               lambda a, x: F.struct(
                                   (a["n"] + F.least(F.lit(WINDOW), x + WINDOW - a["end"])).alias("n"),
                                   (x + WINDOW).alias("end")))["n"]
        return let(placed, lambda p: let(starts(p), words))

    return let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0))
               .otherwise(covered(ws)).cast("long"))


def _ngrams(hashes: Column) -> Column:
    """Bucket of each word and of each pair of neighbours."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))),
                        lambda h, i: bucket(F.xxhash64(h, hashes[i + 1])))
    return F.concat(F.transform(hashes, bucket), pairs)


def _hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def _trusted(labels: DataFrame, id_col: str) -> DataFrame:
    return (labels.groupBy(F.col(id_col).alias("id"))
            .agg(F.min((F.coalesce("quality", F.lit(0)) == 1)
                       & (F.coalesce("toxic", F.lit(0)) == 0)).alias("trusted"))
            .where("trusted"))


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
               text_col: str = "text") -> list[float]:
    """log(p_trusted / p_raw) of each bucket; all 0 without a trusted n-gram."""
    return _ratios(docs, labels, id_col, text_col)[0]


def _ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[list[float], list[float]]:
    """log(p_trusted / p_raw) of each bucket, and the same with one trusted
    n-gram of the bucket held out."""
    trusted = _trusted(labels, id_col)
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            # the same join at every size: labels grow with the documents
            .join(trusted.hint("merge"), "id", "left")
            .select(F.coalesce("trusted", F.lit(False)).cast("long").alias("t"),
                    F.explode(let(_hashes(F.col("text")), _ngrams)).alias("b")))
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("g")).collect():
        raw[r["b"]], good[r["b"]] = r["n"], r["g"]
    if not sum(good):
        return [0.0] * BUCKETS, [0.0] * BUCKETS
    n_raw, n_good = sum(raw) + BUCKETS, sum(good) + BUCKETS
    return ([math.log((g + 1) / n_good) - math.log((n + 1) / n_raw) for g, n in zip(good, raw, strict=True)],
            [math.log((max(g - 1, 0) + 1) / n_good) - math.log((n + 1) / n_raw) for g, n in zip(good, raw, strict=True)])


def _literal(ratios: list[float]) -> Column:
    return F.expr("cast(split('" + ",".join(map(repr, ratios)) + "', ',') as array<double>)")


def learned_threshold(scores: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> float:
    """The largest multiple of ``STEP`` that at most a share of ``LOSS`` of all
    trusted documents (that pass the base rules) miss with their held-out score;
    at most 0, and -inf without such a document."""
    # what lies outside the steps counts at their ends, so the driver sees a bounded number of rows
    step = F.greatest(F.least(F.floor(F.col("held") / STEP), F.lit(0)), F.lit(-STEPS)).cast("int")
    counts = (scores.where(~F.col("base_failed")).join(_trusted(labels, id_col).hint("merge"), F.col("doc_id") == F.col("id"))
              .groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())
    room = LOSS * sum(r["n"] for r in counts)
    for r in sorted(counts):
        room -= r["n"]
        if room < 0:
            return r["step"] * STEP
    return -math.inf


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float | None = THRESHOLD,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, llr.  Without a threshold it is learned from the labels."""
    ratios, held = _ratios(docs, labels, id_col, text_col)
    learn = threshold is None
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    both = rows.select(
        "doc_id",
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(_hashes(F.col("text")), lambda h: F.struct(
            F.size(h).cast("long").alias("n_words"), _repeat_words(h).alias("n_repeat_words"),
            _score(h, [_literal(ratios)] + [_literal(held)] * learn).alias("s"))).alias("m"))
    n, rep = F.col("m.n_words"), F.col("m.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
    scores = both.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                         rep.alias("n_repeat_words"), failed.alias("base_failed"),
                         F.col("m.s")[0].alias("llr"), *[F.col("m.s")[1].alias("held")] * learn)
    if learn:
        scores = staged(scores, "quality-scores")   # a few numbers a document; no text
        threshold = learned_threshold(scores, labels, id_col)
    kept = ~F.col("base_failed") & (F.col("llr") >= threshold)
    return scores.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", kept.alias("kept"), "llr")


def _score(hashes: Column, ratios: list[Column]) -> Column:
    """Mean of each of the ratios over the n-grams."""
    def mean(g: Column, r: Column) -> Column:
        return F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(r, b)) / F.size(g)).otherwise(0.0)
    return let(_ngrams(hashes), lambda g: F.array(*(mean(g, r) for r in ratios)))


def op1_quality_llr(spark, sf_dir):
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), None)
