"""Corpus pipeline: five stages, each over all documents the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.

1. language ID: drops documents without a letter and those whose best language
   isn't told from the others: of k learned languages, the best one's mean
   marginal is 1/k at least, and has to be ``LEAST_LIFT`` of the way from there
   to 1 (with one language, every document with a letter stays);
2. exact dedup: of equal normalised texts, one row stays;
3. n-gram Jaccard join (five words, 0.8): one row of each component stays, the
   one that the exact stage would prefer (most code points, least doc_id);
4. mixing: a document is repeated as often as the mix takes it as a whole; what
   is left over (a part of one document per cell) counts from one half on;
5. SentencePiece: ids of every document the mix took.

A null or clashing column doesn't matter to any stage: decisions are joined to
rows by row number, and every column of ``docs`` is passed on.  An empty table
passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleweave.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_dropout
from ruleweave.llm.common import numbered, staged, table
from ruleweave.llm.token_counts import vocabulary_path

LEAST_LIFT = 0.1
REMEMBERED = 1_000_000   # of the encoder, per worker: beside a heap that four stages have filled
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100
ORACLE_SQL: str | None = None   # three stages rest on hashes and a learned model


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs``, which are numbered, whose numbers are in ``rows``."""
    return docs.join(rows.select("__row"), "__row", "left_semi").drop("__row")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    docs = numbered(docs, "__row")
    # only row numbers and texts go through the Python workers, and no text comes back
    told = language_id.predict(docs.select("__row", "text"), model, ["__row"])
    return _only(docs, told.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score(model))))


def least_score(model: dict | None) -> float:
    k = len(model["langs"]) if model else 1
    return (1 + LEAST_LIFT * (k - 1)) / k if k > 1 else 0.0


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs, "__row")
    kept = exact_dedup.exact_dedup(docs, row_col="__row").where("kept")
    return _only(docs, kept.withColumnRenamed("rid", "__row"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs, "__row")
    linked = ngram_join.jaccard_join(docs, NEAR_WORDS, NEAR_NUM, NEAR_DEN, row_col="__row").select("rid", "root")
    sizes = docs.select(F.col("__row").alias("rid"), F.col("doc_id").cast("long").alias("id"),
                        F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    order = F.struct((-F.col("n")).alias("short"), F.col("id").isNull().alias("no_id"), "id", "rid")
    best = linked.join(sizes, "rid").groupBy("root").agg(F.min(order).alias("best"))
    return _only(docs, best.select(F.col("best.rid").alias("__row")))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows that agree in id, source and text are dealt alike, whichever is which
    same = ["doc_id", "source", "key1", "key2"]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("taken"))
    dealt = mixing.mix(docs).select(*same, F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")))
                                    .otherwise(0).cast("int").alias("times"), "taken").withColumn("nth", nth)
    text = F.col("text").cast("string")
    columns, docs = docs.columns, numbered(docs, "__row")
    mine = docs.select(
        "__row", F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("key1"),
        F.xxhash64(F.lit(mixing.SEED), text).alias("key2")).withColumn(
        "nth", F.row_number().over(Window.partitionBy(*same).orderBy("__row")))
    pair = dealt.alias("a").join(mine.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*same, "nth")])
    copies = pair.where("a.times > 0").select("b.__row", F.explode(F.sequence(F.lit(1), F.col("a.times")))).select("__row")
    return docs.join(copies, "__row").select(*columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_dropout.encode(docs, vocabulary_path(sentencepiece_dropout.VOCABULARY), remember=REMEMBERED)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("sentencepiece", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
