import pytest
from pyspark.sql import functions as F

from ruleweave.llm import ngram_join, suffix_dedup
from ruleweave.llm.common import numbered


@pytest.fixture
def splits(spark):
    """Sets how many bytes a split may have; what was set before is put back."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def put(size):
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    yield put
    for k, v in before.items():
        spark.conf.set(k, v)


def documents(spark, folder):
    rows = spark.range(3000, numPartitions=3).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2((F.col("id") * 7 + i).cast("string"), 256) for i in range(6)]).alias("text"))
    rows.write.option("parquet.block.size", 65536).parquet(folder)
    return spark.read.parquet(folder)


def test_numbers_do_not_follow_the_splits(spark, tmp_path, splits):
    docs = documents(spark, str(tmp_path / "docs"))
    splits("64m")
    rows, plain = numbered(docs, "n"), docs.withColumn("n", F.monotonically_increasing_id())
    first, old = ({r["doc_id"]: r["n"] for r in x.collect()} for x in (rows, plain))
    assert len(set(first.values())) == 3000
    splits("32k")
    assert {r["doc_id"]: r["n"] for r in rows.select("doc_id", "n").collect()} == first
    assert {r["doc_id"]: r["n"] for r in numbered(docs, "n").collect()} == first
    assert {r["doc_id"]: r["n"] for r in plain.select("doc_id", "n").collect()} != old   # what moved before


def test_rows_that_are_no_file_scan_are_written_once(spark):
    rows = numbered(spark.range(100).select(F.rand().alias("x"), "id"), "n")
    assert sorted(rows.collect()) == sorted(rows.collect()) and rows.select("n").distinct().count() == 100


@pytest.mark.parametrize("module, call", [
    (ngram_join, lambda d: ngram_join.jaccard_join(d).drop("rid", "root")), (suffix_dedup, suffix_dedup.remove_repeats)])
def test_splits_that_change_between_passes(spark, tmp_path, splits, monkeypatch, module, call):
    docs = documents(spark, str(tmp_path / "docs"))
    docs.unionByName(docs.limit(50)).write.parquet(str(tmp_path / "copies"))
    docs = spark.read.parquet(str(tmp_path / "copies"))
    splits("64m")
    want = sorted(map(repr, call(docs).collect()))
    staged, turn = module.staged, [0]

    def shaken(*args):
        turn[0] += 1
        splits("20k" if turn[0] % 2 else "64m")
        return staged(*args)
    monkeypatch.setattr(module, "staged", shaken)
    assert sorted(map(repr, call(docs).collect())) == want
