"""URL filter: rules, and gradient-boosted trees on lexical features for what
no rule covers; DataFrame functions and Spark's own tree learner only.

Labels: a URL that a rule covers is labelled with that rule's verdict.  The
trees learn from at most ``TRAIN_URLS`` distinct labelled URLs (those with the
least hash, a documented bound); statistics of host suffixes cover all rows,
and every URL that no rule covers gets the trees' verdict.

Features: length of URL, host and path, depth, digit ratio, character entropy,
number of parameters, hyphens, number of host labels, and of the host's suffix
(its last label) the log frequency, the mean URL length and the smoothed share
of blocked URLs among its labelled ones.

Edge cases: a null URL, or one without ``://``, has an empty host and path, no
rule, and the trees' verdict on zero features; rows repeated as a whole are
judged each; with labels of one verdict only, the trees' part gives that
verdict, and with none ``allow``; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table

# (verdict, host, path); a rule is written host + path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TRAIN_URLS = 20_000
ROUNDS, DEPTH, STEP, SEED = 12, 3, 0.2, 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy",
            "parameters", "hyphens", "labels", "suffix_log_freq", "suffix_mean_length",
            "suffix_blocked"]


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, from columns host, path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host)))
                & F.startswith(F.col("path"), F.lit(path)))
        name = F.when(fits, host + path).otherwise(name)
        verdict = F.when(fits, said).otherwise(verdict)
    return name, verdict


def _lexical(df: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.char_length(url)
    share = lambda c: (size - F.char_length(F.replace(url, c))) / size
    chars = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    entropy = F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.select(
        "*", size.cast("double").alias("url_length"),
        F.char_length("host").cast("double").alias("host_length"),
        F.char_length("path").cast("double").alias("path_length"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"),
        F.when(size > 0, F.regexp_count(url, F.lit("[0-9]")) / size).otherwise(0.0).alias("digit_ratio"),
        entropy.alias("entropy"),
        F.regexp_count(query, F.lit("[^&]+")).cast("double").alias("parameters"),
        F.regexp_count(url, F.lit("-")).cast("double").alias("hyphens"),
        F.regexp_count("host", F.lit("[^.]+")).cast("double").alias("labels"),
        F.substring_index("host", ".", -1).alias("suffix"))


def judge_urls(pages: DataFrame, rules=RULES, train_urls: int = TRAIN_URLS,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and block_score (the trees' probability
    of a block; null where the trees weren't needed or couldn't learn)."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    base = base.withColumn("host", host).withColumn("path", path)
    rule, said = rule_columns(rules)
    known = staged(_lexical(base.withColumn("rule", rule).withColumn("said", said)), "url-features")

    blocked = (F.col("said") == "block").cast("double")
    per_suffix = known.groupBy("suffix").agg(
        F.log1p(F.count(F.lit(1)).cast("double")).alias("suffix_log_freq"),
        F.avg("url_length").alias("suffix_mean_length"),
        ((F.coalesce(F.sum(blocked), F.lit(0.0)) + 1) / (F.count("said") + 2)).alias("suffix_blocked"))
    rows = known.join(per_suffix, "suffix")
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")

    # the sample is chosen by id and hash first, so that only it meets the statistics
    sample = (known.where("said IS NOT NULL").select("url", "said", "suffix", *FEATURES[:9]).distinct()
              .orderBy(F.xxhash64("url"), "url").limit(train_urls))
    train = staged(vector.transform(sample.join(per_suffix, "suffix")).select(
        "features", F.when(F.col("said") == "block", 1.0).otherwise(0.0).alias("label")), "url-train")
    kinds = {r["label"] for r in train.select("label").distinct().collect()}
    out = ["page_id", "host", "path", "rule"]
    if len(kinds) < 2:
        default = "block" if kinds == {1.0} else "allow"
        return known.select(*out, F.coalesce("said", F.lit(default)).alias("verdict"),
                            F.lit(None).cast("double").alias("block_score"))
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=STEP, seed=SEED).fit(train.coalesce(1))
    from pyspark.ml.functions import vector_to_array
    scored = (trees.transform(vector.transform(rows))
              .withColumn("block_score", vector_to_array("probability")[1]))
    by_trees = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return scored.select(*out, F.coalesce("said", by_trees).alias("verdict"),
                         F.when(F.col("said").isNull(), F.col("block_score")).alias("block_score"))


def op8_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))
