"""Benchmark decontamination by a distributed positional inverted index.

1. Items are cut into windows of ``WINDOW`` consecutive words (an item with
   fewer words is one window); equal windows are one.
2. The index holds a posting (term, rid, pos) for each occurrence of a test term
   in the training texts, and one that marks the end of each text.  Lists of
   terms that no item has are never read, so they aren't stored.  Every task
   writes the postings of its own documents: the texts are read once and no
   posting is shuffled to build the index.
3. The terms of a window are ordered by the length of their posting lists; a
   window with a term that has no list can't occur.  The list of the rarest term
   gives the candidates (window, document, start), start being the position less
   the term's offset.  The list of the second rarest is intersected with them at
   the offset of that term, which leaves little but true matches; the lists of
   the other terms are intersected last, in documents that still have a
   candidate.  A term may lie up to ``slop`` positions from its place (proximity
   match); ``away`` is the largest distance, and 0 the exact phrase.  Distances
   are joined by tiles of positions, so every step is an equi-join.
4. Matches are gathered per document: positions that a match covers, and the
   items of its windows.

Only sets of terms or row numbers with at most ``common.SMALL_ROWS`` rows, which
are counted first, are broadcast; larger ones are shuffled.

Edge cases: a null or wordless text has no words and no hit; a null or wordless
item has no window and occurs nowhere; rows of one item_id are one item, all
windows of theirs count; a null item_id marks words, but is neither counted nor
listed; repeated documents are judged each; empty tables give no documents or no
hits; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, small, staged, table

WINDOW = 10
SLOP = 2
# Fixed value: the words of the contract, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = "\x00"   # stands after a text's last word; no word holds it


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def windows_of(items: DataFrame, window: int = WINDOW, id_col: str = "item_id",
               text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(wid, words) of the distinct windows, and (wid, item_id) of their items."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"),
                        words_of(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = staged(rows.select("item_id", "w", F.explode(starts).alias("s")).select(
        "item_id", F.slice("w", F.col("s") + 1, F.lit(window)).alias("words")).distinct(), "test-windows")
    windows = staged(cut.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "test-phrases")
    return windows, staged(cut.join(windows, "words").select("wid", "item_id"), "test-items")


def terms_of(windows: DataFrame) -> DataFrame:
    """(word, term) of the words in windows; term -1 marks the end of a text."""
    words = windows.select(F.explode("words").alias("word")).distinct().withColumn(
        "term", F.monotonically_increasing_id())
    end = windows.sparkSession.createDataFrame([(_END, -1)], "word string, term long")
    return staged(words.unionByName(end), "test-terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, rid, pos) of ``docs`` (rid, text), written by the tasks
    that read the texts.  The posting of term -1 has the number of words."""
    tokens = docs.select("rid", F.posexplode(F.array_append(words_of(F.col("text")), F.lit(_END))).alias("pos", "word"))
    return staged(tokens.join(small(terms), "word").select("term", "rid", "pos"), "token-postings")


def ranked_windows(windows: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(wid, size, order) of the windows whose terms all have postings; order
    has (df, offset, term) of each term, the rarest first."""
    entries = windows.select("wid", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word"))
    # a row per term, with partial counts before the shuffle
    lists = postings.where("term >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    entry = F.struct("df", "offset", "term")
    return staged(
        entries.join(terms, "word").join(staged(lists, "list-lengths"), "term")
        .groupBy("wid", "size").agg(F.sort_array(F.collect_list(entry)).alias("order"))
        .where(F.size("order") == F.col("size")), "ranked-windows")


def _postings_of(postings: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The postings whose ``column`` is among ``keys`` (one column)."""
    return postings.join(small(staged(keys.distinct(), "posting-keys")), column, "left_semi")


def _intersect(wanted: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
    """Rows of ``wanted`` (wid, rid, start, offset, term, ...) whose term has a
    posting within ``slop`` of start + offset, with its distance ``away``."""
    width = 2 * slop + 1
    place = F.col("start") + F.col("offset")
    tile = lambda p: F.floor(p / F.lit(width))
    reach = wanted.withColumn("place", place).withColumn(
        "tile", F.explode(F.sequence(tile(place - slop), tile(place + slop))) if slop else place.cast("long"))
    tiled = lists.withColumn("tile", tile(F.col("pos")) if slop else F.col("pos").cast("long"))
    met = reach.join(tiled, ["rid", "term", "tile"]).withColumn("away", F.abs(F.col("pos") - F.col("place")))
    return (met.where(F.col("away") <= slop)
            .groupBy("wid", "rid", "start", "offset").agg(F.min("away").alias("away")))


def matches(windows: DataFrame, postings: DataFrame, slop: int = 0) -> DataFrame:
    """(wid, rid, start, size, away) of the places where all terms of a ranked
    window lie within ``slop`` of their place beside an occurrence of its
    rarest term."""
    at = lambda k: F.col("order")[k]
    first = windows.select("wid", "size", at(0)["term"].alias("term"), at(0)["offset"].alias("offset"))
    lists = _postings_of(postings, first.select("term"), "term")
    found = lists.join(first, "term").select(
        "wid", "rid", (F.col("pos") - F.col("offset")).alias("start"), "size")
    alone = found.where("size = 1").withColumn("away", F.lit(0))

    second = windows.where("size > 1").select("wid", at(1)["term"].alias("term"), at(1)["offset"].alias("offset"))
    lists = _postings_of(postings, second.select("term"), "term")
    left = staged(_intersect(found.where("size > 1").join(second, "wid"), lists, slop).select(
        "wid", "rid", "start", F.col("away").alias("away2")), "candidates")

    rest = windows.where("size > 2").select("wid", F.explode(F.slice("order", F.lit(3), F.col("size"))).alias("e")).select(
        "wid", "e.term", "e.offset")
    lists = _postings_of(postings, left.select("rid"), "rid")
    others = (_intersect(left.join(rest, "wid"), lists, slop).groupBy("wid", "rid", "start")
              .agg(F.count(F.lit(1)).alias("k"), F.max("away").alias("away")))
    whole = (left.join(windows.select("wid", "size"), "wid").join(others, ["wid", "rid", "start"], "left")
             .where("coalesce(k, 0) = size - 2")
             .select("wid", "rid", "start", "size", F.greatest("away2", "away").alias("away")))
    return alone.select(*whole.columns).unionByName(whole)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids whose windows occur), near_items
    (how many items occur or nearly do), contaminated of every document."""
    rows = numbered(docs.select(id_col, text_col), "__row").select(
        F.col("__row").alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"))
    windows, owners = windows_of(items, window, item_col, item_text_col)
    terms = terms_of(windows)
    postings = build_index(rows, terms)
    found = staged(matches(ranked_windows(windows, terms, postings), postings, slop), "phrase-matches")

    exact = found.where("away = 0")
    hit = (exact.select("rid", F.explode(F.expr("sequence(start, start + size - 1)")).alias("p")).distinct()
           .groupBy("rid").agg(F.count(F.lit(1)).alias("n_hit")))
    named = (found.groupBy("rid", "wid").agg(F.min("away").alias("away")).join(owners, "wid")
             .where("item_id IS NOT NULL").groupBy("rid", "item_id").agg(F.min("away").alias("away"))
             .groupBy("rid").agg(F.count(F.lit(1)).alias("near_items"),
                                 F.array_sort(F.collect_list(F.when(F.col("away") == 0, F.col("item_id")))).alias("items")))
    length = postings.where("term = -1").select("rid", F.col("pos").cast("long").alias("n_words"))
    return (rows.select("rid", "doc_id").join(length, "rid").join(hit, "rid", "left").join(named, "rid", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("near_items", F.lit(0)).alias("near_items"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def op11_benchmark_decontamination(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', "
              f"'{string.ascii_lowercase}'), '{WORD}')")
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark),
cut AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[s + 1:s + {WINDOW}], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS s FROM items WHERE len(w) > 0)),
runs AS (
  SELECT rid, p, size, array_to_string(w[p + 1:p + size], ' ') AS phrase
  FROM (SELECT rid, w, size, unnest(range(greatest(len(w) - size + 1, 0))) AS p
        FROM docs, (SELECT DISTINCT size FROM cut))),
found AS (SELECT * FROM runs JOIN cut USING (size, phrase)),
hit AS (
  SELECT rid, count(DISTINCT q) AS n_hit
  FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM found) GROUP BY rid),
named AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""
