"""N-gram Jaccard self-join by vertical partitioning of the n-gram order.

A document is the set of its distinct word n-grams (64-bit hashes).  Two
documents link when their Jaccard similarity reaches ``num / den``.

1. Documents with equal sets form a class (128-bit key of the set); one row per
   class goes on, so exact copies never meet each other.
2. The global order of n-grams is (band, document frequency, hash).  Bands cut
   the order by hash; a document only puts the first bands into the search, as
   many as hold its prefix (n - ceil(t n) + 1 n-grams).
3. A class that has more than n - ceil(t n) n-grams of band 0 for itself can't
   link with another one, and leaves.  That takes the bulk of a corpus out.
4. Of the classes that stay, all n-grams are counted, and those of one class
   alone (``own``) bound what it can share: a pair whose sizes and own n-grams
   rule a link out is never formed, and a class that no pair can save leaves.
5. Two linked documents share an n-gram of their prefixes.  First round: each
   document of a prefix n-gram (and length class) is paired with the one that
   has the fewest n-grams of its own, the original of a group of near copies;
   components of the links found are formed.  Second round: the documents of a
   prefix n-gram that lie in *different* components are paired, unless what each
   lacks of a common centre rules a link out.  A link within a component changes
   nothing, so no link that matters is lost, and a large group of near copies
   isn't expanded into all its pairs.
6. Each pair is verified on vertical fragments: every document's set is cut by
   hash into ``FRAGMENTS`` fragments, overlaps are counted per (pair, fragment)
   and summed per pair.

What survives step 3 is looked up by a bitmap of fixed size (``BITMAP_BITS``)
in a second pass over the table; a false hit adds a row that step 6 judges like
any other.  The table must be a scan (or otherwise read the same way twice).

Edge cases: a null or blank text has the empty set and links with nothing, its
own component; fewer words than n give one n-gram of all words; a null doc_id
takes part, but doesn't name a component unless all ids in it are null;
repeated rows are copies; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, claim, map_arrow, numbered, staged, table
from .components import components

WORDS, NUM, DEN = 3, 90, 100
FRAGMENTS = 4
BITMAP_BITS = 67_108_859   # a prime near 2**26: 8 MB at any input size
_FEW = 24    # n-grams of a fragment that a document may lack of its centre's for the list to be kept
_BEFORE = 8   # preceding n-grams of a posting that tell whether a pair has been found before
_SLICE_BYTES = 8 << 20
_MIX = tuple(np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def bands(num: int = NUM, den: int = DEN) -> int:
    """Bands of the order: band 0 holds about 5/3 as many n-grams as a prefix."""
    return max(1, 2 * den // (3 * (den - num))) if num < den else 8


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of ``text``."""
    parts = (text or "").encode().lower().split()   # bytes: A-Z and ASCII space only
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(h))
    s = np.full(len(h) - n + 1, n if n < words else 0, np.uint64)
    for k in range(n):
        s = (s ^ h[k:len(h) - n + 1 + k]) * _MIX[k % len(_MIX)]
        s ^= s >> np.uint64(29)
    return np.unique(s)


def _head(s: np.ndarray, prefix: int, n_bands: int) -> np.ndarray:
    """The n-grams of the first bands, as many bands as hold ``prefix``."""
    band = (s >> np.uint64(32)) % np.uint64(n_bands)
    last = np.sort(band)[prefix - 1] if len(s) else 0
    return s[band <= last]


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _prefix(n: int, num: int, den: int) -> int:
    return n + (-num * n) // den + 1   # n - ceil(n * num / den) + 1


def _reader(words: int, num: int, den: int, wanted=None):
    """Slim rows with their head of the order, or (``wanted``: a bitmap of row
    ids) the whole sets of the rows that may be wanted."""
    n_bands = bands(num, den)

    def slim(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x, words) for x in b.column("text").to_pylist()]
        keys = np.array([_key(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [b.column("rid"), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array(keys[:, 0]), pa.array(keys[:, 1]),
             _longs([_head(s, _prefix(len(s), num, den), n_bands) for s in sets])],
            names=["rid", "doc_id", "n", "k1", "k2", "head"])

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        at = b.column("at").to_numpy()
        hit = (wanted.value[at >> 6] >> (at & 63)) & 1 == 1
        b = b.filter(pa.array(hit))
        sets = [shingles(x, words) for x in b.column("text").to_pylist()]
        cuts = np.array([(k << 64) // FRAGMENTS for k in range(1, FRAGMENTS)], np.uint64)
        ends = [0]
        for s in sets:
            ends += (np.append(np.searchsorted(s, cuts), len(s)) + ends[-1]).tolist()
        flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
        parts = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * FRAGMENTS),
                                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
        return pa.RecordBatch.from_arrays(
            [b.column("rid"), pa.array([len(s) for s in sets], pa.int64()),
             _longs([_head(s, _prefix(len(s), num, den), n_bands) for s in sets]),
             parts], names=["rid", "n", "head", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join", lambda: None)
        for big in batches:
            for b in byte_slices(big, "text", _SLICE_BYTES):
                yield slim(b) if wanted is None else whole(b)
    return run


def _key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return d >> 64, d & (1 << 64) - 1


def _slices(lists: pa.ListArray) -> list[np.ndarray]:
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlap of each (pair, fragment), and what y lacks of x, if little."""
    for b in batches:
        counts, lacks = [], []
        for p, q in zip(_slices(b.column("p")), _slices(b.column("q")), strict=True):
            shared = np.intersect1d(p, q, True)
            counts.append(len(shared))
            lacks.append(np.setdiff1d(p, shared, True) if len(p) - len(shared) <= _FEW else None)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("x", "y", "nx", "ny")), pa.array(counts, pa.int64()),
             pa.array(lacks, pa.list_(pa.int64()))], names=["x", "y", "nx", "ny", "partial", "lacks"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, nx, ny, o, lacks) of the pairs: partial overlaps by fragment, summed
    by pair; lacks is null where y lacks much of x."""
    # written, so that the planner knows how few documents are in a pair at all
    paired = staged(pairs.select(F.explode(F.array("x", "y")).alias("rid")).distinct(), "ngram-paired")
    parts = sets.join(paired, "rid", "left_semi").select("rid", "n", F.posexplode("parts").alias("f", "part"))
    left = parts.select(F.col("rid").alias("x"), F.col("n").alias("nx"), "f", F.col("part").alias("p"))
    right = parts.select(F.col("rid").alias("y"), F.col("n").alias("ny"), "f", F.col("part").alias("q"))
    met = pairs.select("x", "y").join(left, "x").join(right, ["y", "f"]).select("x", "y", "nx", "ny", "p", "q")
    counted = map_arrow(met, _overlaps, "x long, y long, nx long, ny long, partial long, lacks array<long>")
    return counted.groupBy("x", "y", "nx", "ny").agg(
        F.sum("partial").alias("o"),
        F.when(F.count("lacks") == FRAGMENTS, F.flatten(F.collect_list("lacks"))).alias("lacks"))


def _linked(num: int, den: int) -> str:
    return f"{den} * o >= {num} * (nx + ny - o)"


def _bit():
    return F.pmod(F.xxhash64("rid"), F.lit(BITMAP_BITS)).alias("at")


def _bitmap(rids: DataFrame):
    at = F.col("at")
    got = (rids.select(_bit()).select(F.floor(at / 64).cast("long").alias("w"), F.pmod(at, F.lit(64)).cast("int").alias("bit"))
           .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("v")).toPandas())
    bits = np.zeros(BITMAP_BITS // 64 + 1, np.int64)
    bits[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    return rids.sparkSession.sparkContext.broadcast(bits)


def _band(g, num: int, den: int):
    return F.pmod(F.shiftrightunsigned(g, 32), F.lit(bands(num, den))).cast("int")


def _survivors(slim: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rid) of one row per class that may link with another class; (g, df) of
    the n-grams that several classes have."""
    alone = F.col("lo") == F.col("hi")
    grams = staged(
        slim.select("k1", F.explode("head").alias("g")).groupBy("g")
        .agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.count(F.lit(1)).alias("df"))
        .where(~alone | (_band(F.col("g"), num, den) == 0))
        .groupBy(F.when(~alone, F.col("g")).alias("g"), F.when(alone, F.col("lo")).alias("own"),
                 F.when(~alone, F.col("df")).alias("df"))
        .agg(F.count(F.lit(1)).alias("alone")), "ngram-counts")
    classes = slim.where("n > 0").groupBy("k1", "k2").agg(F.min("rid").alias("rid"), F.min("n").alias("n"))
    lonely = grams.where("own IS NOT NULL").select(F.col("own").alias("k1"), "alone")
    rids = classes.join(lonely, "k1", "left").where(
        f"coalesce(alone, 0) <= (n * {den - num}) div {den}").select("rid")
    return staged(rids, "ngram-survivors"), grams.where("g IS NOT NULL").select("g", "df")


def _judged_sets(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(rid, n, own, head) of the sets that some pair could still link; ``own``
    counts the n-grams that no other one of them has."""
    alone = (sets.select("rid", F.explode(F.flatten("parts")).alias("g")).groupBy("g")
             .agg(F.min("rid").alias("rid"), F.max("rid").alias("last")).where("rid = last")
             .groupBy("rid").agg(F.count(F.lit(1)).alias("own")))
    return (sets.select("rid", "n", "head").join(alone, "rid", "left")
            .withColumn("own", F.coalesce("own", F.lit(0))).where(f"own <= (n * {den - num}) div {den}"))


def _postings(sets: DataFrame, freq: DataFrame, num: int, den: int) -> DataFrame:
    """(g, rid, n, own, before) of the n-grams in each document's prefix that
    others have; before holds the last ``_BEFORE`` of them that precede g."""
    heads = sets.select("rid", "n", "own", F.explode("head").alias("g")).join(freq, "g", "left")
    ordered = heads.groupBy("rid", "n", "own").agg(F.sort_array(F.collect_list(F.struct(
        _band(F.col("g"), num, den).alias("band"), F.coalesce("df", F.lit(1)).alias("df"), "g"))).alias("o"))
    prefix = F.expr(f"slice(o, 1, cast((n * {den - num}) div {den} + 1 AS int))")
    shared = F.transform(F.filter(prefix, lambda o: o["df"] > 1), lambda o: o["g"])
    return (ordered.select("rid", "n", "own", shared.alias("gs")).select("*", F.posexplode("gs").alias("nth", "g"))
            .select("g", "rid", "n", "own", F.expr(f"slice(gs, greatest(nth - {_BEFORE - 1}, 1), least(nth, {_BEFORE}))").alias("before")))


def _possible(x: str, y: str, num: int, den: int) -> str:
    """Whether sizes and own n-grams let x and y link: they share at most what
    neither has alone."""
    most = f"least({x}.n - {x}.own, {y}.n - {y}.own)"
    return f"{den} * {most} >= {num} * ({x}.n + {y}.n - {most})"


def _alike(x: str, y: str, num: int, den: int) -> str:
    """Whether x and y, compared with the same centre, can link: they differ in
    what either has alone, and in each n-gram of the centre that one of them
    lacks and the other has."""
    apart = (f"({x}.own + {y}.own + size({x}.lacks) + size({y}.lacks) "
             f"- 2 * size(array_intersect({x}.lacks, {y}.lacks)))")
    return (f"(coalesce({x}.centre <> {y}.centre, true) "
            f"OR {den + num} * {apart} <= {den - num} * ({x}.n + {y}.n))")


def _open_pairs(open_: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of different components that share an n-gram.  Where both
    also share one of the preceding n-grams, the pair has been found at that one:
    the first n-gram that they share finds it in any case, the others seldom."""
    return open_.alias("x").join(open_.alias("y"), F.expr(
        f"x.g = y.g AND x.root < y.root AND {_possible('x', 'y', num, den)} AND {_alike('x', 'y', num, den)} "
        "AND NOT arrays_overlap(x.before, y.before)")).select(
        F.least("x.rid", "y.rid").alias("x"), F.greatest("x.rid", "y.rid").alias("y"))


def jaccard_join(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN,
                 id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and rid (``row_col``, or a
    number of its own for each row) and root (the rid that stands for its
    component)."""
    if row_col is None:
        docs, row_col = numbered(docs.select(id_col, text_col), "__row"), "__row"
    rows = docs.select(F.col(row_col).alias("rid"),
                       F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    slim = staged(map_arrow(rows, _reader(words, num, den),
                            "rid long, doc_id long, n long, k1 long, k2 long, head array<long>"), "ngram-rows")
    rids, freq = _survivors(slim, num, den)
    sets = staged(map_arrow(rows.select("rid", _bit(), "text"), _reader(words, num, den, _bitmap(rids)),
                            "rid long, n long, head array<long>, parts array<array<long>>"), "ngram-sets")
    judged = staged(_judged_sets(sets, num, den), "ngram-judged")
    postings = staged(_postings(judged, freq, num, den), "ngram-postings")

    # first round: each document of an n-gram and length class with its likely original
    length = F.floor(F.log("n") / math.log(den / num)) if num < den else F.col("n")
    near = postings.select("g", "rid", "n", "own", length.alias("size"))
    middle = near.groupBy("g", "size").agg(F.min(F.struct("own", "rid", "n")).alias("m"), F.count(F.lit(1)).alias("k"))
    middle = middle.where("k > 1").select("g", "size", "m.*").alias("x")
    first = staged(near.alias("y").join(middle, ["g", "size"])
                   .where(f"x.rid <> y.rid AND {_possible('x', 'y', num, den)}")
                   .select(F.col("x.rid").alias("x"), F.col("y.rid").alias("y")).distinct(), "ngram-pairs")
    compared = staged(_compared(first, sets), "ngram-compared")
    links = compared.where(_linked(num, den)).select("x", "y")
    found = staged(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "ngram-components")
    centres = compared.where("lacks IS NOT NULL").groupBy("y").agg(
        F.max(F.struct("o", "x", "lacks")).alias("c")).select(
        F.col("y").alias("of"), F.col("c.x").alias("centre"), F.col("c.lacks").alias("lacks"))

    # second round: documents of an n-gram that lie in different components
    placed = (postings.join(found, postings.rid == found.node, "left").drop("node")
              .withColumn("root", F.coalesce("root", "rid")))
    mixed = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("g")
    open_ = placed.join(mixed, "g")
    open_ = staged(open_.join(centres, open_.rid == centres.of, "left").drop("of"), "ngram-open")
    second = _open_pairs(open_, num, den).distinct()
    tested = first.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    second = staged(second.join(tested, ["x", "y"], "left_anti"), "ngram-pairs")
    more = _compared(second, sets).where(_linked(num, den)).select("x", "y")
    found = staged(components(links.unionByName(more).select(F.col("x").alias("a"), F.col("y").alias("b"))),
                   "ngram-components")

    # classes, with the component of the row that stands for each
    classes = (slim.where("n > 0").groupBy("k1", "k2")
               .agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least_id")))
    rooted = (classes.join(found, classes.rep == found.node, "left")
              .withColumn("root", F.coalesce("root", "rep")))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("k1", "k2", "root").join(ids, "root")
    own = F.col("n") == 0
    return (slim.select("rid", "doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    "rid", F.when(own, F.col("rid")).otherwise(F.col("root")).alias("root")))


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents")).drop("rid", "root")
