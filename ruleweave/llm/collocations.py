"""Phrase collocations by top-order marginalisation.

Only windows of the highest order (``ORDER`` words) are counted: beside each
word stand the words that lead it, as columns, padded with 0 where its piece
ends.  ``ROLLUP`` over the columns then sums ever shorter prefixes, and these
sums are the counts of all shorter phrases; no shorter n-gram is exploded.

1. Words are counted per language.  A word's key is a 64-bit hash of language and
   word; no two words of the corpus share a key (checked, else another seed is
   taken), so counting keys is exact.
2. All parts of a phrase that occurs ``LEAST`` times do so, too.  So windows are
   cut where they can't hold such a phrase: pairs of frequent words, and triples
   of frequent pairs, are first counted by a hash (what shares one only raises the
   count), and a window ends before a word, pair or triple that isn't frequent.
   These are looked up in bitmaps of a fixed size (``BITMAP_BITS``): a false hit
   leaves a window longer than needed and changes no count.
3. Each task counts the windows of a slice of texts before they are shuffled, so
   a very common word or passage leaves it as a few rows.
4. A phrase's cuts meet the counts of their parts by joins; the lowest score
   counts.  A phrase that lies in a longer one which is nearly as frequent is
   dropped.  The best ``TOP`` of each language stay.

The four passes over the texts (words, pairs, triples, windows) keep nothing between
slices, and memory per task follows the slice (``SLICE_BYTES``, or one text).

Edge cases: a null or empty text has no word; a null language is ``und``; equal
rows count each; equal scores are ordered by count, then phrase (bytes); a text
of separators alone has no piece with a word; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, claim, map_arrow, staged, table

ORDER = 4
LEAST, TOP = 30, 2000
NEARLY = 80            # percent of a phrase's count that a longer phrase needs to replace it
BITMAP_BITS = 67_108_859   # a prime near 2**26: 8 MB at any input size
SEEDS = 4              # tries for keys without a collision
SLICE_BYTES = 8 << 20
_OUT_ROWS = 1 << 16
_FULL = (1 << 64) - 1
# The bytes that part words, and those that part pieces.
_SPACES, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_SPACES)] = 1
_KIND[list(_BREAKS)] = 2


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, A-Z lower-cased, with the number of each one's
    text and whether it is the first of its piece."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    ends = np.frombuffer(low.buffers()[1], np.int32)[low.offset:low.offset + len(low) + 1]
    raw = (np.frombuffer(low.buffers()[2], np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8))
    ends = ends - ends[0]
    kind = _KIND[raw]
    word = kind == 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    stop = np.flatnonzero(word & (~after | edge[1:])) + 1
    text = np.searchsorted(ends, start, side="right") - 1
    breaks = np.cumsum(kind == 2, dtype=np.int32)[start] if len(start) else np.empty(0, np.int32)
    first = np.ones(len(start), bool)
    first[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
    offsets = np.append(0, np.cumsum(stop - start)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[word].tobytes()))
    return words, text, first


class _Slice:
    """The words of a slice: ``code`` numbers its (language, word) pairs, whose
    keys are ``keys``."""

    def __init__(self, batch: pa.RecordBatch, seed: int, mask: int):
        words, text, self.first = tokens(batch.column("text"))
        encoded = words.dictionary_encode()
        langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        both = langs.indices.to_numpy().astype(np.int64)[text] * len(encoded.dictionary) + encoded.indices.to_numpy()
        self.code, pairs = pd.factorize(both)
        self.words = encoded.dictionary.take(pa.array(pairs % max(1, len(encoded.dictionary))))
        self.langs = langs.dictionary.take(pa.array(pairs // max(1, len(encoded.dictionary))))
        seeds = {x: xxhash.xxh3_64_intdigest(x.encode(), seed) for x in langs.dictionary.to_pylist()}
        keys = (xxhash.xxh3_64_intdigest(w.encode(), seeds[x]) & mask or 1
                for w, x in zip(self.words.to_pylist(), self.langs.to_pylist(), strict=True))
        self.keys = np.fromiter(keys, np.uint64, len(pairs))

    def pairs(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word, the number of the pair that it makes with the next one
        of its piece, -1 if one of them isn't frequent; the codes of the pairs'
        words; the pairs' keys."""
        known = _in(frequent, self.keys)[self.code]
        at = np.flatnonzero(known[:-1] & known[1:] & ~self.first[1:])
        which, both = pd.factorize(self.code[at].astype(np.int64) << 32 | self.code[at + 1])
        left, right = both >> 32, both & 0xFFFFFFFF
        pair = np.full(len(self.code) + ORDER, -1, np.int64)
        pair[at] = which
        return pair, left, right, _joined(self.keys[left], self.keys[right])

    def frequent_pairs(self, frequent: np.ndarray, paired: np.ndarray) -> tuple:
        """As ``pairs``, -1 also where the pair isn't frequent."""
        pair, left, right, keys = self.pairs(frequent)
        good = np.append(_in(paired, keys), False)   # pair -1: the last one
        return np.where(good[pair], pair, -1), left, right, keys

    def triples(self, pair: np.ndarray, right: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, the number of the triple that it makes with the next
        two, -1 if they don't hold two frequent pairs; the triples' keys."""
        at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
        which, both = pd.factorize(pair[at] << 32 | pair[at + 1])
        triple = np.full(len(pair), -1, np.int64)
        triple[at] = which
        return triple, _joined(keys[both >> 32], self.keys[right[both & 0xFFFFFFFF]])


def _joined(keys: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Keys of phrases and a word that follows each."""
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ after) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ mixed >> np.uint64(32)


def _in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = ((keys >> np.uint64(1)) % np.uint64(BITMAP_BITS)).astype(np.int64)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def _bitmap(keys: DataFrame):
    """The keys as a broadcast bitmap; the driver gets 2**20 words at most."""
    at = F.pmod(F.shiftrightunsigned("key", 1), F.lit(BITMAP_BITS))
    got = (keys.select(at.alias("at")).selectExpr("at div 64 AS w", "cast(at % 64 AS int) AS bit")
           .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("v")).toPandas())
    bits = np.zeros(BITMAP_BITS // 64 + 1, np.int64)
    bits[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _counted_words(s: _Slice) -> dict:
    return {"lang": s.langs, "word": s.words, "key": _long(s.keys), "c": _long(np.bincount(s.code, minlength=len(s.keys)))}


def _counted_pairs(s: _Slice, frequent: np.ndarray) -> dict:
    pair, _, _, keys = s.pairs(frequent)
    return {"key": _long(keys), "c": _long(np.bincount(pair[pair >= 0], minlength=len(keys)))}


def _counted_triples(s: _Slice, frequent: np.ndarray, paired: np.ndarray) -> dict:
    pair, _, right, keys = s.frequent_pairs(frequent, paired)
    triple, keys = s.triples(pair, right, keys)
    return {"key": _long(keys), "c": _long(np.bincount(triple[triple >= 0], minlength=len(keys)))}


def _counted_windows(s: _Slice, frequent: np.ndarray, paired: np.ndarray, tripled: np.ndarray) -> dict:
    """Windows w1 to w4 and how often they occur in the slice."""
    pair, left, right, keys = s.frequent_pairs(frequent, paired)
    triple, keys = s.triples(pair, right, keys)
    good = np.append(_in(tripled, keys), False)[triple]   # three words or more from here
    own = pair[:len(s.code)]
    alone = np.flatnonzero(own < 0)
    alone = alone[_in(frequent, s.keys)[s.code[alone]]]
    single = np.bincount(s.code[alone], minlength=len(s.keys))
    lone = np.flatnonzero(single)

    # the second half of a window: nothing, one word, or a pair
    whole = np.flatnonzero(own >= 0)
    n_codes, n_pairs = len(s.keys), len(left)
    word = s.code[np.minimum(whole + 2, len(s.code) - 1)]
    half = np.where(~good[whole], 0, np.where(~good[whole + 1], 1 + word, 1 + n_codes + pair[whole + 2]))
    kinds = 1 + n_codes + n_pairs
    which, seen = pd.factorize(own[whole] * kinds + half)
    head, half = seen // kinds, seen % kinds
    keys = np.append(s.keys, np.uint64(0))   # the last one pads
    left, right = np.append(left, n_codes).astype(np.int64), np.append(right, n_codes).astype(np.int64)
    is_pair = half > n_codes
    tail = np.where(is_pair, half - 1 - n_codes, n_pairs)
    w3 = np.where(is_pair, left[tail], np.where(half > 0, half - 1, n_codes))
    columns = [left[head], right[head], w3, right[tail]]
    pad = np.full(len(lone), n_codes, np.int64)
    out = {f"w{k + 1}": _long(keys[np.concatenate([lone if k == 0 else pad, c])]) for k, c in enumerate(columns)}
    return out | {"c": _long(np.concatenate([single[lone], np.bincount(which, minlength=len(seen))]))}


def _pass(docs: DataFrame, count, schema: str, seed: int, mask: int, *bitmaps) -> DataFrame:
    """``count`` over every slice of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("collocations", lambda: None)
        for whole in batches:
            for b in byte_slices(whole, "text", SLICE_BYTES):
                out = pa.RecordBatch.from_pydict(count(_Slice(b, seed, mask), *(x.value for x in bitmaps)))
                for k in range(0, out.num_rows, _OUT_ROWS):
                    yield out.slice(k, _OUT_ROWS)
    return map_arrow(docs, run, schema)


def vocabulary(docs: DataFrame, masks: tuple = (_FULL,) * SEEDS) -> tuple[DataFrame, int, int]:
    """(lang, word, key, f) of every word, and the seed and mask of the keys."""
    for seed, mask in enumerate(masks):
        words = staged(
            _pass(docs, _counted_words, "lang string, word string, key long, c long", seed, mask)
            .groupBy("lang", "word", "key").agg(F.sum("c").alias("f")), "vocabulary")
        if words.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
            return words, seed, mask
    raise RuntimeError(f"no keys without a collision in {len(masks)} tries")


def phrase_counts(docs: DataFrame, words: DataFrame, seed: int, mask: int, least: int = LEAST) -> DataFrame:
    """(p, k, f): the keys of the words of every phrase of 1 to ``ORDER`` words
    that occurs ``least`` times or more, its length and its count."""
    frequent = _bitmap(words.where(F.col("f") >= least).select("key"))
    often = lambda keys: _bitmap(keys.groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("key"))
    paired = often(_pass(docs, _counted_pairs, "key long, c long", seed, mask, frequent))
    tripled = often(_pass(docs, _counted_triples, "key long, c long", seed, mask, frequent, paired))
    columns = [f"w{k + 1}" for k in range(ORDER)]
    schema = ", ".join(f"{c} long" for c in (*columns, "c"))
    windows = (_pass(docs, _counted_windows, schema, seed, mask, frequent, paired, tripled)
               .groupBy(*columns).agg(F.sum("c").alias("c")))
    sums = windows.rollup(*columns).agg(F.sum("c").alias("f"))
    # of a padded window, the shorter prefix has been summed
    last = F.coalesce(*reversed(columns))
    p = F.array_compact(F.array(*columns))
    return staged(sums.where((last != 0) & (F.col("f") >= least)).select(
        p.alias("p"), F.size(p).alias("k"), "f"), "phrase-counts")


def scored(phrases: DataFrame) -> DataFrame:
    """(p, a, l, r, score) of the phrases of two words or more, by the cut of the
    lowest score."""
    one = F.col("k") - F.col("cut")
    cuts = phrases.where("k > 1").select("p", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("p", "a", "cut", F.slice("p", F.lit(1), F.col("cut")).alias("left"),
                       F.slice("p", F.col("cut") + 1, one).alias("right"))
    parts = phrases.select(F.col("p").alias("part"), F.col("f"))
    met = (cuts.join(parts.withColumnsRenamed({"part": "left", "f": "l"}), "left")
           .join(parts.withColumnsRenamed({"part": "right", "f": "r"}), "right"))
    score = F.expr("cast(a AS decimal(20, 0)) * 2000000 div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    return (met.withColumn("score", score.cast("long")).groupBy("p", "a")
            .agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))
            .select("p", "a", "least.l", "least.r", "least.score"))


def _within_longer(phrases: DataFrame) -> DataFrame:
    """(p, most): the largest count of a longer phrase that holds p."""
    inner = F.expr("flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), s -> slice(p, s, n))))")
    return (phrases.where("k > 2").select(F.explode(inner).alias("p"), "f")
            .groupBy("p").agg(F.max("f").alias("most")))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, nearly: int = NEARLY,
                 text_col: str = "text", lang_col: str = "lang", masks: tuple = (_FULL,) * SEEDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases per language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    words, seed, mask = vocabulary(rows, masks)
    phrases = phrase_counts(rows, words, seed, mask, least)
    kept = (scored(phrases).join(_within_longer(phrases), "p", "left")
            .where(f"most IS NULL OR 100 * cast(most AS decimal(20, 0)) < {nearly} * cast(a AS decimal(20, 0))"))
    kept = staged(kept.drop("most"), "phrases-kept")
    spelled = (kept.select("p", F.posexplode("p").alias("at", "key"))
               .join(words.where(F.col("f") >= least).select("key", "lang", "word"), "key").groupBy("p", "lang")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
                    .alias("phrase")))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = (kept.join(spelled, "p").withColumn("rank", F.row_number().over(order).cast("long"))
            .where(F.col("rank") <= top))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
f AS (
  SELECT lang, phrase, k, count(*) AS f
  FROM (SELECT lang, k, array_to_string(w[i + 1:i + k], ' ') AS phrase
        FROM (SELECT lang, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS i
              FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k)))
  GROUP BY lang, phrase, k HAVING count(*) >= 30),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r,
         CAST(c.a AS HUGEINT) * 2000000 // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:c.k], ' ')),
least_cut AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM cuts) WHERE nth = 1),
inner_ AS (
  SELECT lang, array_to_string(w[s + 1:s + m], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(k - m + 1)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM cand WHERE k > 2))
  GROUP BY ALL),
kept AS (
  SELECT c.* FROM least_cut c LEFT JOIN inner_ i USING (lang, phrase)
  WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(c.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
