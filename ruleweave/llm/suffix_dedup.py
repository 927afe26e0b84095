"""Removal of repeated byte strings by sharded suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else (in any document, this one included) is removed.

1. Each window of ``LENGTH`` bytes selects one *anchor*: the place of the least
   hash among the ``GRAM``-byte strings in it, leftmost of equals.  The choice
   depends on the window's bytes alone, so equal windows select equal anchors.
   A document's windows fall into runs that share an anchor; a run's bytes are
   its *context*.  Anchors whose gram is nowhere else are done with.
2. Equal contexts are counted with map-side combine.  A context found twice is
   covered as a whole; one copy of each goes on for the sake of others.
3. The remaining contexts are dealt to shards by their anchor's hash, so equal
   windows meet in one shard.  A shard's text is the contexts, overlapping ones
   of a document joined, with separators; its suffix array (induced sorting)
   and permuted common prefixes give every window that starts twice.  Shards
   hold about ``SHARD_BYTES``, whatever the size of the input.
4. An anchor with more than ``GROUP_CONTEXTS`` different contexts (a passage
   that very many documents quote) would be one shard by itself.  Its windows
   are counted by 128-bit digests instead, with map-side combine: exact as
   well, and free of groups.
5. The intervals of a document are united, and its bytes cut.

Only documents that need it are read again with their text; a bitmap of fixed
size picks them out, and a false hit does no harm.  The table must be a scan
(or otherwise read the same way twice).

Edge cases: a null text is empty; texts shorter than ``LENGTH`` stay whole;
repeated rows remove each other when long enough; a null doc_id is passed on;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, map_arrow, numbered, ship_package, staged, table
from .ngram_join import _bit, _bitmap
from .suffix_array import permuted_lcp, suffix_array

LENGTH, GRAM = 400, 160
SHARD_BYTES = 3 << 20
GROUP_CONTEXTS = 2_000
_SLICE_BYTES = 4 << 20
_PIECE = 1 << 23        # windows handled at once; places fit in 24 bits
_SEPARATOR = 255        # no byte of UTF-8, nor is any byte after adding 1
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash's base and of its inverse (mod 2**64)."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each string of ``gram`` bytes, by sums over powers."""
    n = len(data) - gram + 1
    up, down = _power_tables(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODES[data] * up[:len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, end of windows) of each run of windows that share
    an anchor."""
    out = [], [], []
    for base in range(0, max(0, len(data) - length + 1), _PIECE):
        piece = data[base:base + _PIECE + length - 1]
        h = gram_hashes(piece, gram)
        width = length - gram + 1
        windows = len(h) - width + 1
        # hash in the high bits, place in the low ones: the least is the leftmost of the least
        keyed = h & np.uint64(_MASK ^ 0xFFFFFF) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(keyed) // width) * width, _MASK, np.uint64)
        padded[:len(keyed)] = keyed
        blocks = padded.reshape(-1, width)
        before = np.minimum.accumulate(blocks, 1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        place = np.minimum(after[:windows], before[width - 1:width - 1 + windows]) & np.uint64(0xFFFFFF)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        out[0].append(h[place[first].astype(np.int64)])
        out[1].append(base + first)
        out[2].append(base + np.append(first[1:], windows))
    if not out[0]:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(map(np.concatenate, out))


def _bytes_of(b: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [x or b"" for x in b.column(column).to_pylist()]


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text", _SLICE_BYTES):
                cols: list[list] = [[], [], [], [], []]
                for rid, text in zip(b.column("rid").to_pylist(), _bytes_of(b), strict=True):
                    if len(text) < length:
                        continue
                    key, first, end = anchors(np.frombuffer(text, np.uint8), length, gram)
                    size = end - first + length - 1
                    contexts = [xxhash.xxh3_64_intdigest(text[a:a + n])
                                for a, n in zip(first.tolist(), size.tolist(), strict=True)]
                    for col, x in zip(cols, (np.full(len(key), rid), key.view(np.int64),
                                             np.array(contexts, np.uint64).view(np.int64), first, size), strict=True):
                        col.append(x.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in cols],
                    names=["rid", "key", "context", "first", "size"])
    return run


def _context_rows(length: int):
    """Bytes of the contexts a document gives to shards; of contexts that are
    judged by windows (shard -1), a digest for each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text", _SLICE_BYTES):
                shard, rid, first, body, d1, d2 = [], [], [], [], [], []
                for r, text, wanted in zip(b.column("rid").to_pylist(), _bytes_of(b),
                                           b.column("wanted").to_pylist(), strict=True):
                    for w in wanted:
                        a, n = w["first"], w["size"]
                        if w["shard"] >= 0:
                            got = [(text[a:a + n], None, None)]
                        else:
                            digests = [xxhash.xxh3_128_intdigest(text[i:i + length])
                                       for i in range(a, a + n - length + 1)]
                            got = [(None, (x >> 64) - (1 << 63), (x & _MASK) - (1 << 63)) for x in digests]
                        for i, (x, y, z) in enumerate(got):
                            shard.append(w["shard"])
                            rid.append(r)
                            first.append(a + i)
                            body.append(x)
                            d1.append(y)
                            d2.append(z)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), pa.array(rid, pa.int64()), pa.array(first, pa.int64()),
                     pa.array(body, pa.binary()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())],
                    names=["shard", "rid", "first", "body", "d1", "d2"])
    return run


def repeated_spans(pieces: list[tuple[int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(rid, first, end) of what is covered by strings of ``length`` bytes that
    start twice in ``pieces`` (rid, first, bytes) of documents."""
    joined: list[list] = []   # rid, first, end, parts
    for rid, first, body in sorted(pieces, key=lambda x: (x[0], x[1])):
        if joined and joined[-1][0] == rid and first <= joined[-1][2]:
            more = body[joined[-1][2] - first:]
            if more:
                joined[-1][3].append(more)
                joined[-1][2] += len(more)
        else:
            joined.append([rid, first, first + len(body), [body]])
    text = np.concatenate([x for j in joined for x in (
        np.frombuffer(b"".join(j[3]), np.uint8) + np.uint8(1), np.array([_SEPARATOR], np.uint8))])
    size = np.array([j[2] - j[1] for j in joined])
    start = np.cumsum(size + 1) - size - 1
    plcp, phi = permuted_lcp(text, suffix_array(text))
    region = np.repeat(np.arange(len(joined)), size + 1)
    fits = np.arange(len(text)) + length <= (start + size)[region]
    twice = np.flatnonzero((plcp >= length) & fits)
    hit = np.zeros(len(text), bool)
    hit[twice] = hit[phi[twice]] = True
    at = np.flatnonzero(hit)
    out = []
    for r, a in zip(region[at].tolist(), at.tolist(), strict=True):
        first = joined[r][1] + a - int(start[r])
        if out and out[-1][0] == joined[r][0] and first <= out[-1][2]:
            out[-1][2] = first + length
        else:
            out.append([joined[r][0], first, first + length])
    return [tuple(x) for x in out]


def _shard_spans(length: int):
    def run(t: pa.Table) -> pa.Table:
        rows = zip(t.column("rid").to_pylist(), t.column("first").to_pylist(), t.column("body").to_pylist(), strict=True)
        spans = repeated_spans(list(rows), length)
        return pa.table([pa.array([s[k] for s in spans], pa.int64()) for k in range(3)], names=["rid", "first", "end"])
    return run


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, neighbours that touch joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _whole_rows(wanted):
    """The result of documents without spans; the text of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text", _SLICE_BYTES):
                at = b.column("at").to_numpy()
                hit = ((wanted.value[at >> 6] >> (at & 63)) & 1 == 1).tolist()
                texts = _bytes_of(b)
                zeros = pa.array([0] * len(texts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("rid"), b.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), zeros, zeros,
                     pa.array([None if h else hashlib.sha256(x).hexdigest() for x, h in zip(texts, hit, strict=True)],
                              pa.string()),
                     pa.array([x if h else None for x, h in zip(texts, hit, strict=True)], pa.binary())],
                    names=["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])
    return run


def kept_parts(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    starts = [*(a for a, _ in spans), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = _bytes_of(b)
        spans = [union([(s["first"], s["end"]) for s in x or []]) for x in b.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_bytes"),
             pa.array([sum(e - a for a, e in s) for s in spans], pa.int64()),
             pa.array([len(s) for s in spans], pa.int64()),
             pa.array([hashlib.sha256(kept_parts(x, s)).hexdigest() for x, s in zip(texts, spans, strict=True)],
                      pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_intervals(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                       group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """(rid, first, end) of covered bytes, overlapping, of ``rows`` (rid, text
    as binary)."""
    found = staged(map_arrow(rows.select("rid", "text"), _anchor_rows(length, gram),
                             "rid long, key long, context long, first long, size long"), "suffix-anchors")
    # written first: the join then has exchanges of its own, which AQE can split for a hot anchor
    often = staged(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"),
                   "suffix-often")
    shared = staged(found.join(often, "key"), "suffix-shared")

    contexts = staged(shared.groupBy("key", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first", "size")).alias("one")), "suffix-contexts")
    copied = contexts.where("n > 1").select("key", "context")
    whole = shared.join(copied, ["key", "context"]).select("rid", "first", (F.col("first") + F.col("size")).alias("end"))

    several = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    judged = contexts.join(several, "key").select("key", "kinds", "one.*")
    total = judged.where(F.col("kinds") <= group_contexts).agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    place = F.when(F.col("kinds") <= group_contexts, F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(-1)
    wanted = staged(judged.withColumn("shard", place.cast("int")).groupBy("rid").agg(
        F.collect_list(F.struct("first", "size", "shard")).alias("wanted")), "suffix-wanted")
    hit = _bitmap(wanted)

    def some(batches):
        for b in batches:
            at = b.column("at").to_numpy()
            yield b.filter(pa.array((hit.value[at >> 6] >> (at & 63)) & 1 == 1)).select(["rid", "text"])
    texts = map_arrow(rows.select("rid", _bit(), "text"), some, "rid long, text binary")
    bodies = staged(map_arrow(texts.join(wanted, "rid"), _context_rows(length),
                              "shard int, rid long, first long, body binary, d1 long, d2 long"), "suffix-bodies")
    ship_package(rows.sparkSession)
    by_array = (bodies.where("shard >= 0").select("shard", "rid", "first", "body").groupBy("shard")
                .applyInArrow(_shard_spans(length), "rid long, first long, end long"))
    windows = bodies.where("shard < 0").select("rid", "first", "d1", "d2")
    twice = windows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2")
    by_window = windows.join(twice, ["d1", "d2"]).select("rid", "first", (F.col("first") + length).alias("end"))
    return whole.unionByName(by_array).unionByName(by_window)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                   group_contexts: int = GROUP_CONTEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = numbered(docs.select(id_col, text_col), "__row")
    rows = rows.select(F.col("__row").alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").cast("binary").alias("text"))
    spans = repeated_intervals(rows, length, gram, shard_bytes, group_contexts)
    spans = staged(spans.groupBy("rid").agg(F.collect_list(F.struct("first", "end")).alias("spans")), "suffix-spans")
    judged = staged(map_arrow(rows.select("rid", "doc_id", _bit(), "text"), _whole_rows(_bitmap(spans)),
                              "rid long, " + _RESULT + ", text binary"), "suffix-judged")
    cut = map_arrow(judged.where("text IS NOT NULL").join(spans, "rid", "left")
                    .select("doc_id", "n_bytes", "text", "spans"), _cut_rows, _RESULT)
    return judged.where("text IS NULL").drop("rid", "text").unionByName(cut)


def op3_suffix_array_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
