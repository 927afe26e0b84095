"""Token counts with overlap resynchronisation.

A huge document is cut into chunks that overlap; each is encoded with offsets,
and neighbours are spliced at a boundary that is *proven stable*: a white-space
character after a character that isn't white space.  The tokenizer's pattern
never matches a piece that goes on from a non-space into a space, and has no
look-behind, so every encoding of a text that holds both characters starts a
piece there, and what follows doesn't depend on what came before.  (Its special
strings hold no white space, so none lies across such a place.)  The place must
also be a token start in both encodings; where the overlap holds no such place,
it is widened four-fold, up to the whole text if need be.

An ordinary document is cut at all such boundaries into *units*.  The different
units of a batch are encoded once each, in runs whose units meet at such
boundaries again, so a token's start tells its unit.
A vocabulary file whose definition doesn't prove the boundaries (another
pattern, a normalizer, special strings with white space) has its ordinary
documents encoded whole.

Edge cases: a null or empty text has 0 bytes and 0 tokens; an empty table gives
an empty result; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, map_arrow, table

VOCABULARY = "byte_bpe_50k.json"
CHUNK_CHARS = 16_384   # documents longer than this are chunked
OVERLAP_CHARS = 512    # first overlap of two chunks
TOKEN_LIMIT = 1024
_CALL_BYTES = 1 << 20  # text encoded in one call: bounds the encodings held
_SLICE_BYTES = 8 << 20 # text whose units are told apart at once
_RUN_CHARS = 512       # units encoded as one text
_KNOWN_UNITS, _KNOWN_CHARS = 1 << 18, 32   # units whose counts a task remembers, and their length

_SPACES = [c.encode() for c in map(chr, range(1 << 16)) if not 0xD800 <= ord(c) < 0xE000 and c.isspace()]
_SPACE_CODES = [np.array([int.from_bytes(c) for c in _SPACES if len(c) == n]) for n in (1, 2, 3)]

_tokenizers: dict = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def stable_boundary(text: str, lo: int, hi: int) -> Iterator[int]:
    """Places b in (lo, hi) with white space at b after a non-space, nearest to
    the middle first."""
    mid = (lo + hi) // 2
    for d in range(hi - lo):
        for b in {mid + d, mid - d}:
            if lo < b < hi and text[b] in " \n" and not text[b - 1].isspace():
                yield b


def has_stable_boundaries(tok) -> bool:
    """Whether the definition of ``tok`` is one that the boundaries are proven for."""
    spec = json.loads(tok.to_str())
    pattern, model = spec["pre_tokenizer"] or {}, spec["model"]
    return (spec["normalizer"] is None and spec["truncation"] is None and spec["padding"] is None
            and pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern["add_prefix_space"]
            and model["type"] == "BPE" and not model["dropout"]
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(map(str.isspace, x["content"]))
                        for x in spec["added_tokens"]))


def unit_starts(data: np.ndarray) -> np.ndarray:
    """All stable boundaries of UTF-8 ``data``."""
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[at > 0]
    last = data[at - 1].astype(np.int64)
    inside = ~np.isin(last, _SPACE_CODES[0])
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):
        two = last[wide] | data[at[wide] - 2].astype(np.int64) << 8
        three = two | data[at[wide] - 3].astype(np.int64) << 16
        inside[wide] = ~(np.isin(two, _SPACE_CODES[1]) | np.isin(three, _SPACE_CODES[2]))
    return at[inside]


def encode_units(tok, units: list[str]) -> Iterator[int]:
    """Tokens of each of ``units`` (none empty), several encoded as one text
    where a stable boundary lies between them."""
    calls, run_chars, call_chars = [], 0, 0   # each call's runs of units
    for u in units:
        if calls and run_chars < _RUN_CHARS and u[0] in " \n" and not calls[-1][-1][-1][-1].isspace():
            calls[-1][-1].append(u)
            run_chars += len(u)
        else:
            if not calls or call_chars >= _CALL_BYTES:
                calls.append([])
                call_chars = 0
            calls[-1].append([u])
            run_chars = len(u)
        call_chars += len(u)
    for runs in calls:
        for run, e in zip(runs, tok.encode_batch(["".join(r) for r in runs], add_special_tokens=False), strict=True):
            ends = np.cumsum([len(u) for u in run])
            before = np.searchsorted([a for a, _ in e.offsets], ends)
            yield from np.diff(before, prepend=0).tolist()


def count_units(tok, texts: pa.StringArray, known: dict[str, int]) -> np.ndarray:
    """Tokens of each of ``texts`` (no nulls), summed over its units; ``known``
    holds counts of units met before."""
    if not pc.any(pc.greater(pc.binary_length(texts), 0)).as_py():
        return np.zeros(len(texts), np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    cut = np.zeros(bounds[-1] - bounds[0] + 1, bool)
    cut[bounds - bounds[0]] = True
    cut[unit_starts(np.frombuffer(body, np.uint8)[bounds[0]:bounds[-1]])] = True
    cuts = (bounds[0] + np.flatnonzero(cut)).astype(np.int32)
    units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), body).dictionary_encode()
    kinds = units.dictionary.to_pylist()
    new = [u for u in kinds if u not in known]
    fresh = dict(zip(new, encode_units(tok, new), strict=True))
    counts = np.array([fresh[u] if u in fresh else known[u] for u in kinds], np.int64)
    for u, n in fresh.items():
        if len(known) >= _KNOWN_UNITS:
            break
        if len(u) <= _KNOWN_CHARS:
            known[u] = n
    sums = np.concatenate([[0], np.cumsum(counts[units.indices.to_numpy()])])
    return np.diff(sums[np.searchsorted(cuts, bounds)])


def _starts(tok, text: str, lo: int, hi: int) -> list[int]:
    return [lo + a for a, _ in tok.encode(text[lo:hi], add_special_tokens=False).offsets]


def count_chunked(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``, encoded by overlapping chunks of ``chunk`` chars."""
    n, total = len(text), 0
    lo, hi = 0, min(n, chunk)          # the chunk being kept
    left, begin = _starts(tok, text, lo, hi), 0   # its token starts; first char still to count
    while hi < n:
        width, cut = overlap, None
        while cut is None:
            at = max(begin, hi - width)
            end = min(n, at + max(chunk, 2 * width))
            right = _starts(tok, text, at, end)
            known_left, known_right = set(left), set(right)
            cut = next((b for b in stable_boundary(text, at, hi)
                        if b in known_left and b in known_right), None)
            if cut is None:
                if at == begin:        # the overlap is all that is left: take it as one chunk
                    lo, hi, left = begin, end, right
                    break
                width *= 4             # alignment failed: widen
        if cut is not None:
            total += sum(begin <= s < cut for s in left)
            lo, hi, left, begin = at, end, right, cut
    return total + sum(s >= begin for s in left)


def _counter(path: str, chunk: int, overlap: int):
    def run(batches):
        tok = _tokenizer(path)
        by_units, known = has_stable_boundaries(tok), {}
        for whole in batches:
            for b in byte_slices(whole, "text", _SLICE_BYTES if by_units else _CALL_BYTES):
                texts = pc.fill_null(b.column("text").cast(pa.string()), "")
                huge = pc.greater(pc.utf8_length(texts), chunk).to_numpy(zero_copy_only=False)
                short = texts.filter(pa.array(~huge))
                n = np.zeros(len(texts), np.int64)
                n[~huge] = count_units(tok, short, known) if by_units else [
                    len(e) for e in tok.encode_batch_fast(short.to_pylist(), add_special_tokens=False)]
                n[huge] = [count_chunked(tok, x, chunk, overlap) for x in texts.filter(pa.array(huge)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n)],
                    names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id",
                 text_col: str = "text", chunk: int = CHUNK_CHARS,
                 overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, by the vocabulary
    file at ``path`` (it must be at that place on every machine)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    counted = map_arrow(rows, _counter(path, chunk, overlap),
                        "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
