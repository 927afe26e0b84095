"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

Merges are processed from an agenda: the candidate with the best score first,
the leftmost of equals.  A candidate is skipped when the keyed hash of (seed,
doc_id, position of its unit, its place) falls below the dropout rate; a skipped
candidate doesn't come back unless a neighbour merges.  Agendas of many units are
worked off side by side: one row per unit, and in each step every unit's best
candidate.  A *unit* is a run of
spaces and what follows them up to the next space or line end; no piece of the
vocabulary crosses units, so a text is the sequence of its units.  Every
occurrence of a unit drops candidates for itself: the same document is always
encoded alike, and the same word varies within and between documents.

Workers remember what agendas do, not what occurrences draw: a *path* is a unit
with the candidates dropped so far, and holds the places that come up from there
when nothing else is dropped.  An occurrence hashes those places with its own
key; the first one dropped leads to the next path.  Long units, and occurrences
that drop more than ``_DEPTH`` candidates, run an agenda of their own, with the
same result.

Decoding is lossless: characters outside the vocabulary, line ends, and a
literal U+2581 (the vocabulary's mark for a space) are encoded as byte pieces.

Edge cases: a null text counts as empty; an empty text has no ids and decodes
to the empty text; a null doc_id is a key of its own; repeated rows are encoded
alike; an empty table gives an empty result; other columns are ignored (the
stage form passes on those asked for).
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, claim, map_arrow, table

VOCABULARY = "piece_bpe_32k.model"
RATE, SEED = 0.1, 17
CACHE_PLACES = 8_000_000   # places of all paths that a worker remembers
_CACHED_CHARS = 20         # longer units aren't remembered
_DEPTH = 2
_SLICE_BYTES = 4 << 20
_CELLS = 1 << 16        # symbols whose agendas are worked off side by side
_NEVER = np.int32(2 ** 31 - 1)
_MASK = (1 << 64) - 1
_MIX = tuple(np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

_codecs: dict = {}


class _Rows:
    """A growing array, appended to in blocks."""

    def __init__(self, dtype):
        self.all, self.n = np.empty(1 << 12, dtype), 0

    def add(self, block: np.ndarray) -> None:
        n = self.n + len(block)
        if n > len(self.all):
            self.all = np.concatenate([self.all[:self.n], np.empty(max(n, 3 * self.n // 2) - self.n, self.all.dtype)])
        self.all[self.n:n] = block
        self.n = n


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _dropped(x: np.ndarray, limit: np.uint64) -> np.ndarray:
    """Of sums of a key and a place."""
    x = (x ^ x >> np.uint64(31)) * _MIX[3]
    return (x ^ x >> np.uint64(32)) >> np.uint64(1) < limit


def _place(i, j, end):
    return i.astype(np.uint64) * _MIX[0] + j.astype(np.uint64) * _MIX[1] + end.astype(np.uint64) * _MIX[2]


class Codec:
    """One vocabulary with a dropout rate and a seed."""

    def __init__(self, path: str, rate: float = RATE, seed: int = SEED, remember: int = CACHE_PLACES):
        import sentencepiece
        self.remember = remember
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n)
                  if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ids = {sp.id_to_piece(i): i for i in normal}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # symbols are piece ids; n stands for a character outside the vocabulary
        self.unknown, self.symbol = n, np.full(0x110000, n, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[ord("\n")] = n
        scores = np.array([-sp.get_score(i) for i in range(n)])
        self.rank = np.full(n + 1, _NEVER, np.int32)
        self.rank[normal] = np.unique(scores[normal], return_inverse=True)[1]
        pairs = sorted((ids[piece[:k]] * (n + 1) + ids[piece[k:]], i) for piece, i in ids.items()
                       for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids)
        fits = (n + 1) ** 2 < 1 << 31
        self.pairs = np.array([k for k, _ in pairs] + [(1 << 31) - 1 if fits else 1 << 62],
                              np.int32 if fits else np.int64)
        self.merged = np.array([i for _, i in pairs] + [n], np.int32)
        text = [b""] * n
        for piece, i in ids.items():
            text[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            text[i] = bytes([b])
        self.blob = np.frombuffer(b"".join(text), np.uint8)
        self.size = np.array([len(x) for x in text], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.seed, self.limit = seed, np.uint64(int(rate * 2 ** 63))
        self.code = np.uint16 if n <= 1 << 16 else np.uint32
        self.literal = self._bytes(SPACE)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str | None, int] = {None: 0}   # unit -> its path without drops
        self.units: list[str] = []
        # of each path: its unit, the path it left and at which step, its places, its ids
        self.unit_of, self.parent, self.step = _Rows(np.int32), _Rows(np.int32), _Rows(np.int32)
        self.first, self.places_of = _Rows(np.int64), _Rows(np.int32)
        self.ids_at, self.ids_of = _Rows(np.int64), _Rows(np.int32)
        # of each place: its part of the hash, its step, and the path when it is dropped
        self.place, self.place_step, self.child = _Rows(np.uint64), _Rows(np.uint8), _Rows(np.int32)
        self.ids = _Rows(self.code)
        for rows, x in ((self.unit_of, -1), (self.parent, -1), (self.step, -1), (self.first, 0), (self.places_of, 0),
                        (self.ids_at, 0), (self.ids_of, len(self.literal) // np.dtype(self.code).itemsize)):
            rows.add(np.array([x]))
        self.ids.add(np.frombuffer(self.literal, self.code))

    def _bytes(self, text: str) -> bytes:
        return self.byte_ids[list(text.encode())].astype(self.code).tobytes()

    def _candidates(self, a, b, keys, i, j, end):
        """Rank and piece of merging symbols a and b, which lie at characters
        i to j and j to end of their units; _NEVER where that is impossible or
        dropped.  Without keys nothing is dropped."""
        k = a * self.pairs.dtype.type(self.unknown + 1) + b
        at = np.searchsorted(self.pairs, k)
        piece = np.where(self.pairs[at] == k, self.merged[at], self.unknown)
        if keys is None:
            return self.rank[piece], piece
        return np.where(_dropped(keys + _place(i, j, end), self.limit), _NEVER, self.rank[piece]), piece

    def _merge_all(self, symbols: np.ndarray, lens: np.ndarray, keys: np.ndarray | None,
                   drops: np.ndarray | None = None, trace: list | None = None) -> np.ndarray:
        """Final symbols of each unit, at the place of their first character and
        -1 elsewhere; ``symbols`` has a row per unit, padded.  With ``drops``
        (row, step) the candidates that come up at those steps are dropped, and
        ``trace`` gets (rows, places) of each step."""
        n, width = symbols.shape
        col = np.arange(width)
        inside = col < lens[:, None]
        symbols[~inside] = self.unknown
        # a column more on each side stands for what lies outside a unit
        after = np.minimum(np.arange(1, width + 2), lens[:, None]).astype(np.int32)
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (n, width + 1)).copy()
        symbols = np.concatenate([symbols, np.full((n, 1), self.unknown, np.int32)], 1)
        ranks, pieces = self._candidates(symbols[:, :-1], symbols[:, 1:], None if keys is None else keys[:, None],
                                         col[None, :], after[:, :-1], after[:, 1:])
        ranks[:, -1] = _NEVER
        ranks[(col + 1)[None, :] >= lens[:, None]] = _NEVER
        rows = np.arange(n)
        while len(rows):
            mine = ranks if len(rows) == n else ranks[rows]
            i = mine.argmin(1)
            going = mine[np.arange(len(rows)), i] < _NEVER
            rows, i = rows[going], i[going]
            j = after[rows, i]
            k = after[rows, j]
            live = rows
            if trace is not None:
                skip = drops[rows, len(trace)] if len(trace) < drops.shape[1] else np.zeros(len(rows), bool)
                trace.append((rows, _place(i, j, k)))
                if skip.any():
                    ranks[rows[skip], i[skip]] = _NEVER
                    rows, i, j, k = rows[~skip], i[~skip], j[~skip], k[~skip]
            symbols[rows, i] = pieces[rows, i]
            symbols[rows, j] = -1
            after[rows, i] = k
            before[rows, k] = i
            ranks[rows, j] = _NEVER
            for x, y, z in ((i, k, after[rows, k]), (before[rows, i], i, k)):
                there = np.maximum(x, 0)
                r, p = self._candidates(symbols[rows, there], symbols[rows, y], None if keys is None else keys[rows],
                                        there, y, z)
                ends = (x < 0) | (y >= lens[rows])
                ranks[rows, there] = np.where(ends, np.where(x < 0, ranks[rows, there], _NEVER), r)
                pieces[rows, there] = np.where(ends, pieces[rows, there], p)
            rows = live
        symbols = symbols[:, :-1]
        symbols[~inside] = -1
        return symbols

    def segment(self, units: list[tuple[int, str]]) -> list[bytes]:
        """Ids of (draw, unit) pairs."""
        keys = np.array([xxhash.xxh3_64_intdigest(u.encode(), (self.seed * 1_000_003 + d) & _MASK)
                         for d, u in units], np.uint64)
        return self._segment([u for _, u in units], keys)

    def _segment(self, units: list[str], keys: np.ndarray | None, drops: np.ndarray | None = None,
                 traces: list | None = None) -> list[bytes]:
        """Ids of units with the keys of their occurrences; or with the steps
        that are ``drops`` (a row each, -1 for none), when ``traces`` gets (which
        units, of each step: rows of these and places)."""
        out: list = [b""] * len(units)
        sizes = np.array([len(u) for u in units])
        order = np.argsort(sizes, kind="stable")
        i = 0
        while i < len(order):
            # rows of about equal width, of at most _CELLS cells
            width = int(sizes[order[i]])
            j = i + 1
            while j < len(order) and sizes[order[j]] <= width + 2 and (j - i + 1) * int(sizes[order[j]]) <= _CELLS:
                j += 1
            mine = order[i:j]
            lens = sizes[mine]
            flat = self.symbol[np.frombuffer("".join(units[k] for k in mine).encode("utf-32-le"), np.uint32)]
            width = int(lens[-1])
            grid = np.full((len(mine), width), self.unknown, np.int32)
            grid[np.arange(width) < lens[:, None]] = flat
            if traces is None:
                final = self._merge_all(grid, lens, keys[mine])
            else:
                skip = np.zeros((len(mine), 2 + int(drops[mine].max())), bool)
                skip[np.arange(len(mine))[:, None], drops[mine]] = True   # -1: the last column, which no step reaches
                skip = skip[:, :-1]
                trace: list = []
                final = self._merge_all(grid, lens, None, skip, trace)
                traces.append((mine, trace))
            inside = final >= 0
            whole = final[inside].astype(self.code)
            ends = (np.cumsum(inside.sum(1)) * whole.itemsize).tolist()
            whole, a = whole.tobytes(), 0
            for k, b in zip(mine.tolist(), ends, strict=True):
                out[k] = whole[a:b]
                a = b
            for r in np.flatnonzero((final == self.unknown).any(1)):
                out[mine[r]] = self._spelled(units[mine[r]], final[r][inside[r]])
            i = j
        return out

    def _learn(self, unit: np.ndarray, parent: np.ndarray, step: np.ndarray) -> np.ndarray:
        """New paths: of the units, from the paths ``parent`` (-1: none) by
        dropping what comes up at ``step``."""
        n = len(unit)
        drops, up, at = np.full((n, _DEPTH), -1, np.int64), parent, step
        for k in range(_DEPTH):
            drops[:, k] = at
            at = np.where(up >= 0, self.step.all[up], -1)
            up = np.where(up >= 0, self.parent.all[up], -1)
        traces: list = []
        ids = self._segment([self.units[u] for u in unit.tolist()], None, drops, traces)
        rows = [mine[r] for mine, trace in traces for r, _ in trace]
        steps = [np.full(len(r), t, np.uint8) for _, trace in traces for t, (r, _) in enumerate(trace)]
        if rows:
            row, t = np.concatenate(rows), np.concatenate(steps)
            place = np.concatenate([p for _, trace in traces for _, p in trace])
            later = t > step[row]
            row, t, place = row[later], t[later], place[later]
            order = np.lexsort((t, row))
            row, t, place = row[order], t[order], place[order]
        else:
            row, t, place = np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.uint64)
        new = np.arange(self.unit_of.n, self.unit_of.n + n)
        count = np.bincount(row, minlength=n)
        self.first.add(self.place.n + np.cumsum(count) - count)
        self.places_of.add(count)
        self.place.add(place)
        self.place_step.add(t)
        self.child.add(np.full(len(row), -1, np.int32))
        size = np.array([len(x) for x in ids]) // np.dtype(self.code).itemsize
        self.ids_at.add(self.ids.n + np.cumsum(size) - size)
        self.ids_of.add(size)
        self.ids.add(np.frombuffer(b"".join(ids), self.code))
        self.unit_of.add(unit)
        self.parent.add(parent)
        self.step.add(step)
        return new

    def _follow(self, paths: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Moves occurrences on from their units' paths without drops to those of
        their own drops, in place; those that leave ``_DEPTH`` are returned."""
        left = np.arange(len(paths))
        for depth in range(_DEPTH + 1):
            mine = paths[left]
            size = self.places_of.all[mine]
            at = _ragged(self.first.all[mine], size)
            who = np.repeat(left, size)
            hit = np.flatnonzero(_dropped(keys[who] + self.place.all[at], self.limit))
            at, who = at[hit], who[hit]
            if not len(at):
                return at
            once = np.concatenate([[True], who[1:] != who[:-1]])
            at, left = at[once], who[once]
            if depth == _DEPTH:
                return left
            new = np.unique(at[self.child.all[at] < 0])
            if len(new):
                parent = np.searchsorted(self.first.all[:self.first.n], new, "right") - 1
                self.child.all[new] = self._learn(self.unit_of.all[parent], parent, self.place_step.all[new].astype(np.int64))
            paths[left] = self.child.all[at]
        return left

    def _spelled(self, unit: str, symbols: np.ndarray) -> bytes:
        """Ids of a unit with characters outside the vocabulary."""
        out, at = [], 0
        for i in symbols.tolist():
            if i == self.unknown:
                out.append(self._bytes(unit[at]))
                at += 1
            else:
                out.append(np.array([i], self.code).tobytes())
                at += self.size_in_chars(i)
        return b"".join(out)

    def size_in_chars(self, i: int) -> int:
        return len(self.blob[self.start[i]:self.start[i] + self.size[i]].tobytes().decode())

    def encode_all(self, texts: list[str], ids: list) -> list[np.ndarray]:
        """Ids of each text; ``ids`` are the doc_ids."""
        if self.place.n > self.remember or len(self.units) > self.remember // 13:
            self._forget()
        units, counts, keys = [], [], []
        for text, doc_id in zip(texts, ids, strict=True):
            before = len(units)
            for k, part in enumerate((" " + text).split(SPACE) if text else ()):
                if k:
                    units.append(None)   # a literal mark
                units += _UNIT.findall(part.replace(" ", SPACE))
            counts.append(len(units) - before)
            keys.append(xxhash.xxh3_64_intdigest(str(doc_id).encode(), self.seed & _MASK))
        if not units:
            return [np.empty(0, self.code) for _ in texts]
        counts = np.array(counts)
        key = self._keys(np.repeat(np.array(keys, np.uint64), counts), _ragged(np.zeros_like(counts), counts))
        find = self.known.get
        paths = np.array([find(u, -1) for u in units], np.int64)
        holes = np.flatnonzero(paths < 0)
        fresh = [u for u in dict.fromkeys(units[i] for i in holes.tolist()) if len(u) <= _CACHED_CHARS]
        if fresh:
            at = np.arange(len(self.units), len(self.units) + len(fresh))
            self.units += fresh
            none = np.full(len(fresh), -1)
            self.known.update(zip(fresh, self._learn(at, none, none).tolist(), strict=True))
            paths[holes] = [find(units[i], -1) for i in holes.tolist()]
        short = np.flatnonzero(paths >= 0)
        mine = paths[short]
        deep = self._follow(mine, key[short])
        paths[short] = mine
        alone = np.sort(np.concatenate([np.flatnonzero(paths < 0), short[deep]]))
        own = self._segment([units[i] for i in alone.tolist()], key[alone])
        start, size = self.ids_at.all[paths], self.ids_of.all[paths].astype(np.int64)
        # ids of occurrences by themselves lie after the remembered ones
        size[alone] = np.array([len(x) for x in own], np.int64) // np.dtype(self.code).itemsize
        start[alone] = self.ids.n + np.cumsum(size[alone]) - size[alone]
        flat = np.concatenate([self.ids.all[:self.ids.n], np.frombuffer(b"".join(own), self.code)])[_ragged(start, size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
        return np.split(flat, ends[:-1])

    @staticmethod
    def _keys(doc: np.ndarray, position: np.ndarray) -> np.ndarray:
        x = (doc + position.astype(np.uint64) * _MIX[0]) * _MIX[3]
        x = (x ^ x >> np.uint64(29)) * _MIX[1]
        return x ^ x >> np.uint64(32)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ids) else 0)
        return self.blob[at].tobytes().decode()[1:]


def _codec(*parameters) -> Codec:
    if parameters not in _codecs:
        _codecs[parameters] = Codec(*parameters)
    return _codecs[parameters]


def _encoder(parameters: tuple, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sentencepiece", _codecs.clear)
        codec = _codec(*parameters)
        collecting = gc.isenabled()
        gc.disable()   # millions of small tuples, no cycles: its scans took a sixth of the time
        try:
            for whole in batches:
                for b in byte_slices(whole, "__text", min(_SLICE_BYTES, codec.remember)):
                    texts = [x or "" for x in b.column("__text").to_pylist()]
                    ids = codec.encode_all(texts, b.column("__id").to_pylist())
                    back = [codec.decode(x) for x in ids]
                    ends = pa.array(np.cumsum([0] + [len(x) for x in ids], dtype=np.int32))
                    flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(c) for c in keep), pa.array([len(x) for x in ids], pa.int64()),
                         pa.ListArray.from_arrays(ends, pa.array(flat)),
                         pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                         pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_())],
                        names=[*keep, "n_tokens", "ids", "decoded_sha256", "lossless"])
        finally:   # also where the task fails or stops reading
            if collecting:
                gc.enable()
    return run


def _decoder(parameters: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*parameters)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.string())],
                names=["doc_id", "text"])
    return run


def encode(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED,
           id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
           remember: int = CACHE_PLACES) -> DataFrame:
    """Columns ``keep`` (doc_id) of every row, n_tokens, ids, and of the decoded
    ids their SHA-256 and whether they give the text back.  ``remember`` bounds
    what a worker keeps (about 55 MB a million) and the bytes of text it takes at
    once; less of it costs time only."""
    keep = [id_col] if keep is None else keep
    rows = docs.select(*keep, F.col(id_col).cast("long").alias("__id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    kinds = dict(rows.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    return map_arrow(rows, _encoder((path, rate, seed, remember), keep),
                     schema + "n_tokens long, ids array<int>, decoded_sha256 string, lossless boolean")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids give the empty text."""
    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_arrow(rows, _decoder((path,)), "doc_id long, text string")


def op4_sentencepiece_dropout(spark, sf_dir):
    from .token_counts import vocabulary_path
    return encode(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
