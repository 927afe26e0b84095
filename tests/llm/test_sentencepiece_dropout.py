import collections
import hashlib

import public_tokenizers
import sentencepiece
from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.llm import sentencepiece_dropout as s

PATH = public_tokenizers.path(s.VOCABULARY)
PLAIN = s.Codec(PATH, 0.0)
DROPPED = s.Codec(PATH)


def agenda(codec, unit, draw):
    """One unit with a plain agenda: what comes up is merged unless dropped."""
    import xxhash
    symbols, at = list(unit), list(range(len(unit)))
    ids = {c: int(codec.symbol[ord(c)]) for c in unit}
    known = [ids[c] for c in symbols]
    key = xxhash.xxh3_64_intdigest(unit.encode(), (codec.seed * 1_000_003 + draw) & s._MASK)
    pairs = dict(zip(codec.pairs.tolist(), codec.merged.tolist()))
    m = (1 << 64) - 1
    dropped = set()
    while True:
        best = None
        for k in range(len(known) - 1):
            piece = pairs.get(known[k] * (codec.unknown + 1) + known[k + 1])
            place = (at[k], at[k + 1], at[k + 2] if k + 2 < len(at) else len(unit))
            if piece is not None and place not in dropped and (best is None or codec.rank[piece] < best[0]):
                best = (codec.rank[piece], k, piece, place)
        if best is None:
            return known
        _, k, piece, place = best
        x = (key + sum(p * int(c) for p, c in zip(place, s._MIX))) & m
        x = ((x ^ x >> 31) * int(s._MIX[3])) & m
        if (x ^ x >> 32) >> 1 < int(codec.limit):
            dropped.add(place)
            continue
        known[k:k + 2] = [piece]
        del at[k + 1]


def test_plain_encoding_is_the_librarys(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [r[1] for r in rows if r[1] and s.SPACE not in r[1]] + ["  a  b ", "\n x\n\ny", " ", "日本", "ﬁ ① Ａ"]
    assert [x.tolist() for x in PLAIN.encode_all(texts, [None] * len(texts))] == library.encode(texts)


def test_agendas_side_by_side():
    units = [(d, f"▁{w}") for d in range(3) for w in ("interesting", "a", "internationalisation", "thethethe", "öäöü", "")]
    got_ = DROPPED.segment([u for u in units if len(u[1]) > 1])
    for (d, u), x in zip([u for u in units if len(u[1]) > 1], got_):
        want = agenda(DROPPED, u, d)
        if max(want) < DROPPED.unknown:
            import numpy as np
            assert np.frombuffer(x, DROPPED.code).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60), st.integers(-5, 5))
def test_round_trip(text, doc_id):
    for codec in (PLAIN, DROPPED):
        ids = codec.encode_all([text], [doc_id])[0]
        assert codec.decode(ids) == text
        assert ids.tolist() == codec.encode_all([text], [doc_id])[0].tolist()


def test_dropout_varies():
    text = "internationalisation of interesting conversations " * 4
    seen = {tuple(DROPPED.encode_all([text], [i])[0].tolist()) for i in range(20)}
    assert len(seen) > 5 and tuple(PLAIN.encode_all([text], [0])[0].tolist()) not in seen


def test_query(tables, rows):
    out = s.encode(tables[0], PATH)
    assert got(out, "doc_id", "decoded_sha256", "lossless") == sorted(
        ((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest(), True) for r in rows), key=repr)
    assert got(s.decode(out, PATH)) == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    assert all(r["n_tokens"] == len(r["ids"]) for r in out.collect())
    assert got(s.encode(tables[1], PATH)) == []


def test_a_word_varies_over_its_occurrences():
    # three segmentations in the whole corpus would be all a word had before
    seen = collections.Counter()
    for i in range(40):
        ids = DROPPED.encode_all([" ".join(["interesting"] * 50)], [i])[0]
        words = DROPPED.decode(ids)
        assert words == " ".join(["interesting"] * 50)
        cut, at = [], 0
        for x in ids.tolist():
            at += int(DROPPED.size[x])
            cut.append(x)
            if at % len(" interesting") == 0:
                seen[tuple(cut)] += 1
                cut = []
    assert sum(seen.values()) == 2000 and len(seen) > 20
    # as often as in the library's own dropout
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    theirs = collections.Counter(tuple(library.encode("interesting", enable_sampling=True, alpha=s.RATE, nbest_size=-1))
                                 for _ in range(2000))
    for x, n in theirs.most_common(5):
        assert abs(seen[x] - n) < 150


def test_two_merges_vary_in_most_words():
    units = [w for w in ("the", "and", "for", "you", "was", "are") if len(PLAIN.encode_all([w], [0])[0]) == 1]
    assert units
    for w in units:
        assert len({tuple(DROPPED.encode_all([w], [i])[0].tolist()) for i in range(200)}) > 1


def test_remembered_paths_give_what_agendas_give():
    import numpy as np
    codec = s.Codec(PATH)
    words = ["▁interesting", "▁a", "▁the", "▁thethethe", "▁inter", "▁öäöü", "▁internationalisation-of-conversations"]
    for doc in range(30):
        text = " ".join(w[1:] for w in words * 3)
        ids = codec.encode_all([text], [doc])[0].tolist()
        import xxhash
        key = np.uint64(xxhash.xxh3_64_intdigest(str(doc).encode(), codec.seed & s._MASK))
        n = 3 * len(words)
        keys = codec._keys(np.full(n, key), np.arange(n))
        own = codec._segment(words * 3, keys)
        assert ids == np.frombuffer(b"".join(own), codec.code).tolist()
        if doc == 15:
            codec._forget()
