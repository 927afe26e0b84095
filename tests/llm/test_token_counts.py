import json
import random

import numpy as np
import pyarrow as pa
import pytest
from corpus_cases import got, rows, tables  # noqa: F401  (fixtures)

from ruleweave.llm import token_counts as t

PATH = t.vocabulary_path(t.VOCABULARY)


def whole(text):
    return len(t._tokenizer(PATH).encode(text or "", add_special_tokens=False).ids)


def test_against_whole_texts(tables, rows):
    want = sorted(((r[0], len((r[1] or "").encode()), whole(r[1]), whole(r[1]) > 1024) for r in rows), key=repr)
    assert got(t.token_counts(tables[0], PATH)) == want
    # nearly every text is cut into chunks
    assert got(t.token_counts(tables[0], PATH, chunk=64, overlap=16)) == want


PARTS = ["the ", "word", "  ", "\n\n", " \n ", "ö", "日本語", "<|endoftext|>", "'s", "12345", "!!", "\u00a0", "\u2028", "😀", "\t", "a" * 90, " x"]


@pytest.mark.parametrize("seed", range(40))
def test_splices(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 400)))
    tok = t._tokenizer(PATH)
    for chunk, overlap in ((40, 8), (100, 30), (257, 4)):
        assert t.count_chunked(tok, text, chunk, overlap) == whole(text)


def test_without_white_space():
    """No stable place anywhere: the overlap widens up to the whole text."""
    assert t.count_chunked(t._tokenizer(PATH), "ab1" * 3000, 100, 10) == whole("ab1" * 3000)
    assert t.count_chunked(t._tokenizer(PATH), " " * 5000, 100, 10) == whole(" " * 5000)


def test_empty(tables):
    assert got(t.token_counts(tables[1], PATH)) == []


SPACES = ["\u0085", "\u1680", "\u2003", "\u2028", "\u205f", "\u3000", "\x1c", "\x0b", "\r", "\u200b", "\u0301", "à", "’", "\u2019 "]


@pytest.mark.parametrize("seed", range(40))
def test_units(seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(PARTS + SPACES) for _ in range(rnd.choice((0, 1, 3, 300)))) for _ in range(30)]
    tok, known = t._tokenizer(PATH), {}
    for some in (texts, texts[::-1]):   # the second time, most units are known
        column = pa.array(["left out", *some])[1:]
        assert t.count_units(tok, column, known).tolist() == [whole(x) for x in some]
    for x in texts:
        data = np.frombuffer(x.encode(), np.uint8)
        want = [len(x[:b].encode()) for b in range(1, len(x)) if x[b] in " \n" and not x[b - 1].isspace()]
        assert t.unit_starts(data).tolist() == want


def test_units_are_bounded(monkeypatch):
    """Neither a full memory nor short runs and calls change a count."""
    monkeypatch.setattr(t, "_KNOWN_UNITS", 5)
    monkeypatch.setattr(t, "_RUN_CHARS", 20)
    monkeypatch.setattr(t, "_CALL_BYTES", 50)
    rnd, known = random.Random(5), {}
    texts = ["".join(rnd.choice(PARTS) for _ in range(80)) for _ in range(20)]
    assert t.count_units(t._tokenizer(PATH), pa.array(texts), known).tolist() == [whole(x) for x in texts]
    assert len(known) == 5


class Listening:
    """A tokenizer that notes how many characters it is given."""

    def __init__(self, tok):
        self.tok, self.chars = tok, 0

    def to_str(self):
        return self.tok.to_str()

    def encode(self, text, **more):
        self.chars += len(text)
        return self.tok.encode(text, **more)

    def encode_batch(self, texts, **more):
        self.chars += sum(map(len, texts))
        return self.tok.encode_batch(texts, **more)

    def encode_batch_fast(self, texts, **more):
        self.chars += sum(map(len, texts))
        return self.tok.encode_batch_fast(texts, **more)


def counted(monkeypatch, tok, texts):
    ear = Listening(tok)
    monkeypatch.setattr(t, "_tokenizer", lambda path: ear)
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out = pa.Table.from_batches(t._counter(PATH, t.CHUNK_CHARS, t.OVERLAP_CHARS)([b.slice(0, 150), b.slice(150)]))
    return out.column("n_tokens").to_pylist(), ear.chars


def test_each_unit_is_encoded_once(monkeypatch):
    rnd, tok = random.Random(1), t._tokenizer(PATH)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(50)]
    texts = [" ".join(rnd.choices(words, k=100)) for _ in range(300)] + [None, ""]
    want = [whole(x) for x in texts]
    got, chars = counted(monkeypatch, tok, texts)
    assert got == want and chars < sum(map(len, texts[:300])) / 50


def test_other_definitions_are_encoded_whole(monkeypatch):
    """A prefix space, a normalizer or special strings with spaces: no boundary is proven."""
    from tokenizers import Tokenizer
    base = t._tokenizer(PATH)
    assert t.has_stable_boundaries(base)
    special = {"id": 50256, "content": "a b", "single_word": False, "lstrip": False, "rstrip": False,
               "normalized": False, "special": True}
    for key, value in (("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}),
                       ("pre_tokenizer", None), ("normalizer", {"type": "Strip", "strip_left": True, "strip_right": True}),
                       ("added_tokens", [special]), ("added_tokens", [special | {"content": "ab", "lstrip": True}])):
        spec = json.loads(base.to_str())
        spec[key] = value
        tok = Tokenizer.from_str(json.dumps(spec))
        assert not t.has_stable_boundaries(tok)
        texts = ["x a b  ab\n c"] * 3
        with monkeypatch.context() as m:
            got, _ = counted(m, tok, texts)
        assert got == [len(tok.encode(x, add_special_tokens=False).ids) for x in texts]
