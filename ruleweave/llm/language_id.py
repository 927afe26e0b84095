"""Language ID by a linear-chain conditional random field over words.

Every word of a text is labelled; a text may switch languages.  A word's
emission scores come from hashed affix and character n-gram features and from
lexicon features (the word is in the lexicon of a language); transitions
between neighbouring words are learned.  Forward-backward gives each word's
marginals, and a document's language is the one with the largest mean
marginal, which is the score.

Training: at most ``TRAIN_DOCS`` documents per language (those with the least
hash of doc_id), the first ``TRAIN_CHARS`` characters of each, which is the
documented bound of the classifier's sample.  Half of them give the lexicons,
the other half the sequences, which are spliced from spans of several
languages so that transitions are seen.  Nothing else is learned from: lang,
source and doc_id are no inputs of a prediction.

Prediction covers whole texts: the recursion runs over word positions, for all
documents of a slice at once.  Emissions are computed once per distinct word.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so
is everything when no labelled text can be learned from; ties go to the least
language code; more than ``MAX_LANGS`` labels raise ValueError (none of them is
left out silently); a null doc_id is neither held out nor learned from; rows
repeated as a whole are predicted each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, claim, map_arrow, staged, table

TRAIN_DOCS, TRAIN_CHARS = 120, 3_000
MAX_LANGS = 1024
FEATURES = 1 << 14
SPAN, SEQUENCE = (4, 24), 48   # words of a spliced span, and of a training sequence
STEPS, RATE, DECAY, SEED = 60, 0.15, 1e-4, 17
CACHE_WORDS = 300_000          # distinct words whose emissions a worker keeps
SLICE_BYTES = 6 << 20
_EMISSION_WORDS = 1 << 14
_PUNCTUATION = ".,;:!?\"'()[]{}|#*$%&<>-_/\\«»¿¡…"


def word_features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Hashed features of a lower-case word."""
    w = word.strip(_PUNCTUATION)
    parts = [f"p{w[:k]}" for k in (1, 2, 3)] + [f"s{w[-k:]}" for k in (1, 2, 3)]
    padded = f"^{w}$"
    parts += [padded[i:i + 2] for i in range(len(padded) - 1)]
    parts += [padded[i:i + 3] for i in range(len(padded) - 2)]
    parts += [f"lexicon {lang}" for lang in lexicon.get(w, ())]
    return [zlib.crc32(x.encode()) % FEATURES for x in parts]


def _emissions(words: list[str], weights: np.ndarray, lexicon: dict) -> np.ndarray:
    out = np.empty((len(words), weights.shape[1]), weights.dtype)
    for a in range(0, len(words), _EMISSION_WORDS):   # bounds the lists of features
        found = [word_features(w, lexicon) for w in words[a:a + _EMISSION_WORDS]]
        starts = np.cumsum([0] + [len(f) for f in found[:-1]])
        flat = np.fromiter((x for f in found for x in f), np.int64)
        out[a:a + len(found)] = np.add.reduceat(weights[flat], starts, axis=0)
    return out


def forward_backward(scores: np.ndarray, starts: np.ndarray, lens: np.ndarray,
                     trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of sequences that lie one after another in ``scores`` (exp of
    the emissions, a row per word).  ``lens`` falls; ``trans`` is exp of the
    transitions.  Returns the marginals, and their sum over neighbours by pair
    of labels (expected transitions)."""
    alpha = np.empty_like(scores)
    steps = int(lens[0]) if len(lens) else 0
    active = np.searchsorted(-lens, -np.arange(steps), side="left")  # sequences longer than t
    prev = None
    for t in range(steps):
        at = starts[:active[t]] + t
        a = scores[at] if t == 0 else (prev[:active[t]] @ trans) * scores[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = prev = a
    pairs = np.zeros_like(trans, dtype=np.float64)
    message = np.ones((len(lens), scores.shape[1]), scores.dtype)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        if t + 1 < steps:
            n = active[t + 1]
            after = message[:n] * scores[at[:n] + 1]
            joint = alpha[at[:n]].T[:, None, :] * after.T[None, :, :] * trans[:, :, None]
            pairs += (joint / joint.sum((0, 1))).sum(2)
            m = after @ trans.T
            message[:n] = m / m.sum(1, keepdims=True)
        g = alpha[at] * message[:k]
        message_t = g / g.sum(1, keepdims=True)
        alpha[at] = message_t
    return alpha, pairs


def _marginals(scores: np.ndarray, starts: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Sum of the marginals of each sequence; as forward_backward, in place."""
    steps = int(lens[0])
    active = np.searchsorted(-lens, -np.arange(steps), side="left")
    alpha, prev, back = np.empty_like(scores), None, np.ascontiguousarray(trans.T)
    for t in range(steps):
        at = starts[:active[t]] + t
        a = scores[at]
        if t:
            a *= prev[:active[t]] @ trans
        a /= a.sum(1, keepdims=True)
        alpha[at] = prev = a
    total = np.zeros((len(lens), scores.shape[1]))
    message = np.ones((len(lens), scores.shape[1]), scores.dtype)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        m = message[:k]
        g = alpha[at]
        g *= m
        g /= g.sum(1, keepdims=True)
        total[:k] += g
        m *= scores[at]
        m = m @ back
        m /= m.sum(1, keepdims=True)
        message[:k] = m
    return total


def train(samples: list[tuple[str, str]], seed: int = SEED) -> dict | None:
    """The model from (lang, text) pairs; None when there is nothing to learn."""
    rng = np.random.default_rng(seed)
    docs = [(lang, text.lower().split()) for lang, text in sorted(samples)]
    docs = [(lang, words) for lang, words in docs if words]
    langs = sorted({lang for lang, _ in docs})
    if not langs:
        return None
    code = {lang: i for i, lang in enumerate(langs)}
    seen: dict[str, Counter] = {lang: Counter() for lang in langs}
    spans: list[tuple[int, list[str]]] = []
    turn: Counter = Counter()
    for lang, words in docs:
        turn[lang] += 1
        if turn[lang] % 2:
            seen[lang].update(w.strip(_PUNCTUATION) for w in words)
        if turn[lang] % 2 == 0 or turn[lang] == 1:   # one document at least gives sequences
            i = 0
            while i < len(words):
                n = int(rng.integers(*SPAN))
                spans.append((code[lang], words[i:i + n]))
                i += n
    lexicon: dict[str, tuple[int, ...]] = {}
    for lang in langs:
        for w, n in seen[lang].items():
            if n >= 3 and w:
                lexicon[w] = (*lexicon.get(w, ()), code[lang])

    # sequences: mostly spans of one language after another, now and then a switch
    by_lang = [[s for s in spans if s[0] == c] for c in range(len(langs))]
    words, gold, lens, here, room = [], [], [], 0, 0
    at = [0] * len(langs)
    while any(at[c] < len(by_lang[c]) for c in range(len(langs))):
        if at[here] >= len(by_lang[here]) or rng.random() < 0.25:
            here = int(rng.choice([c for c in range(len(langs)) if at[c] < len(by_lang[c])]))
        c, span = by_lang[here][at[here]]
        at[here] += 1
        for w in span:
            if room == 0:
                lens.append(0)
                room = SEQUENCE
            words.append(w)
            gold.append(c)
            lens[-1] += 1
            room -= 1
    lens = np.array(lens)
    starts = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    vocabulary = sorted(set(words))
    index = {w: i for i, w in enumerate(vocabulary)}
    ids = np.array([index[w] for w in words])
    gold = np.array(gold)
    found = [word_features(w, lexicon) for w in vocabulary]
    flat = np.fromiter((x for f in found for x in f), np.int64)
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    first = np.cumsum([0] + [len(f) for f in found[:-1]])
    n_langs, n = len(langs), len(words)
    weights, trans = np.zeros((FEATURES, n_langs)), np.zeros((n_langs, n_langs))
    inner = np.ones(n, bool)
    inner[starts] = False
    nxt = np.flatnonzero(inner)
    seen_pairs = np.zeros((n_langs, n_langs))
    np.add.at(seen_pairs, (gold[nxt - 1], gold[nxt]), 1)
    one_hot = np.eye(n_langs)[gold]
    moments = [np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(weights), np.zeros_like(trans)]
    for step in range(1, STEPS + 1):
        e = np.add.reduceat(weights[flat], first, axis=0)[ids]
        marginals, pairs = forward_backward(np.exp(e - e.max(1, keepdims=True)), starts, lens, np.exp(trans))
        diff = one_hot - marginals
        per_word = np.stack([np.bincount(ids, diff[:, c], len(vocabulary)) for c in range(n_langs)], 1)
        grad_w = np.stack([np.bincount(flat, per_word[owner, c], FEATURES) for c in range(n_langs)], 1) / n
        grads = [grad_w - DECAY * weights, (seen_pairs - pairs) / n - DECAY * trans]
        for i, (p, g) in enumerate(zip((weights, trans), grads, strict=True)):   # Adam
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 2] = 0.99 * moments[i + 2] + 0.01 * g * g
            p += RATE * (moments[i] / (1 - 0.9 ** step)) / (np.sqrt(moments[i + 2] / (1 - 0.99 ** step)) + 1e-9)
    return {"langs": langs, "lexicon": lexicon, "weights": weights.astype(np.float32),
            "trans": np.exp(trans).astype(np.float32)}


def _predictor(model: dict | None):
    def run(batches):
        claim("language_id", lambda: None)   # its own memory goes with the task
        cache: dict[str, int] = {}
        table_: np.ndarray | None = None
        for whole in batches:
            for b in byte_slices(whole, "text", SLICE_BYTES):
                texts = b.column("text").to_pylist()
                n = len(texts)
                lang, score, ids = ["und"] * n, [0.0] * n, []
                if len(cache) > CACHE_WORDS:
                    cache, table_ = {}, None
                fresh: list[str] = []
                rows = []
                for i, text in enumerate(texts):
                    if model is None or not text or not any(map(str.isalpha, text)):
                        continue
                    words = text.lower().split()
                    for w in words:
                        if w not in cache:
                            cache[w] = len(cache)
                            fresh.append(w)
                    ids.append(np.fromiter(map(cache.__getitem__, words), np.int32, len(words)))
                    rows.append(i)
                if rows:
                    if fresh:
                        e = _emissions(fresh, model["weights"], model["lexicon"])
                        e = np.exp(e - e.max(1, keepdims=True))
                        table_ = e if table_ is None else np.concatenate([table_, e])
                    lens = np.array([len(x) for x in ids])
                    order = np.argsort(-lens, kind="stable")
                    lens = lens[order]
                    flat = np.concatenate([ids[k] for k in order])
                    total = _marginals(table_[flat], np.cumsum(lens) - lens, lens, model["trans"])
                    mean = total / lens[:, None]
                    top = mean.argmax(1)
                    for k, o in enumerate(order):
                        lang[rows[o]] = model["langs"][top[k]]
                        score[rows[o]] = float(min(1.0, mean[k, top[k]]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in b.schema.names if c != "text"]
                    + [pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[c for c in b.schema.names if c != "text"] + ["lang_pred", "score"])
    return run


def fit(docs: DataFrame, per_lang: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> dict | None:
    """The model, learned from at most ``per_lang`` documents a language."""
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                        F.substring(F.col(text_col), 1, TRAIN_CHARS).alias("text")).where(
        "id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL "
        "AND pmod(crc32(cast(cast(id AS string) AS binary)), 3) <> 1")
    in_lang = Window.partitionBy("lang")
    nth = F.row_number().over(in_lang.orderBy(F.xxhash64("id"), "id"))
    chosen = staged(known.select("id", "lang").withColumn("nth", nth).where(F.col("nth") <= per_lang)
                    .select("id", "lang").distinct(), "language-samples")
    n_langs = chosen.select("lang").distinct().limit(MAX_LANGS + 1).count()
    if n_langs > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages among the labels")
    # at most per_lang * MAX_LANGS ids are broadcast; an id may have several texts
    nth = F.row_number().over(in_lang.orderBy(F.xxhash64("id"), "id", "text"))
    got = (known.join(F.broadcast(chosen), ["id", "lang"]).distinct().withColumn("nth", nth)
           .where(F.col("nth") <= per_lang).collect())
    return train([(r["lang"], r["text"]) for r in got])


def predict(docs: DataFrame, model: dict | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs``, lang_pred and score."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return map_arrow(rows, _predictor(model), f"{schema}, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    remainder = F.pmod(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")), F.lit(3))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(remainder == 1, F.lit(False)).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    return predict(rows, model, ["doc_id", "held_out"])


def op7_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))
