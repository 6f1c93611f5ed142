"""Language identification as mixture inference.

Each learned language gives every byte trigram a probability. A text is a mixture: each of its words is drawn from one of the
languages, and expectation-maximisation estimates the languages' shares. The set of languages is chosen by penalised
likelihood: the single best one, then the two, three, ... with the largest shares, as long as another language raises the log
likelihood by more than its penalty, half the logarithm of the number of words plus ``EXTRA``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import text as T
from annalist.llm.shared import few_at_once, fold, lean

#: Trigrams are hashed to so many buckets for up to MAX_LANGS languages; beyond, buckets are halved as languages double, down
#: to LEAST_BUCKETS, so the model keeps its bound of 64 MB.
BUCKETS, MAX_LANGS, LEAST_BUCKETS = 1 << 16, 256, 1 << 8
#: Numbers looked up at once while the words of a text get their likelihoods, at most (but for a single word's).
CELLS = 1 << 24
EXTRA, ROUNDS, SMOOTH = 6.0, 12, 0.05
UNKNOWN = "und"


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each byte of a word, where the words begin among them, and the words' first index by text."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b"  ", np.uint8)
    buf = T.FOLD[buf]
    starts, ends = T.word_spans(buf)
    inside = np.zeros(len(buf) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    wide = np.where(inside, buf, 0x20).astype(np.uint32)
    at = np.flatnonzero(inside)
    code = (wide[at - 1] << np.uint32(16)) | (wide[at] << np.uint32(8)) | wide[at + 1]
    bounds = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), np.concatenate([[0], np.cumsum(ends - starts)])[:-1], np.searchsorted(starts, bounds)


def bucket_bits(n_lang: int) -> int:
    """Bits of a bucket for so many languages."""
    bits = BUCKETS.bit_length() - 1
    while n_lang << bits > MAX_LANGS * BUCKETS:
        bits -= 1
    if 1 << bits < LEAST_BUCKETS:
        raise ValueError(f"{n_lang} languages: more than a model of {LEAST_BUCKETS} buckets has room for")
    return bits


class LanguageModel:
    """``langs`` in order, and the log probability of every bucket in each."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        table = np.stack([counts[x] for x in self.langs], axis=1) if counts else np.zeros((BUCKETS, 0))
        self.logs = np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * len(table))).astype(np.float32)
        self.shift = BUCKETS.bit_length() - len(table).bit_length()

    def _likelihoods(self, buckets: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Log likelihood of every word in every language: looked up for a run of words at a time, so a giant text takes room for
        its words and not for its trigrams."""
        out = np.empty((len(words), len(self.langs)))
        ends = np.append(words[1:], len(buckets))
        a = 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(ends, words[a] + CELLS // len(self.langs), "right")))
            out[a:b] = np.add.reduceat(self.logs[buckets[words[a] : ends[b - 1]] >> self.shift], words[a:b] - words[a], axis=0)
            a = b
        return out

    def infer(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the languages in each text (0 outside its set), and the posterior of each as the only language."""
        n_lang, n = len(self.langs), len(texts)
        buckets, words, first = _trigrams(texts)
        sizes = np.diff(first)
        full = np.flatnonzero(sizes > 0)
        shares, posterior = np.full((n, n_lang), 1 / max(1, n_lang)), np.full((n, n_lang), 1 / max(1, n_lang))
        if not len(full) or not n_lang:
            return shares, posterior
        like = self._likelihoods(buckets, words)
        at = first[:-1][full]
        single = np.add.reduceat(like, at, axis=0)
        odds = np.exp(single - single.max(axis=1, keepdims=True))
        posterior[full] = odds / odds.sum(axis=1, keepdims=True)
        best = single.argmax(axis=1)
        shares[full] = np.eye(n_lang)[best]
        penalty = 0.5 * np.log(sizes[full]) + EXTRA
        bound = np.add.reduceat(like.max(axis=1), at) - single.max(axis=1)
        active = np.flatnonzero(bound > penalty)
        reached = single.max(axis=1)
        order = None
        for k in range(2, n_lang + 1):
            if not len(active):
                break
            picked = np.concatenate([np.arange(a, b) for a, b in zip(first[full[active]], first[full[active] + 1], strict=True)])
            part, count = like[picked], sizes[full[active]]
            starts = np.concatenate([[0], np.cumsum(count)])[:-1]
            if order is None:
                _, theta = self._maximise(part, starts, count, np.ones((len(active), n_lang), bool))
                order = np.zeros((len(full), n_lang), np.int64)
                order[active] = np.argsort(-theta, axis=1, kind="stable")
            allowed = np.zeros((len(active), n_lang), bool)
            np.put_along_axis(allowed, order[active][:, :k], True, axis=1)
            value, theta = self._maximise(part, starts, count, allowed)
            better = value - reached[active] > penalty[active]
            shares[full[active[better]]] = theta[better]
            reached[active[better]] = value[better]
            active = active[better]
        return shares, posterior

    @staticmethod
    def _maximise(like: np.ndarray, starts: np.ndarray, count: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood and shares after ``ROUNDS`` steps, for all texts at once."""
        top = like.max(axis=1, keepdims=True)
        scaled = np.exp(like - top)
        theta = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            drawn = scaled * np.repeat(theta, count, axis=0)
            drawn /= np.maximum(drawn.sum(axis=1, keepdims=True), 1e-300)
            theta = np.add.reduceat(drawn, starts, axis=0) / count[:, None]
        each = np.log(np.maximum((scaled * np.repeat(theta, count, axis=0)).sum(axis=1), 1e-300)) + top[:, 0]
        return np.add.reduceat(each, starts), theta


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang) with a lang, without the rows whose fold is 0.

    Trigrams are counted in the tasks, so a shuffle carries one row for each task, language and bucket at most, and the driver
    receives one for each language and bucket: MAX_LANGS x BUCKETS at most, as more languages have fewer buckets.
    """
    known = few_at_once(docs).filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0)).select("lang", "text")
    bits = bucket_bits(known.select("lang").distinct().count())
    size, shift = 1 << bits, BUCKETS.bit_length() - 1 - bits

    def run(parts):
        counts: dict[str, np.ndarray] = {}

        def rows():
            for lang, table in counts.items():
                kept = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), pa.array(kept.astype(np.int32)), pa.array(table[kept])], names=["lang", "bucket", "n"])

        for part in parts:
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            texts = _bytes(part.column("text"))
            for lang in sorted(set(langs)):
                if lang not in counts and len(counts) >= MAX_LANGS:
                    yield from rows()
                    counts = {}
                buckets, _, _ = _trigrams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                counts.setdefault(lang, np.zeros(size, np.int64))
                counts[lang] += np.bincount(buckets >> shift, minlength=size)
        yield from rows()

    total = known.mapInArrow(lean(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    for lang, part in ((x, total.filter(pc.equal(total.column("lang"), x))) for x in pc.unique(total.column("lang")).to_pylist()):
        counts[lang] = np.zeros(size)
        counts[lang][part.column("bucket").to_numpy()] = part.column("n").to_numpy()
    return LanguageModel(counts)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, langs and shares (arrays: the languages of the text, largest share first) for every row of
    ``docs`` (doc_id, text).

    score: the share of lang_pred in the mixture times its posterior as the only language. A text that is null or has no letter
    is ``und`` with score 0, as is every text if nothing was learned. Ties take the first language in order. Other columns are
    ignored; repeated rows stay; whole texts are used; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGS x BUCKETS numbers

    def run(parts):
        model = shared.value
        for part in parts:
            texts = _bytes(part.column("text"))
            for a, b in T.batches(texts):
                letters = part.column("letters").slice(a, b - a).to_numpy(zero_copy_only=False)
                pred, score, langs, mix = [], [], [], []
                shares, posterior = model.infer(texts[a:b])
                for ok, s, p in zip(letters, shares, posterior, strict=True):
                    if not ok or not len(model.langs):
                        pred, score, langs, mix = [*pred, UNKNOWN], [*score, 0.0], [*langs, []], [*mix, []]
                        continue
                    order = [k for k in np.argsort(-s, kind="stable") if s[k] > 0]
                    pred.append(model.langs[order[0]])
                    score.append(float(min(1.0, s[order[0]] * p[order[0]])) if len(order) == 1 else float(s[order[0]]))
                    langs.append([model.langs[k] for k in order])
                    mix.append([float(s[k]) for k in order])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").slice(a, b - a), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(mix, pa.list_(pa.float64()))],
                    names=["doc_id", "lang_pred", "score", "langs", "shares"],
                )

    rows = few_at_once(docs).select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double, langs array<string>, shares array<double>")
