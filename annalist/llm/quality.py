"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; the unlabelled set is the web text as a whole, whatever its label. With the class prior
pi, the risk of a score g under the logistic loss l is

    pi E_P[l(g)] + max(-beta, E_U[l(-g)] - pi E_P[l(-g)])

which is unbiased while its second part is not below -beta; beta is three standard errors, 3 / sqrt(positives), and goes to 0 as
they grow. As l(g) - l(-g) = -g, the unbiased part is convex, and Newton steps minimise it; a step that would take the second
part below -beta is halved until it does not, so the risk stays the non-negative one.

The prior is estimated from positives and unlabelled texts alone. As the unlabelled are a mixture, no set of texts holds a share
of them that is below pi times its share of the positives. Of the sets {g >= c}, ordered by a first fit, the one with the least
bound (ratio of the two shares and its sampling error) gives the ratio as pi (best-bin estimation, Garg et al. 2021).

Every text is described by how much of it is marks, capitals, digits, repeats and so on, and by how much likelier its byte
trigrams are among the positives than in all texts; each measure is cut at fixed edges, so a text is one cell of a grid. Cells
are counted over all rows, which is all that the risk needs: each Newton step is a sum over the counted cells, taken in Spark.
No unlabelled row is sampled; trigrams of positives are counted for ``most_positives`` of them at most, those with the least
hashes of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import text as T
from annalist.llm.shared import few_at_once, fold, forget, lean, stored

#: Where the measures of a text are cut. Shares are of bytes, letters, words, shingles or lines.
EDGES: dict[str, list[float]] = {
    "symbols": [0.001, 0.005, 0.02, 0.05, 0.1, 0.2],
    "marks": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.4],
    "repeated_marks": [0.001, 0.005, 0.02, 0.05, 0.1],
    "capitals": [0.02, 0.05, 0.1, 0.2, 0.5],
    "digits": [0.001, 0.01, 0.03, 0.1],
    "same_as_before": [0.005, 0.02, 0.05, 0.1, 0.3, 0.6],
    "distinct_words": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "distinct_shingles": [0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97],
    "log_words": [0.5, 1, 1.5, 2, 2.5, 3, 3.5],
    "word_length": [2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10],
    "short_words": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5],
    "line_repeats": [0.01, 0.1, 0.3, 0.5],
    "likeness": [-2.0, -1.0, -0.5, -0.3, -0.2, -0.1, 0.1, 0.2],
}
SIZES = [len(e) + 1 for e in EDGES.values()]
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
WIDTH = sum(SIZES) + 1  # and a constant


def _class_of_bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOLS = _class_of_bytes("#$%&*+/<=>@[\\]^_`{}~")
_UPPER = _class_of_bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = _class_of_bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGITS = _class_of_bytes("0123456789")
_MARKS = _class_of_bytes("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: Buckets that byte trigrams are hashed to, and how many trigrams' worth of the general shares a bucket's share starts from.
BUCKETS, STRENGTH = 4096, 20_000.0


def trigram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram of the lower-cased texts, which two spaces follow, text by text, and where each text's begin (one
    more than texts)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    buf = T.FOLD[np.frombuffer(b"  ".join(texts) + b"  ", np.uint8)].astype(np.uint32)
    code = (buf[:-2] << np.uint32(16)) | (buf[1:-1] << np.uint32(8)) | buf[2:]
    at = np.arange(first[-1]) + np.repeat(2 * np.arange(len(texts)), sizes)  # places of bytes, without the spaces between texts
    return ((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64), first


def log_odds(all_texts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """How much likelier each bucket is among the positives than in all texts, as a logarithm; 0 where little is known."""
    base = (all_texts + 0.5) / (all_texts.sum() + 0.5 * BUCKETS)
    return np.log((positives + STRENGTH * base) / (positives.sum() + STRENGTH) / base)


def measures(texts: list[bytes], odds: np.ndarray) -> np.ndarray:
    """The measures of ``EDGES``, a row for each text. A text without words has 0 everywhere."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    starts, ends = T.word_spans(buf)
    keys = T.word_keys(buf, starts, ends)
    first = np.searchsorted(starts, np.append(at, len(buf)))
    n = np.diff(first)
    count = lambda table: np.add.reduceat(table[buf], at)
    per = lambda x, y: x / np.maximum(y, 1)

    def by_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[first[1:]] - total[first[:-1]]

    length = ends - starts
    again = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        again[1:] = keys[1:] == keys[:-1]
    again[first[:-1][n > 0]] = 0
    sets, set_first = T.shingle_sets(texts)
    distinct, repeats = np.zeros(len(texts)), np.zeros(len(texts))
    for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b > a:
            s = np.sort(keys[a:b])
            distinct[k] = 1 + (s[1:] != s[:-1]).sum()
            lines = [x for x in texts[k].split(b"\n") if x.strip()]
            repeats[k] = 1 - len(set(lines)) / max(1, len(lines))
    twice = np.append(False, (buf[1:] == buf[:-1])) & (_MARKS[buf] > 0)
    grams, bounds = trigram_counts(texts)
    liked = np.concatenate([[0.0], np.cumsum(odds[grams])])
    out = np.stack(
        [
            per(count(_SYMBOLS), sizes),
            per(count(_MARKS), sizes),
            per(np.add.reduceat(twice.astype(np.int64), at), sizes),
            per(count(_UPPER), count(_LETTERS)),
            per(count(_DIGITS), sizes),
            per(by_text(again), n),
            per(distinct, n),
            per(np.diff(set_first), np.maximum(n - 4, 1)),
            np.log10(np.maximum(n, 1)),
            per(by_text(length), n),
            per(by_text((length <= 3).astype(np.int64)), n),
            repeats,
            per(liked[bounds[1:]] - liked[bounds[:-1]], np.diff(bounds)),
        ],
        axis=1,
    )
    out[n == 0] = 0
    return out


def cells(texts: list[bytes], odds: np.ndarray) -> np.ndarray:
    """The grid cell of each text: a byte for each measure."""
    values = measures(texts, odds)
    return np.stack([np.searchsorted(np.array(e), values[:, k], side="right") for k, e in enumerate(EDGES.values())], axis=1).astype(np.uint8)


def _columns(cell_bytes: list[bytes]) -> np.ndarray:
    """Indices of the ones in the design row of each cell, the constant last."""
    grid = np.frombuffer(b"".join(cell_bytes), np.uint8).reshape(-1, len(EDGES)).astype(np.int64)
    return np.concatenate([grid + OFFSETS, np.full((len(grid), 1), WIDTH - 1)], axis=1)


def _slices(part: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Where a slice of about half a megabyte of texts begins in a batch, and its texts."""
    sizes = pc.fill_null(pc.binary_length(pc.cast(part.column("text"), pa.binary())), 0).to_pylist()
    a = total = 0
    for i, size in enumerate([*sizes, 0]):
        if i == len(sizes) or (i > a and total + size > 1 << 19):
            if i > a:
                yield a, [x or b"" for x in pc.cast(part.column("text").slice(a, i - a), pa.binary()).to_pylist()]
            a, total = i, 0
        total += size


def best_bin(u: np.ndarray, p: np.ndarray, gamma: float = 0.01, delta: float = 0.1) -> float:
    """The prior from the counts of unlabelled texts and positives in bins of rising score."""
    n_u, n_p = max(1, u.sum()), max(1, p.sum())
    q_u, q_p = np.cumsum(u[::-1]) / n_u, np.cumsum(p[::-1]) / n_p
    error = np.sqrt(np.log(4 / delta) / 2 / n_u) + np.sqrt(np.log(4 / delta) / 2 / n_p)
    some = q_p > 0
    ratio = q_u[some] / q_p[some]
    return float(min(1.0, ratio[np.argmin(ratio + (1 + gamma) * error / q_p[some])]))


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...]
    prior: float
    steps: int
    odds: tuple[float, ...] = (0.0,) * BUCKETS

    def scores(self, grid: np.ndarray) -> np.ndarray:
        g = np.asarray(self.weights)[_columns([grid.tobytes()])].sum(axis=1)
        return 1 / (1 + np.exp(-g))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, ridge: float | None = None, steps: int = 12, most_positives: int = 1_000_000) -> QualityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), without the rows whose fold is 0.

    ``prior``: the share of good text; None: estimated from the positives and all texts. ``ridge``: the weight of the squared
    weights; None: 0.04 / sqrt(positives), which goes to 0 as they grow. Only labels of 1 are read. Labels of
    unknown ids, null labels and null ids are ignored; of several labels of an id the largest counts. Without any positive the
    model scores everything 0.5.
    """
    trusted = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0))
    trusted = trusted.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality")).filter("quality = 1").select("id")
    source = few_at_once(docs).filter(fold(F.col("doc_id")) != 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    ids = np.sort(trusted.orderBy(F.xxhash64("id"), "id").limit(most_positives).toArrow().column("id").to_numpy().astype(np.int64))
    if not len(ids):
        return QualityModel((0.0,) * WIDTH, 0.5, 0)
    chosen = docs.sparkSession.sparkContext.broadcast(ids)

    def count_trigrams(parts):
        counts, ids = np.zeros((2, BUCKETS), np.int64), chosen.value
        for part in parts:
            doc = pc.fill_null(part.column("doc_id"), -1).to_numpy()
            known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            good = (ids[np.minimum(np.searchsorted(ids, doc), len(ids) - 1)] == doc) & known
            for a, texts in _slices(part):
                grams, first = trigram_counts(texts)
                counts[0] += np.bincount(grams[: first[-1]], minlength=BUCKETS)
                mine = np.repeat(good[a : a + len(texts)], np.diff(first))
                counts[1] += np.bincount(grams[: first[-1]][mine], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), *map(pa.array, counts)], names=["bucket", "u", "p"])

    table = source.mapInArrow(lean(count_trigrams), "bucket long, u long, p long").groupBy("bucket").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).toArrow()  # BUCKETS rows
    u_grams, p_grams = np.zeros(BUCKETS), np.zeros(BUCKETS)
    u_grams[table.column("bucket").to_numpy()], p_grams[table.column("bucket").to_numpy()] = table.column("u").to_numpy(), table.column("p").to_numpy()
    odds = log_odds(u_grams, p_grams)

    def run(parts):
        for part in parts:
            for a, texts in _slices(part):
                grid = cells(texts, odds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(a, len(texts)), pa.array([g.tobytes() for g in grid], pa.binary())], names=["doc_id", "cell"])

    rows = source.mapInArrow(lean(run), "doc_id long, cell binary")
    marked = rows.join(trusted, F.col("doc_id") == F.col("id"), "left")
    counted = stored(marked.groupBy("cell").agg(F.count(F.lit(1)).alias("u"), F.count("id").alias("p")), "cells")
    n_u, n_p = (x or 0 for x in counted.agg(F.sum("u"), F.sum("p")).first())
    if not n_p:
        forget(counted)
        return QualityModel((0.0,) * WIDTH, 0.5, 0)

    def sums(weights: np.ndarray | None) -> dict[int, float]:
        """Gradient, Hessian (by pairs of ones) and the parts of the risk, added up over the counted cells."""

        def part_sums(parts):
            first, second, extra = np.zeros(WIDTH), np.zeros((WIDTH, WIDTH)), np.zeros(2)
            for part in parts:
                if not part.num_rows:
                    continue
                at = _columns(part.column("cell").to_pylist())
                u, p = (part.column(c).to_numpy() for c in ("u", "p"))
                if weights is None:
                    np.add.at(first, at, p[:, None] / n_p)
                    continue
                g = weights[at].sum(axis=1)
                s = 1 / (1 + np.exp(-g))
                np.add.at(first, at, (u / n_u * s)[:, None])
                dense = np.zeros((len(at), WIDTH))
                np.put_along_axis(dense, at, 1.0, axis=1)
                second += dense.T @ (dense * (u / n_u * s * (1 - s))[:, None])
                extra += [(u / n_u * np.logaddexp(0, g)).sum(), (p / n_p * np.logaddexp(0, g)).sum()]
            flat = np.concatenate([first, second.ravel(), extra])
            kept = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(flat[kept])], names=["k", "x"])

        return {r[0]: r[1] for r in counted.mapInArrow(lean(part_sums), "k long, x double").groupBy("k").agg(F.sum("x")).collect()}

    def unpack(found: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.zeros(WIDTH + WIDTH * WIDTH + 2)
        for k, x in found.items():
            flat[k] = x
        return flat[:WIDTH], flat[WIDTH:-2].reshape(WIDTH, WIDTH), flat[-2:]

    mean_p = unpack(sums(None))[0]
    ridge = 0.04 / np.sqrt(n_p) if ridge is None else ridge

    def minimise(prior: float, weights: np.ndarray) -> tuple[np.ndarray, int]:
        state, done = unpack(sums(weights)), 0
        while done < steps:
            mean_u, hessian, _ = state
            gradient = mean_u - prior * mean_p + ridge * weights
            step = np.linalg.solve(hessian + ridge * np.eye(WIDTH), gradient)
            step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
            done += 1
            for halving in range(5):
                tried = unpack(sums(weights - step / 2**halving))
                if tried[2][0] - prior * tried[2][1] >= -3 / np.sqrt(n_p):
                    weights, state = weights - step / 2**halving, tried
                    break
            else:
                break  # on the border of the non-negative part
            if np.abs(step).max() < 0.02:
                break
        return weights, done

    def bins(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of texts and positives in bins of the score, from the counted cells."""

        def run(parts):
            for part in parts:
                g = weights[_columns(part.column("cell").to_pylist())].sum(axis=1)
                at = np.clip(np.floor(20 * g), -400, 400).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), part.column("u"), part.column("p")], names=["bin", "u", "p"])

        found = counted.mapInArrow(lean(run), "bin long, u long, p long").groupBy("bin").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).orderBy("bin").toArrow()  # 801 rows at most
        return found.column("u").to_numpy(), found.column("p").to_numpy()

    weights = np.zeros(WIDTH)
    if prior is None:
        weights, _ = minimise(0.5, weights)
        prior = min(best_bin(*bins(weights)), 0.99)
    weights, done = minimise(prior, weights)
    forget(counted)
    return QualityModel(tuple(float(w) for w in weights), float(prior), done, tuple(float(x) for x in odds))


def score(docs: DataFrame, model: QualityModel, to: str = "score") -> DataFrame:
    """Add the model's probability of quality to every row of ``docs``, from the whole of its column text.

    Null, empty and blank texts are one cell of the grid like any other and get its score. All other columns are kept (an
    older ``to`` is replaced); repeated rows stay; an empty table gives an empty result.
    """
    docs = few_at_once(docs.drop(to))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{to}` double"

    def run(parts):
        odds = np.array(model.odds)
        for part in parts:
            for a, texts in _slices(part):
                arrays = [part.column(c).slice(a, len(texts)) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(model.scores(cells(texts, odds)))], names=[*part.schema.names, to])

    return docs.mapInArrow(lean(run), schema)
