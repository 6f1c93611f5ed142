"""Agents that learn: a multinomial model of words, counted and applied in joins, and the split that keeps its measure honest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.lineage import cut

#: Rows of words that are sent to all tasks, at most; more are joined by shuffle.
BROADCAST_WORDS = 1_000_000
#: Numbers (parts times labels) that are sent to all tasks, at most: 32 MB.
BROADCAST_NUMBERS = 2**22
#: Rows whose tokens a task treats at once.
ROWS_AT_ONCE = 1_000
#: Gives the distinct parts of a list of tokens, the place of each part of each token among these, and how many each token has.
Parts = Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]]


def held_out(key: Column, share: int = 5) -> Column:
    """Whether a row is kept from learning: one in ``share``, by the first four digits of the SHA-256 of its key."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 4), 16, 10).cast("int") % share == 0


def words_of(text: Column) -> Column:
    """Lower-case runs of letters; everything else parts them."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")


def grams_of(text: Column) -> Column:
    """Three-character runs of the words, each with a space before and after: for short and unseen words."""
    whole = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    return F.flatten(F.transform(words_of(text), lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substr(whole(w), i, F.lit(3)))))


def grams_in(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The three-character runs of words, as :func:`grams_of` has them: the distinct ones, the place of each among these, their number by word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.repeat(2 * np.arange(len(words)), sizes) + np.arange(sizes.sum())  # two spaces part words
    coded = pa.array(text[at] << 42 | text[at + 1] << 21 | text[at + 2]).dictionary_encode()
    names = ["".join(map(chr, (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF))) for c in coded.dictionary.to_pylist()]
    return names, coded.indices.to_numpy(), sizes


def learn(docs: DataFrame, tokens: Column, label: str, parts: Parts | None = None) -> tuple[DataFrame, DataFrame]:
    """The model of ``docs``: (label, docs, total) and (token, counts: array of label and n).

    Rows without a label teach nothing. Labels are those that occur; the counts are combined before each shuffle. With ``parts`` it
    is the parts of tokens that are counted: no token is shuffled, and the texts are read once, as the counts are kept.
    """
    known = docs.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), tokens.alias("tokens"))
    if parts:
        spread = known.mapInArrow(_counted(parts), f"label {docs.schema[label].dataType.simpleString()}, token string, n long")
        spread = cut(spread.groupBy("label", "token").agg(F.sum("n").alias("n")))
    else:
        spread = known.select("label", F.explode("tokens").alias("token")).groupBy("label", "token").agg(F.count(F.lit(1)).alias("n"))
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
    totals = spread.groupBy("label").agg(F.sum("n").alias("total"))
    labels = sizes.join(totals, "label", "left").select("label", "docs", F.coalesce("total", F.lit(0)).alias("total"))
    return labels, spread.groupBy("token").agg(F.collect_list(F.struct("label", "n")).alias("counts"))


def predict(docs: DataFrame, tokens: Column, key: str, labels: DataFrame, words: DataFrame, most_labels: int = 1_000, broadcast_words: int = BROADCAST_WORDS, parts: Parts | None = None) -> DataFrame:
    """(key, label, score): the likeliest label of each row (ties: the least) and its log probability of label and tokens.

    log((docs of the label) / docs) + sum over tokens of log((n + 1) / (total + V + 1)), V: distinct tokens learned. A text without
    tokens has the most frequent label. ``key`` is distinct; no label is given where nothing was learned. Labels (``most_labels``
    at most) go to the driver; words are broadcast if they are few, and then no token is shuffled. With ``parts``, as in :func:`learn`,
    rows are scored where they are read: the most frequent parts (``broadcast_words`` and BROADCAST_NUMBERS at most) go to the driver
    and to all tasks; the parts of texts that are others, if the model has more, meet them by shuffle.
    """
    known = sorted(labels.limit(most_labels + 1).collect(), key=lambda r: r.label)
    if len(known) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    kind = labels.schema["label"].dataType
    if not known:
        return docs.select(key, F.lit(None).cast(kind).alias("label"), F.lit(None).cast("double").alias("score"))
    n_words, n_docs = words.count(), sum(r.docs for r in known)
    rows = docs.select(key, tokens.alias("tokens"))
    if parts:
        table = F.array(*[F.lit(r.label).cast(kind) for r in known])
        scored, met = _by_parts(rows, key, table, len(known), words, n_words, broadcast_words, parts)
    else:
        scored = rows.select(key, F.size("tokens").alias("n"), F.array().cast("array<double>").alias("told"))
        met = rows.select(key, F.explode("tokens").alias("token"), F.lit(1).alias("tf")).join(F.broadcast(_adds(words)) if n_words <= broadcast_words else _adds(words), "token")
    if met is None:
        scored = scored.withColumn("gains", F.lit(None).cast(f"map<{kind.simpleString()},double>"))
    else:
        sums = met.select(key, "tf", F.explode("gains").alias("g")).groupBy(key, F.col("g.label").alias("label")).agg(F.sum(F.col("tf") * F.col("g.gain")).alias("gain"))
        scored = scored.join(sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", "gain"))).alias("gains")), key, "left")
    table = F.array(*[F.struct(F.lit(r.label).cast(kind).alias("label"), F.log(F.lit(r.docs / n_docs)).alias("prior"), F.log(F.lit(float(r.total + n_words + 1))).alias("size")) for r in known])
    score = lambda t, i: t["prior"] - F.col("n") * t["size"] + F.coalesce(F.get("told", i), F.lit(0.0)) + F.coalesce(F.try_element_at("gains", t["label"]), F.lit(0.0))
    best = F.array_max(F.transform(table, lambda t, i: F.struct(F.round(score(t, i), 9).alias("score"), (-i).alias("place"), t["label"].alias("label"))))
    return scored.select(key, best.alias("b")).select(key, "b.label", "b.score")


def _adds(words: DataFrame) -> DataFrame:
    """(token, gains: array of label and what the token adds)."""
    return words.select("token", F.transform("counts", lambda c: F.struct(c["label"].alias("label"), F.log(c["n"] + 1).alias("gain"))).alias("gains"))


def _by_parts(rows: DataFrame, key: str, table: Column, labels: int, words: DataFrame, n_words: int, most: int, parts: Parts) -> tuple[DataFrame, DataFrame | None]:
    """(key, n, told: what the parts that were sent add for each label) and, if the model has others, (key, tf, gains) of those."""
    most, rare = min(most, BROADCAST_NUMBERS // labels), None
    if n_words > most:  # those of the highest powers of two of their counts are sent
        words = words.withColumn("power", F.floor(F.log2(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"]))))
        least, total = 64, 0
        for r in sorted(words.groupBy("power").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.power):
            total += r.n
            if total > most:
                break
            least = r.power
        rare = _adds(words.filter(F.col("power") < least))
        words = words.filter(F.col("power") >= least)
    found = words.select("token", F.transform("counts", lambda c: F.array_position(table, c["label"]) - 1).alias("labels"), F.col("counts.n").alias("ns")).toArrow()
    flat = lambda c: pc.list_flatten(found.column(c)).to_numpy()
    gains = np.zeros((labels, len(found) + 1))  # the first column is of parts that are not there
    gains[flat("labels"), np.repeat(np.arange(1, len(found) + 1), pc.list_value_length(found.column("labels")).to_numpy())] = np.log(flat("ns") + 1.0)
    sent = rows.sparkSession.sparkContext.broadcast(({x: i for i, x in enumerate(found.column("token").to_pylist(), 1)}, gains))
    kind = rows.schema[key].dataType.simpleString()
    scored = rows.mapInArrow(_scored(sent, key, parts), f"`{key}` {kind}, n long, told array<double>")
    return scored, None if rare is None else rows.mapInArrow(_others(sent, key, parts), f"`{key}` {kind}, token string, tf long").join(rare, "token")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, np.ndarray]]:
    """A few rows, their distinct tokens, for each of their tokens its place among these, and how many each row has; nulls are none."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            rows = batch.slice(at, ROWS_AT_ONCE)
            tokens = rows.column("tokens")
            flat, sizes = tokens.flatten(), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
            if flat.null_count:
                flat, sizes = flat.drop_null(), _sums(flat.is_valid().to_numpy(zero_copy_only=False).astype(int), sizes)
            coded = flat.dictionary_encode()
            yield rows, coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), sizes


def _sums(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of numbers; runs may be empty."""
    out, some = np.zeros(len(sizes), numbers.dtype), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(numbers, (np.cumsum(sizes) - sizes)[some])
    return out


def _counted(parts: Parts):
    """Counts of parts by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, tokens, codes, sizes in _coded(batches):
            names, places, each = parts(tokens)
            names, labels = pa.array(names, pa.string()), few.column("label").dictionary_encode()
            of = np.repeat(labels.indices.to_numpy(), sizes)
            for i in range(len(labels.dictionary)):
                times = np.bincount(codes[of == i], minlength=len(tokens))
                n = np.bincount(places, np.repeat(times, each), len(names)).astype(np.int64)
                some = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(np.full(len(some), i))), names.take(some), pa.array(n).take(some)], names=["label", "token", "n"])

    return run


def _scored(sent, key: str, parts: Parts):
    """The number of parts of each row, and what they add for each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, gains = sent.value
        for few, tokens, codes, sizes in _coded(batches):
            names, places, each = parts(tokens)
            known = np.fromiter((place.get(x, 0) for x in names), np.int64, len(names))[places]
            told = np.array([_sums(_sums(of[known], each)[codes], sizes) for of in gains])
            told = pa.FixedSizeListArray.from_arrays(pa.array(told.T.ravel()), len(gains)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([few.column(key), pa.array(_sums(each[codes], sizes)), told], names=[key, "n", "told"])

    return run


def _others(sent, key: str, parts: Parts):
    """The parts of each row that were not sent, with how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = sent.value
        for few, tokens, codes, sizes in _coded(batches):
            names, places, each = parts(tokens)
            other = np.fromiter((x not in place for x in names), bool, len(names))[places]
            places, each = places[other], _sums(other.astype(np.int64), each)
            n = each[codes]
            at = np.repeat((np.cumsum(each) - each)[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())  # where the parts of each token are
            rows = np.repeat(np.repeat(np.arange(few.num_rows), sizes), n)
            pairs, tf = np.unique(rows * len(names) + places[at], return_counts=True)
            rows, part = np.divmod(pairs, max(1, len(names)))
            yield pa.RecordBatch.from_arrays([few.column(key).take(pa.array(rows)), pa.array(names, pa.string()).take(pa.array(part)), pa.array(tf)], names=[key, "token", "tf"])

    return run
