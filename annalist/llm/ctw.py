"""Language-model scoring by context-tree weighting over bytes.

A text is its words (A-Z lower-cased) with one space between, and an end. Every byte is eight binary decisions; each decision
has a context tree over the ``depth`` bytes before it. At every node the Krichevsky-Trofimov estimate P_e of its zeros and ones
is mixed with the product of its children, P_w = (P_e + prod P_w(children)) / 2, so all depths take part with the weight that
the training texts give them. A text's score is the sum of the log probabilities of its bytes under the trained tree.

The tree is made of (depth + 1)-grams, which are counted in the tasks and added up in one shuffle. Below its two upper levels
it falls apart by the two bytes before a decision, so each such part is folded in a task of its own, from its counted grams;
the upper levels have 65,535 nodes at most. Nothing of the model is sent whole: tasks get the most frequent 2^20 grams and
words, and what a text has beyond these is looked up by joins, so the answer is that of the whole model at every size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import text as T
from annalist.llm.shared import few_at_once, fold, lean, stored

DEPTH = 5
#: Entries of a table that is sent to the tasks, at most.
SENT = 1 << 20
#: The key of the end of a text among the words' keys.
END = -1


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-grams that end in each coded byte, and how many each text has. Zeros stand before and after a text."""
    buf = T.FOLD[np.frombuffer(b" " * depth + b"".join(t + b" " * depth for t in texts), np.uint8)]
    after = depth + np.cumsum([len(t) + depth for t in texts]) - depth  # where the zeros after each text begin
    starts, ends = T.word_spans(buf)
    owner = np.searchsorted(after, starts, side="right")
    later = np.append(False, owner[1:] == owner[:-1])[: len(starts)]  # words that are not the first of their text
    keep = np.zeros(len(buf) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    keep = np.cumsum(keep[:-1]).astype(bool)
    value = np.where(keep, buf, 0x20)
    coded = keep.copy()
    coded[starts[later] - 1] = True
    keep[starts[later] - 1] = True
    around = np.concatenate([np.arange(depth), (after[:, None] + np.arange(depth)).ravel()])
    keep[around] = True
    value[around] = 0
    coded[after] = True
    seq, at = value[keep].astype(np.int64), np.flatnonzero(coded[keep])
    code = np.zeros(len(at), np.int64)
    for k in range(depth, -1, -1):
        code = (code << 8) | seq[at - k]
    per_text = np.add.reduceat(coded[depth:].astype(np.int64), np.concatenate([[0], after[:-1] + depth - depth]))
    return code, per_text


def _counter(make):
    """A mapInArrow function that counts keys: ``make`` gives those of a list of texts; one row for each key of a task (in
    pieces of at most two million)."""

    def run(parts):
        keys, counts, held = [], [], 0

        def merged():
            u, at = np.unique(np.concatenate(keys), return_inverse=True)
            return u, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

        for part in parts:
            texts = _bytes(part.column("text"))
            for a, b in T.batches(texts, 1 << 22):
                u, c = np.unique(make(texts[a:b]), return_counts=True)
                keys.append(u)
                counts.append(c)
                held += len(u)
            if held > 2_000_000:
                u, c = merged()
                if len(u) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], names=["key", "n"])
                    u, c = u[:0], c[:0]
                keys, counts, held = [u], [c], len(u)
        if keys:
            u, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], names=["key", "n"])

    return lean(run)


def _word_keys(texts: list[bytes]) -> np.ndarray:
    words, _ = T.keyed_words(texts)
    return np.concatenate([words.view(np.int64), np.full(len(texts), END, np.int64)])


_SMALL = np.array([math.lgamma(k / 2) if k else 0.0 for k in range(64)])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive halves and integers."""
    big = np.maximum(x, 16.0)
    series = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return np.where(x < 31, _SMALL[np.minimum(2 * x, 63).astype(np.int64)], series)


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


def _decisions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (partial byte after a leading one) and bits of the eight decisions of each gram, a row for each gram."""
    byte, k = (keys & 255)[:, None], np.arange(8)[None, :]
    return (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


def _place(keys: np.ndarray, nodes: np.ndarray, level: int) -> np.ndarray:
    """Keys of the nodes of decisions at a level: the last ``level`` bytes before them, and the node."""
    return (((keys >> 8) & ((1 << (8 * level)) - 1))[:, None] << 8) | nodes


def _up(places: np.ndarray, level: int) -> np.ndarray:
    """The parents, at ``level``, of nodes one level below."""
    return (places >> 8 & ((1 << (8 * level)) - 1)) << 8 | (places & 255)


class Level:
    """Nodes of one level in the order of their places: the probability of a one, the weight of a node's own estimate, P_w."""

    def __init__(self, places: np.ndarray, a: np.ndarray, b: np.ndarray, level: int, below: "tuple[np.ndarray, np.ndarray] | None"):
        self.places = places
        pe = kt(a, b)
        self.a, self.b, self.p = a, b, (b + 0.5) / (a + b + 1)
        if below is None:
            self.pw, self.own = pe, np.ones(len(pe))
        else:
            split = np.bincount(np.searchsorted(places, _up(below[0], level)), weights=below[1], minlength=len(places))
            self.pw = np.logaddexp(pe, split) - math.log(2)
            self.own = np.exp(pe - math.log(2) - self.pw)

    def mix(self, places: np.ndarray, guess: np.ndarray) -> np.ndarray:
        """The probability of a one, given that of the node below on the way; one half where nothing was seen."""
        at, hit = _found(places.ravel(), self.places)
        at, hit = at.reshape(places.shape), hit.reshape(places.shape)
        if not len(self.places):
            return np.full(places.shape, 0.5)
        return np.where(hit, self.own[at] * self.p[at] + (1 - self.own[at]) * guess, 0.5)


#: Levels below this one are folded in parts.
UPPER = 2


def _subtree(keys: np.ndarray, n: np.ndarray, depth: int) -> list[Level]:
    """The levels ``depth`` to UPPER of the grams of one part."""
    nodes, bits = _decisions(keys)
    weight = np.broadcast_to(n[:, None], bits.shape).ravel().astype(float)
    ones = weight * bits.ravel()
    levels, below = [], None
    for level in range(depth, UPPER - 1, -1):
        places, at = np.unique(_place(keys, nodes, level), return_inverse=True)
        total, b = np.bincount(at.ravel(), weights=weight), np.bincount(at.ravel(), weights=ones)
        levels.append(Level(places, total - b, b, level, below))
        below = (places, levels[-1].pw)
    return levels


def _part():
    """The two bytes before the last of a gram."""
    return F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))


def upper_levels(counts: DataFrame, depth: int) -> list[Level]:
    """The levels UPPER - 1 to 0. The driver gets the nodes of level UPPER - 1 only: 256 x 255 at most."""

    def fold_part(part: pa.Table) -> pa.Table:
        level = _subtree(part.column("key").to_numpy(), part.column("n").to_numpy(), depth)[-1]
        return pa.table({"place": level.places, "a": level.a, "b": level.b, "pw": level.pw})

    second = counts.groupBy(_part()).applyInArrow(fold_part, "place long, a double, b double, pw double")
    above = F.shiftleft(F.shiftright("place", 8).bitwiseAND(F.lit(255).cast("long")), 8).bitwiseOR(F.col("place").bitwiseAND(F.lit(255).cast("long")))
    rows = second.groupBy(above.alias("place")).agg(*(F.sum(c).alias(c) for c in ("a", "b", "pw"))).orderBy("place").toArrow()
    places, a, b, split = (rows.column(c).to_numpy() for c in ("place", "a", "b", "pw"))
    first = Level(places, a, b, 1, (places, split))
    roots = np.unique(places & 255)
    at = np.searchsorted(roots, places & 255)
    root = Level(roots, np.bincount(at, weights=a, minlength=len(roots)), np.bincount(at, weights=b, minlength=len(roots)), 0, (places, first.pw))
    return [first, root]


def gram_scores(wanted: DataFrame, counts: DataFrame, upper, depth: int) -> DataFrame:
    """(key, lp): log10 probability of the last byte of each gram of ``wanted`` (key), seen in training or not."""

    def score_part(wanted: pa.Table, counted: pa.Table) -> pa.Table:
        keys = wanted.column("key").to_numpy()
        nodes, bits = _decisions(keys)
        guess = np.full(bits.shape, 0.5)
        below = _subtree(counted.column("key").to_numpy(), counted.column("n").to_numpy(), depth) if counted.num_rows else []
        for level, tree in zip(range(depth, UPPER - 1, -1), below, strict=False):
            guess = tree.mix(_place(keys, nodes, level), guess)
        for level, tree in zip((1, 0), upper.value, strict=True):
            guess = tree.mix(_place(keys, nodes, level), guess)
        return pa.table({"key": keys, "lp": np.log10(np.where(bits == 1, guess, 1 - guess)).sum(axis=1)})

    return wanted.select("key").groupBy(_part()).cogroup(counts.groupBy(_part())).applyInArrow(score_part, "key long, lp double")


class Lookup:
    """Places of 64-bit keys by open addressing; tables of at most ``SENT`` keys."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.int64)
        self.at = np.full(1 << bits, -1, np.int32)
        todo, slots = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = self.at[slots] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]], self.at[slots[put]] = keys[todo[put]], todo[put]
            todo, slots = todo[~put], (slots[~put] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in the table, -1 where it is not."""
        slots = self._slots(keys)
        out = self.at[slots]
        todo = np.flatnonzero((out >= 0) & (self.keys[slots] != keys))
        slots = slots[todo]
        while len(todo):
            slots = (slots + 1) & self.mask
            out[todo] = self.at[slots]
            more = (out[todo] >= 0) & (self.keys[slots] != keys[todo])
            todo, slots = todo[more], slots[more]
        return out


def _cut(counts: DataFrame) -> int:
    """The least power of two that at most ``SENT`` keys reach."""
    by_size = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}  # 64 numbers at most
    total, least = 0, max(by_size, default=0) + 1
    for k in sorted(by_size, reverse=True):
        total += by_size[k]
        if total > SENT:
            break
        least = k
    return 1 << least


def _sent(table: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """At most ``SENT`` rows, sorted by key."""
    rows = table.select("key", value).toArrow()
    keys, values = rows.column("key").to_numpy(), rows.column(value).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def _found(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text) whose fold is not 1 and score them all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed word counts), score (log10 probability of
    the text) and bits_per_byte, a row for each row. Null and empty texts are an end alone. Repeated rows count as often as they
    occur and are scored each; a null id has the fold of the empty text. Other columns are ignored; an empty table gives an
    empty result, and without training rows every byte costs eight bits.
    """
    docs = few_at_once(docs).select("doc_id", "text")
    train = docs.filter(fold(F.col("doc_id")) != 1).select("text")
    counted = lambda make, name: stored(train.mapInArrow(_counter(make), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), name)
    grams_n = counted(lambda texts: grams(texts, depth)[0], "grams")
    words_n = counted(_word_keys, "words")
    n_all, n_distinct = words_n.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    upper = docs.sparkSession.sparkContext.broadcast(upper_levels(grams_n, depth))

    gram_cut, word_cut = _cut(grams_n), _cut(words_n)
    context = docs.sparkSession.sparkContext
    often = context.broadcast((_sent(gram_scores(grams_n.filter(F.col("n") >= gram_cut), grams_n, upper, depth), "lp"), _sent(words_n.filter(F.col("n") >= word_cut), "n")))

    def rare(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
        """Keys and counts of each text, as arrays."""
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))[: len(keys)]
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(keys)))
        offsets = np.searchsorted(owner[at], np.arange(n + 1)).astype(np.int32)
        return (pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (keys[at], counts.astype(np.int64)))

    def run(parts):
        (gram_keys, gram_lp), (word_keys, word_n) = often.value
        gram_at, word_at = Lookup(gram_keys), Lookup(word_keys)
        row = TaskContext.get().partitionId() << 33
        for part in parts:
            texts = _bytes(part.column("text"))
            for a, b in T.batches(texts):
                n = b - a
                code, n_code = grams(texts[a:b], depth)
                owner = np.repeat(np.arange(n), n_code)
                at = gram_at.find(code)
                hit = at >= 0
                lp = np.bincount(owner[hit], weights=gram_lp[at[hit]], minlength=n).astype(float)
                gk, gn = rare(code[~hit], owner[~hit], n)
                words, first = T.keyed_words(texts[a:b])
                words = np.concatenate([words.view(np.int64), np.full(n, END, np.int64)])
                owner = np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.arange(n)])
                at = word_at.find(words)
                hit = at >= 0
                base = np.bincount(owner[hit], weights=np.log10(word_n[at[hit]] + 0.5), minlength=n).astype(float)
                wk, wn = rare(words[~hit], owner[~hit], n)
                arrays = [
                    part.column("doc_id").slice(a, n), pa.array(row + np.arange(n)), pa.array(np.diff(first) + 1), pa.array(np.bincount(owner[hit], minlength=n).astype(np.int64)),
                    pa.array(n_code.astype(np.int64)), pa.array(base), pa.array(lp), wk, wn, gk, gn,
                ]
                row += n
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "n_tokens", "known", "n_bytes", "base", "lp", "wk", "wn", "gk", "gn"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.mapInArrow(lean(run), f"doc_id {kind}, row long, n_tokens long, known long, n_bytes long, base double, lp double, wk array<long>, wn array<long>, gk array<long>, gn array<long>"), "scored")
    spread = lambda keys, counts: rows.select("row", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(counts).alias("times"))).alias("x")).select("row", "x.key", "x.times")
    rare_words = spread("wk", "wn").join(words_n, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare_words = rare_words.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("more_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    rare_grams = spread("gk", "gn")
    rare_lp = gram_scores(rare_grams.select("key").distinct(), grams_n, upper, depth)
    rare_grams = rare_grams.join(rare_lp, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("lp")).alias("more_lp"))
    total = rows.drop("wk", "wn", "gk", "gn").join(rare_words, "row", "left").join(rare_grams, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    size = math.log10(n_all + 0.5 * (n_distinct + 1))
    lp = F.col("lp") + zero("more_lp")
    return total.select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "n_tokens",
        (F.col("known") + zero("more_known")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") - F.col("n_tokens") * size).alias("base_score"),
        lp.alias("score"),
        (-lp / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
