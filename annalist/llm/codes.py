"""Vector codes: each part of a vector is named by the nearest of a few entries, found by float32 products and settled in integers.

Vectors are integers (floor of 256 times each component), so distances have exact values. A float32 matrix product gives all of
them at once with a rounding error whose bound is known; only entries whose interval reaches the best one are computed again in
64-bit integers, and ties go to the lower index. So the codes are those of exact arithmetic, whatever the processor or library.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.shared import fresh, lean, stored

#: 256 times a component is an integer of 64 bits below this; vectors beyond it are left out like infinite ones.
LARGEST = 2.0**54
#: Half a unit in the last place of float32.
UNIT = 2.0**-24
LONG = (1 << 63) - 1


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite doubles below ``LARGEST``: exact, as the product only shifts the exponent."""
    return np.floor(values * 256.0).astype(np.int64)


def safe_bound(width: int) -> int:
    """Integers up to this have squared distances over ``width`` components that fit in 64 bits."""
    return math.isqrt(LONG // max(width, 1)) // 2


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each point (ties: the lower) and its squared distance; both arrays are int64, rows by width.

    The error of a float32 product of integers x and c, whose components are rounded first, is at most g * |x| * |c| with
    g = (width + 2) * u / (1 - (width + 2) * u), in whatever order it is summed. What the doubles around it may add is covered
    by a margin of 2**-48.
    """
    width = points.shape[1]
    bound = safe_bound(width)
    if max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)) > bound:
        return _nearest_exact(points, entries)
    c2 = (entries * entries).sum(1)
    x_norm = np.sqrt((points * points).sum(1).astype(np.float64))
    c_norm = np.sqrt(c2.astype(np.float64))
    product = (points.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    g = (width + 2) * UNIT / (1 - (width + 2) * UNIT)
    about = c2.astype(np.float64) - 2 * product  # the squared distance without |x|^2, which all entries share
    off = 2 * g * np.outer(x_norm, c_norm) * (1 + 2.0**-40) + (c2 + 2 * np.abs(product)) * 2.0**-48
    row, entry = np.nonzero(about - off <= (about + off).min(1, keepdims=True))
    exact = ((points[row] - entries[entry]) ** 2).sum(1)
    first = np.searchsorted(row, np.arange(len(points)))
    best = np.minimum.reduceat(exact, first) if len(points) else exact
    hits = np.flatnonzero(exact == best[row])  # rows ascend, and entries within a row
    chosen = hits[np.searchsorted(row[hits], np.arange(len(points)))]
    return entry[chosen], best


def _nearest_exact(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with Python integers, for components whose squares 64 bits cannot hold; distances come as objects."""
    p, e = points.astype(object), entries.astype(object)
    best = np.full(len(p), 0, np.int64)
    least = ((p - e[0]) ** 2).sum(1)
    for k in range(1, len(e)):
        d = ((p - e[k]) ** 2).sum(1)
        closer = (d < least).astype(bool)
        best[closer], least[closer] = k, d[closer]
    return best, least


class Codebooks:
    """``parts`` arrays of entries, each entries by width."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for book in self.entries for v in book.ravel()).encode()).hexdigest()

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (rows by parts) and the squared distance of each row, summed over parts."""
        found = [nearest(vectors[:, k * self.width : (k + 1) * self.width], book) for k, book in enumerate(self.entries)]
        wide = any(d.dtype == object for _, d in found) or safe_bound(vectors.shape[1]) < max(np.abs(vectors).max(initial=0), *(np.abs(b).max(initial=0) for b in self.entries))
        total = sum(d.astype(object) if wide else d for _, d in found)
        return np.stack([i for i, _ in found], axis=1), total

    def decode(self, indexes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[indexes[:, k]] for k, book in enumerate(self.entries)], axis=1)


def _vectors(part: pa.RecordBatch, width: int) -> np.ndarray:
    return integers(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(part.num_rows, width)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor empty and has finite components only, all below ``LARGEST``."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))  # a NaN is larger than any number
    return vectors.filter(F.coalesce((F.size(vector) > 0) & fine, F.lit(False)))


def fit(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, key: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """Codebooks of ``vectors``; None where no vector is usable.

    They start as the parts of the ``size`` rows with the smallest keys (null keys last; equal keys by their vectors), fewer if
    there are fewer rows. A round assigns every part of every row to the nearest entry (ties: the lower) and replaces each entry
    by floor(sum / count) of its parts; entries without any stay. The dimension is that of the row with the smallest key, and must
    be a multiple of ``parts``; vectors of another one take no part. To the driver go ``size`` rows, and for a round the sums of
    each entry's components, which are as many as a codebook has.
    """
    rows = usable(vectors, vector).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    first = rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(size).collect()
    if not first:
        return None
    dimension = len(first[0].v)
    if dimension % parts or not 0 < size <= 256:
        raise ValueError(f"vectors of {dimension} components have no {parts} equal parts, or {size} entries do not fit two hex digits")
    if any(len(r.v) != dimension for r in first):
        first = rows.filter(F.size("v") == dimension).orderBy(F.col("k").asc_nulls_last(), "v").limit(size).collect()
    start = integers(np.array([r.v for r in first], np.float64))
    books = Codebooks([part.copy() for part in np.split(start, parts, axis=1)])
    rows = rows.filter(F.size("v") == dimension).select("v")
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    shared = rows.sparkSession.sparkContext.broadcast(books)  # parts x entries x width numbers
    parts, size, width = len(books.entries), len(books.entries[0]), books.width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums and counts of each entry over all rows of a task, in Python's integers: one row for each entry with any."""
        books = shared.value
        count = np.zeros((parts, size), np.int64)
        total = np.zeros((parts, size, width), object)
        for batch in batches:
            vectors = _vectors(batch, parts * width)
            index, _ = books.encode(vectors)
            narrow = len(vectors) * np.abs(vectors).max(initial=0).astype(object) <= LONG
            for k in range(parts):
                count[k] += np.bincount(index[:, k], minlength=size)
                part = vectors[:, k * width : (k + 1) * width]
                added = np.zeros((size, width), np.int64 if narrow else object)
                np.add.at(added, index[:, k], part if narrow else part.astype(object))
                total[k] += added
        part, entry = np.nonzero(count)
        table = {"part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "n": pa.array(count[part, entry])}
        place = np.tile(np.arange(width, dtype=np.int32), len(part))
        flat = {name: column.take(pa.array(np.repeat(np.arange(len(part)), width))) for name, column in table.items()}
        numbers = [int(v) for v in total[part, entry].ravel()]
        yield pa.RecordBatch.from_pydict({**flat, "place": pa.array(place), "total": pa.array([str(v) for v in numbers], pa.string())})

    said = rows.mapInArrow(lean(sums), "part int, entry int, n long, place int, total string")
    moved = said.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    entries = [book.copy() for book in books.entries]
    for r in moved.collect():  # as many rows as the codebooks have numbers, at most
        entries[r.part][r.entry, r.place] = int(r.total) // r.n
    return Codebooks(entries)


def encode(vectors: DataFrame, books: Codebooks | None, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The usable rows of ``vectors`` with ``code`` (the entries' indexes in part order, two hex digits each) and ``error`` (their
    squared distances, summed; null where a long cannot hold it).

    Rows whose vector is null, empty, of another dimension, or has a component that is null, not finite or beyond 2**54 are left
    out. All other columns stay (older ones of the new names are replaced); repeated rows stay; an empty table, or one without a
    usable vector, gives an empty result.
    """
    kept = usable(vectors, vector).drop(code, error)
    made = fresh(kept, "v")
    if books is None:
        return kept.filter("false").withColumns({code: F.lit("").cast("string"), error: F.lit(0).cast("long")})
    dimension = books.width * len(books.entries)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields) + f"`{code}` string, `{error}` long"
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            rows = _vectors(pa.RecordBatch.from_arrays([batch.column(made)], names=["v"]), dimension)
            index, far = books.encode(rows)
            digits = index.astype(np.uint8).tobytes().hex()
            step = 2 * index.shape[1]
            codes = [digits[a : a + step] for a in range(0, len(digits), step)]
            errors = [int(d) if d <= LONG else None for d in far] if far.dtype == object else far
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*names, code, error])

    rows = kept.filter(F.size(vector) == dimension).withColumn(made, F.col(vector).cast("array<double>"))
    return rows.mapInArrow(lean(run), schema)


def total_by(rows: DataFrame, value: str, by: Sequence[str], to: str, broadcast_rows: int = 100_000) -> DataFrame:
    """Add to each row the sum of ``value`` over the rows that are equal in ``by`` (nulls are equal), null where it is beyond a long.

    Sums are made before the shuffle; they are joined back by broadcast if they are ``broadcast_rows`` at most, else by a join
    whose sides are freshly shuffled, so that a frequent key can be split. Null values make the sum null, as no long holds them.
    """
    names = [f"__by{k}" for k in range(len(by))]
    whole = F.sum(F.col(value).cast("decimal(38,0)"))
    fits = (F.count(value) == F.count(F.lit(1))) & (whole <= LONG)
    sums = stored(rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(F.when(fits, whole).cast("long").alias(to)), "sums")
    few = sums.limit(broadcast_rows + 1).count() <= broadcast_rows
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return rows.drop(to).join(F.broadcast(sums) if few else sums, same, "left").drop(*names)
