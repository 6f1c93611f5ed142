"""An inverted-file index over vectors: cells around centres, a search of the nearest cells, and a bound that tells what it may miss."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import text as X
from annalist.operators.lineage import cut

#: Rows that centres are fitted on, at most; every row is assigned and searched.
SAMPLE = 65_536
#: Rows that go to the driver to see how many cells a search has to look at.
TRIED = 4_096
#: Rows of a cell that one task looks at; a cell of more is split by key.
CELL_ROWS = 100_000


@dataclass
class Cells:
    """Unit centres (cells by dimension), for each cell its rows and the widest angle between a row and the centre, and how many cells
    a search has to look at."""

    centres: np.ndarray
    rows: np.ndarray
    angle: np.ndarray
    probes: int


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a direction: not null, finite, and not all zero."""
    norm = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return vectors.filter((F.size(vector) > 0) & (norm > 0) & (norm < float("inf")))


def _scores(df: DataFrame, vector: str, centres: np.ndarray, how, schema: str) -> DataFrame:
    """Every row of ``df`` (``vector``: array of double) with what ``how`` makes of its cosines to the centres (rows by cells)."""
    shared = df.sparkSession.sparkContext.broadcast(centres)  # cells x dimension numbers
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            x = b.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, c.shape[1])
            made = how((x / np.linalg.norm(x, axis=1, keepdims=True)) @ c.T)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *made.values()], names=[*names, *made])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)
    return df.mapInArrow(run, fields + schema)


def fit_cells(vectors: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Cells | None:
    """Cells for ``vectors``: centres by k-means over the ``sample`` rows with the smallest key hashes, then one pass over all rows
    for the size and width of each cell. None where no vector is usable.

    ``cells``: the square root of the sampled rows by default. To the driver go the centres, two numbers for each, and ``TRIED`` of
    the sampled rows.
    """
    rows = usable(vectors, vector).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    some = Normalizer(inputCol="raw", outputCol="features").transform(rows.orderBy(F.xxhash64("k"), "k").limit(sample).select(array_to_vector("v").alias("raw"))).persist()
    try:
        n = some.count()
        if not n:
            return None
        model = KMeans(k=max(1, min(cells or int(np.sqrt(n)), n)), seed=seed, maxIter=10, tol=0.0).fit(some)
        few = np.array([r.x for r in some.select(vector_to_array("features").alias("x")).limit(TRIED).collect()])
    finally:
        some.unpersist()
    centres = np.array(model.clusterCenters())
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = (centres / np.where(norm > 0, norm, 1.0))[norm[:, 0] > 0] if (norm > 0).any() else np.eye(1, centres.shape[1])
    placed = assign(rows, centres, "v").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("low"))
    size, low = np.zeros(len(centres), np.int64), np.ones(len(centres))
    for r in placed.collect():  # one row for each cell
        size[r.cell], low[r.cell] = r.n, r.low
    return Cells(centres, size, np.arccos(np.clip(low, -1.0, 1.0)), _probes(few, centres))


def _probes(some: np.ndarray, centres: np.ndarray, queries: int = 256, k: int = 10, share: float = 0.97) -> int:
    """How many nearest cells hold ``share`` of the ``k`` nearest rows, tried among a few rows; those of all rows are nearer and need no more."""
    asked = some[:queries]
    near = asked @ some.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2.0
    best = np.argsort(-near, axis=1)[:, : min(k, len(some) - 1)]
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # the place of each cell among a query's nearest
    home = (some @ centres.T).argmax(1)
    places = np.sort(np.take_along_axis(order, home[best], axis=1).ravel())
    return int(places[min(len(places) - 1, int(share * len(places)))]) + 1 if len(places) else 1


def assign(rows: DataFrame, centres: np.ndarray, vector: str) -> DataFrame:
    """Add cell (the centre with the greatest cosine; ties: the first) and cosine to rows of usable vectors (arrays of double)."""

    def how(s: np.ndarray) -> dict[str, pa.Array]:
        best = s.argmax(1)
        return {"cell": pa.array(best.astype(np.int32)), "cosine": pa.array(s[np.arange(len(s)), best])}

    return _scores(rows, vector, centres, how, "cell int, cosine double")


#: Products of one matrix multiplication, and how far its cosines may be from those that are rounded to nine places, with room.
PRODUCTS, ROOM = 1 << 22, 4e-9


def best_of_block(asked: pa.Table, stored: pa.Table, k: int) -> pa.Table:
    """(query, key, similarity) of what may be among the ``k`` best of a block for each query: at the ``k``-th best cosine or above, but
    for rounding to nine places; of equal cosines, the ``k`` least keys.

    ``asked``: query, q, q_length; ``stored``: key, v, v_length (vectors, in the order of the file). Cosines are screened by matrix
    products, and those that are left are summed component by component, as Spark's fold does.
    """
    matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
    plain = lambda c: c.combine_chunks().to_numpy(zero_copy_only=False)
    empty = pa.table({"query": asked["query"].slice(0, 0), "key": stored["key"].slice(0, 0), "similarity": pa.array([], pa.float64())})
    if not len(asked) or not len(stored):
        return empty
    stored = stored.take(pa.array(np.argsort(plain(stored["key"]), kind="stable")))
    q, v, names, keys = matrix(asked["q"]), matrix(stored["v"]), plain(asked["query"]), plain(stored["key"])
    q_length, v_length = plain(asked["q_length"]), plain(stored["v_length"])
    units, step = (v / v_length[:, None]).T, max(1, PRODUCTS // len(v))
    at_query, at_row, found = [], [], []
    for start in range(0, len(q), step):
        s = (q[start : start + step] / q_length[start : start + step, None]) @ units
        s[names[start : start + step, None] == keys[None, :]] = -4.0
        least = np.partition(s, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(s), -2.0)
        for i, (row, low) in enumerate(zip(s, np.maximum(least - ROOM, -2.0), strict=True), start):
            near = np.flatnonzero(row >= low)
            exact = np.concatenate([np.empty(0), *[np.add.accumulate(q[i] * v[part], axis=1)[:, -1] for part in np.array_split(near, len(near) // 65_536 + 1)]]) / (q_length[i] * v_length[near])
            order = np.argsort(-exact, kind="stable")
            ranked = exact[order]
            starts = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
            place = np.arange(len(ranked)) - np.maximum.accumulate(np.where(starts, np.arange(len(ranked)), 0))
            order = order[place < k]
            at_query.append(np.full(len(order), i))
            at_row.append(near[order])
            found.append(exact[order])
    return pa.table({"query": asked["query"].take(pa.array(np.concatenate(at_query))), "key": stored["key"].take(pa.array(np.concatenate(at_row))), "similarity": pa.array(np.concatenate(found), pa.float64())})


def block_best(asked: DataFrame, stored: DataFrame, key: str, k: int, by: list[str]) -> DataFrame:
    """(query, key, similarity rounded to nine places): what may be among the ``k`` best, of each block (``by``) on its own."""
    kind = stored.schema[key].dataType.simpleString()
    left = asked.select(*by, "query", "q", "q_length").groupBy(*by)
    right = stored.select(*by, F.col(key).alias("key"), "v", "v_length").groupBy(*by)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return best_of_block(a, b, k)

    met = left.cogroup(right).applyInArrow(run, f"query {asked.schema['query'].dataType.simpleString()}, key {kind}, similarity double")
    return met.select("query", F.col("key").alias(key), F.round("similarity", 9).alias("similarity"))


def query_parts(queries: DataFrame, part_rows: int) -> int:
    """In how many parts queries are dealt, so that a block and a part are of bounded size."""
    return max(1, -(-queries.count() // part_rows))


def _ranked(df: DataFrame, k: int, key: str, *by: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.col("similarity").desc(), key))
    return df.withColumn("rank", place).filter(F.col("rank") <= k)


def search(queries: DataFrame, vectors: DataFrame, index: Cells | None, key: str, vector: str, k: int = 10, probes: int | None = None, exact: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The ``k`` most similar vectors (cosine) for each query, itself left out: (query, key, similarity, rank, certain).

    The ``probes`` cells with the nearest centres are searched (by default as many as the index found to be needed), every row of theirs; cells of more than ``cell_rows`` rows are
    split by key, so that a frequent vector is no single task. ``certain``: no row of another cell can be better, as a cell's
    rows lie within its widest angle of the centre. With ``exact``, the cells that might hold a better one are searched as well, so the
    answer is that of all rows; without, queries that are not certain may miss some (the tests measure how many).

    Queries need distinct keys. Vectors that are null, zero or not finite take no part. Ties go to the lesser key.
    """
    kind = queries.schema[key].dataType.simpleString()
    if index is None:
        return queries.sparkSession.createDataFrame([], f"query {kind}, `{key}` {kind}, similarity double, rank int, certain boolean")
    rows = usable(vectors, vector).select(F.col(key), F.col(vector).cast("array<double>").alias("v"))
    asked = usable(queries, vector).select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("q"))
    probes = min(probes or index.probes, len(index.centres))
    blocks = np.maximum(1, -(-index.rows // cell_rows))

    def near(s: np.ndarray) -> dict[str, pa.Array]:
        """Nearest cells, and the best cosine that a row of each cell could have."""
        first = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        gap = np.maximum(0.0, np.arccos(np.clip(s, -1.0, 1.0)) - index.angle)
        bound = np.where(index.rows > 0, np.cos(gap), -2.0) + 1e-9
        return {"near": pa.array(first.astype(np.int32).tolist(), pa.list_(pa.int32())), "bound": pa.array(bound.tolist(), pa.list_(pa.float64()))}

    parts = query_parts(queries, cell_rows)
    length = lambda c: F.sqrt(X.dot(F.col(c), F.col(c)))
    asked = _scores(asked, "q", index.centres, near, "near array<int>, bound array<double>").withColumn("q_length", length("q"))
    spread = F.array(*[F.lit(int(b)) for b in blocks])
    block = F.pmod(F.xxhash64(key), F.element_at(spread, F.col("cell") + 1)).cast("int")
    stored = assign(rows, index.centres, "v").drop("cosine").withColumns({"block": block, "v_length": length("v")})

    def found(cells: DataFrame) -> DataFrame:
        """The best of each block, then of each query; ``cells``: query, q, q_length, cell."""
        wanted = cells.withColumns({"block": F.explode(F.sequence(F.lit(0), F.element_at(spread, F.col("cell") + 1) - 1)), "part": F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")})
        dealt = stored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return _ranked(block_best(wanted, dealt, key, k, ["cell", "block", "part"]), k, key, "query")

    first = cut(found(asked.select("query", "q", "q_length", F.explode("near").alias("cell"))))
    last = first.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).otherwise(-2.0).alias("least"))
    judged = asked.join(last, "query", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    left = F.filter(F.sequence(F.lit(0), F.lit(len(index.centres) - 1)), lambda c: (F.element_at("bound", c + 1) >= F.col("least")) & ~F.array_contains("near", c))
    left = judged.select("query", "q", "q_length", left.alias("left"))
    if exact:
        more = found(left.select("query", "q", "q_length", F.explode("left").alias("cell")))
        first = _ranked(first.drop("rank").unionByName(more.drop("rank")), k, key, "query")
        return first.withColumn("certain", F.lit(True)).select("query", key, "similarity", "rank", "certain")
    return first.join(left.select("query", (F.size("left") == 0).alias("certain")), "query").select("query", key, "similarity", "rank", "certain")
