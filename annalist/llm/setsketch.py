"""MinHash near-dedup by SetSketch registers.

1. Every text becomes the set of its 5-word shingles and a sketch: register i holds floor(1 - log_b(x_i)), cut off at 0 and
   ``LAST``, where x_i is the least of exponential variates that the shingles draw for that register. The registers of a
   union are the maxima of the registers (``merge``), and the closer two sets, the more of their registers agree.
2. Texts with equal sets are one class from here on; a class is represented by its smallest doc_id.
3. Bands of eight register values are keys. In every band bucket, each class is paired with one leader (the class with the most
   copies), never with all others. Enough bands are used for a pair at the threshold to be missed with probability 1e-5.
4. A pair whose sizes, or whose jointly estimated similarity (by likelihood over the registers), rule the threshold out is
   dropped; the likelihood has to be e^-12.5 of its best, five standard errors. All others are verified on their full sets.
5. A bucket whose members the verified links leave in more than one component is settled exactly: its members meet in blocks of
   bounded size, each block pair a task of its own, first with their sketches. A pair counts in the first bucket that it shares,
   if it lies across components and sizes and likelihood leave it room. Members with such a pair meet once more with their full
   sets, and only a spanning forest of the links found leaves the task. So a pair that shares a bucket is never lost, whatever
   its leader, and no pair is compared that shares none.
6. Components of the links are found by star contraction, and every row takes the component of its class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import text as T
from annalist.llm.components import connected_components
from annalist.llm.shared import few_at_once, forget, lean, stored

BASE, RATE, LAST = 1.001, 20.0, 2**16 - 2
ROWS = 8
_RNG = np.random.default_rng(97)
_A = _RNG.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, 1024, dtype=np.uint64)
#: Shingles and rows of one side of a block pair.
BLOCK_SHINGLES, BLOCK_ROWS = 262_144, 512


def bands_for(percent: int, miss: float = 1e-5) -> int:
    """Bands with which a pair of that similarity is missed with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** ROWS))


def registers(shingles: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Sketches (texts x m, uint16) of non-empty sets; ``first``: where each set begins in ``shingles``, and the end."""
    out = np.zeros((len(first) - 1, m), np.uint16)
    i = 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(first, first[i] + 65_536)) - 1)
        part, at = shingles[first[i] : first[j]], first[i:j] - first[i]
        for k in range(m):
            least = np.minimum.reduceat(part * _A[k] + _B[k], at).astype(np.float64) / 2.0**64
            x = -np.log1p(-np.minimum(least + 2.0**-65, 1 - 2.0**-53)) / RATE
            out[i:j, k] = np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, LAST + 1)
        i = j
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)


def may_reach(more: np.ndarray, less: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray, percent: int, slack: float = 12.5) -> np.ndarray:
    """Whether the joint likelihood of the similarity J leaves room for J >= percent / 100.

    ``more``, ``less``: registers in which a is above, below b; ``n_a``, ``n_b``: set sizes.
    """
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :]
    feasible = np.minimum(j, np.minimum(u / v, v / u) - 1e-9)
    up, down = _chance(u - v * feasible), _chance(v - u * feasible)
    even = np.clip(1 - up - down, 1e-12, 1)
    like = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (m - more - less)[:, None] * np.log(even)
    return like[:, percent:].max(axis=1) >= like.max(axis=1) - slack


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def _sketcher(m: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("check", pa.int64()), ("sketch", pa.binary()), ("text_key", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = _bytes(part.column("text"))
            for a, b in T.batches(texts):
                sets, first = T.shingle_sets(texts[a:b])
                n = np.diff(first)
                full = n > 0
                sketch = np.zeros((b - a, m), np.uint16)
                keys = np.zeros((2, b - a), np.uint64)
                if full.any():
                    at = first[:-1][full]
                    sketch[full] = registers(sets, np.append(at, first[-1]), m)
                    for k in range(2):
                        keys[k, full] = T.mix(np.add.reduceat(T.mix(sets ^ _A[k]), at) + n[full].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(n), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array([s.tobytes() for s in sketch], pa.binary()), part.column("text_key").slice(a, b - a)],
                    schema=schema,
                )

    return lean(run), "doc_id long, n long, cid long, check long, sketch binary, text_key long"


def _band_keys(sketch: np.ndarray) -> np.ndarray:
    """The keys of the bands of each sketch."""
    wide = sketch.astype(np.uint64).reshape(len(sketch), -1, ROWS)
    h = np.tile(np.arange(1, wide.shape[1] + 1, dtype=np.uint64), (len(sketch), 1))
    for r in range(ROWS):
        h = T.mix(h * np.uint64(31) + wide[:, :, r])
    return h


def _sketches(column: pa.ChunkedArray | pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, m)


def _bander(m: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            keys = _band_keys(_sketches(part.column("sketch"), m))
            cid = np.repeat(part.column("cid").to_numpy(), keys.shape[1])
            copies = np.repeat(part.column("copies").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(cid), pa.array(copies)], names=["band", "cid", "copies"])

    return lean(run), "band long, cid long, copies long"


def _estimator(m: int, percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            a, b = (_sketches(part.column(c), m) for c in ("sketch_a", "sketch_b"))
            n_a, n_b = (part.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            keep = may_reach((a > b).sum(axis=1), (a < b).sum(axis=1), m, n_a, n_b, percent)
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return lean(run), "a long, b long"


def _set_maker(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        texts = _bytes(part.column("text"))
        for a, b in T.batches(texts):
            sets, first = T.shingle_sets(texts[a:b])
            n = np.diff(first)
            key = np.zeros(b - a, np.uint64)
            full = n > 0
            if full.any():
                key[full] = T.mix(np.add.reduceat(T.mix(sets ^ _A[0]), first[:-1][full]) + n[full].astype(np.uint64))
            cid = part.column("cid").slice(a, b - a).to_numpy()
            out = pa.RecordBatch.from_arrays([pa.array(cid), pa.array(n), pa.array([sets[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["cid", "n", "shingles"])
            yield out.filter(pa.array(key.view(np.int64) == cid))


def _verifier(percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = np.zeros(part.num_rows, bool)
            for i, (x, y) in enumerate(zip(part.column("shingles_a"), part.column("shingles_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return lean(run), "a long, b long"


def _common(sets: list[np.ndarray], n_left: int, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the first ``n_left`` sets with the others, in column blocks of bounded size."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    owner, column = owner[keep], np.cumsum(often)[column[keep]] - 1
    total = np.zeros((n_left, len(sets) - n_left), np.float32)
    for lo in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[a:b], column[a:b] - lo] = 1
        total += grid[:n_left] @ grid[n_left:].T
    return total.astype(np.int64)


def _buckets(classes: DataFrame, m: int) -> DataFrame:
    """(band, a, b): the members b of the band buckets that more than one class shares, each with the leader a of its bucket."""
    bands = classes.select("cid", "copies", "sketch").mapInArrow(*_bander(m))
    heads = bands.groupBy("band").agg(F.max(F.struct("copies", "cid")).alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return bands.join(heads, "band").select("band", F.col("head.cid").alias("a"), F.col("cid").alias("b"))


def _sides(block: pa.Table) -> tuple[pa.Table, int]:
    """The rows of a block pair, those of the left block first, and how many these are."""
    right = block.column("right").to_numpy(zero_copy_only=False)
    return block.take(pa.array(np.argsort(right, kind="stable"))).combine_chunks(), int((~right).sum())


def _hopeful_rows(m: int, percent: int):
    def run(block: pa.Table) -> pa.Table:
        """The rows of a block pair that have a hopeful pair across it: in its first shared band, and of different components."""
        block, n_left = _sides(block)
        hope = np.zeros(block.num_rows, bool)
        if 0 < n_left < block.num_rows:
            sketch = _sketches(block.column("sketch"), m)
            keys, here = _band_keys(sketch), block.column("band")[0].as_py()
            comp, n = block.column("comp").to_numpy(), block.column("n").to_numpy().astype(float)
            band = int(np.flatnonzero(keys[0].view(np.int64) == here)[0])
            for i in range(n_left):
                ahead = (comp[n_left:] != comp[i]) & (100 * np.minimum(n[i], n[n_left:]) >= percent * np.maximum(n[i], n[n_left:]))
                ahead &= ~(keys[n_left:, :band] == keys[i, :band]).any(axis=1)
                j = n_left + np.flatnonzero(ahead)
                if len(j):
                    near = may_reach((sketch[i] > sketch[j]).sum(axis=1), (sketch[i] < sketch[j]).sum(axis=1), m, np.full(len(j), n[i]), n[j], percent)
                    hope[i] |= near.any()
                    hope[j[near]] = True
        kept = block.filter(pa.array(hope))
        return kept.select(["band", "left", "kind", "at", "right", "cid", "comp"])

    return run


def _block_linker(percent: int):
    def run(block: pa.Table) -> pa.Table:
        """The links between the left and the right rows of a block pair that join different components, as a forest."""
        block, n_left = _sides(block)
        found: list[tuple[int, int]] = []
        if 0 < n_left < block.num_rows:
            cid, comp, n = (block.column(c).to_numpy() for c in ("cid", "comp", "n"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("shingles").combine_chunks()]
            common = _common(sets, n_left)
            near = 100 * common >= percent * (n[:n_left, None] + n[None, n_left:] - common)
            near &= comp[:n_left, None] != comp[None, n_left:]
            root = {int(c): int(c) for c in comp}
            for i, j in zip(*np.nonzero(near), strict=True):
                x, y = (int(comp[k]) for k in (i, n_left + j))
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append((int(cid[i]), int(cid[n_left + j])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _block_pairs(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (band, cid, comp, n) once for each block pair in which they meet the other components of their bucket.

    The largest component of a bucket is met by the rest only, and the rest by itself as well. Buckets of one component are left out.
    """
    by_comp = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    blocks = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    plan = (
        by_comp.groupBy("band")
        .agg(F.max(F.struct("rows", "comp", "shingles")).alias("top"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.count(F.lit(1)).alias("comps"))
        .filter("comps > 1")
        .select(
            "band",
            F.col("top.comp").alias("main"),
            blocks(F.col("top.rows"), F.col("top.shingles")).alias("main_blocks"),
            blocks(F.col("rows") - F.col("top.rows"), F.col("shingles") - F.col("top.shingles")).alias("rest_blocks"),
        )
    )
    placed = members.join(plan, "band").withColumn("is_main", F.col("comp") == F.col("main"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda left, kind, right, is_right: F.struct(left.alias("left"), F.lit(kind).alias("kind"), right.alias("at"), F.lit(is_right).alias("right"))
    here = F.col("block")
    tasks = F.when(F.col("is_main"), F.transform(upto(F.col("rest_blocks")), lambda i: pair(i, "main", here, True))).otherwise(
        F.concat(
            F.transform(upto(F.col("main_blocks")), lambda j: pair(here, "main", j, False)),
            F.transform(F.filter(upto(F.col("rest_blocks")), lambda j: j >= here), lambda j: pair(here, "rest", j, False)),
            F.transform(F.filter(upto(F.col("rest_blocks")), lambda i: i <= here), lambda i: pair(i, "rest", here, True)),
        )
    )
    return placed.select("band", "cid", "comp", "n", F.explode(tasks).alias("task")).select("band", "cid", "comp", "n", "task.*")


def _residual_links(members: DataFrame, links: DataFrame, classes: DataFrame, sets: DataFrame, m: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Exact links across the components that the verified links leave in a bucket (``members``: band, cid, n), and the stored
    rows of hopeful pairs that they are made from."""
    comps = connected_components(links).select(F.col("node").alias("cid"), F.col("root").alias("comp"))
    members = members.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    task = ["band", "left", "kind", "at"]
    rows = _block_pairs(members).join(classes.select("cid", "sketch"), "cid").select(*task, "right", "cid", "comp", "n", "sketch")
    hopeful = rows.groupBy(*task).applyInArrow(_hopeful_rows(m, percent), "band long, left int, kind string, at int, right boolean, cid long, comp long")
    hopeful = stored(hopeful, "hopeful")
    rows = hopeful.join(sets, "cid").select(*task, "right", "cid", "comp", "n", "shingles")
    return rows.groupBy(*task).applyInArrow(_block_linker(percent), "a long, b long"), hopeful


def near_components(docs: DataFrame, percent: int = 80, text_key: bool = False) -> DataFrame:
    """Group the rows of ``docs`` (doc_id long, text) whose shingle sets reach a Jaccard similarity of ``percent`` / 100.

    Returns a row for each row: doc_id, n_shingles, component_id (smallest doc_id that can be reached over links), kept
    (doc_id = component_id). Words: runs of anything but 0x20 and 0x09-0x0D, A-Z lower-cased. A text of one to four words is
    one shingle; a null or empty text has no shingle, no link and itself as component. Equal texts and repeated rows are one
    class. Rows that share a doc_id are rows of their own; a null doc_id never names a component that has another id, and of a
    component of null ids only, the rows of one class are kept. With ``text_key``, the column text_key (xxhash64 of the text)
    tells rows that share a doc_id apart, and family is one number for each component (null without words). Other columns are ignored; an empty table gives an empty result. Whole texts are used, of any length.
    """
    m = ROWS * bands_for(percent)
    source = few_at_once(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    rows = stored(source.mapInArrow(*_sketcher(m)), "sketches")
    classes = rows.filter("n > 0").groupBy("cid", "check", "n").agg(F.min("doc_id").alias("rep"), F.min("text_key").alias("rep_key"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "classes")
    members = stored(_buckets(classes, m), "buckets")
    stars = stored(members.select("a", "b").filter("a <> b").distinct(), "stars")

    wanted = members.select(F.col("b").alias("cid")).distinct().join(classes.select("cid", F.col("rep").alias("doc_id"), "rep_key"), "cid")
    sets = source.join(wanted.filter("doc_id IS NOT NULL").drop("rep_key"), "doc_id").select("cid", "text")
    # a class of null ids only has its text by the key of one of its texts
    nameless = source.filter("doc_id IS NULL").join(wanted.filter("doc_id IS NULL").select("cid", F.col("rep_key").alias("text_key")), "text_key").select("cid", "text")
    sets = sets.unionByName(nameless).mapInArrow(lean(_set_maker), "cid long, n long, shingles binary")
    sets = stored(sets.groupBy("cid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "sets")

    side = lambda x, cols: [F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols]]
    narrow = classes.select("cid", "n", "sketch")
    likely = stars.join(narrow.select(*side("a", ["n", "sketch"])), "a").join(narrow.select(*side("b", ["n", "sketch"])), "b")
    likely = likely.filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").mapInArrow(*_estimator(m, percent))
    verified = likely.join(sets.select(*side("b", ["shingles"])), "b").join(sets.select(*side("a", ["shingles"])), "a").mapInArrow(*_verifier(percent))
    verified = stored(verified, "verified")
    sized = members.select("band", F.col("b").alias("cid")).join(classes.select("cid", "n"), "cid")
    residual, hopeful = _residual_links(sized, verified, classes, sets, m, percent)

    parts = stored(connected_components(verified.unionByName(residual)).select(F.col("node").alias("cid"), F.col("root").alias("comp")), "parts")
    least = parts.join(classes.select("cid", "rep"), "cid").groupBy("comp").agg(F.min("rep").alias("component_id"), F.min("cid").alias("first"))
    named = parts.join(least, "comp").select("cid", "component_id", "first")
    by_class = classes.join(named, "cid", "left").select("cid", F.coalesce("component_id", "rep").alias("component_id"), (F.col("cid") == F.coalesce("first", "cid")).alias("leads"), F.coalesce("first", "cid").alias("family"))
    by_class = stored(by_class, "named")
    forget(classes, members, stars, sets, verified, hopeful, parts)
    found = (
        rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid"), "text_key")
        .join(by_class, "cid", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "leads", "text_key", "family")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("doc_id").isNotNull() | F.coalesce("leads", F.lit(True))))
    )
    return found.select("doc_id", "n_shingles", "component_id", "kept", *(["text_key", "family"] if text_key else []))
