"""Exact dedup by an extendible-hash index kept in files that all executors share.

1. Each text is lower-cased (A-Z) and keyed by 64 bits. The distinct keys are counted by their first ``max_depth`` bits.
2. The directory: buckets start as one; a bucket with more than ``capacity`` keys is split in two by its next bit, and the
   directory doubles when that bit is beyond its depth. A slot of the directory leads to a bucket, and a bucket is a key range.
3. Tasks look each text's slot up, combine the equal texts that they meet, and send one entry for each to the owner of its
   bucket. Owners walk their buckets in the order of keys. Entries with one key are chained: an entry is compared byte by byte
   with the texts of the chain, and joins the one it equals or ends the chain. A chain says what stays of each text, and the
   owner writes it as index pages. An owner holds the chain of one key at a time, and a text copied a billion times reaches it
   as a few entries from each task.
4. Every row goes through its slot and bucket to the chain of its key. Where a chain holds several texts, the digest tells which.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.shared import ascii_lower, few_at_once, lean, stored

#: Bytes of texts that a task combines at once.
WINDOW = 2 << 20


def directory(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[tuple[int, int, int]]]:
    """(global depth, [(slot, bucket, local depth)]) for key counts by ``max_depth``-bit prefix.

    At most 2 ** max_depth slots. A bucket that is overfull at ``max_depth`` keeps its keys (an overflow page).
    """
    below = [0] * ((1 << max_depth) + 1)
    for slot in range(1 << max_depth):
        below[slot + 1] = below[slot] + counts.get(slot, 0)
    leaves, todo, depth = [], [(0, 0)], 0
    while todo:
        prefix, local = todo.pop()
        width = max_depth - local
        n = below[(prefix + 1) << width] - below[prefix << width]
        if n > capacity and local < max_depth:
            depth = max(depth, local + 1)
            todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        else:
            leaves.append((prefix, local))
    slots = []
    for bucket, (prefix, local) in enumerate(leaves):
        spread = depth - local
        slots += [(slot, bucket, local) for slot in range(prefix << spread, (prefix + 1) << spread)]
    return depth, slots


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")


def _more(a, b):
    """The larger of two ids; a null one loses."""
    return b if a is None else a if b is None else max(a, b)


def _combine(kind: pa.DataType):
    schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("norm", pa.binary()), ("keep_id", kind), ("group_size", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One entry for each text of a window of rows."""
        held: dict[bytes, list] = {}
        size = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*((bucket, key, norm, keep, n) for norm, (bucket, key, keep, n) in held.items()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for part in parts:
            columns = (part.column("bucket"), part.column("key"), pc.cast(part.column("norm"), pa.binary()), part.column("doc_id"))
            for bucket, key, norm, doc in zip(*(c.to_pylist() for c in columns), strict=True):
                entry = held.get(norm)
                if entry:
                    entry[2], entry[3] = _more(entry[2], doc), entry[3] + 1
                else:
                    held[norm] = [bucket, key, doc, 1]
                    size += len(norm)
            if size > WINDOW:
                yield batch()
                held.clear()
                size = 0
        if held:
            yield batch()

    return lean(run)


def _own(kind: pa.DataType):
    schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("chained", pa.int32()), ("digest", pa.string()), ("keep_id", kind), ("group_size", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages of the buckets of a task, whose entries come in the order of bucket and key."""
        at: tuple | None = None
        chain: dict[bytes, list] = {}
        pages: list[tuple] = []

        def close() -> None:
            by_digest = sorted(((hashlib.sha256(norm).hexdigest(), keep, n) for norm, (keep, n) in chain.items()), key=lambda x: x[0])
            pages.extend((*at, k, len(by_digest), *x) for k, x in enumerate(by_digest, 1))

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pages, strict=True), schema, strict=True)], schema=schema)
            pages.clear()
            return out

        for part in parts:
            for bucket, key, norm, keep, n in zip(*(part.column(c).to_pylist() for c in ("bucket", "key", "norm", "keep_id", "group_size")), strict=True):
                if (bucket, key) != at:
                    if at:
                        close()
                    at = (bucket, key)
                    chain = {}
                met = chain.get(norm)  # equal hash of the text, then equal bytes
                if met:
                    met[0], met[1] = _more(met[0], keep), met[1] + n
                else:
                    chain[norm] = [keep, n]
            if pages:
                yield batch()
        if at:
            close()
            yield batch()

    return lean(run)


def build_index(docs: DataFrame, capacity: int = 1_000, max_depth: int = 16, key: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, text) as (doc_id, norm, key, bucket), and the directory and pages of the index written for them.

    Pages: bucket, key, chain (position among the texts of one key, from 1), chained (how many texts these are), digest, keep_id,
    group_size. The driver holds at most 2 ** max_depth counts and slots (65,536 by default), whatever the input.
    """
    spark = docs.sparkSession
    keyed = few_at_once(docs).select("doc_id", ascii_lower(F.col("text")).alias("norm")).withColumn("key", key(F.col("norm")))
    found = keyed.select("key").distinct().groupBy(_prefix(max_depth).alias("slot")).count()
    depth, slots = directory({r[0]: r[1] for r in found.collect()}, capacity, max_depth)
    folder = stored(spark.createDataFrame(slots, "slot long, bucket int, local_depth int").coalesce(1), "exact-directory")
    routed = keyed.withColumn("slot", _prefix(depth)).join(F.broadcast(folder.select("slot", "bucket")), "slot")  # at most 2 ** max_depth rows
    rows = routed.select("doc_id", "norm", "key", "bucket")

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = docs.limit(0).select("doc_id").toArrow().schema.field(0).type
    entries = rows.mapInArrow(_combine(kind), f"bucket int, key long, norm binary, keep_id {id_type}, group_size long")
    owned = entries.repartition("bucket").sortWithinPartitions("bucket", "key")
    pages = owned.mapInArrow(_own(kind), f"bucket int, key long, chain int, chained int, digest string, keep_id {id_type}, group_size long")
    return rows, folder, stored(pages, "exact-pages")


def exact_duplicates(docs: DataFrame, capacity: int = 1_000, max_depth: int = 16, key: Callable[[Column], Column] = F.xxhash64, broadcast_keys: int = 1_000_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Null and empty texts are one group. Of equal texts the row with the largest doc_id stays (rows that share this doc_id all
    stay: they cannot be told apart); null ids lose to any other, and a group of null ids keeps them all. Other columns are
    ignored; an empty table gives an empty result. ``key``: the hash of a text (long); texts that collide are told apart.
    """
    rows, _, pages = build_index(docs, capacity, max_depth, key)
    crowded = pages.filter("chain = 2").select(F.col("key").alias("crowded"))
    crowded = F.broadcast(crowded) if crowded.count() <= broadcast_keys else crowded
    asked = rows.join(crowded, F.col("key") == F.col("crowded"), "left")
    asked = asked.select("doc_id", "bucket", "key", F.when(F.col("crowded").isNotNull(), F.sha2("norm", 256)).alias("own_digest"))
    found = asked.join(pages, ["bucket", "key"]).filter((F.col("chained") == 1) | (F.col("own_digest") == F.col("digest")))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "bucket",
        "chain",
    )
