"""An index of keys that only grows: sorted runs, split by key prefix, each prefix with a Bloom filter.

A lookup reads of each run the filters of the prefixes that its keys have, and then the keys of those prefixes alone whose filter
does not rule all of them out. A prefix of which it has many keys is read without its filter, which would hardly rule out all.
A prefix holds at most a fixed number of keys, as larger runs have longer prefixes, and runs of a size are merged into one of the
next, so there are few: what a lookup reads depends on its own keys and not on the index.

A filter is made of blocks of eight words. A key has one block and one bit in each of its words, so it is one row when filters
are written and when they are asked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.sources.commits import CommitLog, Snapshot

#: Keys of one prefix, about; a run of fewer keys is not split and has no filter.
PREFIX_KEYS = 1 << 18
#: Bits for each key, and words of a block: one or two absent keys in ten thousand pass a filter.
BITS, WORDS = 20, 8
#: Keys of one prefix in a lookup beyond which its filter is not asked.
MANY = 1_000
#: Runs of one level that become one of the next.
FANOUT = 8
HEX = 16


def key_of(*columns: Column) -> Column:
    """The key of a row: the SHA-256 of its columns, with their lengths, so that no two rows share one by chance or by design."""
    text = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*text), 256))


@dataclass
class Reads:
    """Prefixes whose filters and keys a lookup has read, of how many there are."""

    filters: int = 0
    keys: int = 0
    prefixes: int = 0
    whole_runs: int = 0


class Runs:
    """The runs of a table of a commit log: ``key`` (binary) and the columns of ``values`` (a schema, may be empty).

    Of a key that several runs hold, the one with the greatest ``newest`` counts (a column of values; None: they are equal).
    """

    def __init__(self, log: CommitLog, table: str, values: str = "", newest: str | None = None, prefix_keys: int = PREFIX_KEYS, fanout: int = FANOUT):
        self.log, self.table, self.newest, self.prefix_keys, self.fanout = log, table, newest, prefix_keys, fanout
        self.schema = "key binary" + (f", {values}" if values else "")
        self.columns = [f.split()[0] for f in values.split(",")] if values else []
        self.reads = Reads()

    def _prefix(self, depth: int) -> Column:
        return F.concat(F.lit("p"), F.substring(F.hex("key"), 1, depth))

    @staticmethod
    def _block(blocks: int) -> Column:
        """The block of a key in a filter of ``blocks``."""
        return F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")

    @staticmethod
    def _marks() -> list[Column]:
        """A key's bit in each word of its block."""
        places = F.xxhash64("key", F.lit(1))
        return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(places, 6 * i).bitwiseAND(F.lit(63)).cast("int")).alias(f"m{i}") for i in range(WORDS)]

    def stage(self, rows: DataFrame, count: int) -> dict:
        """Write a run of ``count`` rows (distinct keys) to a waiting folder."""
        depth = 0
        while count > self.prefix_keys * HEX**depth:
            depth += 1
        blocks = 1 + BITS * (count // HEX**depth + 1) * 5 // 4 // (64 * WORDS)

        def write(path: str) -> None:
            kept = rows.select("key", *self.columns)
            if not depth:
                kept.coalesce(1).write.parquet(f"{path}/keys")
                return
            kept = kept.withColumn("prefix", self._prefix(depth))
            kept.repartition("prefix").sortWithinPartitions("prefix", "key").write.partitionBy("prefix").parquet(f"{path}/keys")
            again = self.log.spark.read.schema("key binary, prefix string").parquet(f"{path}/keys")
            marks = again.select("prefix", self._block(blocks), *self._marks())
            filters = marks.groupBy("prefix", "block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])
            filters.repartition("prefix").sortWithinPartitions("prefix", "block").write.partitionBy("prefix").parquet(f"{path}/blocks")

        level, least = 0, self.fanout
        while count >= least:
            level, least = level + 1, least * self.fanout
        return self.log.stage(self.table, write, rows=count, depth=depth, blocks=blocks, level=level)

    def find(self, keys: DataFrame, snapshot: Snapshot) -> DataFrame:
        """The rows (key and values) of the keys in ``keys`` (distinct) that the index has. ``keys`` is read several times."""
        self.reads = Reads()
        found = []
        runs = snapshot.tables.get(self.table, [])
        whole = [f"{self.log.folder(self.table, r['id'])}/keys" for r in runs if not r["depth"]]
        if whole:
            self.reads.whole_runs = len(whole)
            found.append(self.log.spark.read.schema(self.schema).parquet(*whole))
        deepest = max((r["depth"] for r in runs), default=0)
        asked = {}
        if deepest:  # as many as the largest run has prefixes, at most
            asked = {r.prefix: r["count"] for r in keys.groupBy(self._prefix(deepest).alias("prefix")).count().collect()}
        for r in runs:
            if r["depth"] and (rows := self._in_run(r, keys, asked)) is not None:
                found.append(rows)
        if not found:
            return self.log.spark.createDataFrame([], self.schema)
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        out = out.join(keys.select("key"), "key", "left_semi")
        return self._latest(out) if len(found) > 1 or len(whole) > 1 else out

    def _latest(self, rows: DataFrame) -> DataFrame:
        if not self.columns:
            return rows.distinct()
        value = F.struct(*self.columns)
        best = F.max_by(value, self.newest) if self.newest else F.first(value)
        return rows.groupBy("key").agg(best.alias("v")).select("key", *[F.col(f"v.{c}").alias(c) for c in self.columns])

    def _in_run(self, run: dict, keys: DataFrame, asked: dict[str, int]) -> DataFrame | None:
        """The keys of the prefixes that may hold some of ``keys``; ``asked``: how many these have of each (longer) prefix."""
        folder = self.log.folder(self.table, run["id"])
        counts: dict[str, int] = {}
        for prefix, n in asked.items():
            counts[prefix[: 1 + run["depth"]]] = counts.get(prefix[: 1 + run["depth"]], 0) + n
        open_ = [p for p, n in counts.items() if n > MANY or "blocks" not in run]  # runs of before have filters of another form
        few = [p for p in counts if p not in set(open_)]
        if few:
            names = [f"w{i}" for i in range(WORDS)]
            filters = self.log.spark.read.schema(f"block bigint, {', '.join(f'{w} bigint' for w in names)}, prefix string").parquet(f"{folder}/blocks").filter(F.col("prefix").isin(few))
            probes = keys.select(self._prefix(run["depth"]).alias("prefix"), self._block(run["blocks"]), *self._marks()).filter(F.col("prefix").isin(few))
            maybe = probes.join(filters, ["prefix", "block"])
            for i in range(WORDS):
                maybe = maybe.filter(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) != 0)
            open_ += [r.prefix for r in maybe.select("prefix").distinct().collect()]
        self.reads.filters += len(few)
        self.reads.keys += len(open_)
        self.reads.prefixes += HEX ** run["depth"]
        if not open_:
            return None
        return self.log.spark.read.schema(f"{self.schema}, prefix string").parquet(f"{folder}/keys").filter(F.col("prefix").isin(open_)).drop("prefix")

    def all(self, snapshot: Snapshot) -> DataFrame:
        """Every key with its newest values."""
        runs = snapshot.tables.get(self.table, [])
        if not runs:
            return self.log.spark.createDataFrame([], self.schema)
        return self._latest(self._read(runs))

    def _read(self, runs: list[dict]) -> DataFrame:
        out = None
        for r in runs:  # one by one, as folders with and without prefixes cannot be read together
            rows = self.log.spark.read.schema(self.schema).parquet(f"{self.log.folder(self.table, r['id'])}/keys").select("key", *self.columns)
            out = rows if out is None else out.unionByName(rows)
        return out

    def merge(self) -> int:
        """Merge runs of a level that has ``fanout`` of them, in commits of their own; returns how many merges were done. One that
        another writer overtakes is left for the next time."""
        done = 0
        while True:
            now = self.log.snapshot()
            levels: dict[int, list[dict]] = {}
            for r in now.tables.get(self.table, []):
                levels.setdefault(r["level"], []).append(r)
            full = next((runs for _, runs in sorted(levels.items()) if len(runs) >= self.fanout), None)
            if full is None:
                return done
            merged = self._latest(self._read(full))
            scratch = self.log.scratch()
            try:
                merged.write.parquet(scratch)
                merged = self.log.spark.read.schema(self.schema).parquet(scratch)
                run = self.stage(merged, merged.count())
            finally:
                self.log.files.delete(scratch)
            run["level"] = max(run["level"], full[0]["level"] + 1)
            if not self.log.commit(now, {self.table: [run]}, {self.table: [r["id"] for r in full]}):
                self.log.abandon({self.table: [run]})
                return done
            done += 1
