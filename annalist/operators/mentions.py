"""Names in texts: all places of many names at once, by an automaton over the names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of names in one automaton, about; more names take several passes over the texts.
NAME_CHARS = 20_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(shared: tuple[str, list[str]]) -> ahocorasick.Automaton:
    """The automaton of a broadcast list of names with its own mark, made once in a process."""
    mark, names = shared
    if mark not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for name in names:
            found.add_word(name, len(name))
        found.make_automaton()
        _BUILT[mark] = found
    return _BUILT[mark]


def find_names(texts: DataFrame, names: DataFrame, key: str, text: str, name: str, whole_words: bool = True, fold_case: bool = True, longest: bool = False, name_chars: int = NAME_CHARS) -> DataFrame:
    """Every place of every name: (key, name, start, end), code points from 0, end exclusive.

    ``texts`` has distinct keys. ``whole_words``: no letter or digit stands beside the place. ``fold_case``: A-Z and a-z are the
    same. Names that overlap are all found, and the same name at overlapping places too; with ``longest``, of overlapping places
    the one that starts first stays, of those that start together the longest, and the next is sought behind its end. Two names
    that are equal but for folded case are one, in folded form. Null texts, null and empty names match nothing.

    Names are sent to the tasks, ``name_chars`` characters at a time, about: if there are more, the texts are read once for each
    share of the names. Only one share is on the driver at a time.
    """
    folded = F.translate(F.col(name), _UPPER, _LOWER) if fold_case else F.col(name)
    given = names.select(folded.alias("name")).filter(F.length("name") > 0).distinct()
    total = given.agg(F.sum(F.length("name"))).first()[0] or 0
    shares = -(-total // name_chars)
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(key, text).filter(F.col(text).isNotNull())
    out = None
    for share in range(shares):
        part = [r.name for r in given.filter(F.pmod(F.xxhash64("name"), F.lit(shares)) == share).collect()]
        places = rows.mapInArrow(_finder(texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, part)), key, text, whole_words, fold_case), f"`{key}` {kind}, name string, start int, end int")
        out = places if out is None else out.unionByName(places)
    if out is None:
        return texts.sparkSession.createDataFrame([], f"`{key}` {kind}, name string, start int, end int")
    return _longest(out, key) if longest else out


def _finder(shared, key: str, text: str, whole_words: bool, fold_case: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(shared.value)
        for batch in batches:
            at, said, starts, ends = [], [], [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                looked = t.translate(_FOLD) if fold_case else t
                for last, n in found.iter(looked) if len(found) else ():
                    a, b = last + 1 - n, last + 1
                    if whole_words and ((a and t[a - 1].isalnum()) or (b < len(t) and t[b].isalnum())):
                        continue
                    at.append(i)
                    said.append(looked[a:b])
                    starts.append(a)
                    ends.append(b)
            keys = batch.column(key).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(said, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "name", "start", "end"])

    return run


def _longest(places: DataFrame, key: str) -> DataFrame:
    """Of overlapping places the leftmost, then the longest: one walk over the places of each text in order, which are not gathered."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema.fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = object(), 0
        for batch in batches:
            kept = []
            for i, (k, a, b) in enumerate(zip(batch.column(key).to_pylist(), batch.column("start").to_pylist(), batch.column("end").to_pylist(), strict=True)):
                if k != now:
                    now, end = k, 0
                if a >= end:
                    kept.append(i)
                    end = b
            yield batch.take(pa.array(kept, pa.int32()))

    return places.repartition(key).sortWithinPartitions(key, "start", F.col("end").desc()).mapInArrow(walk, schema)
