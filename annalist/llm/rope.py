"""Fill-in-the-middle: a text is a rope, whose pieces are moved by splitting and joining its tree.

A leaf holds a stretch of text with its numbers of units and of code points; an inner node has the sums of its two sides. So a
cut at a rank of units or of code points walks one path down the tree and cuts one leaf, and no text is copied until the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.shared import few_at_once, fresh, lean

#: Code points in a leaf, at most, where units are code points; units in a leaf otherwise.
LEAF = 4_096


class Rope:
    """A leaf (``text``) or a node of two ropes; ``units`` and ``points`` are known of both."""

    __slots__ = ("left", "points", "right", "text", "unit_ends", "units")

    def __init__(self, text: str = "", unit_ends: Sequence[int] | None = None, left: Rope | None = None, right: Rope | None = None):
        """``unit_ends`` of a leaf: where its units end, None where each code point is one."""
        self.left, self.right, self.text, self.unit_ends = left, right, text, unit_ends
        if left is None:
            self.points = len(text)
            self.units = self.points if unit_ends is None else len(unit_ends)
        else:
            self.units, self.points = left.units + right.units, left.points + right.points

    @classmethod
    def of(cls, text: str, unit: re.Pattern | None = None, leaf: int = LEAF) -> Rope:
        """A balanced rope. Units are the matches of ``unit``, found from left to right (None: code points); what lies between
        two matches belongs to the later one, and what follows the last to the last. A text without a match is one unit."""
        if unit is None:
            leaves = [cls(text[a : a + leaf]) for a in range(0, len(text), leaf)]
        else:
            ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
            ends = [*ends[:-1], len(text)] if text else []
            cuts = [0, *ends[leaf - 1 : -1 : leaf], *ends[-1:]]
            leaves, k = [], 0
            for a, b in pairwise(cuts):
                inside = ends[k : k + leaf]
                leaves.append(cls(text[a:b], [e - a for e in inside]))
                k += leaf
        while len(leaves) > 1:
            leaves = [cls(left=leaves[i], right=leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else cls()

    def _measure(self, by: str) -> int:
        return self.units if by == "units" else self.points

    def _cut_leaf(self, rank: int, by: str) -> tuple[Rope, Rope]:
        if self.unit_ends is None:
            return Rope(self.text[:rank]), Rope(self.text[rank:])
        if by == "units":
            k, at = rank, self.unit_ends[rank - 1] if rank else 0
        else:  # a cut inside a unit leaves its end to the right side as a unit
            k, at = sum(e <= rank for e in self.unit_ends), rank
        return Rope(self.text[:at], self.unit_ends[:k]), Rope(self.text[at:], [e - at for e in self.unit_ends[k:]])

    def split(self, rank: int, by: str = "units") -> tuple[Rope, Rope]:
        """The first ``rank`` units (or points), and the rest."""
        if rank <= 0 or rank >= self._measure(by):
            return (Rope(), self) if rank <= 0 else (self, Rope())
        if self.left is None:
            return self._cut_leaf(rank, by)
        size = self.left._measure(by)
        if rank <= size:
            a, b = self.left.split(rank, by)
            return a, b + self.right
        a, b = self.right.split(rank - size, by)
        return self.left + a, b

    def __add__(self, other: Rope) -> Rope:
        return other if not self.points else self if not other.points else Rope(left=self, right=other)

    def leaves(self) -> Iterator[str]:
        waiting = [self]
        while waiting:
            node = waiting.pop()
            if node.left is None:
                yield node.text
            else:
                waiting += [node.right, node.left]

    def __str__(self) -> str:
        return "".join(self.leaves())


@dataclass(frozen=True)
class Sentinels:
    """The strings that mark the three parts. No part of one may be taken for another where texts and sentinels touch."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        for i, a in enumerate(marks):
            for k, b in enumerate(marks):
                overlaps = any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)) + (i != k)))
                if not a or overlaps or (i != k and (a in b or b in a)):
                    raise ValueError(f"sentinels must not be empty, overlap or hold one another: {a!r}, {b!r}")

    def inside(self, text: str) -> bool:
        return self.prefix in text or self.suffix in text or self.middle in text

    def order(self, form: str) -> tuple[str, ...]:
        return {"psm": (self.prefix, self.suffix, self.middle), "spm": (self.suffix, self.prefix, self.middle)}[form]


def rearrange(text: str, low: int, high: int, form: str, sentinels: Sentinels, unit: re.Pattern | None) -> tuple[str, int, int]:
    """The text in ``form`` (psm or spm) with its middle between the unit ranks ``low`` and ``high``, and the code points of prefix and middle."""
    head, suffix = Rope.of(text, unit).split(high)
    prefix, middle = head.split(low)
    parts = {sentinels.prefix: prefix, sentinels.suffix: suffix, sentinels.middle: middle}
    out = Rope()
    for mark in sentinels.order(form):
        out = out + Rope(mark) + parts[mark]
    return str(out), prefix.points, middle.points


def restore(text: str, form: str, sentinels: Sentinels) -> str:
    """The text that :func:`rearrange` was given: the tree of its result is split at the sentinels, and its parts are joined in order."""
    marks = sentinels.order(form)
    places, at = [], 0
    for mark in marks:
        at = text.find(mark, at)
        if at < 0:
            raise ValueError(f"no {mark!r} in a text of form {form}")
        places.append(at)
        at += len(mark)
    rest, parts = Rope.of(text), {}
    for mark, place in reversed(list(zip(marks, places, strict=True))):
        rest, tail = rest.split(place, "points")
        parts[mark] = tail.split(len(mark), "points")[1]
    return str(parts[sentinels.prefix] + parts[sentinels.middle] + parts[sentinels.suffix])


def _slices(part: pa.RecordBatch, column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    first = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(part.column(column)), 0).to_pylist()):
        if i > first and total + n > limit:
            yield part.slice(first, i - first)
            first, total = i, 0
        total += n
    yield part.slice(first)


def _with_columns(part: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [c for c in part.schema.names if c not in columns]
    return pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *columns.values()], names=[*kept, *columns])


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def draws(key: Column, n: int = 4) -> list[Column]:
    """``n`` unsigned numbers of 32 bits from the SHA-256 of ``1:`` and the key as text (a null key counts as empty)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


#: What :func:`fill_in_middle` adds.
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str | None = None, rate: int = 90, spm_rate: int = 20, sentinels: Sentinels = Sentinels()
) -> DataFrame:
    """Every row of ``docs`` with n (units of its text), form (plain, psm, spm), prefix_chars, middle_chars and output.

    ``unit``: a regular expression whose matches, from left to right, are the units at which a text may be cut (None: code
    points). ``rate`` of a hundred texts are rearranged, ``spm_rate`` of these with the suffix first. What happens to a row is
    drawn from its key alone, so equal keys draw alike, and a null key draws as the empty text.

    A null text counts as empty. An empty text and one that holds a sentinel are plain: their output is the text, their counts
    of prefix and middle are null. All other columns stay (older ones of the new names are replaced, but for the key and the
    text, which may not have these names); repeated rows stay; an empty table gives an empty result.
    """
    if {key.lower(), text.lower()} & set(ADDED):
        raise ValueError(f"key and text may not be named as one of {ADDED}")
    docs = few_at_once(docs.drop(*[c for c in docs.columns if c.lower() in ADDED]))
    drawn = fresh(docs, "__draws")
    pattern = None if unit is None else re.compile(unit, re.DOTALL)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in _slices(whole, text):
                rows = []
                for said, (h1, h2, h3, h4) in zip(part.column(text).to_pylist(), part.column(drawn).to_pylist(), strict=True):
                    said = said or ""
                    n = len(said) if pattern is None else Rope.of(said, pattern).units
                    if not said or h3 % 100 >= rate or sentinels.inside(said):
                        rows.append((n, "plain", None, None, said))
                        continue
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    form = "spm" if h4 % 100 < spm_rate else "psm"
                    out, before, between = rearrange(said, low, high, form, sentinels, pattern)
                    rows.append((n, form, before, between, out))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                made = {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(ADDED, kinds, strict=True))}
                out = _with_columns(part, **made)
                yield out.select([c for c in out.schema.names if c != drawn])

    return docs.withColumn(drawn, F.array(*draws(F.col(key)))).mapInArrow(lean(run), _fields(docs) + "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def undo(rows: DataFrame, output: str = "output", form: str = "form", to: str = "restored", sentinels: Sentinels = Sentinels()) -> DataFrame:
    """Add the texts that were rearranged, from output and form alone, as the column ``to``; a null form is plain, a null output empty."""
    rows = few_at_once(rows.drop(to))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in _slices(whole, output):
                pairs = zip(part.column(output).to_pylist(), part.column(form).to_pylist(), strict=True)
                texts = [x or "" if how in (None, "plain") else restore(x, how, sentinels) for x, how in pairs]
                yield _with_columns(part, **{to: pa.array(texts, pa.string())})

    return rows.mapInArrow(lean(run), _fields(rows) + f"`{to}` string")
