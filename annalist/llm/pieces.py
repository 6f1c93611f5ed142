"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A BPE model cuts a text into the only sequence of pieces in which every two neighbours are stable: encoding the two
together gives the two again. So the encoding is a path through the lattice of pieces with weight 0 for stable neighbours and
minus infinity for others, and a max-plus product of transfer matrices finds it:

1. A giant document is split at fixed positions, inside words too. The states at a cut are the pieces that start before it and
   end at or after it (136 at most for pieces of up to 16 characters).
2. Each chunk yields a matrix from the states at its left cut to those at its right cut, 0 or minus infinity (kept as bits).
3. The matrices are combined associatively: within blocks of chunks, over the blocks of a document, and back into the blocks.
   One state is left at every cut.
4. Each chunk is then traced back on its own: the pieces between two resolved states are the encoding of the text between.

Other documents are one chunk, and their encoding is the path itself. Ids are those of the model, as its own library gives
them, except that the character U+2581 is written as its three bytes, so that decoding gives every text back.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.shared import few_at_once, forget, fresh, lean, stored

MARK = "▁"
#: Private characters to stand for U+2581 while the library encodes; the first that the text lacks is taken.
_STAND_INS = range(0x10FFFD, 0xF0000, -1)
#: Fixed value: protocol-buffer bytes that, at the end of a model, set normalizer_spec.add_dummy_prefix to false.
NO_PREFIX = b"\x1a\x02\x18\x00"
#: Chunks whose matrices are combined in one step.
BLOCK = 64
MAX_MODEL_BYTES = 64 << 20


class Pieces:
    """A SentencePiece BPE model, over texts in which a space stands for the model's mark."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model + NO_PREFIX)
        ids = range(self.library.get_piece_size())
        special = lambda i: self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)
        self.ids = {self.library.id_to_piece(i).replace(MARK, " "): i for i in ids if not special(i)}
        self.longest = max(map(len, self.ids))
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        barrier = "" if any("\n" in p for p in self.ids) else "\n"
        #: Stretches that no piece goes beyond: spaces and what follows them, or a character that no piece has.
        self.stretches = re.compile(f" *[^ {barrier}]+| +" + (f"|{barrier}+" if barrier else ""))
        self.known: dict[str, array] = {}
        content = [b""] * self.library.get_piece_size()
        for p, i in self.ids.items():
            content[i] = p.encode()
        for b, i in enumerate(self.bytes):
            content[i] = bytes([b])
        self.content = np.frombuffer(b"".join(content), np.uint8)
        self.length = np.array([len(c) for c in content])
        self.start = np.cumsum(self.length) - self.length
        self.stable: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece goes beyond a word; words are not independent in this model")

    def encode(self, text: str) -> list[int]:
        """Ids of ``text`` as it is, without the space that a document begins with."""
        if MARK not in text:
            return self.library.encode(text)
        stand_in = next(c for c in map(chr, _STAND_INS) if c not in text and c not in self.ids)
        given, wanted = ([self.bytes[b] for b in c.encode()] for c in (stand_in, MARK))
        ids, out, k = self.library.encode(text.replace(MARK, stand_in)), [], 0
        while k < len(ids):
            hit = ids[k : k + len(given)] == given
            out += wanted if hit else ids[k : k + 1]
            k += len(given) if hit else 1
        return out

    def encode_documents(self, texts: list[str]) -> pa.ListArray:
        """Ids of whole documents. Stretches repeat, so each is looked up; the store of a worker is emptied at 100,000."""
        stretches = [self.stretches.findall(" " + t) if t else [] for t in texts]
        new = list({x for found in stretches for x in found} - self.known.keys())
        if len(self.known) + len(new) > 100_000:
            self.known.clear()
            new = list({x for found in stretches for x in found})
        plain = [x for x in new if MARK not in x]
        self.known.update(zip(plain, (array("i", i) for i in self.library.encode(plain)), strict=True))
        self.known.update((x, array("i", self.encode(x))) for x in new if MARK in x)
        ids, ends = array("i"), [0]
        for found in stretches:
            for x in found:
                ids.extend(self.known[x])
            ends.append(len(ids))
        for x in new:
            if len(x) > 64:
                del self.known[x]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))

    def decode_documents(self, ids: pa.ListArray) -> list[str]:
        """Texts of id lists; ids that do not spell UTF-8 give U+FFFD."""
        flat, ends = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
        size = self.length[flat]
        total = np.concatenate([[0], np.cumsum(size)])
        spelt = self.content[np.repeat(self.start[flat] - total[:-1], size) + np.arange(total[-1])].tobytes()
        at = total[ends]
        return [spelt[i:j].decode("utf-8", "replace")[1:] for i, j in zip(at[:-1], at[1:], strict=True)]

    def is_token(self, piece: str) -> bool:
        known = self.stable.get(piece)
        if known is None:
            at = self.ids.get(piece)
            known = len(piece) == 1 if at is None else self.library.encode(piece) == [at]
            self.stable[piece] = known
        return known

    def fit(self, a: str, b: str) -> bool:
        """Whether the neighbours ``a`` and ``b`` stay apart."""
        if not a or (b[0] == " " and a[-1] != " ") or a not in self.ids or b not in self.ids:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self.library.encode(a + b) == [self.ids[a], self.ids[b]]
        return known

    def states(self, left: str, right: str) -> list[tuple[int, int]]:
        """States at a cut: how far their piece begins before it and ends after it."""
        span = range(1, min(self.longest, len(left)) + 1)
        return [(s, e) for s in span for e in range(0, min(self.longest - s, len(right)) + 1) if self.is_token(left[len(left) - s :] + right[:e])]

    def transfer(self, left: str, body: str, right: str) -> np.ndarray:
        """The matrix (bool: 0 or minus infinity) of a chunk; no ``left``: it begins the document, no ``right``: it ends it."""
        text, begin, end = left + body + right, len(left), len(left) + len(body)
        enter = self.states(left, body[: self.longest]) if left else [(0, 0)]
        leave = {(s, e): k for k, (s, e) in enumerate(self.states((left + body)[-self.longest :], right))} if right else {}
        out = np.zeros((len(enter), len(leave) if right else 1), bool)
        masks: dict[int, dict[str, int]] = defaultdict(lambda: defaultdict(int))

        def reach(at: int, to: int, piece: str, mask: int) -> None:
            if to < end:
                masks[to][piece] |= mask
            elif right or to == end:
                column = leave.get((end - at, to - end)) if right else 0
                if column is not None:
                    out[:, column] |= [bool(mask >> k & 1) for k in range(len(enter))]

        for k, (s, e) in enumerate(enter):
            reach(begin - s, begin + e, text[begin - s : begin + e], 1 << k)
        words = [p for p in range(begin + self.longest, end) if text[p] == " " and text[p - 1] != " "]
        first, last = (words[0], words[-1]) if len(words) > 1 else (end, end)
        at = begin
        while at < end:
            if at == first:  # whole words lie between the first and the last: one path
                mask = 0
                for m in masks[at].values():
                    mask |= m
                at = last
                masks[at] = defaultdict(int, {"": mask})
                first = end
            before = masks.pop(at, None)
            if before:
                for n in range(1, min(self.longest, len(text) - at) + 1):
                    piece = text[at : at + n]
                    if self.is_token(piece):
                        mask = 0
                        for p, m in before.items():
                            if self.fit(p, piece):
                                mask |= m
                        if mask:
                            reach(at, at + n, piece, mask)
            at += 1
        return out


_LOADED: dict[bytes, Pieces] = {}


def _pieces(model) -> Pieces:
    """The broadcast model, loaded once in a worker."""
    content = model.value
    if content not in _LOADED:
        _LOADED.clear()
        _LOADED[content] = Pieces(content)
    return _LOADED[content]


def load_model(spark: SparkSession, path: str):
    """Broadcast the file of a model, which is checked to be small."""
    content = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").first()[0]
    if len(content) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} has {len(content)} bytes; {MAX_MODEL_BYTES} are allowed")
    return spark.sparkContext.broadcast(bytes(content))


def _slices(sizes: list[int], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _with(part: pa.RecordBatch, a: int, b: int, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [c for c in part.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*[part.column(c).slice(a, b - a) for c in kept], column], names=[*kept, name])


def _pack(m: np.ndarray) -> bytes:
    return np.array(m.shape, np.int32).tobytes() + np.packbits(m).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    shape = np.frombuffer(b[:8], np.int32)
    return np.unpackbits(np.frombuffer(b[8:], np.uint8), count=int(shape[0] * shape[1])).reshape(shape).astype(bool)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two 0 / minus infinity matrices, as bits."""
    return (a.astype(np.float32) @ b.astype(np.float32)) > 0


def resolve(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The state at every cut, given those at both ends: reachable from the left and leading to the right."""
    vectors = [np.arange(matrices[0].shape[0]) == enter]
    for m in matrices:
        vectors.append(compose(vectors[-1][None, :], m)[0])
    state, states = leave, [leave]
    for m, v in zip(reversed(matrices), reversed(vectors[:-1]), strict=True):
        ways = np.flatnonzero(v & m[:, state])
        if len(ways) != 1:
            raise ValueError(f"{len(ways)} paths through a chunk")
        state = int(ways[0])
        states.append(state)
    return states[::-1]


def _resolved(table: pa.Table, by: str, enter: int, leave: int) -> pa.Table:
    """The states at both ends of the chunks or blocks of a table; -1 if not exactly one path leads through them."""
    try:
        states = resolve([_unpack(m) for m in table.column("matrix").to_pylist()], enter, leave) if enter >= 0 else None
    except ValueError:
        states = None
    n = table.num_rows
    enters, leaves = (states[:-1], states[1:]) if states else ([-1] * n, [-1] * n)
    return pa.table({"key": table.column("key"), by: table.column(by), "enter": pa.array(enters, pa.int32()), "leave": pa.array(leaves, pa.int32())})


def _long_ids(giants: DataFrame, model, chunk: int) -> DataFrame:
    """(key, ids) for the texts of ``giants`` (key, text), which are distinct.

    A text through which the scan does not find one path is encoded by the model's library whole, in one task.
    """

    chunk_schema = pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("left", pa.string()), ("body", pa.string()), ("right", pa.string())])

    def split(parts):
        longest = _pieces(model).longest
        for part in parts:
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                text = " " + text
                for k, at in enumerate(range(0, len(text), chunk)):
                    end = min(at + chunk, len(text))
                    yield pa.RecordBatch.from_pylist([{"key": key, "chunk": k, "left": text[max(0, at - longest) : at], "body": text[at:end], "right": text[end : end + longest]}], chunk_schema)

    def matrices(parts):
        pieces = _pieces(model)
        for part in parts:
            found = [_pack(pieces.transfer(*(part.column(c)[i].as_py() for c in ("left", "body", "right")))) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("chunk"), pa.array(found, pa.binary())], names=["key", "chunk", "matrix"])

    def product(block: pa.Table) -> pa.Table:
        block = block.sort_by("chunk")
        total = None
        for m in block.column("matrix").to_pylist():
            total = _unpack(m) if total is None else compose(total, _unpack(m))
        return pa.table({"key": block.column("key")[:1], "block": pa.array([block.column("chunk")[0].as_py() // BLOCK], pa.int32()), "matrix": pa.array([_pack(total)], pa.binary())})

    def borders(blocks: pa.Table) -> pa.Table:
        return _resolved(blocks.sort_by("block"), "block", 0, 0)

    def inside(block: pa.Table) -> pa.Table:
        return _resolved(block.sort_by("chunk"), "chunk", block.column("enter")[0].as_py(), block.column("leave")[0].as_py())

    def trace(parts):
        pieces = _pieces(model)
        for part in parts:
            out = []
            for row in part.to_pylist():
                text, begin = row["body"] + row["right"], 0
                if row["left"]:
                    begin = pieces.states(row["left"], row["body"][: pieces.longest])[row["enter"]][1]
                end = len(row["body"])
                if row["right"]:
                    end += pieces.states((row["left"] + row["body"])[-pieces.longest :], row["right"])[row["leave"]][1]
                out.append(pieces.encode(text[begin:end]) if end > begin else [])
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("chunk"), pa.array(out, pa.list_(pa.int32()))], names=["key", "chunk", "ids"])

    chunks = giants.mapInArrow(split, "key string, chunk int, left string, body string, right string").repartition("key", "chunk")
    chunks = stored(chunks, "chunks")
    steps = stored(chunks.mapInArrow(matrices, "key string, chunk int, matrix binary").withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("int")), "transfers")
    blocks = steps.groupBy("key", "block").applyInArrow(product, "key string, block int, matrix binary")
    ends = blocks.groupBy("key").applyInArrow(borders, "key string, block int, enter int, leave int")
    states = steps.join(ends, ["key", "block"]).groupBy("key", "block").applyInArrow(inside, "key string, chunk int, enter int, leave int")
    states = stored(states, "states")
    lost = stored(states.filter("enter < 0").select("key").distinct(), "no-path")
    forget(steps)
    traced = chunks.join(states, ["key", "chunk"]).join(lost, "key", "left_anti").mapInArrow(trace, "key string, chunk int, ids array<int>")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])
    found = traced.groupBy("key").agg(F.flatten(ordered).alias("ids"))

    def whole(parts):
        pieces = _pieces(model)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(map(pieces.encode, part.column("text").to_pylist()), pa.list_(pa.int32()))], names=["key", "ids"])

    return found.unionByName(giants.join(lost, "key", "left_semi").mapInArrow(whole, "key string, ids array<int>"))


def encode(docs: DataFrame, model_path: str, chunk: int = 32_768, verify: str | None = None) -> DataFrame:
    """Add ``ids`` (array of int) to every row of ``docs``, from its column text.

    ``verify``: a column to add that says whether decoding the ids gives the text again (null counts as empty).

    Null and empty texts have no ids. Texts of more than ``chunk`` characters take the parallel scan; equal ones are encoded
    once. All other columns are kept (older columns of the new names are replaced); repeated rows stay; an empty table gives an
    empty result.
    """
    if chunk < 64:
        raise ValueError("a chunk has 64 characters at least")
    model = load_model(docs.sparkSession, model_path)
    docs = few_at_once(docs.drop("ids", *([verify] if verify else [])))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", ids array<int>" + (f", `{verify}` boolean" if verify else "")

    def whole(parts):
        pieces = _pieces(model)
        for part in parts:
            sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).to_pylist()
            for a, b in _slices(sizes):
                texts = [t or "" for t in part.column("text").slice(a, b - a).to_pylist()]
                ids = pieces.encode_documents(texts)
                out = _with(part, a, b, "ids", ids)
                if verify:
                    same = pa.array([x == t for x, t in zip(pieces.decode_documents(ids), texts, strict=True)], pa.bool_())
                    out = _with(out, 0, b - a, verify, same)
                yield out

    is_giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    small = docs.filter(~is_giant).mapInArrow(lean(whole), schema)
    by, again = fresh(docs, "__key"), fresh(docs, "__decoded")
    giants = docs.filter(is_giant).withColumn(by, F.sha2("text", 256))
    distinct = giants.groupBy(F.col(by).alias("key")).agg(F.first("text").alias("text"))
    ids = _long_ids(distinct, model, chunk).withColumnRenamed("key", by)
    long = giants.join(ids, by).select(*docs.columns, "ids")
    if verify:
        long = decode(long, model_path, again).select(*docs.columns, "ids", (F.col(again) == F.col("text")).alias(verify))
    return small.unionByName(long)


def decode(encoded: DataFrame, model_path: str, to: str = "decoded") -> DataFrame:
    """Add the text that ``ids`` (array of int) stand for as the column ``to``; null and empty arrays give an empty text."""
    model = load_model(encoded.sparkSession, model_path)
    encoded = few_at_once(encoded.drop(to))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + f", `{to}` string"

    def run(parts):
        pieces = _pieces(model)
        for part in parts:
            sizes = pc.fill_null(pc.list_value_length(part.column("ids")), 0).to_pylist()
            for a, b in _slices([4 * n for n in sizes]):
                yield _with(part, a, b, to, pa.array(pieces.decode_documents(part.column("ids").slice(a, b - a)), pa.string()))

    return encoded.mapInArrow(lean(run), schema)
