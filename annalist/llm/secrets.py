"""Secret scans: patterns of assignments, access keys and hex strings, and a test of how well a vocabulary packs a string.

A vocabulary of byte pairs packs words and names into few tokens and random strings into many: a run of letters and digits that
takes a token for every one or two characters was hardly written by hand. Digests and identifiers look alike and are known by
their forms; they are set aside first.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from annalist.llm.pieces import load_model
from annalist.llm.rope import _fields, _slices, _with_columns
from annalist.llm.shared import few_at_once, lean

#: Kinds of spans in their order.
KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind: string, start: int, end: int>>"
#: The split of a text before byte pairs are merged, of the vocabularies that the scan takes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as AKIA[A-Z0-9]+ of 20 characters or more: a run begins at its first AKIA
_HEX = re.compile(r"[0-9a-f]{24,}")
_VALUE_CHARS = 6

#: Characters of a string that may be tested, and the fewest of them.
_RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
LEAST_CHARS = 20
#: A string with fewer characters a token is random.
CHARS_PER_TOKEN = 1.85
#: Characters that go to the vocabulary at once, as the time of a merge grows with the square of its length.
_AT_ONCE = 1_024
#: The lengths in hex digits of common digests.
DIGEST_DIGITS = (32, 40, 48, 56, 64, 96, 128)
_KNOWN = re.compile(
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # universally unique identifiers
    r"|(sha|SHA)-?(1|224|256|384|512)-[A-Za-z0-9+/]+={0,2}"  # digests that name their function
    r"|[0-9+/_-]+={0,2}"  # numbers, dates, telephone numbers
    r"|[A-Za-z]?[a-z]+|[A-Z]+"  # one word
    r"|([A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,6})([_/-]([A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,6}))+"  # words and short numbers in a row
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, in code points: each kind leftmost and without overlaps."""
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= _VALUE_CHARS]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return found


def is_known(run: str) -> bool:
    """Digests and identifiers, by their form."""
    digits = len(run) in DIGEST_DIGITS and not run.strip("0123456789abcdefABCDEF")
    return digits or _KNOWN.fullmatch(run) is not None


def chars_per_token(run: str, vocabulary: tiktoken.Encoding) -> float:
    tokens = sum(len(vocabulary.encode_ordinary(run[a : a + _AT_ONCE])) for a in range(0, len(run), _AT_ONCE))
    return len(run) / max(tokens, 1)


def _free_runs(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of 20 characters or more, without what ``taken`` (sorted) has of them. A run beside another letter, as one with
    an accent, is part of a word and left out."""
    k = 0
    for m in _RUN.finditer(text):
        a, end = m.span()
        if end - a < LEAST_CHARS:
            continue
        if (a and text[a - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
            continue
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        i = k
        while i < len(taken) and taken[i][0] < end:
            if taken[i][0] - a >= LEAST_CHARS:
                yield a, taken[i][0]
            a, i = max(a, taken[i][1]), i + 1
        if end - a >= LEAST_CHARS:
            yield a, end


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def all_spans(text: str, vocabulary: tiktoken.Encoding, least_ratio: float = CHARS_PER_TOKEN) -> list[tuple[int, int, str]]:
    """The spans of the patterns and, in what these leave, random strings; by start, then kind."""
    base = base_spans(text)
    more = []
    for a, b in _free_runs(text, _merged(base)):
        run = text[a:b]
        if not is_known(run) and chars_per_token(run, vocabulary) < least_ratio:
            more.append((a, b, "random"))
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


_LOADED: dict[bytes, tiktoken.Encoding] = {}


def vocabulary_of(content: bytes) -> tiktoken.Encoding:
    """The vocabulary of a file of ranks (lines of a base64 token and its rank), made once in a process."""
    if content not in _LOADED:
        _LOADED.clear()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
        _LOADED[content] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[content]


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    out, at = [], 0
    for a, b in _merged(spans):
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, vocabulary_path: str, text: str = "text", to: str = "secrets", least_ratio: float = CHARS_PER_TOKEN, mask: str | None = None) -> DataFrame:
    """Every row of ``docs`` with ``to``: its secrets as kind, start and end (code points, end exclusive), by start, then kind.

    Kinds: ``assign`` (a password, token or key that is given a value of six characters or more: the whole assignment),
    ``access`` (access keys), ``hex`` (24 hex digits or more), and ``random``: runs of 20 characters or more outside those with
    fewer than ``least_ratio`` characters a token in the vocabulary (a tiktoken file of ranks, at most 64 MB, which is read once
    and sent to the tasks) that are no digest and no identifier by their form. Within a kind, spans do not overlap; a hex string
    may lie in an assignment. With ``mask``, it takes the place of every secret in the text too.

    A null text has no secrets and stays null. All other columns stay (an older one named ``to`` is replaced); repeated rows
    stay; an empty table gives an empty result. Whole texts of any length are read.
    """
    if to.lower() == text.lower():
        raise ValueError("the secrets need a column of their own")
    shared = load_model(docs.sparkSession, vocabulary_path)
    docs = few_at_once(docs.drop(to))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(shared.value)
        for whole in parts:
            for part in _slices(whole, text):
                texts = part.column(text).to_pylist()
                found = [all_spans(t or "", vocabulary, least_ratio) for t in texts]
                made = {to: pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in found], kind)}
                if mask is not None:
                    made[text] = pa.array([t if t is None else masked(t, s, mask) for t, s in zip(texts, found, strict=True)], pa.string())
                out = _with_columns(part, **made)
                yield out.select(names)

    names = [*docs.columns, to]
    return docs.mapInArrow(lean(run), _fields(docs) + f"`{to}` {SPANS}")
