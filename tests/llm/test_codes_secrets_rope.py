import hashlib
import os
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import codes, queries, rope, secrets
from tests.compare import same_rows

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_fill_in_middle"])
def test_equals_sql(spark, duck, sf, name):
    same_rows(queries.QUERIES[name](spark, sf), duck, queries.SQL[name])


def _plain_nearest(points, entries):
    out = []
    for p in points:
        far = [sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in entries]
        out.append((far.index(min(far)), min(far)))
    return out


@pytest.mark.parametrize("scale", [1, 3, 256, 10**6, 7 * 10**8, 10**12])
def test_nearest_is_exact_with_ties(scale):
    rng = np.random.default_rng(scale)
    entries = rng.integers(-scale, scale + 1, (64, 4))
    entries[40] = entries[7]  # the lower of equal entries is chosen
    points = np.concatenate([rng.integers(-scale, scale + 1, (300, 4)), entries, (entries[:-1] + entries[1:]) // 2])
    index, far = codes.nearest(points, entries)
    assert list(zip(index.tolist(), [int(d) for d in far], strict=True)) == _plain_nearest(points, entries)


def test_screening_leaves_few_entries_to_settle(monkeypatch):
    rng = np.random.default_rng(5)
    settled = []
    plain = np.nonzero
    monkeypatch.setattr(codes.np, "nonzero", lambda x: settled.append(int(x.sum())) or plain(x))
    codes.nearest(rng.integers(-600, 600, (2_000, 4)), rng.integers(-600, 600, (64, 4)))
    assert 2_000 <= settled[0] < 2_100  # and not 128,000


def _plain_codes(rows, parts, size, rounds):
    rows = sorted(((k, [int(np.floor(256 * float(x))) for x in v]) for k, v in rows), key=lambda r: (r[0] is None, r[0], r[1]))
    w = len(rows[0][1]) // parts
    books = [[r[1][p * w : (p + 1) * w] for r in rows[:size]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            mine = [r[1][p * w : (p + 1) * w] for r in rows]
            at = [i for i, _ in _plain_nearest(mine, books[p])]
            for e in range(len(books[p])):
                hit = [m for m, i in zip(mine, at, strict=True) if i == e]
                if hit:
                    books[p][e] = [sum(c) // len(hit) for c in zip(*hit, strict=True)]
    out = []
    for k, v in rows:
        found = [_plain_nearest([v[p * w : (p + 1) * w]], books[p])[0] for p in range(parts)]
        out.append((k, "".join(f"{i:02x}" for i, _ in found), sum(d for _, d in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("tasks", [1, 7])
def test_codes_equal_plain_loops(spark, tasks):
    rnd = random.Random(3)
    rows = [(k, [float(np.float32(rnd.choice([0.1, -0.5, 0.25, rnd.gauss(0, 1)]))) for _ in range(8)], k % 3 or None) for k in range(60)]
    rows += [(5, rows[5][1], None), (5, rows[9][1], 1), (None, rows[2][1], 2)]  # repeated rows, one id with two vectors, no id
    bad = [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [float("nan")] * 8, 1), (103, [1.0] * 7 + [float("-inf")], 2), (104, [], 1), (105, [1.0] * 4, 1)]
    df = spark.createDataFrame(bad + rows, VECTORS).repartition(tasks).withColumn("code", F.lit("clash")).withColumn("v", F.lit(1))
    books = codes.fit(df, parts=4, size=10, rounds=2)
    out = codes.total_by(codes.encode(df, books), "error", ["label"], "label_error").collect()
    wanted, sha = _plain_codes([r[:2] for r in rows], 4, 10, 2)
    assert sorted((str(r.vec_id), r.code, r.error) for r in out) == sorted((str(k), c, e) for k, c, e in wanted)
    assert books.sha256() == sha
    by = {}
    for r in out:
        by[r.label] = by.get(r.label, 0) + r.error
    assert all(r.label_error == by[r.label] and r.v == 1 for r in out)
    few = codes.total_by(codes.encode(df, books), "error", ["label"], "label_error", broadcast_rows=0)
    assert sorted(map(str, few.collect())) == sorted(map(str, out))


def test_few_none_and_very_large_vectors(spark):
    df = spark.createDataFrame([(1, [3e9] * 4, 1), (2, [-1e12, 0.0, 1.0, 5e8], 1), (3, [0.0] * 4, 2), (4, [1e30] * 4, 2)], VECTORS)
    books = codes.fit(df, parts=2, size=2, rounds=1)
    out = {r.vec_id: (r.code, r.error) for r in codes.total_by(codes.encode(df, books), "error", ["label"], "t").collect()}
    wanted, sha = _plain_codes([(r.vec_id, r.embedding) for r in df.filter("vec_id < 4").collect()], 2, 2, 1)
    assert out == {k: (c, e if e < 2**63 else None) for k, c, e in wanted}
    assert books.sha256() == sha
    assert codes.fit(df.filter("vec_id = 4")) is None
    assert codes.encode(df.filter("false"), None).count() == 0
    with pytest.raises(ValueError, match="parts"):
        codes.fit(df.filter("vec_id < 4"), parts=3)


def test_decode_gives_the_entries():
    books = codes.Codebooks([np.array([[1, 2], [3, 4]]), np.array([[5, 6], [7, 8]])])
    index, far = books.encode(np.array([[3, 4, 5, 7]]))
    assert index.tolist() == [[1, 0]] and far.tolist() == [1]
    assert books.decode(index).tolist() == [[3, 4, 5, 6]]


# --- secrets


def _plain_base(text):
    """Base spans by a walk over the characters, without regular expressions."""
    found, letters = [], string.ascii_letters + string.digits + "+/_.=-"
    i = 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if "".join(c.lower() if c in string.ascii_letters else c for c in text[i : i + len(word)]) == word:
                j = i + len(word)
                for quote in (True, False):
                    k = j + 1 if quote and text[j : j + 1] in ('"', "'") and j < len(text) else j
                    while text[k : k + 1] == " ":
                        k += 1
                    if k < len(text) and text[k] in ":=":
                        k += 1
                        while text[k : k + 1] == " ":
                            k += 1
                        if k < len(text) and text[k] in "\"'":
                            k += 1
                        v = k
                        while k < len(text) and text[k] in letters:
                            k += 1
                        if k > v:
                            end = (v, k)
                            break
                break
        if end:
            if end[1] - end[0] >= 6:
                found.append((i, end[1], "assign"))
            i = end[1]
        else:
            i += 1
    for start, chars, least, kind in (("AKIA", string.ascii_uppercase + string.digits, 20, "access"), ("", "0123456789abcdef", 24, "hex")):
        i = 0
        while i < len(text):
            if text.startswith(start, i) and (start or text[i] in chars):
                k = i
                while k < len(text) and text[k] in chars:
                    k += 1
                if k - i >= least and (kind == "hex" or k > i + 4):
                    found.append((i, k, kind))
                i = max(k, i + 1)
            else:
                i += 1
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def _noise(rnd):
    bits = ["token", "ToKen", "password", "api_key", "APIKEY", "secret", "ſecret", "toKen", "AKIA", "AKIAAKIA", "é", "😀", " ", "  ", "=", ":", '"', "'", "\n", "abc", "0f" * 13, "A1B2" * 5, "x" * 5, "deadbeef", ".", "-"]
    return "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))


def test_base_spans_equal_a_walk_over_the_characters():
    rnd = random.Random(11)
    hits = 0
    for _ in range(4_000):
        text = _noise(rnd)
        found = sorted(secrets.base_spans(text), key=lambda s: (s[0], secrets.KINDS.index(s[2])))
        assert found == _plain_base(text), text
        hits += len(found)
    assert hits > 2_000


@pytest.fixture(scope="module")
def vocabulary():
    with open(queries.RANKS, "rb") as f:
        return secrets.vocabulary_of(f.read())


def test_random_strings_are_found_and_names_are_not(vocabulary):
    rnd = random.Random(2)
    for chars in (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567"):
        runs = ["".join(rnd.choice(chars) for _ in range(rnd.randint(24, 60))) for _ in range(300)]
        found = sum(secrets.all_spans(f"is {r}, so", vocabulary) == [(3, 3 + len(r), "random")] for r in runs)
        assert found >= 290, chars
    names = [
        "getUserAccountByEmailAddress", "MAX_CONNECTION_POOL_SIZE", "node_modules/react-dom/index", "550e8400-e29b-41d4-a716-446655440000", "HTTPResponseStatusCode404",
        "AbstractSingletonProxyFactoryBean", "1234567890123456789012", "Donaudampfschifffahrtsgesellschaft", "-" * 40, "A" * 30, "1111-2222-3333-4444-5555", "2024-01-15/2024-02-15",
        "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "eineinpftzschtzzueinpf", "x86_64-unknown-linux-gnu",
    ]
    for name in names:
        assert secrets.all_spans(f'"{name}"', vocabulary) == [], name


def test_what_the_patterns_leave_is_tested(vocabulary):
    run = "q7Zp2LxV9mKd4RtB8wYcN3hJ"
    assert secrets.all_spans(f"token: {run} and {run}.", vocabulary) == [(0, 31, "assign"), (36, 60, "random")]
    assert secrets.all_spans(run + "AKIA" + "Z9" * 8 + "/" + run, vocabulary) == [(0, 24, "random"), (24, 44, "access"), (44, 69, "random")]
    assert secrets.all_spans("é" + run, vocabulary) == []  # part of a word
    blob = "".join(random.Random(1).choices(string.ascii_letters + string.digits, k=200_000))
    assert secrets.all_spans(blob, vocabulary) == [(0, 200_000, "random")]


def test_scan_of_rows(spark):
    key = "q7Zp2LxV9mKd4RtB8wYcN3hJ"
    rows = [(1, f"😀 key {key} here"), (2, None), (3, ""), (1, f"😀 key {key} here"), (None, 'password="hunter2x"'), (4, "z " * 200_000 + "AKIA" + "A" * 16)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("secrets", F.lit(1)).withColumn("kind", F.lit("k"))
    out = secrets.find_secrets(df, queries.RANKS, mask="[gone]").collect()
    got = sorted((str(r.doc_id), (r.text or "")[-20:], [(s.kind, s.start, s.end) for s in r.secrets], r.kind) for r in out)
    one = ("1", "😀 key [gone] here", [("random", 6, 30)], "k")
    assert got == sorted([one, one, ("2", "", [], "k"), ("3", "", [], "k"), ("None", '[gone]"', [("assign", 0, 18)], "k"), ("4", "z z z z z z z [gone]"[-20:], [("access", 400_000, 400_020)], "k")])
    assert [r.text for r in out if r.doc_id == 2] == [None]
    assert secrets.find_secrets(df.filter("false"), queries.RANKS).count() == 0


def test_secret_query_equals_brute_force(spark, sf, vocabulary):
    sf = f"{os.path.dirname(sf)}/sf0.01"  # the smallest table has no secrets
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op12_secret_scan(spark, sf).collect()
    assert len(out) == len(texts)
    n = 0
    for r in out:
        base = _plain_base(texts[r.doc_id])
        n += len(base)
        said = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, _, k in base) for kind in secrets.KINDS[:3])
        assert set(said) <= set(filter(None, r.spans.split(",")))
        for extra in set(filter(None, r.spans.split(","))) - set(said):
            kind, a, b = extra.split(":")
            run = texts[r.doc_id][int(a) : int(b)]
            assert kind == "random" and len(run) >= 20 and len(run) / len(vocabulary.encode_ordinary(run)) < secrets.CHARS_PER_TOKEN
            assert all(int(b) <= x or int(a) >= y for x, y, _ in base)
    assert n > 0


# --- rope


def _some_text(rnd):
    return "".join(rnd.choice(["a", "b ", "<P>", "<", "P", "S>", "\n", "😀", "é", "é"]) for _ in range(rnd.randint(0, 40)))


@pytest.mark.parametrize("unit", [None, r"\w+|\W+", r"\S+\s*", r"x"])
def test_rope_splits_and_joins(unit):
    rnd, pattern = random.Random(8), unit and re.compile(unit, re.DOTALL)
    for _ in range(800):
        text = _some_text(rnd)
        r = rope.Rope.of(text, pattern, leaf=3)
        ends = [*[m.end() for m in pattern.finditer(text)][:-1], len(text)] if pattern else list(range(1, len(text) + 1))
        units = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)] if text else []
        assert (str(r), r.units, r.points) == (text, len(units), len(text))
        k = rnd.randint(0, len(units))
        a, b = r.split(k)
        assert (str(a), str(b), a.units, b.units) == ("".join(units[:k]), "".join(units[k:]), k, len(units) - k)
        again = b + a
        at = rnd.randint(0, len(text))
        assert "".join(map(str, again.split(at, "points"))) == str(again) == str(b) + str(a)


@pytest.mark.parametrize("unit", [None, r"\S+\s*"])
def test_forms_are_undone(spark, unit):
    rnd = random.Random(9)
    rows = [(k, _some_text(rnd)) for k in range(400)] + [(None, "no id"), (7, "again"), (7, "again"), (500, None), (501, ""), (502, "long 😀 " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Form", F.lit("clash")).withColumn("output", F.lit(1))
    out = rope.undo(rope.fill_in_middle(df, unit=unit)).collect()
    assert len(out) == len(rows)
    forms = {}
    for r in out:
        text = r.text or ""
        forms[r.form] = forms.get(r.form, 0) + 1
        assert r.restored == text
        if r.form == "plain":
            assert r.output == text and r.prefix_chars is None and r.middle_chars is None
        else:
            p, m = r.prefix_chars, r.middle_chars
            a, b, c = text[:p], text[p : p + m], text[p + m :]
            assert r.output == (f"<P>{a}<S>{c}<M>{b}" if r.form == "psm" else f"<S>{c}<P>{a}<M>{b}")
        if "<P>" in text or not text:
            assert r.form == "plain"
    assert forms["psm"] > forms["spm"] > 0
    assert rope.fill_in_middle(df.filter("false")).count() == 0


def test_sentinels_that_could_be_mistaken_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "><", "<M>"), ("<P>", "<P>>", "<M>")):
        with pytest.raises(ValueError):
            rope.Sentinels(*marks)
    with pytest.raises(ValueError):
        rope.restore("<P>a<S>b", "psm", rope.Sentinels())
