import pytest
from pyspark.sql import functions as F

from annalist.llm import chat, decontam, queries, templates
from tests.compare import same_rows

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op2_decontamination", "op6_line_dedup", "op10_chat_format"])
def test_equals_sql(spark, duck, sf, name):
    same_rows(queries.QUERIES[name](spark, sf), duck, queries.SQL[name])


@pytest.mark.parametrize("name", ["op2_decontamination", "op6_line_dedup", "op10_chat_format"])
def test_runs_no_python(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("PythonUDF", "MapInArrow", "MapInPandas", "ArrowEvalPython"))


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 2


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_contamination(spark, broadcast):
    words = ITEM.split()
    edited = words[:]
    edited[1] = "changed"
    half = "x y " + " ".join(words[:20])
    docs = spark.createDataFrame(
        [(1, "Before, " + ITEM.upper() + " after"), (2, " ".join(edited)), (3, half), (4, None), (5, ""), (6, "two words"), (7, "z " * 60_000 + ITEM), (None, ITEM), (8, " ".join(words[:-1]))], DOCS
    ).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(10, ITEM), (11, "two words"), (12, None), (13, "..."), (10, ITEM)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (round(r.similarity, 3), r.start_word) for r in decontam.contaminated(docs, bench, broadcast_seeds=broadcast).collect()}
    n = len(words) - 4
    assert found == {(1, 10): (1.0, 2), (2, 10): (round((n - 2) / (n + 2), 3), 1), (6, 11): (1.0, 1), (7, 10): (1.0, 60_001), (None, 10): (1.0, 1), (8, 10): (round((n - 1) / n, 3), 1)}
    assert decontam.contaminated(docs.filter("false"), bench).count() == 0
    assert decontam.contaminated(docs, bench.filter("false")).count() == 0


def test_simhash_blocks_find_all_pairs_within_the_radius(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for _ in range(200):
        a = rnd.getrandbits(63)
        b = a
        for k in rnd.sample(range(63), rnd.randint(0, 19)):
            b ^= 1 << k
        rows.append((a, b))
    pairs = spark.createDataFrame(rows, "a long, b long")
    meet = F.arrays_overlap(F.transform(decontam._blocks(F.col("a"), 19), lambda x: x.cast("string")), F.transform(decontam._blocks(F.col("b"), 19), lambda x: x.cast("string")))
    assert pairs.filter(meet).count() == 200


def test_repeated_shingles_count_with_their_number(spark):
    row = spark.createDataFrame([([1, 1, 2],)], "s array<bigint>")
    assert row.select(F.size(F.array_distinct(decontam._numbered(F.col("s")))).alias("n")).first().n == 3


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_line_templates(spark, limit):
    fixed = "this page was served to you"
    docs = [(k, f"own line number {'abcdefgh'[k]} of this text only\n{fixed}\ncall {k} at 555-{k} for your free offer now\nthe known user {'abcdefgh'[k]} has logged in from our main office today\nok") for k in range(8)]
    docs += [(20, None), (21, ""), (22, fixed), (22, fixed), (23, fixed + "\n" + fixed), (None, "x\n" + fixed)]
    frame = spark.createDataFrame(docs, DOCS).withColumn("form", F.lit(0)).withColumn("drop", F.lit(0))
    found = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in templates.drop_recurring_lines(frame, min_docs=5, broadcast_rows=limit).collect()), key=str)
    wanted = [(k, "ok", 5, 4) for k in range(8)] + [(20, "", 1, 0), (21, "", 1, 0), (22, "", 1, 1), (22, "", 1, 1), (23, "", 2, 2), (None, "x", 2, 1)]
    assert found == sorted(wanted, key=str)
    assert templates.drop_recurring_lines(frame.filter("false")).count() == 0


def test_copies_of_a_document_do_not_make_a_template(spark):
    docs = spark.createDataFrame([(k, "one two three four five\nsix seven eight nine ten") for k in range(20)], DOCS)
    assert templates.drop_recurring_lines(docs).filter("n_dropped > 0").count() == 0


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_several_templates_share_a_leaf(spark, tmp_path, limit):
    """Templates of one length and lead: in parts of a half, three eighths and less; one with two fields of frequent values; prose."""
    import itertools

    import duckdb

    from annalist.llm import queries
    from tests.compare import same_rows

    word = ["".join(x) for x in itertools.product("abcdefgh", repeat=3)]
    lines = [f"the known user {w} logged in from our main office" for w in word[:60]]
    lines += [f"the known user list was sent by {w} before noon" for w in word[:90]]
    lines += [f"the known user of {a} went away to the {b}" for a, b in itertools.product(word[:9], word[9:18])]
    prose = [f"the known user {' '.join(word[(7 * k * k + 31 * k * i + i) % 512] for i in range(7))}" for k in range(200)]
    rare = [f"the known user {w} was never seen here by day" for w in word[:4]]
    wide = ["登録利用者は本日事務所より接続し記録を残した後に退出したことをここに知らせるものであるから注意されたい"] * 5
    docs = [(k, f"own {k}\n{x}") for k, x in enumerate(lines + prose + rare)] + [(1000 + k, f"line {'abcde'[k]}\n{x}\n短い行") for k, x in enumerate(wide)]
    frame = spark.createDataFrame(docs, DOCS)
    found = {r.doc_id: r.n_dropped for r in templates.drop_recurring_lines(frame, broadcast_rows=limit).collect()}
    n = len(lines)
    assert all(found[k] == 1 for k in range(n))
    assert not any(found[k] for k in range(n, n + len(prose) + len(rare)))
    assert all(found[1000 + k] == 1 for k in range(5))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(templates.drop_recurring_lines(frame, broadcast_rows=limit), con, queries.SQL["op6_line_dedup"])
    forms = templates.recurring_forms(frame).select("template").distinct().collect()
    assert ["the", "known", "user", "of", None, "went", "away", "to", "the", None] in [r.template for r in forms]


TURNS = "conv_id long, turn long, role string, text string"


def test_chats_read_back_whatever_they_say(spark):
    hard = ["\\### Assistant: </turn> ok", "</turn>", "\\", "\\\\h", "a\\bc", "####", "##", "#", "", "</turn>\n### user: hi</turn>\n", "\n", "é: \U0001f600", "x" * 200_000]
    rows = [(k, t, r, x) for k, x in enumerate(hard) for t, r in ((0, "user"), (1, "assistant"))]
    rows += [(100, 0, "user", None), (100, 1, "assistant", None), (101, 0, None, "x"), (102, 0, "ro:le\\", "y"), (103, None, "user", "n"), (103, 1, "assistant", "m")]
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, TURNS).withColumn("t", F.lit(1)))).collect()}
    for k, x in enumerate(hard):
        assert [(t.role, t.text) for t in out[k].turns] == [("user", x), ("assistant", x)]
        assert out[k].loss_text == x and out[k].valid
        assert "".join(s.text for s in out[k].segments) == out[k].formatted
    assert [(t.role, t.text) for t in out[100].turns] == [("user", ""), ("assistant", "")]
    assert (out[101].valid, out[101].first_error, out[101].turns[0].role) == (False, 1, "")
    assert out[102].turns[0].role == "ro:le\\"
    assert out[103].valid and out[103].loss_text == "m"
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize(
    ("roles", "valid", "first_error"),
    [("sua", True, None), ("uaua", True, None), ("u", False, None), ("a", False, 1), ("usa", False, 2), ("uua", False, 2), ("suaa", False, 4), ("x", False, 1)],
)
def test_role_machine(spark, roles, valid, first_error):
    name = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    r = chat.format_chats(spark.createDataFrame([(1, k, name[c], "t") for k, c in enumerate(roles)], TURNS)).first()
    assert (r.valid, r.first_error) == (valid, first_error)


def test_ties_and_repeated_turns_have_one_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    texts = {chat.format_chats(spark.createDataFrame(x, TURNS)).first().formatted for x in (rows, rows[::-1])}
    assert len(texts) == 1


def test_parts_of_an_item_in_another_order_are_found(spark):
    a, b = ([f"{x}{k}" for k in range(50)] for x in "ab")
    other = [f"o{k}" for k in range(200)]
    docs = spark.createDataFrame([(1, " ".join(other[:100] + b + a + other[100:])), (2, " ".join(other[:100] + b[:20] + a[:20] + other[100:]))], DOCS)
    bench = spark.createDataFrame([(10, " ".join(a + b))], "item_id long, text string")
    found = [(r.doc_id, r.item_id, round(r.similarity, 3), r.start_word) for r in decontam.contaminated(docs, bench).collect()]
    assert found == [(1, 10, round(92 / 100, 3), 101)]


def test_long_texts_lose_the_same_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, "one\ntwo\nthree"), (-2, "one\ntwo\nthree")], DOCS))
    key = lambda limit: sorted((tuple(r) for r in templates.drop_recurring_lines(docs, long_lines=limit).collect()), key=str)
    assert key(2_000) == key(2) == key(0)


def brute_leaks(docs, items, threshold=0.8):
    """Every window of an item's size at every start of every document, by multiplicity-weighted shingle similarity."""
    import re
    from collections import Counter

    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bags = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for d, t in docs:
        w = tokens(t)
        for i, x in items:
            v = tokens(x)
            k = min(5, len(v))
            if not v or len(w) < k:
                continue
            b = bags(v, k)
            for start in range(max(1, len(w) - len(v) + 1)):
                a = bags(w[start : start + len(v)], k)
                common = sum((a & b).values())
                s = common / (sum(a.values()) + sum(b.values()) - common)
                if s >= threshold:
                    out[d, i] = max(out.get((d, i), 0), round(s, 9))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_window_of_a_document_is_missed(spark, seed):
    """Items edited at an edge, in a run, here and there, with halves exchanged, in long and short documents."""
    import random

    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [(k, [word() for _ in range(rnd.choice([1, 3, 4, 5, 8, 22, 40, 60, 100]))]) for k in range(25)]
    docs = []
    for _ in range(120):
        body = [word() for _ in range(rnd.randint(0, 150))]
        for _ in range(rnd.randint(1, 2)):
            x = rnd.choice(items)[1][:]
            n = max(1, len(x) // 9)
            how = rnd.randrange(5)
            if how == 1:
                x[-n:] = [word() for _ in range(n)]
            elif how == 2:
                at = rnd.randrange(len(x))
                x[at : at + n] = [word() for _ in range(len(x[at : at + n]))]
            elif how == 3:
                for at in rnd.sample(range(len(x)), min(len(x), max(1, len(x) // 45))):
                    x[at] = word()
            elif how == 4:
                x = x[len(x) // 2 :] + x[: len(x) // 2]
            at = rnd.randint(0, len(body))
            body[at:at] = x
        docs.append((len(docs), " ".join(body)))
    items = [(k, " ".join(x)) for k, x in items]
    wanted = brute_leaks(docs, items)
    found = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found.collect()} == wanted and len(wanted) > 30


def test_texts_are_not_looked_through_again_for_their_forms(spark, monkeypatch):
    """Forms are made for the search, and for the lines of texts that have some to drop: two places of the whole job's plans."""
    made = []
    form = templates._form
    monkeypatch.setattr(templates, "_form", lambda line: (made.append(1), form(line))[1])
    rows = [(k, f"Page {k} of the daily report here\n\ttwo  tabs {k}\x0band more words") for k in range(8)] + [(k + 8, "Page 3 of the daily report here\nown words of one text only") for k in range(3)]
    df = templates.drop_recurring_lines(spark.createDataFrame([*rows, (20, None)], "doc_id long, text string"))
    assert {r.doc_id: (r.text, r.n_dropped) for r in df.collect()} == {**{k: ("", 2) for k in range(8)}, **{k + 8: ("own words of one text only", 1) for k in range(3)}, 20: ("", 0)}
    assert "transform(split" not in df._jdf.queryExecution().optimizedPlan().toString().split("array_contains")[0].split("Union")[0]
    assert len(made) == 2  # of short texts that are kept in part, and of long ones
