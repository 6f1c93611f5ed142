import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from annalist.llm import pagediff, pieces, queries

PATH = queries.PIECE_MODEL
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def scanned(model, text, chunk):
    """The max-plus scan without Spark."""
    text, n = " " + text, model.longest
    cut = [(text[max(0, at - n) : at], text[at : at + chunk], text[at + chunk : at + chunk + n]) for at in range(0, len(text), chunk)]
    states = pieces.resolve([model.transfer(*c) for c in cut], 0, 0)
    out = []
    for (left, body, right), enter, leave in zip(cut, states[:-1], states[1:], strict=True):
        begin = model.states(left, body[:n])[enter][1] if left else 0
        end = len(body) + (model.states((left + body)[-n:], right)[leave][1] if right else 0)
        out += model.encode((body + right)[begin:end]) if end > begin else []
    return out


@pytest.mark.parametrize("kind", range(6))
def test_scan_equals_the_library(model, library, spark, sf, kind):
    rnd = random.Random(kind)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    for _ in range(25):
        base = rnd.choice(texts)[: rnd.randint(1, 900)]
        text = [base, base.replace(" ", ""), "".join(rnd.choice("abetnoirs   é\U0001f600\n") for _ in range(rnd.randint(1, 400))), " " * rnd.randint(1, 300) + base[:50], rnd.choice(["a", "ab", "the", "ha", "é"]) * rnd.randint(1, 300), base.upper()][kind]
        assert scanned(model, text, 64) == library.encode(text)


def test_matrices_combine_associatively(model):
    text = " " + "internationalisationofthings" * 12
    cut = [(text[max(0, a - 16) : a], text[a : a + 64], text[a + 64 : a + 80]) for a in range(0, len(text), 64)]
    m = [model.transfer(*c) for c in cut]
    left = right = m[0]
    for x in m[1:]:
        left = pieces.compose(left, x)
    right = m[-1]
    for x in m[-2::-1]:
        right = pieces.compose(x, right)
    assert (left == right).all() and left.sum() == 1


def test_encode_and_decode_every_kind_of_text(spark, library):
    texts = ["", None, " ", "  a  b ", "▁x", "a▁b", "hello\n\tworld\r\n", "é\U0001f600", "<s> </s> <unk> <0x0A>", "word " * 9000, "x" * 40_000, " " * 3000 + "▁" * 100, "\x00"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(9, "word " * 9000), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("old")).withColumn("key", F.lit(1)).withColumn("chunk", F.lit(2))
    for chunk in (64, 5000):
        out = pieces.decode(pieces.encode(docs, PATH, chunk=chunk, verify="ok"), PATH).collect()
        assert len(out) == len(rows) and sorted(map(str, (r.doc_id for r in out))) == sorted(str(i) for i, _ in rows)
        for r in out:
            assert r.decoded == (r.text or "") and r.ok and (r.key, r.chunk) == (1, 2)
            if r.text and "▁" not in r.text and len(r.text) < 50_000:
                assert list(r.ids) == library.encode(r.text)
    assert pieces.encode(docs.filter("false"), PATH).count() == 0


def test_a_text_without_one_path_is_encoded_by_the_library(spark, library, monkeypatch):
    """A scan that fails: every product of matrices is empty."""
    text = " ".join(f"word{k}" for k in range(300))
    docs = spark.createDataFrame([(1, text), (2, text + "\u2581"), (3, "short")], "doc_id long, text string").withColumn("__key", F.lit("theirs")).withColumn("__decoded", F.lit("also"))
    steps = pieces._resolved(pa.table({"key": ["a"], "block": pa.array([0], pa.int32()), "matrix": [pieces._pack(np.zeros((1, 1), bool))]}), "block", 0, 0)
    assert steps.column("enter").to_pylist() == [-1] and pieces._resolved(steps.append_column("matrix", pa.array([b""])), "block", -1, -1).column("leave").to_pylist() == [-1]
    monkeypatch.setattr(pieces.Pieces, "transfer", lambda self, left, body, right: np.zeros((len(self.states(left, body[: self.longest])) if left else 1, len(self.states((left + body)[-self.longest :], right)) if right else 1), bool))
    out = {r.doc_id: r for r in pieces.encode(docs, PATH, chunk=64, verify="ok").collect()}
    assert list(out[1].ids) == library.encode(text) and all(r.ok and r["__key"] == "theirs" and r["__decoded"] == "also" for r in out.values()) and len(out) == 3


def test_encode_the_table(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_sentencepiece(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.round_trip and list(r.ids) == library.encode(docs[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def article(title, *parts):
    body = "".join(f"<p>{p}</p>" for p in parts)
    return f"<html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body><nav><a href=/>menu</a></nav><article><h1>{title}</h1>{body}<aside>see also</aside><div class='comments'>nice<div>more</div></div></article><footer>&copy; us</footer></body></html>"


def test_lines_of_marked_pages():
    page = article("A &amp; B", "one\n two&nbsp;three<br>four", "<b>bold</b> text", "") + "<!-- ad --><div id=cookie-notice>cookies</div>"
    assert [t for t, inside in pagediff.lines_of(page) if inside] == ["A & B", "one two three four", "bold text"]
    assert pagediff.lines_of("") == [] and pagediff.lines_of("just text &lt;b&gt;") == [("just text <b>", False)]
    assert pagediff.lines_of("<p>a<p>b<div hidden>c</div><script>x") == [("a", False), ("b", False)]
    assert pagediff.lines_of("<div class='ad'><div>x</div>y</div><p>z") == [("z", False)]


def brute_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_longest():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randint(0, 14))] for _ in range(2))
        shared = pagediff.common_lines(a, b)
        assert len(shared) == brute_common(a, b)
        it = iter(b)
        assert all(a[i] in it for i in sorted(shared))


def test_differencing_deletes_the_frame_of_unmarked_pages(spark):
    frame = lambda k: f"<body><div>Top line of site</div><div>Home | About</div><p>Own text {k} with many words of its own, long enough to be most of the page.</p><div>All rights reserved</div>"
    pages = [(k, f"http://h.example/{k}", frame(k)) for k in range(6)] + [(10, "http://other.example/1", frame(3)), (11, None, None), (12, "http://h.example/5", frame(5)), (13, "", "")]
    df = spark.createDataFrame(pages, PAGES).withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    out = {r.page_id: (r.text, r.n_chars) for r in pagediff.main_texts(df).collect()}
    own = lambda k: f"Own text {k} with many words of its own, long enough to be most of the page."
    for k in range(5):
        assert out[k] == (own(k), len(own(k)))
    assert out[5][0] in (own(5), "\n".join(["Top line of site", "Home | About", own(5), "All rights reserved"]))
    assert own(3) in out[10][0] and out[11] == ("", 0) and out[13] == ("", 0)
    assert pagediff.main_texts(df.filter("false")).count() == 0


def test_marked_articles_keep_what_they_share(spark):
    pages = [(k, f"http://h.example/a/{k}", article(f"title {k}", "the same paragraph", f"own {k}")) for k in range(5)]
    out = {r.page_id: r.text for r in pagediff.main_texts(spark.createDataFrame(pages, PAGES)).collect()}
    assert out == {k: f"title {k}\nthe same paragraph\nown {k}" for k in range(5)}


def test_extraction_of_the_table(spark, sf):
    """Articles of the pages are the documents that their urls number, under a title."""
    docs = {r.doc_id: [" ".join(x.split()) for x in r.text.split("\n") if x.strip()] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_html_extraction(spark, sf).withColumn("doc", F.regexp_extract("url", r"://[^/]+/[a-z]+/([0-9]+)", 1).try_cast("long")).collect()
    known = [r for r in rows if r.doc in docs]
    assert len(known) > 10 and all(r.text.split("\n")[1:] == docs[r.doc] for r in known)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_short_articles_lose_a_long_frame_wherever_tasks_end(spark):
    frame = "".join(f"<div>Entry {k} of the long menu of this site</div>" for k in range(20))
    page = lambda k: f"<body>{frame}<p>own {k}</p><div>All rights reserved</div>"
    rows = [(k, f"http://h.example/{k:03}", page(k)) for k in range(9)]
    rows += [(100 + k, f"http://h.example/004/{k:02}", page(4)) for k in range(12)]  # a run of copies
    rows += [(200, "http://g.example/1", page(1)), (201, "http://g.example/2", page(2)), (202, None, None)]
    wanted = {i: f"own {4 if i >= 100 else i}" for i, _, _ in rows if i < 200} | {200: "own 1", 201: "own 2", 202: ""}
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that tasks stay as small as they are dealt
        for n in ("1", "3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.page_id: r.text for r in pagediff.main_texts(spark.createDataFrame(rows, PAGES)).collect()} == wanted
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def brute_texts(rows):
    """Nearest-URL differencing in plain loops: the page before and the page after of the host that are no copies."""
    made = {i: pagediff.blocks_of(h or "") for i, _, h in rows}
    stays = {i: pagediff._may_stay(b) for i, b in made.items()}
    main = {i: [t for (t, _), s in zip(b, stays[i], strict=True) if s] for i, b in made.items()}
    split = {i: (u or "").split("://")[-1].partition("/") for i, u, _ in rows}
    order = sorted(made, key=lambda i: (split[i][0], "/" + split[i][2]))
    out = {}
    for at, i in enumerate(order):
        around = []
        for way in (range(at - 1, -1, -1), range(at + 1, len(order))):
            j = next((order[k] for k in way if split[order[k]][0] != split[i][0] or main[order[k]] != main[i]), None)
            if j is not None and split[j][0] == split[i][0]:
                around.append(j)
        alike = lambda j: pagediff._alike(split[i][2], split[j][2])
        lines, found, both = [t for t, _ in made[i]], None, None
        for j in sorted(around, key=lambda j: -alike(j)):
            shared = pagediff.common_lines(lines, [t for t, _ in made[j]])
            assert len(shared) == brute_common(lines, [t for t, _ in made[j]])
            if 2 * sum(len(lines[k]) for k in shared if stays[i][k]) < sum(map(len, main[i])):
                found = shared
                break
            both = shared if both is None else both & shared
        out[i] = pagediff.text_of(made[i], found if found is not None else both or set())[0]
    return out


def frames(seed):
    """Pages of four hosts with a frame that markup names, one that it does not, and one in part; own text, shared passages, copies."""
    rnd = random.Random(seed)
    say = lambda n: " ".join(rnd.choice("abcdefghijkl") * 3 for _ in range(n))
    passages, rows = [say(30) for _ in range(3)], []
    for host in range(4):
        menu, notice, foot = [f"menu{host} {say(2)}" for _ in range(8)], f"notice{host} {say(6)}", f"foot{host} {say(4)}"
        for k in range(9):
            body = [f"title {host} {k}", say(12), *rnd.sample(passages, rnd.randint(0, 2)), say(12)]
            text = "".join(f"<p>{x}</p>" for x in body)
            bare = "".join(f"<div>{m}</div>" for m in menu)
            page = [
                f"<nav>{bare}</nav><div class='notice'>{notice}</div><article>{text}</article><div class='comments'>own comment {k}</div><footer>{foot}</footer>",
                f"{bare}<div>{notice}</div><div>{text}</div><div>{foot}</div>",
                f"{bare}<div>{notice}</div><article>{text}</article><div>{foot}</div>",
                f"<nav>{bare}</nav><div>{notice}</div><div>{text}</div><div class='comments'>own comment {k}</div><div>{foot}</div>",
            ][host]
            rows.append((len(rows), f"http://h{host}.example/{k // 3}/{k}", page))
            if k == 4:
                rows += [(len(rows) + c, f"http://h{host}.example/{k // 3}/{k}-{c}", page) for c in range(5)]
    return rows


@pytest.mark.parametrize("partitions", ["1", "4", "31"])
def test_differencing_equals_plain_loops_at_any_number_of_tasks(spark, partitions):
    rows = frames(5)
    wanted = brute_texts(rows)
    assert all("notice" not in t and "menu" not in t and "comment" not in t and "foot" not in t for t in wanted.values())
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        out = pagediff.main_texts(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.page_id: r.text for r in out} == wanted
    assert all(r.n_shared >= 10 for r in out)  # the frame of eight entries, a notice and a foot goes by differencing


def test_names_that_only_look_like_frames_stay():
    kept = lambda html: [t for t, _ in pagediff.lines_of(html)]
    assert kept('<article><p class="light-rail">The tram opened.</p><h2 id="search">Search for survivors</h2><p class="ad-1990">x</p></article>') == ["The tram opened.", "Search for survivors", "x"]
    assert kept('<body><div class="social-policy"><p>Policy.</p></div>') == ["Policy."]
    assert kept("<p>before <label>a label</label> after</p>") == ["before a label after"]
    assert kept("<p>before <span class='share'>Share!</span> after</p>") == ["before after"]
    assert kept("<div data-class='ad'>x</div><div class='box ad'>y</div>") == ["x"]


def test_differencing_deletes_lines_of_the_table(spark, sf):
    """The frames of the table differ from page to page of a host, but some of their lines recur."""
    n, by_pair, by_markup = queries.op4_html_extraction(spark, sf).agg(F.count(F.lit(1)), F.count_if(F.col("n_shared") > 0), F.count_if(F.col("n_marked") > 0)).first()
    print(f"of {n} pages, {by_pair} lose lines by differencing, {by_markup} by markup")
    assert 0 < by_pair <= n


@pytest.mark.parametrize("name", sorted(pagediff.UNSURE))
def test_unsure_names_in_an_article_are_decided_by_the_nearest_page(spark, name):
    """Text of its own stays, whatever the class; what the nearest page has too goes; outside of articles the name is a mark."""
    page = lambda k, inside: f"<body><div class='{name}'>Outer {k}</div><article><p>Intro {k} of some length</p><div class='{name}'><p>{inside}</p></div><p>End {k} of the article</p></article></body>"
    own = lambda k: f"Intro {k} of some length\nThe body paragraph {k}.\nEnd {k} of the article"
    rows = [(1, "http://h.example/a/1", page(1, "The body paragraph 1.")), (2, "http://h.example/a/2", page(2, "The body paragraph 2."))]
    rows += [(k, f"http://s.example/a/{k}", page(k, "Tell your friends")) for k in (3, 4, 5)] + [(6, "http://one.example/a", page(6, "The body paragraph 6."))]
    out = {r.page_id: r.text for r in pagediff.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert out == {k: own(k) for k in (1, 2, 6)} | {k: f"Intro {k} of some length\nEnd {k} of the article" for k in (3, 4, 5)}
    assert [t for t, _ in pagediff.lines_of(f"<article><p>a</p><div class='{name} comments'>b</div><p>c <span class='{name}'>d</span></p></article>")] == ["a", "c"]
