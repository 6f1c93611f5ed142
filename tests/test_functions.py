import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from annalist.functions import ids
from annalist.functions import text as X
from annalist.operators import govern as G
from annalist.operators import score as S
from annalist.operators import timing as Tm


def value(spark, text, function):
    return spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("$1.2bn", (Decimal("1200000000"), "USD")), ("about €3,400 paid", (Decimal("3400"), "EUR")), ("US$ 5 million", (Decimal("5000000"), "USD")), ("K250m", (Decimal("250000000"), "ZMW")), ("12 apples", None), (None, None)],
)
def test_money(spark, text, wanted):
    found = value(spark, text, X.parse_money)
    assert (found and (found.amount, found.currency)) == wanted


@pytest.mark.parametrize(("text", "wanted"), [("12.5%", Decimal("0.125")), ("7 per cent", Decimal("0.07")), ("none", None)])
def test_percent(spark, text, wanted):
    assert value(spark, text, X.parse_percent) == wanted


@pytest.mark.parametrize(("text", "wanted"), [("2024-03-01", dt.date(2024, 3, 1)), ("1 March 2024", dt.date(2024, 3, 1)), ("March 1, 2024", dt.date(2024, 3, 1)), ("soon", None)])
def test_dates(spark, text, wanted):
    assert value(spark, text, X.parse_date) == wanted


def test_value_in_quote(spark):
    rows = spark.createDataFrame([("1.2bn", "costs $1,200 million"), ("1.2bn", "costs $1.3bn"), ("5", None)], "v string, q string")
    assert [r.x for r in rows.select(X.value_in_quote(F.col("v"), F.col("q")).alias("x")).collect()] == [True, False, False]


@pytest.mark.parametrize(("text", "wanted"), [("It is reportedly closed", "reported"), ("The owner is in talks", "speculative"), ("It opened", "stated"), (None, "stated")])
def test_certainty(spark, text, wanted):
    assert value(spark, text, X.certainty) == wanted


def test_normalise(spark):
    assert value(spark, "é\r\na\rb", X.normalise) == "é\na\nb"
    assert value(spark, None, X.normalise) is None


def test_names_spans_and_ids(spark):
    assert value(spark, "  Acme Mining Co. Ltd ", X.name_key) == "acme mining"
    assert value(spark, "a\U0001f600bc", lambda t: X.span(t, F.lit(1), F.lit(3))) == "\U0001f600b"
    made = [r.u for r in spark.range(50).select(ids.ulid(F.col("id")).alias("u")).collect()]
    assert len(set(made)) == 50 and {len(u) for u in made} == {26}


def test_erased_people_cannot_be_read(spark):
    keys = spark.createDataFrame([("p", bytearray(b"0" * 16)), ("q", bytearray(b"1" * 16))], "person_id string, key binary")
    people = spark.createDataFrame([("p", "Ann"), ("q", "Bo")], "person_id string, name string").join(keys, "person_id")
    sealed = people.select("person_id", G.seal(F.col("name"), F.col("key")).alias("name")).cache()
    assert {r.person_id: r.name for r in G.unseal(sealed, keys, ["name"]).collect()} == {"p": "Ann", "q": "Bo"}
    left = G.erase(keys, spark.createDataFrame([("p",)], "person_id string"))
    assert {r.person_id: r.name for r in G.unseal(sealed, left, ["name"]).collect()} == {"p": None, "q": "Bo"}


def test_approval_and_roles(spark):
    rows = spark.createDataFrame([("EntityIdentified", "stated", 0.89), ("EntityIdentified", "stated", 0.9), ("EntityMerged", "stated", 1.0), ("SiteStatusChanged", "stated", 1.0), ("DemandDriverObserved", "reported", 1.0)], "e string, c string, p double")
    assert [r.d for r in rows.select(G.approval(F.col("e"), F.col("c"), F.col("p")).alias("d")).collect()] == ["review", "auto", "review", "review", "review"]
    roles = spark.createDataFrame([("viewer", "analyst"), ("admin", "viewer"), ("ghost", "viewer")], "a string, b string")
    assert [r.x for r in roles.select(G.can(F.col("a"), F.col("b")).alias("x")).collect()] == [False, True, False]


def test_nobody_approves_their_own(spark):
    proposals = spark.createDataFrame([("p1", "DealIdentified", "{}", ["e"], "stated", "ann"), ("p2", "DealIdentified", "{}", ["e"], "stated", "ann")], "id string, event_type string, payload string, evidence_ids array<string>, certainty string, created_by string")
    approvals = spark.createDataFrame([("p1", "ann", None, 1), ("p2", "bo", '{"edited": 1}', 2)], "proposal_id string, actor_id string, payload string, recorded_at long")
    assert [(r.proposal_id, r.payload, r.evidence_ids) for r in G.approve(proposals, approvals).collect()] == [("p2", '{"edited": 1}', ["e"])]


def test_formula_takes_only_known_columns(spark):
    rows = spark.createDataFrame([(2.0, 3.0), (None, 1.0)], "a double, b double")
    assert [r.estimate for r in S.estimate(rows, "a * (1 + b)", ["a", "b"]).collect()] == [8.0, None]
    for bad in ("a + c", "java_method(a)", "a; drop", "'a'"):
        with pytest.raises(ValueError):
            S.formula(bad, ["a", "b"])


def test_interval_support_and_forecast(spark):
    rows = [(f"p{k}", n, s, dt.date(2024, 1, 1 + n * (k + 1))) for k in range(5) for n, s in ((0, 1), (1, 2))] + [("q", 0, 2, dt.date(2024, 1, 1)), ("q", 1, 3, dt.date(2024, 1, 9))]
    events = spark.createDataFrame(rows, "p string, n int, stage int, at date")
    stats = Tm.interval_stats(Tm.stage_intervals(events, "p", ["n"], "stage", "at"), "p").cache()
    found = {(r.from_stage, r.to_stage): (r.median_days, r.projects, r.supported) for r in stats.collect()}
    assert found == {(1, 2): (3.0, 5, True), (2, 3): (8.0, 1, False)}
    now = spark.createDataFrame([("x", 1, dt.date(2024, 2, 1)), ("y", 2, dt.date(2024, 2, 1))], "p string, stage int, at date")
    dates = {r.p: (r.earliest, r.latest) for r in Tm.forecast(now, stats, "stage", "at").collect()}
    assert dates == {"x": (dt.date(2024, 2, 2), dt.date(2024, 2, 6)), "y": (None, None)}
