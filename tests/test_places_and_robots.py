"""Areas against closed forms and plain loops; robots patterns against a plain matcher."""

import random

import pytest
from pyspark.sql import functions as F

from annalist.functions.geo import shape
from annalist.operators import documents as D
from annalist.sources import store as St


@pytest.mark.parametrize(
    ("wkt", "expected"),
    [
        ("POINT (1.5 -2)", ("point", 1.5, -2.0, 0.0)), ("  point(3e1   .5)  ", ("point", 30.0, 0.5, 0.0)), ("POINT Z (1 2 9)", ("point", 1.0, 2.0, 0.0)),
        ("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))", ("polygon", 2.0, 1.0, 8.0)), ("POLYGON((0 0,0 2,4 2,4 0,0 0))", ("polygon", 2.0, 1.0, 8.0)),
        ("POLYGON ((0 0, 6 0, 0 3, 0 0))", ("polygon", 2.0, 1.0, 9.0)),
        ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 2 0, 2 4, 0 4, 0 0))", ("polygon", 3.0, 2.0, 8.0)), ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 0 4, 2 4, 2 0, 0 0))", ("polygon", 3.0, 2.0, 8.0)),
        ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((2 0, 4 0, 4 1, 2 1, 2 0), (2 0, 3 0, 3 1, 2 1, 2 0)))", ("multipolygon", 2.0, 0.5, 2.0)),
        ("POLYGON ((1000000 1000000, 1000001 1000000, 1000001 1000001, 1000000 1000001, 1000000 1000000))", ("polygon", 1000000.5, 1000000.5, 1.0)),
        ("POLYGON ((0 0, 1 0, 1 1, 0 1))", None), ("POLYGON ((0 0, 1 0, 0 0))", None), ("POLYGON ((0 0, 1 1, 2 2, 0 0))", None), ("POLYGON EMPTY", None), ("LINESTRING (0 0, 1 1)", None), ("POINT (1)", None),
        ("POINT (1 2, 3 4)", None), ("POLYGON (0 0, 1 0, 1 1, 0 0)", None), ("POLYGON ((0 0, 1 0, 1 x, 0 0))", None), ("", None), (None, None), ("POLYGON (((0 0, 1 0, 1 1, 0 0)))", None),
    ],
)
def test_shapes(spark, wkt, expected):
    got = spark.createDataFrame([(wkt,)], "wkt string").select(shape(F.col("wkt")).alias("s")).first().s
    assert (got is None) == (expected is None)
    if got:
        assert got.kind == expected[0] and all(abs(a - b) < 1e-9 for a, b in zip(got[1:], expected[1:], strict=True))


def test_a_long_outline(spark):
    """A star of many places, against plain loops; text of any length is read without deep recursion."""
    rnd = random.Random(2)
    points = []
    import math

    for k in range(20_000):
        r = 1 + rnd.random()
        points.append((3 + r * math.cos(2 * math.pi * k / 20_000), 5 + r * math.sin(2 * math.pi * k / 20_000)))
    points.append(points[0])
    area = cx = cy = 0.0
    for (a, b), (c, d) in zip(points, points[1:], strict=False):
        cross = (a - 3) * (d - 5) - (c - 3) * (b - 5)
        area, cx, cy = area + cross / 2, cx + cross * (a + c - 6) / 6, cy + cross * (b + d - 10) / 6
    wkt = "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in points) + "))"
    got = spark.createDataFrame([(wkt,)], "wkt string").select(shape(F.col("wkt")).alias("s")).first().s
    assert abs(got.area - area) < 1e-6 and abs(got.lon - 3 - cx / area) < 1e-6 and abs(got.lat - 5 - cy / area) < 1e-6


def test_areas_give_sites_their_points(spark):
    rows = [("a", "point", 1.0, 2.0, None, False, "e"), ("b", "area", None, None, "POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))", False, "e"), ("c", "area", None, None, "broken", True, "e")]
    points = St.shaped(spark.createDataFrame(rows, "site_id string, kind string, lon double, lat double, wkt string, approximate boolean, evidence_id string"))
    sites = spark.createDataFrame([(s, "d") for s in "abcx"], "site_id string, district string")
    out = St.site_point(sites, points, spark.createDataFrame([("other", 9.0, 9.0)], "district string, lon double, lat double"))
    assert {r.site_id: (r.lon, r.lat, r.approximate) for r in out.collect()} == {"a": (1.0, 2.0, False), "b": (2.0, 1.0, False), "c": (None, None, None), "x": (None, None, None)}


def _plain_match(path, pattern):
    """By trying every length for every star."""
    ends = pattern.endswith("$")
    pattern = pattern[:-1] if ends else pattern

    def fits(i, j):
        if j == len(pattern):
            return i == len(path) or not ends
        if pattern[j] == "*":
            return any(fits(k, j + 1) for k in range(i, len(path) + 1))
        return i < len(path) and path[i] == pattern[j] and fits(i + 1, j + 1)

    return fits(0, 0)


def test_patterns_equal_a_plain_matcher(spark):
    rnd = random.Random(7)
    make = lambda chars, n: "/" + "".join(rnd.choice(chars) for _ in range(rnd.randint(0, n)))
    rules = [(f"h{k % 6}", make("ab*$./\\E?", 6), rnd.random() < 0.5) for k in range(60)] + [("h0", "", False), ("h0", None, False), ("h1", "*", False), ("h2", "$", True)]
    asked = [(k, f"h{k % 7}", make("ab./\\E?$", 7)) for k in range(400)]
    got = {r.k: r.allowed for r in D.allowed_by_patterns(spark.createDataFrame(asked, "k long, host string, path string"), spark.createDataFrame(rules, "host string, pattern string, allow boolean")).collect()}
    for k, host, path in asked:
        fit = [(len(p), allow) for h, p, allow in rules if h == host and p and _plain_match(path, p)]
        assert got[k] == (max(fit)[1] if fit else True), (host, path)


def test_rules_of_the_agent_come_first(spark):
    rules = spark.createDataFrame([("h", "*", "/", False), ("h", "Annalist", "/private", False), ("g", "*", "/x", False), ("g", "other", "/", False)], "host string, agent string, pattern string, allow boolean")
    asked = spark.createDataFrame([("h", "/a"), ("h", "/private/a"), ("g", "/x"), ("g", "/y"), ("n", "/")], "host string, path string")
    got = {(r.host, r.path): r.allowed for r in D.allowed_by_patterns(asked, rules, agent="annalist").collect()}
    assert got == {("h", "/a"): True, ("h", "/private/a"): False, ("g", "/x"): False, ("g", "/y"): True, ("n", "/"): True}
