"""Areas as Columns: well-known text of points, polygons with holes and multipolygons, their size and centre of area."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[-+]?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?|[-+]?\.[0-9]+(?:[eE][-+]?[0-9]+)?"
_PLACE = rf"(?:{_NUMBER}) (?:{_NUMBER})(?: (?:{_NUMBER}))?"


def _plain(wkt: Column) -> Column:
    """One space between numbers, none elsewhere."""
    tidy = F.upper(F.trim(F.regexp_replace(wkt, r"\s+", " ")))
    return F.regexp_replace(tidy, r" ?([(),]) ?", "$1")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, where functions over arrays would work it out for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _points(ring: Column) -> Column:
    number = lambda p, k: F.try_element_at(F.split(p, " "), F.lit(k)).try_cast("double")
    return F.transform(F.split(ring, ","), lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y")))


def _form(text: Column) -> Column:
    """What is left of a shape when its places, rings and polygons are folded one after another; no expression grows with the text."""
    out = F.regexp_replace(text, _PLACE, "p")
    for found, name in ((r"\(p\)", "r"), (r"\(r\)", "q")):
        out = F.regexp_replace(F.replace(out, F.lit("," + found[2]), F.lit("")), found, name)
    return F.replace(out, F.lit(",q"), F.lit(""))


def _sums(points: Column, outer: Column, x0: Column, y0: Column) -> Column:
    """Area and moments of a ring about (x0, y0), counted against the shape where it is a hole, whichever way it runs."""
    n = F.size(points)
    step = lambda a, b: F.struct(
        ((a["x"] - x0) * (b["y"] - y0) - (b["x"] - x0) * (a["y"] - y0)).alias("c"), (a["x"] + b["x"] - 2 * x0).alias("sx"), (a["y"] + b["y"] - 2 * y0).alias("sy")
    )
    steps = F.zip_with(F.slice(points, F.lit(1), n - 1), F.slice(points, F.lit(2), n - 1), step)
    total = lambda value: F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + value(s))
    area = total(lambda s: s["c"]) / 2
    sign = F.when(outer, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.signum(area)
    return F.struct((sign * area).alias("area"), (sign * total(lambda s: s["c"] * s["sx"]) / 6).alias("mx"), (sign * total(lambda s: s["c"] * s["sy"]) / 6).alias("my"))


def shape(wkt: Column) -> Column:
    """kind (point, polygon, multipolygon), lon, lat and area (in square degrees, as on a plane) of a well-known text; null if it is none
    of these, or has no area. A ring has four places or more and ends where it begins.

    lon and lat of an area are its centre weighted by area, without its holes: it may lie outside of the area. The first ring of
    a polygon is its outline, further ones are holes, whichever way they run. A third number of a place is passed over.
    """
    text = _plain(wkt)
    kind = F.lower(F.regexp_extract(text, r"^([A-Z]+?)(?: ?Z)?\(", 1))
    body = F.regexp_extract(text, r"^[A-Z ]+(\(.*)$", 1)
    ring = r",?(\(+)([^()]+)\)"
    opened, written = F.regexp_extract_all(body, F.lit(ring), F.lit(1)), F.regexp_extract_all(body, F.lit(ring), F.lit(2))
    read = F.zip_with(opened, written, lambda o, w: F.struct((F.length(o) > 1).alias("outer"), _points(w).alias("points")))

    def of(rings: Column) -> Column:
        first = F.try_element_at(F.try_element_at(rings, F.lit(1))["points"], F.lit(1))
        return _let(first, lambda f: _let(F.transform(rings, lambda r: _sums(r["points"], r["outer"], f["x"], f["y"])), lambda sums: placed(rings, f, sums)))

    def placed(rings: Column, first: Column, sums: Column) -> Column:
        total = lambda name: F.aggregate(sums, F.lit(0.0), lambda acc, s: acc + s[name])
        closed = F.forall(rings, lambda r: (F.size(r["points"]) >= 4) & (F.element_at(r["points"], 1) == F.element_at(r["points"], -1)))
        form, area = _form(text), total("area")
        one = F.rlike(form, F.lit("^POINT ?Z?r$")) & (F.size(F.try_element_at(rings, F.lit(1))["points"]) == 1)
        many = F.rlike(form, F.lit(r"^(POLYGON ?Z?q|MULTIPOLYGON ?Z?\(q\))$")) & closed & (area > 0)
        point = F.struct(kind.alias("kind"), first["x"].alias("lon"), first["y"].alias("lat"), F.lit(0.0).alias("area"))
        whole = F.struct(kind.alias("kind"), (first["x"] + total("mx") / area).alias("lon"), (first["y"] + total("my") / area).alias("lat"), area.alias("area"))
        return F.when(one, point).when(many, whole)

    return _let(read, of)
