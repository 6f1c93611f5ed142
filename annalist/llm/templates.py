"""Line dedup by a log-template tree, in DataFrame functions only.

A line is its tokens (between white space) with every run of digits masked as 0. The tree has a fixed depth: token count, then
the first ``LEADING`` tokens; its leaves hold the distinct masked lines, called forms. A leaf has two kinds of templates:

* its modal one: the token that most documents have at a place is constant there if half of them have it, and every other place
  is a variable field. A form that agrees with the constants on ``alike`` of its places or more is an instance.
* those of its levels, as lines of several templates may share length and lead: at level j a token is constant at its place if
  ``min_docs`` * 2^j documents of the leaf or more have it there. Forms with the same constants at a level, on ``alike`` of the
  places or more, have one template. What is rare at one level is a field there, however frequent it is at those below, and
  other lines that come to the leaf take nothing from a template.

Every form is also a template of its own. Templates that occur in ``min_docs`` documents or more are dropped from all of them.

Copies of a document count once. Everything is counted by narrow keys; only the forms of leaves in which documents meet travel
with their tokens. Keys are broadcast only while there are at most ``broadcast_rows`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.shared import forget, stored

LEADING = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _plain(line: Column) -> Column:
    """A line's form: digits masked, tokens with one space between. Most lines have single spaces only, which stay."""
    masked = F.regexp_replace(line, "[0-9]+", "0")
    wide = line.contains("  ")
    for c in "\t\r\f\x0B":
        wide = wide | line.contains(c)
    return F.trim(F.when(wide, F.regexp_replace(masked, r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " ")).otherwise(masked))


def _form(line: Column) -> Column:
    """The 64-bit key of a line's form."""
    return F.xxhash64(_plain(line))


def _doc() -> Column:
    """The 64-bit key of a document. Two texts that share one only look among more recurring forms for those of their lines."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def _levels(met: DataFrame, min_docs: int, alike: float) -> DataFrame:
    """(leaf, form, key, template): the templates of the levels at which enough of a form is constant, with a 64-bit key each."""
    places = met.select("leaf", "form", "docs", F.posexplode("tokens").alias("place", "token"))
    common = places.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    level = F.length(F.bin(F.floor(F.col("docs") / min_docs))) - 1
    common = common.select("leaf", "place", "token", level.alias("level"))
    at = F.sort_array(F.collect_list(F.struct("place", "token", "level")))
    marked = places.drop("docs").join(common, ["leaf", "place", "token"], "left").groupBy("leaf", "form").agg(at.alias("at"))
    tried = marked.select("leaf", "form", "at", F.explode(F.array_distinct(F.filter(F.transform("at", lambda x: x["level"]), lambda x: x.isNotNull()))).alias("j"))
    constants = F.filter("at", lambda x: x["level"] >= F.col("j"))
    tried = tried.filter(F.size(constants) / F.size("at") >= alike)
    key = F.xxhash64("leaf", F.transform(constants, lambda x: F.struct(x["place"], x["token"])))
    return tried.select("leaf", "form", key.alias("key"), F.transform("at", lambda x: F.when(x["level"] >= F.col("j"), x["token"])).alias("template"))


def _recurring(docs: DataFrame, min_docs: int = 5, alike: float = 0.7, min_tokens: int = 4, broadcast_rows: int = 1_000_000, min_chars: int = 40) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    # the forms are made inside the array, so that each is made once, whatever reads it later
    plain = F.array_distinct(F.transform(_lines(F.col("text")), _plain))
    lines = docs.select(_doc().alias("doc"), F.explode(plain).alias("plain"))
    size = F.length("plain") - F.length(F.replace(F.col("plain"), F.lit(" "), F.lit(""))) + 1
    lines = lines.filter((F.col("plain") != "") & ((size >= min_tokens) | (F.length("plain") >= min_chars)))
    lines = lines.select("doc", "plain", F.xxhash64(size, F.substring_index("plain", " ", LEADING)).alias("leaf"), F.xxhash64("plain").alias("form"))
    lines = stored(lines, "lines")  # so that the forms are made once; most readers take the keys only
    seen = stored(lines.select("leaf", "form", "doc").distinct(), "forms")
    forms = seen.groupBy("leaf", "form").agg(F.count(F.lit(1)).alias("docs"))
    own = forms.filter(F.col("docs") >= min_docs).select("form", F.lit(None).cast("array<string>").alias("template"))

    leaves = forms.groupBy("leaf").agg(F.count(F.lit(1)).alias("forms"), F.sum("docs").alias("total")).filter((F.col("forms") > 1) & (F.col("total") >= min_docs))
    leaves = stored(leaves.select("leaf", "total"), "leaves")
    met = lines.join(_small(leaves.select("leaf"), broadcast_rows), "leaf").groupBy("leaf", "form").agg(F.first("plain").alias("plain"))
    met = met.join(forms, ["leaf", "form"]).select("leaf", "form", F.split("plain", " ").alias("tokens"), "docs")
    met = stored(met, "met")
    places = met.select("leaf", "docs", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "place", "token").agg(F.sum("docs").alias("docs"))
    modal = places.groupBy("leaf", "place").agg(F.max(F.struct("docs", "token")).alias("top")).join(leaves, "leaf")
    modal = modal.withColumn("token", F.when(2 * F.col("top.docs") >= F.col("total"), F.col("top.token")))
    template = modal.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("template"))
    template = stored(template, "templates")  # so that the rows of a large leaf can be split in the join
    same = F.size(F.filter(F.zip_with("tokens", "template", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    instances = met.join(template, "leaf").filter(same / F.size("tokens") >= alike).select("leaf", "form", "template")
    instances = stored(instances, "instances")
    spread = seen.join(instances.select("leaf", "form"), ["leaf", "form"]).select("leaf", "doc").distinct().groupBy("leaf").count().filter(F.col("count") >= min_docs)
    general = instances.join(spread.select("leaf"), "leaf").select("form", "template")
    levels = stored(_levels(met, min_docs, alike), "levels")
    many = seen.join(levels.select("leaf", "form", "key"), ["leaf", "form"]).select("key", "doc").distinct().groupBy("key").count().filter(F.col("count") >= min_docs)
    several = levels.join(many.select("key"), "key").select("form", "template")
    found = own.unionByName(general).unionByName(several).groupBy("form").agg(F.max("template").alias("template"))
    return found, (lines, seen, leaves, met, template, instances, levels)


def recurring_forms(docs: DataFrame, min_docs: int = 5, alike: float = 0.7, min_tokens: int = 4, broadcast_rows: int = 1_000_000, min_chars: int = 40) -> DataFrame:
    """(form, template): the forms that belong to a recurring template; template is null where only the form itself recurs.

    In a template the fields are null; of several templates that a form belongs to, the greatest is named.
    """
    found, steps = _recurring(docs, min_docs, alike, min_tokens, broadcast_rows, min_chars)
    found = stored(found, "recurring")
    forget(*steps)
    return found


def _found(docs: DataFrame, min_docs: int, alike: float, min_tokens: int, broadcast_rows: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """The recurring forms, and (doc, drop): those of each document that has some."""
    found, steps = _recurring(docs, min_docs, alike, min_tokens, broadcast_rows, min_chars)
    found = stored(found, "recurring")
    seen = steps[1]
    hits = stored(seen.join(_small(found.select("form"), broadcast_rows), "form").groupBy("doc").agg(F.collect_set("form").alias("drop")), "hits")
    forget(*steps)
    return found, hits


def drop_recurring_lines(docs: DataFrame, min_docs: int = 5, alike: float = 0.7, min_tokens: int = 4, broadcast_rows: int = 1_000_000, long_lines: int = 2_000, min_chars: int = 40) -> DataFrame:
    """doc_id, text without the lines of recurring templates, n_lines and n_dropped for every row of ``docs`` (doc_id, text).

    Lines of fewer than ``min_tokens`` tokens and fewer than ``min_chars`` characters, empty ones among them, always stay; one with
    few tokens and many characters, as in scripts without spaces, goes if its form recurs. A null text is empty, one empty line. Whether
    a line is dropped depends on its form alone, so rows that share a doc_id and repeated rows are treated alike; a null doc_id
    is an id like any other. Ties for a constant take the larger token. Other columns are ignored; an empty table gives an
    empty result. Whole texts of any length are read; the lines of one with more than ``long_lines`` are joined with the forms
    one by one, as a look through an array of forms for each line would take the square of their number.
    """
    forms, hits = _found(docs, min_docs, alike, min_tokens, broadcast_rows, min_chars)
    forms = forms.select("form")
    lines = _lines(F.col("text"))
    is_long = F.size(lines) > long_lines
    docs = docs.select("doc_id", "text")
    short, long = docs.filter(~is_long), docs.filter(is_long).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))

    # forms were made for the search: texts find theirs by key, and are not looked through for them again. There are as many hits as
    # documents with lines to drop, so texts are shuffled once, at any size; Spark would broadcast hits while their files are small
    rows = short.withColumn("doc", _doc()).join(hits.hint("merge"), "doc", "left")
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("drop", _form(x))))
    rows = rows.select("doc_id", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))

    spread = long.select("sha", "text").dropDuplicates(["sha"]).select("sha", F.posexplode(F.transform(lines, lambda x: F.struct(x.alias("line"), _form(x).alias("form")))).alias("at", "x"))
    stay = spread.select("sha", "at", "x.line", "x.form").join(_small(forms, broadcast_rows), "form", "left_anti")
    stay = stay.groupBy(F.col("sha").alias("of")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("left"))
    empty = F.array().cast("array<string>")
    long = long.join(stay, F.col("sha") == F.col("of"), "left").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("left", empty).alias("kept"))
    return rows.unionByName(long).select("doc_id", F.array_join("kept", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))
