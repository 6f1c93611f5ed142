"""Agents and their guards. An agent is any function DataFrame -> DataFrame; the ones here follow rules and call no model.

They read texts as data: an instruction inside a text is text like any other and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import text as X
from annalist.operators.mentions import find_names

Agent = Callable[[DataFrame], DataFrame]
CLAIM = "struct<source_id:string,subject:string,predicate:string,object:string,value:string,certainty:string,char_start:int,char_end:int,quote:string>"


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, quote, char_start, char_end): sentences with their offsets, code points from 0. ``key`` is unique."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?:[^.!?\n]|[.!?](?=[^\s.!?]))+[.!?]*|[.!?\n])"), F.lit(0))
    rows = docs.select(key, F.posexplode(parts).alias("place", "quote"))
    before = F.sum(F.length("quote")).over(W.partitionBy(key).orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("char_start", F.coalesce(before, F.lit(0)).cast("int")).withColumn("char_end", F.col("char_start") + F.length("quote"))
    return rows.filter(F.length(F.trim(F.col("quote"))) > 1)


def classify(docs: DataFrame, key: str, text: str, taxonomy: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, codes, in_scope): the codes of which a keyword is among a text's words."""
    tokens = X.words(F.regexp_replace(F.col(text), r"[^\p{L}\p{N}\s]+", " "))
    hit = lambda words: F.arrays_overlap(tokens, F.array(*[F.lit(w.lower()) for w in words]))
    codes = F.filter(F.array(*[F.when(hit(words), F.lit(code)) for code, words in taxonomy.items()]), lambda c: c.isNotNull())
    return docs.select(key, codes.alias("codes")).withColumn("in_scope", F.size("codes") > 0)


def extract(docs: DataFrame, key: str, text: str, predicates: Mapping[str, str]) -> DataFrame:
    """Claims (source, predicate, value, certainty, span, quote): sentences that hold a predicate's pattern and an amount."""
    rows = sentences(docs, key, text)
    held = F.filter(F.array(*[F.when(F.lower("quote").rlike(p), F.lit(name)) for name, p in predicates.items()]), lambda c: c.isNotNull())
    rows = rows.withColumn("predicate", F.explode(held)).withColumn("money", X.parse_money(F.col("quote")))
    value = F.coalesce(F.col("money.amount").cast("string"), X.parse_number(F.col("quote")).cast("string"))
    return rows.select(F.col(key).alias("source_id"), "predicate", value.alias("value"), F.col("money.currency").alias("currency"), X.certainty(F.col("quote")).alias("certainty"), "char_start", "char_end", "quote", F.sha2("quote", 256).alias("quote_hash"))


def lifecycle(docs: DataFrame, key: str, text: str, stages: Mapping[str, int]) -> DataFrame:
    """(key, stage, quote): a stage only where a sentence names it; the latest stage of several."""
    rows = sentences(docs, key, text)
    named = F.filter(F.array(*[F.when(F.contains(F.lower("quote"), F.lit(w.lower())), F.struct(F.lit(n).alias("stage"), F.col("quote"))) for w, n in stages.items()]), lambda c: c.isNotNull())
    return rows.withColumn("x", F.array_max(named)).filter("x IS NOT NULL").groupBy(key).agg(F.max("x").alias("x")).select(key, "x.stage", "x.quote")


def filter_sentences(summaries: DataFrame, valid: DataFrame, sentences_column: str = "sentences", evidence: str = "evidence_id") -> DataFrame:
    """Summaries (id, sentences: array of text and evidence_ids) without the sentences of which no evidence is valid."""
    spread = summaries.select("id", F.posexplode(sentences_column).alias("place", "s"))
    named = spread.select("id", "place", "s", F.explode("s.evidence_ids").alias(evidence)).join(valid.select(evidence).distinct(), evidence, "left_semi")
    kept = named.groupBy("id").agg(F.transform(F.sort_array(F.collect_set(F.struct("place", "s"))), lambda x: x["s"]).alias(sentences_column))
    empty = F.array().cast(summaries.schema[sentences_column].dataType)
    return summaries.drop(sentences_column).join(kept, "id", "left").withColumn(sentences_column, F.coalesce(sentences_column, empty))


def valid_payload(payload: Column, required: Mapping[str, str]) -> Column:
    """Whether a JSON payload has the required fields with the required types, checked field by field: a parser in its
    permissive mode would turn a wrong type into null."""
    parsed = F.try_parse_json(payload)
    ok = parsed.isNotNull()
    for name, kind in required.items():
        ok = ok & F.try_variant_get(parsed, f"$.{name}", kind).isNotNull() & ~((F.lit(kind) != "string") & F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")).isin("STRING"))
    return F.coalesce(ok, F.lit(False))


def guard(claims: DataFrame, sources: DataFrame, predicates: Sequence[str], key: str = "source_id", text: str = "text") -> DataFrame:
    """Claims with the reason code of the first guard that they fail; null for those that may be proposed."""
    joined = claims.join(sources.select(key, F.col(text).alias("__text")), key, "left")
    there = X.span(F.col("__text"), F.col("char_start"), F.col("char_end")) == F.col("quote")
    reason = (
        F.when(~F.col("predicate").isin(*predicates), "unknown_predicate")
        .when(F.length("quote") > 500, "quote_too_long")
        .when(~F.coalesce(there & (F.sha2("quote", 256) == F.col("quote_hash")), F.lit(False)), "bad_span")
        .when(F.col("value").isNotNull() & ~X.value_in_quote(F.col("value"), F.col("quote")), "value_not_in_quote")
    )
    return joined.withColumn("reason_code", reason).drop("__text")


def with_retry(agent: Agent, rows: DataFrame, key: str, output: str, required: Mapping[str, str]) -> DataFrame:
    """What an agent says of ``rows``, with reason_code: bad_payload where ``output`` lacks the required fields twice.

    Rows whose output fails the schema are given to the agent once more. Guards on spans and values follow (:func:`guard`).
    """
    judged = lambda said: said.withColumn("__ok", valid_payload(F.col(output), required))
    first = judged(agent(rows))
    again = judged(agent(rows.join(first.filter(~F.col("__ok")).select(key), key, "left_semi")))
    said = first.filter("__ok").unionByName(again)
    return said.withColumn("reason_code", F.when(~F.col("__ok"), "bad_payload")).drop("__ok")


def quarantined(judged: DataFrame, key: str, step: str, output: Column, at: Column) -> DataFrame:
    """Rows of the quarantine for what a guard refused."""
    bad = judged.filter(F.col("reason_code").isNotNull())
    return bad.select(F.col(key).cast("string").alias("id"), F.lit(step).alias("step"), output.alias("output"), "reason_code", at.alias("created_at"))


def route_merges(proposals: DataFrame) -> DataFrame:
    """Merges and splits: always for review, never automatic."""
    return proposals.filter(F.col("event_type").isin("EntityMerged", "EntitySplit")).withColumn("decision", F.lit("review"))


def log_calls(agent: Agent, name: str, model_id: str, prompt_version: str, input_columns: Sequence[str], output_columns: Sequence[str]) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """Wrap an agent: its output, and a row of the call log for each of its rows.

    Tokens and latency (``tokens``, ``latency_s``) are those that the agent gives with its rows; null where it gives none.
    """

    def run(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        out = agent(rows)
        call = out.select(
            X.ulid_like(F.lit(name), *[F.col(c) for c in input_columns]).alias("id"),
            F.lit(model_id).alias("model_id"),
            F.lit(prompt_version).alias("prompt_version"),
            F.sha2(F.to_json(F.struct(*input_columns)), 256).alias("input_hash"),
            F.to_json(F.struct(*output_columns)).alias("output"),
            *[(F.col(c) if c in out.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (("tokens", "long"), ("latency_s", "double"))],
        )
        return out, call

    return run


def relations(docs: DataFrame, key: str, text: str, names: DataFrame, name: str, predicates: Mapping[str, str]) -> DataFrame:
    """Claims with subject and object: sentences in which a name stands before a predicate's first place, and maybe one behind it.

    ``names``: column ``name``, found as whole words whatever their case; ``predicates``: regular expressions over the lower-case
    sentence. The subject is the last name that ends before the predicate, the object the first that begins behind it (null if
    none does); of names at one place the longest counts. Returns source_id, subject, predicate, object, certainty, quote,
    quote_hash, char_start and char_end (of the sentence) and subject_start, object_start, code points of the document from 0. ``key``
    is distinct. Names come in folded case (a-z). A sentence without a name says nothing here; a null text has no sentences.
    """
    rows = sentences(docs, key, text).withColumn("__sentence", F.concat_ws(":", F.col(key).cast("string"), F.col("place").cast("string")))
    found = find_names(rows.select("__sentence", "quote"), names, "__sentence", "quote", name, longest=True)
    told = found.groupBy("__sentence").agg(F.sort_array(F.collect_list(F.struct("start", "end", "name"))).alias("names"))
    at = lambda pattern: F.regexp_instr(F.lower("quote"), F.lit(f"(?s){pattern}")) - 1
    size = lambda pattern: F.length(F.regexp_extract(F.lower("quote"), f"(?s){pattern}", 0))
    held = F.array(*[F.struct(F.lit(n).alias("predicate"), at(p).alias("at"), (at(p) + size(p)).alias("to")) for n, p in predicates.items()])
    said = rows.join(told, "__sentence").withColumn("p", F.explode(F.filter(held, lambda p: p["at"] >= 0)))
    subject = F.try_element_at(F.filter("names", lambda n: n["end"] <= F.col("p.at")), F.lit(-1))
    thing = F.try_element_at(F.filter("names", lambda n: n["start"] >= F.col("p.to")), F.lit(1))
    said = said.withColumns({"s": subject, "o": thing}).filter(F.col("s").isNotNull())
    return said.select(
        F.col(key).alias("source_id"),
        F.col("s.name").alias("subject"),
        "p.predicate",
        F.col("o.name").alias("object"),
        X.certainty(F.col("quote")).alias("certainty"),
        "quote",
        F.sha2("quote", 256).alias("quote_hash"),
        "char_start",
        "char_end",
        (F.col("char_start") + F.col("s.start")).alias("subject_start"),
        (F.col("char_start") + F.col("o.start")).alias("object_start"),
    )
