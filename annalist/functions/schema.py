"""JSON Schema as a Column: what a payload breaks first, worked out over a variant without leaving the engine."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keywords that are understood; others are refused, so that no rule is passed over in silence.
KEYWORDS = (
    "type", "required", "properties", "additionalProperties", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern",
    "items", "minItems", "maxItems", "title", "description", "$schema", "$id",
)
#: The types of JSON Schema, each with how a variant's schema begins. A whole number has another rule besides.
TYPES = {"string": ("STRING",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "integer": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}


def _is(value: Column, kinds: Sequence[str]) -> Column:
    shape = F.schema_of_variant(value)
    out = F.lit(False)
    for kind in kinds:
        if kind not in TYPES:
            raise ValueError(f"unknown type {kind!r}")
        one = F.lit(False)
        for start in TYPES[kind]:
            one = one | F.startswith(shape, F.lit(start))
        if kind == "integer":
            number = F.try_variant_get(value, "$", "double")
            one = one & F.coalesce(number == F.floor(number), F.lit(False))
        out = out | one
    return F.coalesce(out, F.lit(False))


def _equals(value: Column, wanted) -> Column:
    """Whether a variant is one JSON value; numbers by value, objects and arrays by their text with sorted names."""
    if wanted is None:
        return _is(value, ["null"])
    if isinstance(wanted, bool):
        return _is(value, ["boolean"]) & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, int | float):
        return _is(value, ["number"]) & (F.try_variant_get(value, "$", "double") == F.lit(float(wanted)))
    if isinstance(wanted, str):
        return _is(value, ["string"]) & (F.try_variant_get(value, "$", "string") == F.lit(wanted))
    return F.to_json(value) == F.lit(json.dumps(wanted, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _broken(value: Column, schema: Mapping | bool, path: str, depth: int = 0) -> list[Column]:
    """Messages, each null where its rule holds, in order. ``value`` is a variant that is there."""
    if isinstance(schema, bool):
        return [] if schema else [F.lit(f"{path}: nothing is allowed")]
    if unknown := sorted(set(schema) - set(KEYWORDS)):
        raise ValueError(f"keywords that are not understood at {path}: {unknown}")
    said = lambda bad, what: F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{path}: {what}"))
    out = []
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        out.append(said(~_is(value, kinds), f"type is not {' or '.join(kinds)}"))
    if "const" in schema:
        out.append(said(~_equals(value, schema["const"]), "not the constant"))
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    is_number, is_text = _is(value, ["number"]), _is(value, ["string"])
    if "enum" in schema:
        numbers = [float(w) for w in schema["enum"] if isinstance(w, int | float) and not isinstance(w, bool)]
        texts = [w for w in schema["enum"] if isinstance(w, str)]
        one = (is_number & F.coalesce(number.isin(numbers), F.lit(False))) | (is_text & F.coalesce(text.isin(texts), F.lit(False)))
        for wanted in schema["enum"]:
            if isinstance(wanted, bool) or not isinstance(wanted, int | float | str):
                one = one | F.coalesce(_equals(value, wanted), F.lit(False))
        out.append(said(~one, "not one of the values"))
    for keyword, bad, what in (
        ("minimum", lambda x: number < x, "below the minimum"), ("maximum", lambda x: number > x, "above the maximum"), ("exclusiveMinimum", lambda x: number <= x, "below the minimum"), ("exclusiveMaximum", lambda x: number >= x, "above the maximum"),
    ):
        if keyword in schema:
            out.append(said(is_number & bad(F.lit(float(schema[keyword]))), what))
    if "minLength" in schema:
        out.append(said(is_text & (F.length(text) < schema["minLength"]), "too short"))
    if "maxLength" in schema:
        out.append(said(is_text & (F.length(text) > schema["maxLength"]), "too long"))
    if "pattern" in schema:
        out.append(said(is_text & ~F.rlike(text, F.lit(schema["pattern"])), "does not match the pattern"))
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    names = F.map_keys(fields)
    is_object = _is(value, ["object"])
    for name in schema.get("required", ()):
        out.append(F.when(is_object & ~F.coalesce(F.array_contains(names, name), F.lit(False)), F.lit(f"{path}.{name}: missing")))
    known = schema.get("properties", {})
    if schema.get("additionalProperties", True) is False:
        more = F.array_except(names, F.array(*[F.lit(n) for n in known]).cast("array<string>"))
        out.append(F.when(is_object & (F.size(more) > 0), F.concat(F.lit(f"{path}."), F.array_min(more), F.lit(": not a known name"))))
    elif not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"additionalProperties may be true or false ({path})")
    for name, inner in known.items():
        for message in _broken(F.try_element_at(fields, F.lit(name)), inner, f"{path}.{name}", depth):
            out.append(F.when(is_object & F.coalesce(F.array_contains(names, name), F.lit(False)), message))
    is_array, parts = _is(value, ["array"]), F.try_variant_get(value, "$", "array<variant>")
    if "minItems" in schema:
        out.append(said(is_array & (F.size(parts) < schema["minItems"]), "too few items"))
    if "maxItems" in schema:
        out.append(said(is_array & (F.size(parts) > schema["maxItems"]), "too many items"))
    if "items" in schema:
        wrong = lambda x: F.coalesce(*_broken(x, schema["items"], f"{path}[]", depth + 1), F.lit(None).cast("string"))
        found = F.filter(F.transform(parts, wrong), lambda m: m.isNotNull())
        out.append(F.when(is_array, F.try_element_at(found, F.lit(1))))
    return out


def violation(payload: Column, schema: Mapping | bool) -> Column:
    """The first rule of ``schema`` that a JSON text breaks, as ``path: what is wrong``; null if it keeps them all. A text that is
    null or no JSON breaks ``$: no JSON``. Rules are looked at from the outside in, in the order of the schema's names."""
    value = F.try_parse_json(payload)
    return F.when(value.isNull(), F.lit("$: no JSON")).otherwise(F.coalesce(*_broken(value, schema, "$"), F.lit(None).cast("string")))


def violation_by(kind: Column, payload: Column, schemas: Mapping[str, Mapping | bool]) -> Column:
    """The same by kind of row; kinds without a schema may say anything."""
    out = F.lit(None).cast("string")
    for name, schema in schemas.items():
        out = F.when(kind == name, violation(payload, schema)).otherwise(out)
    return out
