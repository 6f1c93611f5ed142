"""Column functions over texts: normal forms, fingerprints, similarities and value normalisers."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalise(text: Column) -> Column:
    """NFC, and every line end as one line feed. Spark has no normal forms, hence a pandas function."""
    return F.regexp_replace(F.pandas_udf(_nfc, StringType())(text), "\r\n?", "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def token_bits(token: Column) -> Column:
    """60 bits of a token: the first 15 hexadecimal digits of its SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 15), 16, 10).cast("long")


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def trigrams(text: Column) -> Column:
    """Distinct three-character runs of the lower-case text, padded with two spaces before and one after."""
    padded = F.concat(F.lit("  "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def span(text: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` (from 0) to ``end`` (not included)."""
    return F.substr(text, start + 1, end - start)


def excerpt(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1))


def name_key(name: Column) -> Column:
    """A name without case, punctuation, company forms and doubled spaces."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    plain = F.regexp_replace(plain, r"\b(limited|ltd|plc|inc|llc|gmbh|sa|corp|corporation|company|co)\b", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


#: Date formats, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "dd/MM/yyyy", "yyyy/MM/dd")
#: What a word after a number multiplies it by.
MAGNITUDES = {"k": 3, "thousand": 3, "m": 6, "mn": 6, "million": 6, "bn": 9, "b": 9, "billion": 9, "tn": 12, "trillion": 12}
#: Currencies by sign or code.
CURRENCIES = {"$": "USD", "us$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP", "zmw": "ZMW", "k": "ZMW", "zar": "ZAR", "r": "ZAR"}
_NUMBER = r"([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)"
_SCALE = r"\s*(thousand|million|billion|trillion|mn|bn|tn|k|m|b)?\b"


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats])


def _scaled(text: Column, pattern: str, number: int, scale: int) -> Column:
    low = F.lower(text)
    value = F.regexp_replace(F.regexp_extract(low, pattern, number), ",", "").try_cast("decimal(38,6)")
    power = F.regexp_extract(low, pattern, scale)
    table = F.create_map(*[x for word, k in MAGNITUDES.items() for x in (F.lit(word), F.lit(10**k).cast("decimal(20,0)"))])
    factor = F.coalesce(F.try_element_at(table, power), F.lit(1).cast("decimal(20,0)"))
    return (value * factor).cast("decimal(38,6)")


def parse_number(text: Column) -> Column:
    """The first number with its magnitude, as decimal(38,6); null if there is none."""
    return _scaled(text, _NUMBER + _SCALE, 1, 2)


def parse_percent(text: Column) -> Column:
    """The first percentage as a share."""
    return (F.regexp_extract(F.lower(text), _NUMBER + r"\s*(?:%|per ?cent)", 1).try_cast("decimal(38,6)") / 100).cast("decimal(38,8)")


def parse_money(text: Column) -> Column:
    """struct<amount decimal(38,6), currency string>; null without a currency."""
    pattern = r"(us\$|\$|€|£|\busd\b|\beur\b|\bgbp\b|\bzmw\b|\bzar\b|\bk(?=[0-9])|\br(?=[0-9]))\s*" + _NUMBER + _SCALE
    sign = F.regexp_extract(F.lower(text), pattern, 1)
    currency = F.try_element_at(F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair]), sign)
    return F.when(currency.isNotNull(), F.struct(_scaled(text, pattern, 2, 3).alias("amount"), currency.alias("currency")))


def value_in_quote(value: Column, quote: Column) -> Column:
    """Whether a number of ``value`` is one of the numbers that the quote holds, however either is written."""
    said = F.regexp_extract_all(F.lower(quote), F.lit(_NUMBER + _SCALE), F.lit(0))
    wanted = parse_number(value)
    return F.coalesce(F.exists(said, lambda x: parse_number(x) == wanted), F.lit(False))


def certainty(text: Column) -> Column:
    """stated, reported or speculative, by wording."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.rlike(r"\b(in talks|may|might|could|considering|rumou?r|rumou?red|speculation|possible|possibly)\b"), "speculative")
        .when(low.rlike(r"\b(reportedly|sources say|sources said|according to|people familiar|is said to|reports say)\b"), "reported")
        .otherwise("stated")
    )


#: Frequent short words of each language.
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "und", "den", "das", "von", "zu", "mit", "ist", "für", "auf", "des", "im", "ein", "eine", "nicht"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "as", "it", "be", "are", "on", "this"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "las", "por", "con", "para", "una", "su", "no", "un"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "dans", "qui", "au"),
}


def detect_language(text: Column) -> Column:
    """The language with the most stop words; the first in order on a tie, null without any."""
    tokens = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "), " ")
    known = sorted({w for words in STOP_WORDS.values() for w in words})

    def scored(found: Column, place: int, lang: str) -> Column:
        hits = F.size(F.filter(found, lambda w: w.isin(*STOP_WORDS[lang])))
        return F.struct(hits.alias("n"), F.lit(-place).alias("place"), F.lit(lang).alias("lang"))

    # the words are bound once, as the element of an array, and the languages look at those that any of them knows
    best = F.transform(F.array(F.filter(tokens, lambda w: w.isin(*known))), lambda found: F.array_max(F.array(*[scored(found, k, x) for k, x in enumerate(sorted(STOP_WORDS))])))[0]
    return F.when(best["n"] > 0, best["lang"])


def ulid_like(*parts: Column) -> Column:
    """A 26-character id that depends on the parts alone, for tests and replays."""
    return F.upper(F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 26))
