"""String, date, JSON and hash helpers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def us_ticker(text: Column) -> Column:
    """A US symbol: class shares with a dash; anything that is none is null."""
    s = F.upper(F.trim(text))
    return F.when(s.rlike(r"^[A-Z]{1,5}([.-][A-Z])?$"), F.replace(s, F.lit("."), F.lit("-")))


def hk_ticker(text: Column) -> Column:
    """A Hong Kong code: its digits without leading zeros, four at least, with the suffix."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(digits != "", F.concat(F.lpad(F.ltrim(digits, F.lit("0")), 4, "0"), F.lit(".HK")))


def sg_ticker(text: Column) -> Column:
    """A Singapore code: what follows a prefix, with the suffix."""
    code = F.upper(F.trim(F.element_at(F.split(text, ":"), -1)))
    return F.when(code.rlike(r"^[A-Z0-9]{3,4}$"), F.concat(code, F.lit(".SI")))


def resolve(text: Column, aliases: dict[str, str]) -> Column:
    """A symbol from what a user typed: an alias, a numeric Hong Kong code, else the text in upper case."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    upper = F.upper(F.trim(text))
    return F.coalesce(F.try_element_at(known, upper), F.when(upper.rlike("^[0-9]+$"), hk_ticker(upper)), upper)


def compact_date(text: Column) -> Column:
    """yyyyMMddTHHmmss to a timestamp, else null."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss"))


def age_text(seconds: Column) -> Column:
    """How long ago, in words."""
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 3600, part(60, "m ago")).when(seconds < 86_400, part(3600, "h ago")).otherwise(part(86_400, "d ago"))


def tolerant_json(text: Column) -> Column:
    """The JSON object in a text: all of it, fenced, or between the outermost braces; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    whole = lambda x: F.when(F.try_parse_json(x).isNotNull() & F.ltrim(x).startswith("{"), F.trim(x))
    return F.coalesce(whole(text), whole(fenced), whole(braces))


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts).cast("binary"))


def canonical_hash(struct: Column) -> Column:
    """SHA-256 of a struct as JSON; name its fields in order."""
    return F.sha2(F.to_json(struct), 256)


def html_escaped(text: Column) -> Column:
    """Text with the five characters that mean something in HTML as references."""
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def printf(template: str, *values: Column) -> Column:
    """C's printf, null where a value is: a double is rounded by its exact value and ties go to the even digit, while
    ``format_string`` rounds its shortest decimal half up (0.125 and 1.005 to two digits: 0.12 and 1.00, not 0.13 and 1.01)."""

    def filled(*row):
        return None if None in row else template % row

    return F.udf(filled, "string", useArrow=True)(*values)
