"""Coercions of untrusted fields and the text escapes of the sinks, as ``Column -> Column`` functions."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal literals only: a bare try_cast would also take "12d" and "NaN".
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def text(value: Column) -> Column:
    """Text, empty where null."""
    return F.coalesce(value.cast("string"), F.lit(""))


def name_or(value: Column, fallback: Column) -> Column:
    """The value unless it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def non_negative_integer(value: Column) -> Column:
    """Numeric text truncated toward zero; 0 for anything negative, unparsable or not finite.

    Hexadecimal, octal and binary literals count too. Numbers beyond a long become the largest long.
    """
    raw, most = value.cast("string"), F.lit((1 << 63) - 1)
    number = F.when(raw.rlike(NUMBER), F.trim(raw).try_cast("double"))
    bare = F.lower(F.trim(raw))
    coded = F.coalesce(*[F.when(bare.rlike(f"^0{mark}{digits}+$"), F.conv(F.substring(bare, 3, 1 << 20), base, 10).try_cast("decimal(20,0)")) for mark, digits, base in (("x", "[0-9a-f]", 16), ("o", "[0-7]", 8), ("b", "[01]", 2))])
    plain = F.when((number >= 2.0**63) & (number < float("inf")), most).when((number >= 0) & (number < 2.0**63), number.try_cast("bigint"))
    return F.coalesce(F.when(coded.isNotNull(), F.least(coded, most.cast("decimal(20,0)")).cast("bigint")), plain, F.lit(0).cast("bigint"))


def iso_utc(timestamp: Column) -> Column:
    """ISO-8601 text in UTC with milliseconds; the session time zone is UTC."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_date(iso: Column) -> Column:
    return F.substring(iso, 1, 10)


def csv_cell(value: Column) -> Column:
    """Empty for null; quoted, with quotes doubled, only where a quote, comma or line break occurs."""
    raw = text(value)
    return F.when(raw.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(raw, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(raw)


def markdown_cell(value: Column) -> Column:
    """Empty for null; pipes escaped, line breaks as one space (a lone carriage return stays)."""
    return F.regexp_replace(F.replace(text(value), F.lit("|"), F.lit("\\|")), "\r?\n", " ")


def signed(value: Column) -> Column:
    return F.concat(F.lit("+"), value.cast("string"))


def next_link(header: Column) -> Column:
    """The URL before ``rel="next"`` in a Link header; empty where there is none."""
    return F.regexp_extract(F.coalesce(header, F.lit("")), r'(?i)<([^>]+)>;\s*rel="next"', 1)


def uri_component(value: str) -> str:
    return quote(value, safe="!'()*~")


def collated(value: Column) -> Column:
    """For ORDER BY only: English-like order; as a key it would merge composed and decomposed letters."""
    return F.collate(value, "UNICODE")
