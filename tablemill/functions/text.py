"""Column helpers for text whose rules differ from Spark's own defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.tables import let

# The white space that ECMAScript's trim() and \s accept, as a Java regex class.
JS_BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
JS_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def plain_path(col: Column) -> Column:
    """A path as the file system spells it, from one that is percent-encoded (as the file metadata of a scan is)."""
    return F.url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))


def js_trim(col: Column) -> Column:
    """Trim every kind of white space at both ends (Spark's ``trim`` strips spaces only)."""
    # the pattern looks at every character; it is left for texts that end with NEL, before which its ``$`` matches too
    return F.when(F.endswith(col, F.lit("\u0085")), F.regexp_replace(col, f"^{JS_SPACE}+|{JS_SPACE}+$", "")).otherwise(
        F.btrim(col, F.lit(JS_BLANKS)))


def trim_end(col: Column) -> Column:
    return F.regexp_replace(col, f"{JS_SPACE}+$", "")


def strip_bom(col: Column) -> Column:
    return F.regexp_replace(col, r"^\ufeff", "")


def unix_lines(col: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(col, r"\r\n?", "\n")


def count_matches(col: Column, pattern: str) -> Column:
    """Number of matches; null text counts as 0."""
    return F.coalesce(F.regexp_count(col, F.lit(pattern)), F.lit(0)).cast("bigint")


def match_values(col: Column, pattern: str) -> Column:
    """Distinct trimmed captures of group 1 in first-seen order, empties dropped; null text gives an empty array."""
    found = F.regexp_extract_all(col, F.lit(pattern), F.lit(1))
    kept = F.filter(F.transform(found, js_trim), lambda v: v != "")
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def xml_value(col: Column, tag: str) -> Column:
    """Text of the first ``<tag>`` element: inner tags stripped, trimmed, empty gives null."""
    quoted = "\\Q" + tag + "\\E"
    inner = F.regexp_extract(col, rf"(?i)<{quoted}(?:\s[^>]*)?>([\s\S]*?)</{quoted}>", 1)
    return F.nullif(js_trim(F.regexp_replace(inner, "<[^>]+>", "")), F.lit(""))


def js_number(col: Column) -> Column:
    """A double printed the way ECMAScript prints it: ``2`` not ``2.0``, ``1e+21`` not ``1.0E21``."""
    text = col.cast("string")
    size = F.abs(col)
    plain = F.regexp_replace(
        F.when(size >= 1, text.cast("decimal(38,16)").cast("string"))
        .otherwise(text.cast("decimal(38,24)").cast("string")),
        r"\.?0+$", "")
    science = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E-", "e-"), r"E", "e+")
    return (
        F.when(F.isnan(col) | size.isin(float("inf")), text)
        .when(col == 0, "0")
        .when((size < 2**53) & (col % 1 == 0), col.cast("bigint").cast("string"))
        .when((size >= 1e21) | (size < 1e-6), science)
        .when(col % 1 == 0, text.cast("decimal(38,0)").cast("string"))
        .otherwise(plain)
    )


def clock_ms(col: Column) -> Column:
    """``[h:]m:s`` text to milliseconds, half up; the first comma is the decimal point; null when not a clock."""
    def number(piece: Column) -> Column:
        return let(js_trim(piece), lambda p: F.when(p == "", F.lit(0.0)).when(
            p.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), p.try_cast("double")))

    def total(parts: Column) -> Column:
        n = F.size(parts)
        hours = F.when(n == 3, number(F.get(parts, F.lit(0)))).otherwise(F.lit(0.0))
        seconds = hours * 3600 + number(F.get(parts, n - 2)) * 60 + number(F.get(parts, n - 1))
        return F.when((n >= 2) & (n <= 3), F.floor(seconds * 1000 + 0.5).cast("bigint"))

    return let(F.split(F.regexp_replace(js_trim(col), r"^([^,]*),", "$1."), ":"), total)


def clean_ass(col: Column) -> Column:
    r"""Drop ``{\...}`` override tags, turn ``\N`` into a line feed and ``\h`` into a space, trim."""
    out = F.regexp_replace(col, r"\{\\[^}]*\}", "")
    out = F.regexp_replace(out, r"(?i)\\n", "\n")
    return js_trim(F.regexp_replace(out, r"(?i)\\h", " "))


def ustar_split(col: Column) -> Column:
    """``struct<name, prefix, error>``: the path split over the USTAR name (100 bytes) and prefix (155) fields."""
    path = F.regexp_replace(F.replace(col, F.lit("\\"), F.lit("/")), r"^/+|/+$", "")
    parts = F.split(path, "/", -1)
    # candidate i splits before part i; the right-most one that fits wins
    fits = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda i: F.struct(
                F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("name"),
                F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix"),
            ),
        ),
        lambda s: (F.size(parts) > 1) & (F.octet_length(s["prefix"]) <= 155) & (F.octet_length(s["name"]) <= 100),
    )
    short = F.octet_length(path) <= 100
    best = F.try_element_at(fits, F.lit(-1))
    error = (
        F.when(path == "", "TAR_PATH_INVALID: Empty TAR path.")
        .when(short | best.isNotNull(), F.lit(None).cast("string"))
        .otherwise("TAR_PATH_TOO_LONG: Path cannot be represented safely in USTAR.")
    )
    return F.struct(
        F.when(error.isNotNull(), F.lit(None)).when(short, path).otherwise(best["name"]).alias("name"),
        F.when(error.isNotNull(), F.lit(None)).when(short, F.lit("")).otherwise(best["prefix"]).alias("prefix"),
        error.alias("error"),
    )
