"""Private data: validated numbers and dates become keyed pseudonyms of the same format.

Cards (Luhn), phone numbers, social security numbers, IPv4 addresses and calendar dates are found by pattern, validated,
read as a pair of numbers and permuted by a keyed Feistel network whose two halves live in exact ranges, so every
pseudonym is again a valid value of the same format, different values stay different, and equal values stay linked across
documents and formats. E-mail addresses and secrets (access keys, tokens, passwords) have no numeric range; their parts
are replaced by keyed digests of the same kind of characters, equal ones again alike.

The work is an expression per row: the text is split at the matches of one pattern, each match is replaced on its own, and
the pieces are joined. No shuffle, no Python.

Defined results: null text stays null with no findings; empty text stays empty; texts of any length are read whole; what
looks like a number but fails its check stays as it is, and the groups of digits inside it are looked at again; equal values in any document get equal pseudonyms under one key;
rows repeated in full give equal rows; an empty table gives an empty result; other columns pass through, but one
called ``n_private`` gives way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.tables import let, once

ROUNDS = 8

# Starts only where a run starts, and never gives back: linear in a text without the sign, however long its runs.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"
ACCESS_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
SECRET = r"(?i:\b(?:token|password|passwd|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_.-]{8,}"
IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
DATE = r"(?<![\w/-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w/-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
# A group that starts one of these belongs to it, not to the number before it.
OTHER = "|".join(f"(?:{p})" for p in (EMAIL, IP, DATE, SSN))
# Look-behinds need a plain sequence. ABROAD: at most 15 digits; a year after 11 of them stands beside the number.
_AFTER = r"\d[ .()-]{0,3}"
ABROAD = (rf"(?<![\w+])\+[2-9]\d{{0,2}}(?:(?!(?<={_AFTER * 11}) (?:19|20)\d\d(?!\w))(?! (?:{OTHER}))[ .-]?\(?\d{{1,4}}\)?){{2,5}}"
          rf"(?<!{_AFTER * 16})(?![\w-])")
# A whole run of digit groups, however long; ``cards`` looks for the cards inside. A telephone number ends it after 13 digits.
CARD = (r"(?<![\w-])(?=\d(?:[ -]?\d){12})\d++(?!\w|-(?!\d))"
        rf"(?:[ -](?!{OTHER}|(?<={r'\d[ -]?' * 12}\d[ -])(?:{PHONE}))\d++(?!\w|-(?!\d)))*+")
# (groups, how they look together), tried in this order: 16 digits come before 17 to 19, as a check code often follows.
SHAPES = [(4, r"^\d{4}(?:[ -]\d{4}){3}$"), (3, r"^\d{4}[ -]\d{6}[ -]\d{4,5}$"), (1, r"^\d{13,19}$"),
          (5, r"^\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}$")]
KINDS = {"email": EMAIL, "key": ACCESS_KEY, "secret": SECRET, "ip": IP, "date": DATE, "ssn": SSN, "phone": PHONE,
         "abroad": ABROAD, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

# Days from 1900-01-01 to 2099-12-31: 73049 = 17 * 4297, so a day is a pair in exact ranges.
FIRST_DAY, LOW_DAYS, HIGH_DAYS = "1900-01-01", 17, 4297


def _draw(key: str, kind: str, number: int, half: Column, size: Column | int) -> Column:
    """A keyed number below ``size`` for one half."""
    digest = F.sha2(F.concat(F.lit(f"{key}:{kind}:{number}:"), half.cast("string")), 256)
    value = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return F.pmod(value, F.lit(size) if isinstance(size, int) else size)


def _round(number: int, high_size: Column | int, low_size: Column | int, key: str, kind: str) -> Callable[[Column], Column]:
    """Even rounds move the high half by what the low one draws, odd rounds the low half."""
    def add(value: Column, other: Column, size: Column | int, name: str) -> Column:
        whole = F.lit(size).cast("bigint") if isinstance(size, int) else size
        return F.pmod(value + _draw(key, kind, number, other, size), whole).alias(name)

    if number % 2 == 0:
        return lambda p: F.struct(add(p["h"], p["l"], high_size, "h"), p["l"].alias("l"))
    return lambda p: F.struct(p["h"].alias("h"), add(p["l"], p["h"], low_size, "l"))


def feistel(high: Column, low: Column, high_size: Column | int, low_size: Column | int, key: str, kind: str) -> Column:
    """``struct<h, l>``: a keyed permutation of all pairs with ``h < high_size`` and ``l < low_size``."""
    pair = F.struct(high.cast("bigint").alias("h"), low.cast("bigint").alias("l"))
    for number in range(ROUNDS):
        pair = let(pair, _round(number, high_size, low_size, key, kind))
    return pair


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _fill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order; everything else stays."""
    def copy(new: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

        def step(acc: Column, c: Column) -> Column:
            is_digit = c.between("0", "9") & (F.length(c) == 1)
            sign = F.when(is_digit, F.substring(new, acc["at"], F.lit(1))).otherwise(c)
            return F.struct(F.concat(acc["out"], sign).alias("out"), (acc["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

        return F.aggregate(F.split(template, ""), start, step)["out"]

    return let(digits, copy)


def _luhn(digits: Column) -> Column:
    """Luhn sum of all digits, the last one counting once."""
    parts = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))
    doubled = F.transform(parts, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _ten(power: Column) -> Column:
    return F.pow(F.lit(10.0), power).cast("bigint")


def _pad(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def card(found: Column, key: str) -> Column:
    """13 to 19 digits with a valid check digit: the others are permuted and the check digit set anew."""
    def build(d: Column) -> Column:
        body, size = F.substring(d, F.lit(1), F.length(d) - 1), F.length(d) - 1
        cut = F.floor(size / 2).cast("int")
        pair = feistel(F.substring(body, F.lit(1), cut).cast("bigint"), F.substring(body, cut + 1, size).cast("bigint"),
                       _ten(cut), _ten(size - cut), key, "card")
        new = let(pair, lambda p: F.concat(_pad(p["h"], cut), _pad(p["l"], size - cut)))
        return let(new, lambda b: F.concat(b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return let(_digits(found), lambda d: F.when(F.length(d).between(13, 19) & (_luhn(d) % 10 == 0), _fill(found, build(d))))


def _span(groups: Column, at: Column, size: Column | int) -> Column:
    """The text of ``size`` groups from the 0-based ``at`` on."""
    return F.regexp_replace(F.array_join(F.slice(groups, at + 1, size), ""), "[ -]$", "")


def _valid(found: Column) -> Column:
    return _luhn(_digits(found)) % 10 == 0


def _chosen(groups: Column) -> Column:
    """``i, k``: first group and number of groups of each card in a run, from the left.

    At each group the usual shapes come first; where none is valid, the longest span of at most 19 digits in any grouping
    is tried, as long as no card of a usual shape starts inside it.
    """
    indices = F.sequence(F.lit(0), F.size(groups) - 1)

    def shaped(i: Column) -> Column:
        def one(k: int, look: str) -> Column:
            return let(_span(groups, i, k), lambda s: F.when(s.rlike(look) & _valid(s), F.lit(k)))

        return F.coalesce(*[one(k, look) for k, look in SHAPES], F.lit(0))

    def longest(i: Column) -> Column:
        start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("d"), F.lit(True).alias("open"))

        def grow(a: Column, g: Column) -> Column:
            d = a["d"] + F.length(_digits(g))
            return F.when(a["open"] & (d <= 19), F.struct((a["k"] + 1).alias("k"), d.alias("d"), F.lit(True).alias("open"))).otherwise(
                F.struct(a["k"].alias("k"), a["d"].alias("d"), F.lit(False).alias("open")))

        return F.aggregate(F.slice(groups, i + 1, 19), start, grow)

    def fold(takes: Column) -> Column:
        def state(free: Column, chunk: Column, at: Column) -> Column:
            return F.struct(free.alias("free"), chunk.alias("chunk"), at.alias("at"))

        def step(a: Column, i: Column) -> Column:
            def take(k: Column) -> Column:
                return state(i + k, i + k, F.concat(a["at"], F.array(F.struct(i.alias("i"), k.alias("k")))))

            k = F.get(takes, i)
            loose = let(longest(i), lambda c: F.when((c["d"] < 13) | F.exists(F.slice(takes, i + 1, F.greatest(c["k"], F.lit(1))), lambda t: t > 0), a)
                        .when(_valid(_span(groups, i, c["k"])), take(c["k"])).otherwise(state(a["free"], i + c["k"], a["at"])))
            return F.when(i < a["free"], a).when(k > 0, take(k)).when(i < a["chunk"], a).otherwise(loose)

        return F.aggregate(indices, state(F.lit(0), F.lit(0), F.array().cast("array<struct<i:int,k:int>>")), step)["at"]

    return let(F.transform(indices, shaped), fold)


def cards(found: Column, key: str) -> Column:
    """``text, n``: a run of digit groups with its valid cards replaced, and their number; null without one."""
    def build(groups: Column) -> Column:
        def fill(at: Column) -> Column:
            end = lambda c: F.coalesce(c["i"] + c["k"], F.lit(0))

            def piece(c: Column, j: Column) -> Column:
                last = end(F.get(at, j - 1))
                return F.concat(F.array_join(F.slice(groups, last + 1, c["i"] - last), ""), card(_span(groups, c["i"], c["k"]), key),
                                F.regexp_extract(F.get(groups, end(c) - 1), "[ -]$", 0))

            last = end(F.get(at, F.size(at) - 1))
            text = F.concat(F.array_join(F.transform(at, piece), ""), F.array_join(F.slice(groups, last + 1, F.size(groups)), ""))
            return F.when(F.size(at) > 0, F.struct(text.alias("text"), F.size(at).alias("n")))

        return let(_chosen(groups), fill)

    return let(F.split(found, r"(?<=[ -])"), build)


def phone(found: Column, key: str) -> Column:
    """Ten digits after an optional country code: area and exchange from 200, four digits."""
    def build(d: Column) -> Column:
        n = F.substring(d, F.length(d) - 9, F.lit(10))
        area, exchange, line = (F.substring(n, a, b).cast("bigint") for a, b in ((1, 3), (4, 3), (7, 4)))
        pair = feistel((area - 200) * 800 + exchange - 200, line, 640_000, 10_000, key, "phone")
        new = let(pair, lambda p: F.concat(_pad(F.floor(p["h"] / 800) + 200, 3), _pad(p["h"] % 800 + 200, 3), _pad(p["l"], 4)))
        valid = (area >= 200) & (exchange >= 200)
        return F.when(valid, _fill(found, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new)))

    return let(_digits(found), build)


def abroad(found: Column, key: str) -> Column:
    """8 to 15 digits after a plus: the first two, which hold the country, stay."""
    def build(d: Column) -> Column:
        size = F.length(d) - 2
        cut = F.floor(size / 2).cast("int")
        pair = feistel(F.substring(d, F.lit(3), cut).cast("bigint"), F.substring(d, cut + 3, size).cast("bigint"),
                       _ten(cut), _ten(size - cut), key, "abroad")
        new = let(pair, lambda p: F.concat(F.substring(d, 1, 2), _pad(p["h"], cut), _pad(p["l"], size - cut)))
        return F.when(F.length(d).between(8, 15), _fill(found, new))

    return let(_digits(found), build)


def ssn(found: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group from 01, serial from 0001."""
    area, group, serial = (F.substring(found, a, b).cast("bigint") for a, b in ((1, 3), (5, 2), (8, 4)))
    rank = area - F.when(area > 666, 2).otherwise(1)
    pair = feistel(rank * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
    rank_out = lambda p: F.floor(p["h"] / 99)
    out = let(pair, lambda p: F.concat_ws("-", _pad(rank_out(p) + F.when(rank_out(p) >= 665, 2).otherwise(1), 3),
                                          _pad(p["h"] % 99 + 1, 2), _pad(p["l"] + 1, 4)))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), out)


def ip(found: Column, key: str) -> Column:
    def build(parts: Column) -> Column:
        at = lambda i: F.get(parts, F.lit(i)).cast("bigint")
        pair = feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), 65_536, 65_536, key, "ip")
        out = let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (
            F.floor(p["h"] / 256), p["h"] % 256, F.floor(p["l"] / 256), p["l"] % 256)]))
        return F.when(F.forall(parts, lambda p: p.cast("int") <= 255), out)

    return let(F.split(found, r"\."), build)


def date(found: Column, key: str) -> Column:
    """A calendar day of 1900 to 2099, in its own notation; day before month where dots or slashes stand first."""
    year_first = found.rlike(r"^\d{4}")
    mark = F.when(year_first, F.substring(found, 5, 1)).otherwise(F.substring(F.regexp_replace(found, r"^\d+", ""), 1, 1))

    def build(parts: Column) -> Column:
        at = lambda i: F.get(parts, F.lit(i))
        iso = F.when(year_first, F.concat_ws("-", at(0), at(1), at(2))).otherwise(
            F.concat_ws("-", at(2), F.lpad(at(1), 2, "0"), F.lpad(at(0), 2, "0")))

        def permute(day: Column) -> Column:
            number = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
            pair = feistel(F.floor(number / LOW_DAYS), number % LOW_DAYS, HIGH_DAYS, LOW_DAYS, key, "date")
            new = let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["h"] * LOW_DAYS + p["l"]).cast("int")))
            text = let(new, lambda d: F.when(year_first,
                                             F.concat(F.date_format(d, "yyyy"), mark, F.date_format(d, "MM"), mark, F.date_format(d, "dd")))
                       .otherwise(F.concat(F.date_format(d, "dd"), mark, F.date_format(d, "MM"), mark, F.date_format(d, "yyyy"))))
            return F.when(day.isNotNull() & number.between(0, LOW_DAYS * HIGH_DAYS - 1), text)

        return let(iso.try_cast("date"), permute)

    return let(F.split(found, r"[./-]"), build)


def _keyed(text: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}:{kind}:"), text), 256)


def email(found: Column, key: str) -> Column:
    """A keyed local part under a keyed host that can never exist."""
    local, host = F.lower(F.substring_index(found, "@", 1)), F.lower(F.substring_index(found, "@", -1))
    return F.concat(F.lit("u"), F.substring(_keyed(F.concat(local, F.lit("@"), host), key, "email"), 1, 20), F.lit("@h"),
                    F.substring(_keyed(host, key, "host"), 1, 20), F.lit(".invalid"))


def access_key(found: Column, key: str) -> Column:
    return F.concat(F.lit("AKIX"), F.upper(F.substring(_keyed(found, key, "key"), 1, 16)))


def secret(found: Column, key: str) -> Column:
    """The value after the name and sign; the name stays."""
    head = F.regexp_extract(found, r"^(?i)(\w+(?:[_-]?key)?\s*[=:]\s*[\"']?)", 1)
    value = F.substring(found, F.length(head) + 1, F.length(found))
    digest = _keyed(value, key, "secret")
    return F.concat(head, F.substring(F.repeat(digest, (F.length(value) / 64 + 1).cast("int")), F.lit(1), F.length(value)))


RULES = {"email": email, "key": access_key, "secret": secret, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "abroad": abroad}


def replacement(found: Column, key: str) -> Column:
    """``text, n``: the pseudonym of one match and the values it replaces; the match itself where no rule accepts it."""
    def of(new: Column) -> Column:
        return F.when(new.isNotNull(), F.struct(new.alias("text"), (new != found).cast("int").alias("n")))

    tried = [let(F.when(found.rlike(f"^(?:{KINDS[kind]})$"), rule(found, key)), of) for kind, rule in RULES.items()]
    run = F.when(found.rlike(f"^(?:{CARD})$"), cards(found, key))
    return F.coalesce(*tried, run, F.struct(found.alias("text"), F.lit(0).alias("n")))


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with pseudonyms in ``text`` and their number in ``n_private``."""
    df = df.select(*[c for c in df.columns if c.lower() != "n_private"])
    body = F.col(text)
    # every kind holds one of these signs, access keys perhaps letters alone, so most texts end here
    marked = once(df, __found=F.when(body.rlike("[0-9@=:]|AKIA|ASIA"), F.regexp_extract_all(body, F.lit(ANY), F.lit(0))))
    marked = once(marked, __new=F.when(F.size("__found") > 0, F.transform("__found", lambda m: replacement(m, key))))
    rest = F.when(F.size("__found") > 0, F.split(body, ANY, -1))
    joined = F.array_join(F.transform(F.arrays_zip(rest.alias("r"), F.col("__new").alias("n")), lambda z: F.concat(
        z["r"], F.coalesce(z["n"]["text"], F.lit("")))), "")
    changed = F.aggregate("__new", F.lit(0), lambda a, n: a + n["n"])
    done = once(marked, __text=F.when(F.size("__found") > 0, joined).otherwise(body),
                n_private=F.when(F.size("__found") > 0, changed).otherwise(0).cast("bigint"))
    return done.select(*[F.col("__text").alias(c) if c == text else F.col(c) for c in df.columns], "n_private")
