"""Scalar rules that recur: stripping, tokens, clamps, scores and the columns of CASE ladders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\f\r"
_TOKEN = "[A-Za-z0-9_']+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends; null is empty. (trim alone only takes spaces.)"""
    return F.btrim(F.coalesce(_c(x), F.lit("")), F.lit(_SPACE))


def tokens(x: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_c(x), F.lit(_TOKEN), F.lit(0)), F.lower)


def token_count(x: Column | str) -> Column:
    return F.regexp_count(_c(x), F.lit(_TOKEN)).cast("long")


def contains_term(tokens_: Column | str, term: Column | str) -> Column:
    """Whether the term's words stand one after another among the tokens; other characters of a term part words."""
    padded = F.concat(F.lit(" "), F.array_join(_c(tokens_), " "), F.lit(" "))
    wanted = tokens(F.lit(term) if isinstance(term, str) else term)
    return padded.contains(F.concat(F.lit(" "), F.array_join(wanted, " "), F.lit(" ")))


def text_hash(x: Column | str) -> Column:
    return F.sha2(strip(x), 256)


def short_id(prefix: str, *parts: Column | str, length: int = 24) -> Column:
    """A deterministic id: the prefix and the first digits of the parts' hash."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def clamp(x: Column | str, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), _c(x)))


def half_even(x: Column, digits: int) -> Column:
    """x to so many digits, halves to the even one. What counts as a half is the scaled double, where a sum's last bit is mostly gone."""
    return F.bround(x * 10.0**digits, 0) / 10.0**digits


def score(x: Column | str, scale: float) -> Column:
    """0 to 100, saturating: two digits of 100 * (1 - exp(-x / scale))."""
    return F.bround(clamp(100 * (1 - F.exp(-F.greatest(F.lit(0.0), _c(x)) / scale))), 2)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ratio(a: Column, b: Column, digits: int = 6, empty: float | None = 0.0) -> Column:
    return F.when(b != 0, F.round(a / b, digits)).otherwise(F.lit(empty).cast("double"))


def ladder(*steps: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first step whose condition holds."""
    first, *rest = steps
    out = reduce(lambda c, s: c.when(s[0], s[1]), rest, F.when(*first))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def path_key(x: Column | str) -> Column:
    return F.replace(_c(x), F.lit("\\"), F.lit("/"))


def base_name(x: Column | str) -> Column:
    return F.element_at(F.split(path_key(x), "/"), -1)


def suffix(x: Column | str) -> Column:
    """The lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(x), "(\\.[^.]*)$", 1))


def evidence_text(entries: Column | str) -> Column:
    """k=v, k=v of a map, in key order."""
    sorted_ = F.array_sort(F.map_entries(_c(entries)))
    return F.array_join(F.transform(sorted_, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit hashes kept as longs."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b))).cast("int")


def hex_hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two hashes of 16 hex digits; halves, as a whole one doesn't fit a signed long."""
    half = lambda x, at: F.conv(F.substring(_c(x), at, 8), 16, 10).cast("long")
    return (hamming(half(a, 1), half(b, 1)) + hamming(half(a, 9), half(b, 9))).cast("int")
