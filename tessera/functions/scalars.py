"""Scalar expressions: rounding, parsing, escaping, hashing, formatting, geometry and bit masks."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGEST_MOD = 2147483647  # fixed value: the digest's modulus
DIGEST_BASE = 31  # fixed value: the digest's base


def half_units(v: Column) -> Column:
    """Whole number of half units, halves up, whatever the sign."""
    return F.floor(v * 2 + 0.5)


def plain_zero(v: Column) -> Column:
    """A negative zero as zero."""
    return F.when(v == 0, F.lit(0.0)).otherwise(v)


def half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's ``round`` of doubles, for arrays in tasks: halves of the shortest decimal go away from zero."""
    scale = 10.0**digits
    m = np.floor(np.abs(v) * scale)
    up = np.abs(v) >= (2 * m + 1) / (2 * scale)  # the double of the decimal half way
    return np.copysign((m + up) / scale, v) + 0.0


def round3(v: Column) -> Column:
    """Three decimals, halves to even, without a negative zero."""
    return plain_zero(F.bround(v, 3))


def quarter_units(v: Column) -> Column:
    return plain_zero(F.floor(v * 4 + 0.5) / 4)


def parse_coords(text: Column) -> Column:
    """(x, y) of a text of exactly two numbers and separators, floored and below a thousand million; else null."""
    ok = F.rlike(text, F.lit(r"^[\s,;:/()]*-?[0-9]+(\.[0-9]+)?[\s,;:/()]+-?[0-9]+(\.[0-9]+)?[\s,;:/()]*$"))
    n = F.regexp_extract_all(text, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    x, y = F.floor(F.get(n, F.lit(0)).try_cast("double")), F.floor(F.get(n, F.lit(1)).try_cast("double"))
    return F.when(ok & (F.abs(x) < 10**9) & (F.abs(y) < 10**9), F.struct(x.alias("x"), y.alias("y")))


def parse_integer(text: Column, digits: int = 15) -> Column:
    """A plain integer of at most ``digits`` digits, else null."""
    return F.when(F.rlike(text, F.lit(rf"^-?[0-9]{{1,{digits}}}$")), text.try_cast("long"))


def percent_escape(text: Column, special: str = "%\t\n\r") -> Column:
    """Percent codes for the listed characters; the percent sign goes first."""
    out = text
    for c in sorted(special, key=lambda c: c != "%"):
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def percent_unescape(text: Column, special: str = "%\t\n\r") -> Column:
    out = text
    for c in sorted(special, key=lambda c: c == "%"):
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def utf16_hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-16BE"))


def from_utf16_hex(code: Column) -> Column:
    return F.decode(F.unhex(code), "UTF-16BE")


def split_fields(line: Column, sep: str = "\t", most: int = 64) -> Column:
    """Fields with empty ones kept, or null if there are more than ``most``."""
    parts = F.split(line, rf"\Q{sep}\E", -1)
    return F.when(F.size(parts) <= most, parts)


def safe_token(text: Column) -> Column:
    """Letters, digits, dots, dashes and underscores; others become underscores."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


@F.arrow_udf(T.StringType())
def slug(text: pa.Array) -> pa.Array:
    """Compatibility-decomposed ASCII in lower case with dashes: Spark has no such normalisation. A task holds 500 texts besides its batch."""

    def one(t: str | None) -> str:
        plain = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")

    parts = [pa.array([one(v.as_py()) for v in text[i : i + 500]], pa.string()) for i in range(0, len(text), 500)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def distance_label(metres: Column) -> Column:
    """Metres below a kilometre, else kilometres with one decimal."""
    return F.when(metres < 1000, F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m"))).otherwise(F.concat(F.format_string("%.1f", F.round(metres / 1000.0, 1)), F.lit(" km")))


def geometry_id(points: Column) -> Column:
    """SHA-256 of the half-unit coordinates of an array of (x, y), in order."""
    key = lambda p: F.concat_ws(":", half_units(p["x"]).cast("string"), half_units(p["y"]).cast("string"))
    return F.sha2(F.concat_ws(",", F.transform(points, key)), 256)


def polynomial_digest(*values: Column) -> Column:
    """A row's digest: the values as coefficients of a polynomial, modulo DIGEST_MOD; sums of them do not depend on order."""
    h = F.lit(0).cast("long")
    for v in values:
        h = F.pmod(h * DIGEST_BASE + v, F.lit(DIGEST_MOD))
    return h


def elapsed_since(now_ms: Column, then_ms: Column) -> Column:
    """Milliseconds since then; null if the clock was set back."""
    return F.when(now_ms >= then_ms, now_ms - then_ms)


def has_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << bit).cast("long")) != 0


def csv_set_lacks(value: Column, csv: str) -> Column:
    """Whether a value is not in a comma-separated option text; blanks around names do not count."""
    names = [x.strip() for x in csv.split(",") if x.strip()]
    return ~value.isin(names) if names else F.lit(True)


def coerce(value: Column, kind: str, default) -> Column:
    """A text option as boolean, integer or number, or the default if it is missing or malformed."""
    if kind == "boolean":
        low = F.lower(F.trim(value))
        return F.coalesce(F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False), F.lit(default))
    return F.coalesce(F.trim(value).try_cast("long" if kind == "integer" else "double"), F.lit(default))


def by_name(name: Column, exact: dict[str, str], prefixes: list[tuple[str, str]], default: str) -> Column:
    """A class of a name: exact names first, then prefixes in the order given."""
    out = None
    for k, v in exact.items():
        out = (F if out is None else out).when(name == k, v)
    for k, v in prefixes:
        out = (F if out is None else out).when(F.startswith(name, F.lit(k)), v)
    return F.lit(default) if out is None else out.otherwise(default)


#: Factors of travel cost by surface, and of bridges.
SURFACE_FACTORS = {"gravel": 1.05, "dirt": 1.10}
BRIDGE_FACTOR = 1.10
ACCOUNT_MIN = "76561197960265728"  # fixed value: the least account id


def travel_cost(length: Column, surface: Column, bridge: Column) -> Column:
    """A length times the factors of its surface and of a bridge; unknown surfaces count as paved."""
    factor = F.lit(1.0)
    for name, f in SURFACE_FACTORS.items():
        factor = F.when(surface == name, f).otherwise(factor)
    return length * factor * F.when(bridge, BRIDGE_FACTOR).otherwise(1.0)


def json_body(text: Column, most: int = 64) -> Column:
    """A text as the inside of a JSON string; null if it is empty, longer than ``most`` or has a control character.

    Tabs and ends of lines are escaped by their codes.
    """
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c in "\t\n\r":
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return F.when(F.char_length(text).between(1, most) & ~F.rlike(out, F.lit(r"[\x00-\x1f\x7f]")), out)


def is_json_body(text: Column) -> Column:
    """Whether a text can stand inside a JSON string: no bare quote or control character, only \\" \\\\ and \\uXXXX."""
    return F.rlike(text, F.lit(r'^(?:[^"\\\x00-\x1f\x7f]|\\["\\]|\\u[0-9A-Fa-f]{4})*$'))


def clean_name(text: Column) -> Column:
    """A name without blanks at its ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def number_in(text: Column, low: int, high: int, digits: int) -> Column:
    """A plain integer of at most ``digits`` digits between the bounds, else null."""
    v = parse_integer(text, digits)
    return F.when(v.between(low, high), v)


def is_account_id(text: Column) -> Column:
    """Whether a text is an account id: 17 digits and no less than the least one, so texts compare as numbers do."""
    return F.rlike(text, F.lit("^[0-9]{17}$")) & (text >= ACCOUNT_MIN)


def first_tag(tags: list[tuple[str, Column]], most: int = 4) -> Column:
    """The first of at most ``most`` registered tags whose condition holds; later ones are not registered."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in tags[:most]])
