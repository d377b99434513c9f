"""Scalar functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of protein accessions, new and old form.
ACCESSION_NEW = "([A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})"
ACCESSION_OLD = "[OPQ][0-9][A-Z0-9]{3}[0-9]"


def minifloat8(c: Column) -> Column:
    """Value of an 8-bit float: four bits of exponent (bias 15), four of fraction. Sums of values up to 1 are exact."""
    return F.pow(F.lit(2.0), F.shiftright(c.bitwiseAND(240), 4) - 15) * (1 + c.bitwiseAND(15) / F.lit(16.0))


def minifloat16(c: Column) -> Column:
    """Value of a 16-bit float: six bits of exponent (bias 63), nine of fraction; the lowest bit does not count."""
    return F.pow(F.lit(2.0), F.shiftright(c, 10).bitwiseAND(63) - 63) * (1 + c.bitwiseAND(1022) / F.lit(1024.0))


def fixed_point(w: Column) -> Column:
    """Weight as an integer of 1/10000, truncated."""
    return (w * F.lit(10000.0)).cast("int")


def accessions(text: Column) -> Column:
    """All accessions in a text, new form first, joined by a blank."""
    return F.array_join(F.concat(F.regexp_extract_all(text, F.lit(ACCESSION_NEW), F.lit(1)), F.regexp_extract_all(text, F.lit(ACCESSION_OLD), F.lit(0))), " ")


def sequence_name(header: Column) -> Column:
    """First token of a header without its > signs."""
    return F.split(F.trim(F.replace(header, F.lit(">"), F.lit(""))), r"\s+")[0]


def intervals_text(fragments: Column) -> Column:
    """s-e,s-e of an array of structs (start, end)."""
    return F.array_join(F.transform(fragments, lambda f: F.concat_ws("-", f["start"].cast("string"), f["end"].cast("string"))), ",")


def entry_query(name: Column) -> Column:
    """Query id of an archive entry: its name up to the first point."""
    return F.substring_index(name, ".", 1)


def template_key(template: Column) -> Column:
    """Second token between bars, else the whole."""
    return F.coalesce(F.try_element_at(F.split(template, r"\|"), F.lit(2)), template)


def exact_4f(w: Column | str) -> Column:
    """Four decimals, as exact_decimals gives them."""
    return exact_decimals(w, 4)


def exact_decimals(w: Column | str, digits: int) -> Column:
    """A number's text with 1 to 7 decimals, rounded half to even on the binary value (Spark's own formats round half up on the decimal).

    The fraction times 10^digits is a double and the exact error of that product, by
    splitting the factor into halves of 26 bits; the error tells which side of a half the
    true product lies. As text of its whole part and its digits; nan, inf and -inf
    as such. Numbers from 2^63 on are refused with an error, null stays null.
    """
    x = (F.col(w) if isinstance(w, str) else w).cast("double")
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole.cast("double")
    near = part * F.lit(10.0**digits)
    spread = part * F.lit(134217729.0)
    high = spread - (spread - part)
    error = (high * F.lit(10.0**digits) - near) + (part - high) * F.lit(10.0**digits)
    down = F.floor(near)
    over = near - down.cast("double") - F.lit(0.5)
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (down % 2 == 1))))
    number = down + up.cast("long")
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, (whole + F.when(number == 10**digits, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((number % 10**digits).cast("string"), digits, "0"))
    large = F.raise_error(F.lit("decimals of a number from 2^63 on")).cast("string")
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(size >= 2.0**63, large).otherwise(text)
