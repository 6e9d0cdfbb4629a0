"""Scalar functions on numbers and number-like text: Column -> Column, null-safe, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Text without the white space around it."""
    return F.trim(col(x), F.lit(SPACES))


def empty_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def digits(x: Column | str) -> Column:
    """number_text with '' where there are no digits; one chain, in which x stands once."""
    plain = F.regexp_replace(F.regexp_replace(col(x).cast("string"), r"[^0-9.,]", ""), r"\.(?=\d{3}(?:\D|$))", "")
    return F.trim(F.translate(plain, ",", "."), F.lit("."))


def number_text(x: Column | str) -> Column:
    """Digits with a decimal point out of text. Dots before groups of three digits go, a comma is the point;
    anything but ASCII digits is dropped, and a text without digits is NULL."""
    return F.nullif(digits(x), F.lit(""))


def to_double(x: Column | str) -> Column:
    """A double with a decimal comma or point; bad text is NULL."""
    return F.replace(col(x).cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def room_range(x: Column | str) -> Column:
    """A count. `3+` is 4, `a-b` is b, `a-b+` is b + 1, decimals are cut off, bad text is NULL."""
    text = F.translate(col(x).cast("string"), SPACES, "")
    ranged = r"^(?:\d+-)?(\d+)(\+?)$"
    upper = F.regexp_extract(text, ranged, 1).try_cast("int") + F.when(F.endswith(text, F.lit("+")), 1).otherwise(0)
    return F.when(text.rlike(r"^-?\d+(\.\d*)?$"), text.try_cast("double").cast("int")).otherwise(upper)


def room_count(x: Column | str) -> Column:
    """Whole numbers as they are, `3+` is 4 and `5+` is 6, other text NULL."""
    text = strip(col(x).cast("string"))
    return F.when(text == "3+", 4).when(text == "5+", 6).otherwise(text.try_cast("int"))


def first_number(x: Column | str) -> Column:
    """The first number in a text."""
    return F.regexp_extract(col(x).cast("string"), r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def surface(shown: Column | str, value: Column | str) -> Column:
    """The surface out of the first of two texts that is there."""
    return digits(F.coalesce(col(shown), col(value))).try_cast("double")


def whole_amount(x: Column | str) -> Column:
    """C14: the text before the comma without its dots, as a number."""
    head = F.replace(F.split_part(col(x).cast("string"), F.lit(","), F.lit(1)), F.lit("."), F.lit(""))
    return F.regexp_replace(head, r"[^0-9]", "").try_cast("double")


BASEMENT, GROUND = r"(?i)interrato", r"(?i)terra|rialzato"


def property_floor(abbreviation: Column | str, text: Column | str) -> Column:
    """The floor of a property: ground floor (T, or a text of it, basements apart) is 0, else a whole number."""
    ground = (F.upper(col(abbreviation)) == "T") | (col(text).rlike(GROUND) & ~col(text).rlike(BASEMENT))
    return F.when(F.coalesce(ground, F.lit(False)), 0).otherwise(strip(F.coalesce(col(text), col(abbreviation))).try_cast("int"))


def floor_level(x: Column | str) -> Column:
    """A floor label as a level: basements -1, ground and raised ground floor 0, else the first number."""
    text = col(x).cast("string")
    number = F.regexp_extract(text, r"(-?\d+)", 1).try_cast("int")
    return F.when(text.rlike(BASEMENT), -1).when(text.rlike(GROUND), 0).otherwise(number)


def consumption(x: Column | str) -> Column:
    """C17: energy consumption from a number or a text of one."""
    text = col(x).cast("string")
    number = F.when(text.rlike(r"^\s*[-+]?(?:\d|\.\d|(?i:nan|inf))\S*\s*$"), text.try_cast("double"))  # a failing cast is slow
    return F.coalesce(number, digits(x).try_cast("double"))


def mortgage_payment(principal: Column | str, rate: Column | str, years: int = 30) -> Column:
    """The monthly payment that pays off a loan, to the cent; NULL unless principal and rate are positive."""
    p, r = col(principal).cast("double"), col(rate).cast("double") / 12
    return F.when((p > 0) & (r > 0), F.bround(p * r / (1 - F.pow(1 + r, F.lit(-12.0 * years))), 2))


def monthly_payment(price: Column | str, rate: Column | str, years: int = 30, down: float = 0.2) -> Column:
    """The same of a price less a down payment, unrounded."""
    p, r = col(price).cast("double") * (1 - down), col(rate).cast("double") / 12
    return F.when((p > 0) & (r > 0), p * r / (1 - F.pow(1 + r, F.lit(-12.0 * years))))


def price_per_sqm(price: Column | str, area: Column | str) -> Column:
    """Rounded to the cent; NULL without an area."""
    return F.bround(F.try_divide(col(price).cast("double"), F.nullif(col(area).cast("double"), F.lit(0.0))), 2)


def round_to(x: Column | str, n: float) -> Column:
    """The nearest multiple of n, halves to the even one."""
    return F.bround(col(x).cast("double") / n) * n


def random_round(x: Column | str, seed: int = 0) -> Column:
    """The nearest whole number; an exact half goes up or down by a seeded coin."""
    v = col(x).cast("double")
    low = F.floor(v)
    return F.when(v - low == 0.5, low + (F.rand(seed) < 0.5).cast("int")).otherwise(F.bround(v).cast("long"))


def clamp(x: Column | str, low: float, high: float) -> Column:
    """Not below low nor above high; NULL stays."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(x))))


def rent_yield(rent: Column | str, price: Column | str) -> Column:
    """Yearly rent in percent of the price, rounded to the cent; NULL without a price."""
    return F.bround(F.try_divide(col(rent).cast("double") * 12, F.nullif(col(price).cast("double"), F.lit(0.0))) * 100, 2)
