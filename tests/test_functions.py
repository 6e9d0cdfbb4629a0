"""Edge cases of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listing_lake.functions import dates, numbers, strings

D = dt.date
CASES = [
    (numbers.number_text, [("€ 300.000,00", "300000.00"), ("120 m²", "120"), ("120,5", "120.5"), ("N/A", None), ("", None), (None, None)]),
    (numbers.whole_amount, [("€ 300.000,00", 300000.0), ("120 m²", 120.0), ("120,5", 120.0), ("N/A", None), (None, None)]),
    (numbers.room_range, [("3+", 4), ("2 - 5", 5), ("2-5+", 6), ("5.7", 5), ("x", None), (None, None)]),
    (numbers.room_count, [("2", 2), ("3+", 4), ("5+", 6), ("4+", None)]),
    (numbers.floor_level, [("piano terra", 0), ("Rialzato", 0), ("seminterrato", -1), ("3° piano", 3), ("0", 0), (None, None)]),
    (numbers.first_number, [("€ 12.5 al mese", 12.5), ("x", None)]),
    (numbers.to_double, [("1,5", 1.5), ("x", None), (None, None)]),
    (dates.to_date, [("2024-01-15", D(2024, 1, 15)), ("15/01/2024", D(2024, 1, 15)), ("15/01/24", D(2024, 1, 15)), ("5/1/2024", D(2024, 1, 5)), ("invalid", None), ("31/02/2024", None), (None, None)]),
    (lambda c: dates.work_dates(c)[0], [("01/03/2023 - 15/09/2024", D(2023, 3, 1)), ("01/03/2023", D(2023, 3, 1)), (None, None)]),
    (lambda c: dates.work_dates(c)[1], [("01/03/2023 - 15/09/2024", D(2024, 9, 15)), ("01/03/2023", None)]),
    (dates.full_year, [("24-01-15", "2024-01-15"), ("24-1", "24-1"), (None, None)]),
    (strings.place_name, [("Valle d'Aosta X", "valle-d'aosta-x"), (None, "")]),
    (strings.before_separator, [(" a | b", "a"), (None, "")]),
    (lambda c: strings.truncated(c, 5), [("abcdef", "ab..."), ("abcde", "abcde"), (None, None)]),
    (strings.spaced, [("a,b c/d e-f 1/2 x__y", "a, b c / d e - f 1/2 x y"), (None, None)]),
    (strings.cleaned, [("  a \n\t b ", "a b"), (None, None)]),
    (lambda c: strings.nested(c, "a", "b", default="-"), [('{"a": {"b": 4}}', "4"), ("{bad", "-"), (None, "-")]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_scalars(spark, i):
    function, cases = CASES[i]
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "k int, x string").select("k", function(F.col("x")).alias("y")).collect()
    assert {r.k: r.y for r in rows} == {k: y for k, (_, y) in enumerate(cases)}


def test_payments_and_rounding(spark):
    row = spark.range(1).select(
        numbers.mortgage_payment(F.lit(200000), F.lit(0.04)).alias("a"), F.bround(numbers.monthly_payment(F.lit(300000), F.lit(0.035)), 2).alias("b"),
        numbers.monthly_payment(F.lit(300000), F.lit(0)).alias("c"), numbers.price_per_sqm(F.lit(200000), F.lit(85)).alias("d"), numbers.price_per_sqm(F.lit(1), F.lit(0)).alias("e"),
        *(numbers.round_to(F.lit(x), 10000).alias(f"m{x}") for x in (75721, 114595, 834729)), numbers.round_to(F.lit(25), 10).alias("h"), numbers.rent_yield(F.lit(1), F.lit(0)).alias("y"),
        numbers.clamp(F.lit(9), 1, 6).alias("k"), dates.completion(F.lit("2024-01-01"), F.lit("2024-01-01"), F.lit("2024-01-02")).alias("z"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (954.83, 1077.71, None, 2352.94, None)
    assert (row.m75721, row.m114595, row.m834729, row.h, row.y, row.k, row.z) == (80000, 110000, 830000, 20, None, 6, None)
