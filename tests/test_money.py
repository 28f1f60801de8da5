from fractions import Fraction

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import money


def test_to_minor(spark):
    rows = [("1,234.565", "INR", 123456), ("0.125", "INR", 12), ("0.135", "INR", 14), ("5", "jpy", 5), ("1.2345", "KWD", 1234), ("n/a", "INR", None), ("NaN", "INR", None), ("2e15", "INR", None), (" -3.5 ", "INR", -350), (None, "INR", None)]
    df = spark.createDataFrame(rows, "a string, c string, want long")
    assert [tuple(r) for r in df.select(money.to_minor(F.col("a"), F.col("c")), "want").collect()] == [(r[2], r[2]) for r in rows]


def test_format(spark):
    rows = [(1_00_00_000_00, "INR", "INR 1,00,00,000.00"), (123456, "USD", "USD 1,234.56"), (-99, "INR", "INR -0.99"), (0, "INR", "INR 0.00"), (12_34_567_00, "INR", "INR 12,34,567.00")]
    df = spark.createDataFrame(rows, "m long, c string, want string")
    for got, want in df.select(money.formatted(F.col("m"), F.col("c")), "want").collect():
        assert got == want


def largest_remainder(total, weights):
    if not sum(weights):
        return [total] + [0] * (len(weights) - 1)
    shares = [total * w // sum(weights) for w in weights]
    order = sorted(range(len(weights)), key=lambda i: (-(total * weights[i] % sum(weights)), i))
    for i in order[: total - sum(shares)]:
        shares[i] += 1
    return shares


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**12), st.lists(st.integers(0, 1000), min_size=1, max_size=6)), min_size=40, max_size=60))
def test_largest_remainder(spark, cases):
    rows = [(g, total, i, w) for g, (total, weights) in enumerate(cases) for i, w in enumerate(weights)]
    got = money.largest_remainder(spark.createDataFrame(rows, "g int, total long, i int, w long"), ["g"], "total", "w", ["i"]).orderBy("g", "i").collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append(r["share"])
    for g, (total, weights) in enumerate(cases):
        assert by[g] == largest_remainder(total, weights)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**18), st.integers(1, 5000)), min_size=50, max_size=80))
def test_half_even(spark, cases):
    got = spark.createDataFrame(cases, "n long, d long").select(money.half_even(F.col("n"), F.col("d"))).collect()
    assert [r[0] for r in got] == [round(Fraction(n, d)) for n, d in cases]


def test_period_allocation(spark):
    rows = [("2024-01-01", "2024-12-31", "FULLY_IN_PERIOD"), ("2023-07-01", "2024-06-30", "DAY_PRORATED"), ("2025-01-01", "2025-12-31", "OUTSIDE_PERIOD_FUTURE"), ("2022-01-01", "2022-12-31", "OUTSIDE_PERIOD_PAST"), (None, "2024-01-01", "DATES_UNKNOWN")]
    df = spark.createDataFrame(rows, "s string, e string, want string").select(F.to_date("s").alias("s"), F.to_date("e").alias("e"), "want")
    c = money.period_allocation(F.col("s"), F.col("e"), F.lit(100_00), F.lit(500), F.lit("monthly"), F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date"))
    got = df.select("want", c["rule"].alias("rule"), c["in_period"].alias("i"), c["future_period"].alias("f"), c["annualised"].alias("a")).collect()
    assert [r["rule"] for r in got] == [r["want"] for r in got]
    assert got[0]["i"] == 12 * 100_00 + 500 and got[2]["f"] == 12 * 100_00 + 500 and got[1]["a"] == 120_000
