"""Money as integer minor units, periods as inclusive date ranges. Every function maps columns to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# ISO 4217 currencies whose exponent isn't 2.
NO_DECIMALS = ("BIF", "CLP", "DJF", "GNF", "JPY", "KMF", "KRW", "MGA", "PYG", "RWF", "UGX", "VND", "VUV", "XAF", "XOF", "XPF")
THREE_DECIMALS = ("BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND")
#: Largest magnitude in major units.
MAX_MAJOR = 10**15
PERIODS_PER_YEAR = {"monthly": 12, "quarterly": 4, "half_yearly": 2, "annual": 1}


def exponent(currency: Column) -> Column:
    code = F.upper(F.trim(currency))
    return F.when(code.isin(*NO_DECIMALS), 0).when(code.isin(*THREE_DECIMALS), 3).otherwise(2)


def to_minor(amount: Column, currency: Column) -> Column:
    """PRJ11: minor units of a decimal string, half to even; null (to be quarantined) if it isn't a number of allowed size."""
    number = F.regexp_replace(F.trim(amount.cast("string")), ",", "").try_cast("decimal(38,10)")
    scaled = [F.bround(number * 10**e).cast("decimal(38,0)") for e in (0, 2, 3)]
    by = exponent(currency)
    minor = F.when(by == 0, scaled[0]).when(by == 3, scaled[2]).otherwise(scaled[1])
    return F.when(F.abs(number) <= MAX_MAJOR, minor.cast("long"))


def minor_of(amount: Column) -> Column:
    """Minor units of a double that is exact to the cent."""
    return F.bround(amount.cast("decimal(18,2)") * 100).cast("long")


def half_even(numerator: Column, denominator: Column) -> Column:
    """The quotient of two non-negative integers, rounded half to even, exactly."""
    n, d = numerator.cast("decimal(38,0)"), denominator.cast("decimal(38,0)")
    q = F.floor((n - n % d) / d).cast("decimal(38,0)")
    twice = (n % d) * 2
    return (q + F.when((twice > d) | ((twice == d) & (q % 2 == 1)), 1).otherwise(0)).cast("long")


def days_inclusive(start: Column, end: Column) -> Column:
    return F.when(end < start, 0).otherwise(F.datediff(end, start) + 1)


def overlap_days(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """DT1: days that two inclusive ranges share."""
    return F.greatest(F.lit(0), F.datediff(F.least(e1, e2), F.greatest(s1, s2)) + 1)


def prorated(amount: Column, s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """DT2: the part of an amount over [s1, e1] that falls into [s2, e2]."""
    covered, term = overlap_days(s1, e1, s2, e2), days_inclusive(s1, e1)
    part = half_even(amount.cast("decimal(38,0)") * covered, F.greatest(term, F.lit(1)))
    return F.when(covered == 0, 0).when(covered >= term, amount).otherwise(part)


def periods_per_year(frequency: Column) -> Column:
    out = F
    for name, n in PERIODS_PER_YEAR.items():
        out = out.when(frequency == name, F.lit(n))
    return out.otherwise(F.lit(None).cast("int"))


def annualised(recurring: Column, frequency: Column) -> Column:
    """DT5: fee by year; 0 if the frequency doesn't recur."""
    return F.coalesce(recurring * periods_per_year(frequency), F.lit(0)).cast("long")


def contract_value(recurring: Column, frequency: Column, term_days: Column) -> Column:
    """DT4: fee over the whole term, in as many billing periods as the term spans, one at least."""
    n = periods_per_year(frequency)
    times = F.greatest(F.lit(1), F.rint(term_days / (F.lit(365.0) / n)).cast("long"))
    return F.when(n.isNull() | (recurring == 0), recurring).otherwise(recurring * times).cast("long")


def period_allocation(start: Column, end: Column, recurring: Column, one_time: Column, frequency: Column, p0: Column, p1: Column) -> dict[str, Column]:
    """DT3: rule, in_period, future and annualised amounts of a contract; the one-time fee belongs to the period with the start."""
    unknown = start.isNull() | end.isNull() | (end < start)
    covered, term = overlap_days(start, end, p0, p1), days_inclusive(start, end)
    total = contract_value(recurring, frequency, term)
    future = start > p1
    rule = (
        F.when(unknown, "DATES_UNKNOWN").when((covered == 0) & future, "OUTSIDE_PERIOD_FUTURE").when(covered == 0, "OUTSIDE_PERIOD_PAST")
        .when(covered < term, "DAY_PRORATED").otherwise("FULLY_IN_PERIOD")
    )
    part = prorated(total, start, end, p0, p1)
    once = F.when(start.between(p0, p1), one_time).otherwise(0)
    later = F.when(end > p1, total - part).otherwise(0)
    return {
        "rule": rule,
        "in_period": F.when(unknown | (covered == 0), 0).otherwise(part + once).cast("long"),
        "future_period": F.when(unknown, 0).when(covered == 0, F.when(future, total + one_time).otherwise(0)).otherwise(later).cast("long"),
        "annualised": F.when(unknown, 0).otherwise(annualised(recurring, frequency)).cast("long"),
    }


def largest_remainder(rows: DataFrame, keys: list[str], total: str, weight: str, order: list[str], out: str = "share") -> DataFrame:
    """WIN5: deal `total` out within each group in proportion to `weight`: floor shares, leftover units to the largest
    remainders, ties by `order`; with no weight at all the first row takes everything. The shares add up exactly."""
    group = Window.partitionBy(*keys)
    t, w = F.col(total).cast("decimal(38,0)"), F.col(weight).cast("decimal(38,0)")
    rows = rows.withColumn("_w", F.sum(w).over(group)).withColumn("_rem", F.when(F.col("_w") > 0, (t * w) % F.col("_w")).otherwise(0).cast("decimal(38,0)"))
    rows = rows.withColumn("_floor", F.when(F.col("_w") > 0, F.floor((t * w - F.col("_rem")) / F.col("_w"))).otherwise(0).cast("long"))
    rows = rows.withColumn("_left", F.col(total) - F.sum("_floor").over(group)).withColumn("_n", F.row_number().over(group.orderBy(F.col("_rem").desc(), *order)))
    first = F.row_number().over(group.orderBy(*order)) == 1
    share = F.when(F.col("_w") > 0, F.col("_floor") + F.when(F.col("_n") <= F.col("_left"), 1).otherwise(0)).otherwise(F.when(first, F.col(total)).otherwise(0))
    return rows.withColumn(out, share.cast("long")).drop("_w", "_rem", "_floor", "_left", "_n")


def even_split(total: Column, n: Column, index: Column) -> Column:
    """WIN7: share number `index` (from 0) of `n` equal ones; the first takes the remainder."""
    each = F.floor(total / n).cast("long")
    return each + F.when(index == 0, total - each * n).otherwise(0)


def converted(minor: Column, rate: Column, from_exponent: Column, to_exponent: Column) -> Column:
    """MTH2: minor units in another currency at a pinned rate, half to even."""
    return F.bround(minor.cast("decimal(20,0)") * rate.cast("decimal(12,6)") * F.pow(F.lit(10), to_exponent - from_exponent).cast("decimal(5,3)")).cast("long")


def formatted(minor: Column, currency: Column) -> Column:
    """PRJ12: code and amount; rupees in the Indian grouping 1,00,00,000."""
    two = F.lpad((F.abs(minor) % 100).cast("string"), 2, "0")
    whole = F.floor(F.abs(minor) / 100).cast("string")
    grouped = F.regexp_replace(F.format_number(F.floor(F.abs(minor) / 100), 0), "^$", "0")
    last, head = F.right(whole, F.lit(3)), F.substr(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    indian = F.when(F.length(whole) <= 3, whole).otherwise(F.concat_ws(",", F.reverse(F.regexp_replace(F.reverse(head), r"(\d{2})(?=\d)", "$1,")), last))
    return F.concat(currency, F.lit(" "), F.when(minor < 0, "-").otherwise(""), F.when(currency == "INR", indian).otherwise(grouped), F.lit("."), two)


def currency_sums(rows, keys: list[str], amount: str, currency: str, expected: Column):
    """AGG1: totals by key in the expected currency. A group with any other currency has no total, but an error."""
    foreign = F.array_sort(F.collect_set(F.when(F.col(currency) != expected, F.col(currency))))
    by = rows.groupBy(*keys).agg(F.sum(amount).alias("total"), foreign.alias("foreign"))
    mixed = F.size("foreign") > 0
    return by.select(*keys, F.when(~mixed, F.col("total")).alias("total"), F.when(mixed, F.concat(F.lit("cannot sum "), F.array_join("foreign", ", "), F.lit(" into a "), expected, F.lit(" total"))).alias("error"))
