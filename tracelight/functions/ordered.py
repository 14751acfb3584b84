"""Global ranks and running sums without a single-partition sort.

Rows are cut into value ranges at approximate quantiles of the leading sort key. The sums of whole ranges
(a small table) give each range its offset, and a window inside each range does the rest.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one range, which one task sorts, and the bounds of the number of ranges.
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 500_000, 8, 16_384
#: Keys that fill several ranges and are cut by their ties at most.
MOST_HOT = 32
_FINE = 1_024


def text_key(text: Column) -> Column:
    """A number that sorts like the first six bytes of a text."""
    first = F.rpad(F.substring(F.hex(F.encode(text, "UTF-8")), 1, 12), 12, "0")
    return F.conv(first, 16, 10).cast("double")


def value_range(df: DataFrame, key: Column, ranges: int | None = None, tie: Column | None = None) -> Column:
    """A number that grows with a column ``__key``, which holds the values of ``key`` (castable to double); equal numbers are one range.

    Without ``ranges`` their count follows that of the rows. One pass counts rows and finds cuts; more than
    ``_FINE`` ranges take a second one. Equal keys share a range, but keys that fill several are cut by ``tie``,
    whose values a column ``__tie`` holds.
    """

    def cuts(rows: DataFrame, k: Column, n: int, *more: Column):
        shares = F.array(*(F.lit(i / n) for i in range(1, n)))
        return rows.select(k.cast("double").alias("k")).agg(F.percentile_approx("k", shares, max(1000, 10 * n)).alias("cuts"), *more).first()

    found = cuts(df, key, ranges or _FINE, F.count("*").alias("n"))
    wanted = ranges or max(LEAST_RANGES, min(MOST_RANGES, -(-found["n"] // ROWS_PER_RANGE)))
    every = (found if ranges or wanted <= _FINE else cuts(df, key, wanted))["cuts"] or []
    step = max(1, round((len(every) + 1) / wanted))
    chosen = Counter(c for c in every[step - 1 :: step] if math.isfinite(c))
    places = sorted(chosen)
    base = f"0.5D + {_search(places, '__key')}"
    hot = [] if tie is None else [v for v, n in chosen.most_common(MOST_HOT) if n > 1]
    if not hot:
        return F.expr(base)
    whens = []
    for v in hot:
        inner = cuts(df.where(key.cast("double") == F.lit(v)), tie, chosen[v] + 1)["cuts"] or []
        own = sorted({c for c in inner if math.isfinite(c)})
        whens.append(f"WHEN __key = {v!r}D THEN {places.index(v) + 1} + 0.5D * ({_search(own, '__tie')}) / {len(own) + 1}")
    return F.expr(f"CASE {' '.join(whens)} ELSE {base} END")


def _search(cuts: list[float], key: str) -> str:
    """SQL of a binary search for the number of ``cuts`` that are at most ``key``."""

    def between(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN {key} >= {cuts[middle]!r}D THEN {between(middle + 1, high)} ELSE {between(low, middle)} END"

    return between(0, len(cuts))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], key: Column, by: list[str] | None = None, descending: bool = False, ranges: int | None = None, tie: Column | None = None) -> DataFrame:
    """``df`` with running sums in ``order``, whose first column sorts like ``key`` (from the top if ``descending``).

    The second column sorts like ``tie``, if given (likewise from the top). ``by`` restarts the sums for each of its values. Columns starting with ``__`` are used inside.
    """
    by = by or []
    number = value_range(df, key, ranges, tie)
    keyed = df.withColumns({"__key": key.cast("double"), "__tie": F.lit(0.0) if tie is None else tie.cast("double")})
    cut = keyed.withColumn("__range", -number if descending else number).drop("__key", "__tie")
    totals = cut.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__range", *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums))
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"__l_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    out = local.join(totals, [*by, "__range"])
    return out.withColumns({n: F.col(f"__l_{n}") + F.col(f"__o_{n}") for n in sums}).drop("__range", *(f"__{p}_{n}" for n in sums for p in "lo"))


def ranked(df: DataFrame, order: list[Column], key: Column, name: str = "rank", by: list[str] | None = None, descending: bool = False, tie: Column | None = None) -> DataFrame:
    """``df`` with its 1-based position in ``order``."""
    return running(df, order, {name: F.lit(1)}, key, by, descending, tie=tie)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, a column for each of ``shares``; nulls are left out.

    Equal values are counted first; their running sums by value range give the two neighbours of each quantile.
    """
    by = by or []
    points = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    at = running(points, [F.col(value)], {"__c": F.col("__n")}, F.col(value), by)
    totals = points.groupBy(*by).agg(F.sum("__n").alias("__all"))
    at = at.join(totals, by) if by else at.crossJoin(F.broadcast(totals))  # one row
    place = {name: (F.col("__all") - 1) * F.lit(share) for name, share in shares.items()}
    reached = lambda k: F.min(F.when(F.col("__c") > k, F.col(value)))
    sides = [f(p) for p in place.values() for f in (lambda p: reached(F.floor(p)), lambda p: reached(F.ceil(p)), lambda p: F.max(p - F.floor(p)))]
    found = at.groupBy(*by).agg(*(c.alias(f"__{kind}_{name}") for c, (name, kind) in zip(sides, ((n, k) for n in shares for k in ("low", "high", "part")))))
    return found.select(*by, *((F.col(f"__low_{n}") + (F.col(f"__high_{n}") - F.col(f"__low_{n}")) * F.col(f"__part_{n}")).alias(n) for n in shares))
