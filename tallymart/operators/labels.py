"""Per-period thresholds, top-quantile labels and the breakout cohort.

The label functions read their input more than once. Where revenue comes from floating-point sums,
pass a written table (``session.materialize``): the row that sets a threshold is then compared with
the very value it set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.operators.features import TIME_ORDER
from tallymart.session import materialize

PERIOD = ("year", "month")


MOST_CELLS = 100_000
SPLIT = 64
METHODS = ("nearest", "disc", "linear")
_PLACE = ("_rank", "_next", "_n")


def _same(keys: Sequence[str], suffix: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in keys]


def _narrowed(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted values (keys, _cell, _count, _rank, _next, _n) cut down to at most MOST_CELLS for each group.

    A row without ``_cell`` stands for all values below the others.
    """
    counted = materialize(counted, "quantile-cells")
    while counted.groupBy(*keys).count().where(F.col("count") > MOST_CELLS).limit(1).count():
        shares = [i / SPLIT for i in range(1, SPLIT)]
        marks = counted.groupBy(*keys).agg(F.percentile_approx("_cell", shares, 100 * SPLIT).alias("_marks"))
        marks = materialize(marks.withColumnsRenamed({k: f"{k}_m" for k in keys}), "quantile-marks")
        above = F.size(F.filter("_marks", lambda m: m < F.col("_cell")))
        ranged = counted.join(marks, _same(keys, "_m")).withColumn(
            "_range", F.when(F.col("_cell").isNull(), -1).otherwise(above)
        )
        totals = ranged.groupBy(*keys, "_range").agg(
            F.sum("_count").alias("_total"), *[F.max(c).alias(c) for c in _PLACE]
        )
        upto = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_range"))  # at most SPLIT + 1 rows
        wanted = totals.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_total"))
        # The ranges of both ranks; nothing lies between them.
        has_rank = (F.col("_upto") >= F.col("_rank")) & (F.col("_before") < F.col("_next"))
        wanted = wanted.where(has_rank | (F.col("_n") == 0))
        wanted = materialize(wanted.withColumnsRenamed({c: f"{c}_w" for c in (*keys, "_range")}), "quantile-ranges")
        inside = ranged.join(
            wanted.select(*[f"{c}_w" for c in (*keys, "_range")]), _same((*keys, "_range"), "_w")
        )
        rows = inside.select(*keys, "_cell", "_count", *_PLACE)
        first = wanted.where((F.col("_before") > 0) & (F.col("_before") < F.col("_rank")))
        below = first.select(
            *[F.col(f"{k}_w").alias(k) for k in keys],
            F.lit(None).cast(counted.schema["_cell"].dataType).alias("_cell"),
            F.col("_before").alias("_count"), *_PLACE,
        )
        counted = materialize(rows.union(below), "quantile-cells")
    return counted


def _ranks(n: Column, q: float, method: str) -> tuple[Column, Column]:
    """The rank of the wanted value, from 1, and of the other one to interpolate with, or the same."""
    place = (n - 1) * F.lit(q)
    if method == "nearest":
        rank = F.floor(place + 0.5) + 1
        return rank, rank
    if method == "disc":
        rank = F.greatest(F.ceil(n * F.lit(q)), F.lit(1))
        return rank, rank
    return F.floor(place) + 1, F.ceil(place) + 1


def group_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    q: float,
    out: str = "quantile",
    method: str = "nearest",
    bounded_groups: bool = False,
    accuracy: int = 1000,
) -> DataFrame:
    """Exact quantile per group over the n non-NULL values in order.

    ``nearest`` is the value at index round((n-1)*q), halves up; ``disc`` the first value whose share of
    rows up to it reaches ``q``, rank ceil(n*q); ``linear`` goes between the two values around index
    (n-1)*q in proportion, as double. No task holds a whole group:

    1. a mergeable sketch per group gives two marks around the wanted rank. Its rank error is at
       most ``n / accuracy`` and the marks lie three times that to either side, so the wanted value
       is between them;
    2. values between the marks are counted one by one, those under them only as a total, both
       combined in the map tasks. A running count over the at most ``6 * n / accuracy`` values left
       finds the wanted one.

    3. unless groups are bounded, the counted values are written, and while a group has more than
       ``MOST_CELLS`` of them they are cut into SPLIT ranges, of which the one with the rank is kept
       and those before it become one total. So the last running count is over a bounded number of
       rows, and only giant groups need extra passes.

    Groups of at most ``accuracy`` values skip the marks. If a value were not found between the
    marks the query would fail, not return another one. A higher ``accuracy`` makes the sketches
    larger and the last step smaller.

    ``bounded_groups`` states that the number of groups does not grow with the data (calendar months
    do not), so the marks are broadcast. Otherwise they are written to the shared folder when this
    is called; Spark then knows their size and broadcasts them only if they are small.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError(f"q must be between 0 and 1, not {q}")
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}, not {method!r}")
    aliases = [f"_key{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, aliases)], F.col(value).alias("_x"))
    margin = 3.0 / accuracy
    marks = F.percentile_approx("_x", [max(0.0, q - margin), min(1.0, q + margin)], accuracy)
    large = F.col("_n") > accuracy
    rank, following = _ranks(F.col("_n"), q, method)
    groups = (
        rows.groupBy(*aliases)
        .agg(F.count("_x").alias("_n"), marks.alias("_marks"))
        .select(
            *[F.col(a).alias(f"{a}_g") for a in aliases],
            "_n",
            rank.alias("_rank"),
            following.alias("_next"),
            F.when(large, F.col("_marks")[0]).alias("_low"),
            F.when(large, F.col("_marks")[1]).alias("_high"),
        )
    )
    same_group = [F.col(a).eqNullSafe(F.col(f"{a}_g")) for a in aliases]
    groups = F.broadcast(groups) if bounded_groups else materialize(groups, "quantile-marks")
    marked = rows.join(groups, same_group)
    x = F.col("_x")
    counted = (
        marked.filter(F.coalesce(x <= F.col("_high"), F.lit(True)))
        .withColumn("_cell", F.when(F.coalesce(x >= F.col("_low"), F.lit(True)), x))
        .groupBy(*aliases, "_cell")
        .agg(F.count("_x").alias("_count"), *[F.max(c).alias(c) for c in _PLACE])
    )
    if not bounded_groups:
        counted = _narrowed(counted, aliases)
    running = F.sum("_count").over(
        Window.partitionBy(*aliases)
        .orderBy(F.col("_cell").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reached, passed = (F.col("_running") >= F.col(rank) for rank in ("_rank", "_next"))
    found = (
        counted.withColumn("_running", running)
        .groupBy(*aliases)
        .agg(
            F.max("_n").alias("_n"),
            F.min(F.when(reached, F.col("_cell"))).alias("_value"),
            F.min(F.when(passed, F.col("_cell"))).alias("_above"),
            F.max(reached & F.col("_cell").isNull()).alias("_under"),
        )
    )
    missed = F.raise_error(F.lit("quantile outside its marks; raise accuracy"))
    low, high = (F.when(F.col("_under"), missed).otherwise(F.coalesce(c, missed)) for c in ("_value", "_above"))
    if method == "linear":
        place = (F.col("_n") - 1) * F.lit(q)
        low, high = low.cast("double"), high.cast("double")
        between = low + (high - low) * (place - F.floor(place))
    else:
        between = low
    picked = F.when(F.col("_n") > 0, between)
    return found.select(*[F.col(a).alias(k) for a, k in zip(aliases, keys)], picked.alias(out))


def group_quantile_nearest(
    df: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "quantile", **options
) -> DataFrame:
    """:func:`group_quantile` by the nearest rank."""
    return group_quantile(df, keys, value, q, out, "nearest", **options)


def monthly_thresholds(
    df: DataFrame,
    value: str = "monthly_revenue",
    q: float = 0.75,
    period: Sequence[str] = PERIOD,
    out: str = "q75",
    method: str = "nearest",
) -> DataFrame:
    """Quantile of ``value`` per month, or per another ``period``, by default the nearest rank."""
    return group_quantile(df, period, value, q, out, method, bounded_groups=tuple(period) == PERIOD)


def quartile_labels(
    df: DataFrame,
    value: str = "monthly_revenue",
    q: float = 0.75,
    period: Sequence[str] = PERIOD,
    threshold: str = "q75",
    label: str = "is_top_quartile",
) -> DataFrame:
    """Add the month's threshold and whether the row reaches it (1 or 0).

    Monthly thresholds are broadcast: one row per calendar month, about 120,000 for all years a date
    can hold. With another ``period`` Spark decides.
    """
    thresholds = monthly_thresholds(df, value, q, period, threshold)
    if tuple(period) == PERIOD:
        thresholds = F.broadcast(thresholds)
    reaches = (F.col(value) >= F.col(threshold)).cast("int")
    return df.join(thresholds, list(period), "left").withColumn(label, reaches)


def breakout_labels(
    df: DataFrame,
    store: str = "store_name",
    order: Sequence[str] = TIME_ORDER,
    label: str = "is_top_quartile",
    previous: str = "was_top_quartile_last_month",
    **options,
) -> DataFrame:
    """Labelled rows of stores whose row before was below its month's threshold.

    The label then says whether the store breaks out. A store's first row has no row before and is
    left out. ``options`` go to :func:`quartile_labels`.
    """
    labelled = quartile_labels(df, label=label, **options)
    before = F.lag(label, 1).over(Window.partitionBy(store).orderBy(*order))
    return labelled.withColumn(previous, before).filter(F.col(previous) == 0)
