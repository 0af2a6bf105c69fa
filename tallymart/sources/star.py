"""The sales table as a view over a star schema of order lines.

Each dimension is joined only when one of its columns is asked for, so a mart over three columns
does not pay for every join. All joins are left joins: a line whose key has no dimension row stays, with
NULL there, and every mart is over the same lines whatever columns it reads.
No join is hinted: ``part``, ``supplier``, ``customer`` and ``orders`` grow with the data, so Spark
decides on a broadcast from file and run-time sizes, and splits the skewed partitions of a shuffled
join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions.exact_sums import FLOATING, exact_total
from tallymart.session import materialize
from tallymart.sources.footers import counted
from tallymart.sources.readers import read_parquet
from tallymart.sources.schema import COLUMN_NAMES

# Liquor category text standing in for each part brand; Brand#25 has none (NULL).
CATEGORY_OF_BRAND = {
    "Brand#1": "STRAIGHT BOURBON WHISKIES",
    "Brand#2": "Scotch Whiskies",
    "Brand#3": "WHISKEY LIQUEUR",
    "Brand#4": "AMERICAN VODKAS",
    "Brand#5": "imported flavored vodka",
    "Brand#6": "SPICED RUM",
    "Brand#7": "DRUM AGED SPIRIT",
    "Brand#8": "MIXTO TEQUILA",
    "Brand#9": "MEZCAL",
    "Brand#10": "AMERICAN DRY GINS",
    "Brand#11": "VIRGIN ISLAND SPIRIT",
    "Brand#12": "GRAPE BRANDIES",
    "Brand#13": "COGNAC",
    "Brand#14": "PEPPERMINT SCHNAPPS",
    "Brand#15": "TRIPLE SEC",
    "Brand#16": "CREAM LIQUEURS",
    "Brand#17": "ROCK & RYE",
    "Brand#18": "AMERICAN DISTILLED SPIRITS SPECIALTY",
    "Brand#19": "NEUTRAL GRAIN SPIRITS",
    "Brand#20": "COCKTAILS / RTD",
    "Brand#21": "IOWA DISTILLERIES",
    "Brand#22": "HOLIDAY VAP",
    "Brand#23": "TEMPORARY & SPECIALTY PACKAGES",
    "Brand#24": "UNKNOWN THING",
}

# Sales column -> (dimension it needs, SQL expression over the joined row).
_COLUMNS = {
    "invoice_item": ("lineitem", "concat(l_orderkey, '-', l_linenumber)"),
    "order_key": ("lineitem", "l_orderkey"),
    "order_line": ("lineitem", "l_linenumber"),
    "sale_date": ("orders", "cast(o_orderdate as date)"),
    "store_number": ("store", "store_number"),
    "store_name": ("store", "store_name"),
    "address": ("store", "concat(store_number, ' High Street')"),
    "city": ("city", "n_name"),
    "zip_code": ("store", "cast(50000 + store_nationkey as string)"),
    "store_location": ("lineitem", "nullif(l_returnflag, 'R')"),
    "county_number": ("county", "r_regionkey"),
    "county": ("county", "r_name"),
    "category": ("part", "substr(p_brand, 7)"),
    "category_name": ("part", "category_name"),
    "vendor_number": ("part", "p_size"),
    "vendor_name": ("part", "p_type"),
    "item_number": ("lineitem", "l_partkey"),
    "item_description": ("part", "p_name"),
    "pack": ("lineitem", "l_linenumber"),
    "bottle_volume_ml": ("part", "p_size * 100"),
    "state_bottle_cost": ("part", "p_retailprice / 2"),
    "state_bottle_retail": ("part", "p_retailprice"),
    "bottles_sold": ("lineitem", "cast(l_quantity as smallint)"),
    "sale_dollars": ("lineitem", "l_extendedprice"),
    "volume_liters": ("part", "l_quantity * p_size / 10"),
    "volume_gallons": ("part", "l_quantity * p_size / 10 * 0.264172D"),
}

_STORE_KEYS = {
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "l_suppkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "o_custkey"),
}


# Many lines are joined with their orders in tasks of so many lines; few are left to Spark.
LINES_PER_TASK = 500_000
MANY_LINES = 8_000_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{root}/{name}.parquet")


def _stores(spark: SparkSession, root: str, kind: str) -> DataFrame:
    key, name, nation, _ = _STORE_KEYS[kind]
    return table(spark, root, kind).select(
        F.col(key).alias("store_number"),
        F.col(name).alias("store_name"),
        F.col(nation).alias("store_nationkey"),
    )


def _parts(spark: SparkSession, root: str) -> DataFrame:
    pairs = [F.lit(text) for pair in CATEGORY_OF_BRAND.items() for text in pair]
    category = F.create_map(*pairs)[F.col("p_brand")]
    return table(spark, root, "part").withColumn("category_name", category)


def _tasks_by_order(spark: SparkSession, root: str) -> int | None:
    """Number of tasks to deal the lines to by order, None to leave them as they are.

    A shuffled line takes a few bytes when packed and hundreds in a task that sorts and groups it, so partitions of
    a size in bytes hold millions of lines. An order has few lines, so its key deals them evenly; lines
    without one would come to one task, and where there are any the split is left to Spark.
    """
    n_lines, n_keys = counted(spark, f"{root}/lineitem.parquet", "l_orderkey")
    return math.ceil(n_lines / LINES_PER_TASK) if n_lines > MANY_LINES and n_keys == n_lines else None


def sales(
    spark: SparkSession, root: str, columns: Iterable[str], store: str = "supplier"
) -> DataFrame:
    """The named sales columns, typed as after cleaning.

    ``store`` is the dimension that plays the store: ``supplier`` (every store sells every month) or
    ``customer`` (months without sales).
    """
    columns = list(columns)
    needed = {_COLUMNS[name][0] for name in columns}
    store_key = _STORE_KEYS[store][3]
    if "county" in needed:
        needed.add("city")
    if "city" in needed:
        needed.add("store")
    if "store" in needed and store_key.startswith("o_"):
        needed.add("orders")

    # Joined one by one to the lines: Spark knows the size of a plain table from its files, while it
    # overestimates that of a join and would not broadcast the result.
    lines = table(spark, root, "lineitem")
    stores_of_orders = False
    if "orders" in needed:
        orders = table(spark, root, "orders")
        if tasks := _tasks_by_order(spark, root):
            lines = lines.repartition(tasks, "l_orderkey")
            if stores_of_orders := "store" in needed and store_key.startswith("o_"):
                # There are fewer orders than lines to shuffle by their store.
                stores = _stores(spark, root, store)
                orders = orders.join(stores, F.col(store_key) == F.col("store_number"), "left")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "part" in needed:
        lines = lines.join(_parts(spark, root), F.col("l_partkey") == F.col("p_partkey"), "left")
    if "store" in needed and not stores_of_orders:
        stores = _stores(spark, root, store)
        lines = lines.join(stores, F.col(store_key) == F.col("store_number"), "left")
    if "city" in needed:
        nations = table(spark, root, "nation")
        lines = lines.join(nations, F.col("store_nationkey") == F.col("n_nationkey"), "left")
    if "county" in needed:
        regions = table(spark, root, "region")
        lines = lines.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return lines.select(*[F.expr(_COLUMNS[name][1]).alias(name) for name in columns])


# What names a store in a panel.
PLACE = ("store_name", "city", "county")


def _numbered(df: DataFrame, columns: Iterable[str], number: str) -> DataFrame:
    """The distinct values of ``columns`` with a number each, written; where all are NULL there is none."""
    some = reduce(or_, [F.col(c).isNotNull() for c in columns])
    rows = df.select(*columns).where(some).distinct().withColumn(number, F.monotonically_increasing_id())
    return materialize(rows, f"{number}-numbers")


def _with_number(df: DataFrame, columns: Iterable[str], numbers: DataFrame) -> DataFrame:
    others = numbers.withColumnsRenamed({c: f"_{c}" for c in columns})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return df.join(others, same, "left").drop(*[f"_{c}" for c in columns])


def keyed_sales(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The lines a panel is made of, with numbers for texts, and the ``places`` the numbers stand for.

    ``place`` stands for the store's name, city and county, and ``item`` for the item's description: the same number
    for the same texts, NULL where all are NULL. So lines are grouped by whole numbers, and names are joined
    to the few rows that come out. Lines lie by order, so that an invoice line is in one task. Few lines, or
    lines of which some have no order, lie by invoice line and place after the join with the orders, which
    Spark can then split.
    """
    nations, regions = table(spark, root, "nation"), table(spark, root, "region")
    stores = _stores(spark, root, "supplier")
    stores = stores.join(nations, F.col("store_nationkey") == F.col("n_nationkey"), "left")
    stores = stores.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    stores = stores.select("store_number", *[F.expr(_COLUMNS[name][1]).alias(name) for name in PLACE])
    places = _numbered(stores, PLACE, "place")
    # Written, so that Spark knows their size.
    stores = materialize(_with_number(stores, PLACE, places).select("store_number", "place"), "store-places")
    parts = table(spark, root, "part").select("p_partkey", "p_size", "p_name")
    parts = _with_number(parts, ["p_name"], _numbered(parts, ["p_name"], "item"))
    parts = materialize(parts.select("p_partkey", "p_size", "item"), "part-items")

    lines = table(spark, root, "lineitem")
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    lines = lines.join(stores, F.col("l_suppkey") == F.col("store_number"), "left")
    columns = ("order_key", "order_line", "store_location", "bottles_sold", "sale_dollars", "volume_liters")
    lines = lines.select("place", "item", *[F.expr(_COLUMNS[name][1]).alias(name) for name in columns])
    if tasks := _tasks_by_order(spark, root):
        lines = lines.repartition(tasks, "order_key")
    orders = table(spark, root, "orders")
    lines = lines.join(orders, F.col("order_key") == F.col("o_orderkey"), "left")
    if not tasks:
        lines = lines.repartition("order_key", "order_line", "place")
    return lines.select("place", "item", *columns, F.expr(_COLUMNS["sale_date"][1]).alias("sale_date")), places


# Measure -> the column of the lines that is summed per foreign key, and the measure from that sum. A
# volume is the same in exact arithmetic whether the quantity is summed before or after.
_VOLUME = "cast(quantity as decimal(24,4)) * cast(p_size as decimal(6,0))"
_SUMS = {
    "sale_dollars": ("dollars", "dollars"),
    "bottles_sold": ("bottles", "bottles"),
    "volume_liters": ("quantity", f"{_VOLUME} * 0.1BD"),
    "volume_gallons": ("quantity", f"{_VOLUME} * 0.0264172BD"),
}
_SUMMED = {"dollars": "l_extendedprice", "bottles": "cast(l_quantity as smallint)", "quantity": "l_quantity"}


def sales_by(spark: SparkSession, root: str, keys: Iterable[str], measures: Iterable[str] = ()) -> DataFrame:
    """Partial sums of ``measures`` and ``n_rows`` with the dimension columns ``keys``.

    Lines are summed per foreign key before any dimension is joined: that combines in the map tasks,
    so no line is shuffled by its part or supplier and a hot key is one row per task. Sums are exact decimals
    and add up, so a mart sums what this returns. For columns of parts and supplier stores; those of orders need
    the lines themselves (:func:`sales`).
    """
    keys, measures = list(keys), list(measures)
    needed = {_COLUMNS[name][0] for name in (*keys, *measures)} - {"lineitem"}
    if "orders" in needed:
        raise ValueError("columns of orders cannot be joined to sums per part and supplier")
    by_store = bool(needed & {"store", "city", "county"})
    foreign = ["l_partkey"] * ("part" in needed) + ["l_suppkey"] * by_store
    summed = sorted({_SUMS[name][0] for name in measures})
    lines = table(spark, root, "lineitem").select(*foreign, *[F.expr(_SUMMED[name]).alias(name) for name in summed])
    totals = [exact_total(lines, name).alias(name) for name in summed]
    rows = lines.groupBy(*foreign).agg(*totals, F.count(F.lit(1)).alias("n_rows"))
    if "part" in needed:
        rows = rows.join(_parts(spark, root), F.col("l_partkey") == F.col("p_partkey"), "left")
    if by_store:
        rows = rows.join(_stores(spark, root, "supplier"), F.col("l_suppkey") == F.col("store_number"), "left")
    if needed & {"city", "county"}:
        nations = table(spark, root, "nation")
        rows = rows.join(nations, F.col("store_nationkey") == F.col("n_nationkey"), "left")
    if "county" in needed:
        regions = table(spark, root, "region")
        rows = rows.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select(
        *[F.expr(_COLUMNS[name][1]).alias(name) for name in keys],
        *[F.expr(_SUMS[name][1]).alias(name, metadata={} if name == "bottles_sold" else FLOATING) for name in measures],
        "n_rows",
    )


def raw_sales(spark: SparkSession, root: str) -> DataFrame:
    """All columns under their source names and as text, the way the CSV holds them."""
    rows = sales(spark, root, COLUMN_NAMES.values())
    text = {name: F.col(name).cast("string") for name in COLUMN_NAMES.values()}
    text["sale_date"] = F.date_format("sale_date", "MM/dd/yyyy")
    return rows.select(*[text[name].alias(source) for source, name in COLUMN_NAMES.items()])
