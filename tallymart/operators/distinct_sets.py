"""Distinct counts that can be added up: sets of dense ids as bits.

A number of distinct invoices per month cannot be summed to one per quarter, but the sets can be united. Each
value gets a dense whole number, and a group keeps its set as words of 64 bits, one per run of 64 numbers it
has values in, so a set of few values is small. Words of several groups are joined with OR in the map tasks,
so any coarser count comes from the sets alone, exact, without the lines.

Numbers are given along an order in which the values of a group stand together, so that a group touches few
words: an invoice is numbered by the first month and store it occurs in. Numbering is a distributed
running count (``prefix``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.columns import exact
from tallymart.operators.prefix import numbered
from tallymart.session import materialize

RANGE = "id_range"
WORD = "id_word"
BITS = "id_bits"
WORD_BITS = 64


def _same(columns: Sequence[str], suffix: str) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}{suffix}")) for c in columns])


def dense_ids(df: DataFrame, value: Sequence[str], near: Sequence[str] = ()) -> DataFrame:
    """The distinct values of columns ``value`` with a number from 1, ``id``; NULL is a value.

    Values are numbered in the order of the least ``near`` columns they occur with. The least number is found by
    hashing, the least of several columns or of text by sorting all rows.
    """
    keys = [F.min(F.struct(*near) if len(near) > 1 else exact(near[0])).alias("_near")] if near else []
    values = df.groupBy(*value).agg(F.lit(1).alias("_one"), *keys)
    order = [*(["_near"] if near else []), *value]
    return materialize(numbered(values, order, "id").select(*value, "id"), "dense-ids")


def distinct_sets(df: DataFrame, keys: Sequence[str], value: Sequence[str], ids: DataFrame) -> DataFrame:
    """keys, id_range, id_word and id_bits: the set of values of each group, one row per word it touches.

    A range is 32,768 numbers, a word 64 of them.

    ``ids`` comes from :func:`dense_ids` over the same or more rows. A value it does not have fails the
    query. Rows are made distinct before the join, which shuffles on keys and value.
    """
    pairs = df.select(*keys, *value).distinct()
    numbers = ids.withColumnsRenamed({c: f"{c}_id" for c in value})
    unknown = F.raise_error(F.lit(f"a value of {', '.join(value)} has no id"))
    known = pairs.join(numbers, _same(value, "_id"), "left").select(*keys, F.coalesce("id", unknown).alias("id"))
    place = F.bitmap_bit_position("id")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % WORD_BITS).cast("int"))
    words = known.select(
        *keys, F.bitmap_bucket_number("id").alias(RANGE), F.floor(place / WORD_BITS).cast("int").alias(WORD), bit.alias(BITS)
    )
    return rolled_up(words, keys)


def rolled_up(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sets of coarser groups: ``keys`` are columns of ``sets``, or made from them before."""
    return sets.groupBy(*keys, RANGE, WORD).agg(F.bit_or(BITS).alias(BITS))


def set_sizes(sets: DataFrame, keys: Sequence[str], out: str = "n_distinct") -> DataFrame:
    """Exact number of distinct values per group of ``keys``, from the sets of these or finer groups."""
    united = rolled_up(sets, keys)
    return united.groupBy(*keys).agg(F.sum(F.bit_count(BITS)).alias(out))
