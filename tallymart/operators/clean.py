"""Drop, cast, parse and enrich: raw transactions to the cleaned sales table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tallymart.functions.calendar import WEEKEND_START, calendar_columns, parse_date
from tallymart.functions.columns import exact
from tallymart.operators.profile import null_heavy_columns, null_report, over_threshold
from tallymart.session import scratch_path
from tallymart.sources.footers import footer_profile
from tallymart.sources.schema import COLUMN_NAMES, NUMERIC_TYPES, TEXT_COLUMNS, UNUSED_COLUMNS


@dataclass(frozen=True)
class CleaningRules:
    """What to do to which source column. ``mode`` is ``strict`` or ``lenient`` for casts and dates."""

    drop: tuple[str, ...] = UNUSED_COLUMNS
    numeric: Mapping[str, str] = field(default_factory=lambda: dict(NUMERIC_TYPES))
    text: tuple[str, ...] = TEXT_COLUMNS
    date: str = "Date"
    date_format: str = "M/d/yyyy"
    names: Mapping[str, str] = field(default_factory=lambda: dict(COLUMN_NAMES))
    mode: str = "strict"
    weekend_start: int = WEEKEND_START


def cast_columns(df: DataFrame, types: Mapping[str, str], mode: str = "strict") -> DataFrame:
    """Cast the named columns that exist. ``strict`` fails on bad values, ``lenient`` gives NULL."""
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be 'strict' or 'lenient', not {mode!r}")
    present = {name: kind for name, kind in types.items() if name in df.columns}
    if mode == "strict":
        return df.withColumns({name: exact(name).cast(kind) for name, kind in present.items()})
    return df.withColumns({name: exact(name).try_cast(kind) for name, kind in present.items()})


def add_calendar(
    df: DataFrame, date: str = "sale_date", weekend_start: int = WEEKEND_START
) -> DataFrame:
    return df.withColumns(calendar_columns(exact(date), weekend_start))


def clean(
    raw: DataFrame, rules: CleaningRules | None = None, also_drop: Iterable[str] = ()
) -> DataFrame:
    """One narrow projection: drop, cast, parse the date, rename, add calendar columns."""
    rules = rules or CleaningRules()
    kept = raw.drop(*rules.drop, *also_drop)
    kept = cast_columns(kept, rules.numeric, rules.mode)
    kept = cast_columns(kept, dict.fromkeys(rules.text, "string"), rules.mode)
    parsed = parse_date(exact(rules.date), rules.date_format, rules.mode)
    kept = kept.withColumn(rules.date, parsed).withColumnsRenamed(dict(rules.names))
    return add_calendar(kept, rules.names.get(rules.date, rules.date), rules.weekend_start)


def clean_profiled(
    raw: DataFrame,
    rules: CleaningRules | None = None,
    null_threshold: float = 0.10,
    required: Iterable[str] = (),
    staged: bool = False,
) -> DataFrame:
    """:func:`clean` without the columns whose share of NULLs reaches ``null_threshold``.

    The raw table is computed twice, for the profile and for the result. With ``staged`` it is written
    first, without the columns that are dropped anyway, and the shares come from the footers of what was written: right for
    a raw table that is a join, while a plain file is better read again.

    The date column is kept whatever its share, because the calendar needs it. ``required`` names
    source columns a later step cannot do without; if one of them would go, this fails with its name.
    """
    rules = rules or CleaningRules()
    required = tuple(required)
    if staged:
        path = scratch_path(raw.sparkSession, "raw")
        raw = raw.drop(*[name for name in rules.drop if name not in (*required, rules.date)])
        raw.write.option("compression", "zstd").parquet(path)
        raw = raw.sparkSession.read.schema(raw.schema).parquet(path)
        over = over_threshold(null_report(footer_profile(raw.sparkSession, path)), null_threshold).collect()
        heavy = [row.column_name for row in over]
    else:
        heavy = null_heavy_columns(raw, null_threshold)
    sparse = [name for name in heavy if name != rules.date]
    if needed := [name for name in required if name in sparse]:
        raise ValueError(f"columns with too many NULLs that are needed later: {', '.join(needed)}")
    return clean(raw, rules, also_drop=sparse)
