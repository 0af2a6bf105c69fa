"""Rules, the two ways to apply them, and the audits."""

import pytest
from pyspark.sql import functions as F

from tallymart.functions.aggregates import n_rows
from tallymart.operators import categorize as cat

EXPECTED = {
    "STRAIGHT BOURBON WHISKIES": "WHISKEY",
    "Scotch Whiskies": "WHISKEY",
    "WHISKEY LIQUEUR": "WHISKEY",
    "imported flavored vodka": "VODKA",
    "DRUM AGED SPIRIT": "RUM",
    "MEZCAL": "TEQUILA & MEZCAL",
    "VIRGIN ISLAND SPIRIT": "GIN",
    "GRAPE BRANDIES": "BRANDY & COGNAC",
    "PEPPERMINT SCHNAPPS": "SCHNAPPS",
    "ROCK & RYE": "LIQUEURS & CORDIALS",
    "AMERICAN DISTILLED SPIRITS SPECIALTY": "SPECIALTY & OTHER SPIRITS",
    "COCKTAILS / RTD": "READY-TO-DRINK",
    "IOWA DISTILLERIES": "CRAFT/LOCAL",
    "TEMPORARY & SPECIALTY PACKAGES": "ADMINISTRATIVE/NON-PRODUCT",
    "UNKNOWN THING": "UNCATEGORIZED",
    "": "UNCATEGORIZED",
    None: "UNCATEGORIZED",
}


@pytest.fixture(scope="module")
def names(spark):
    # Every name twice, and one of them in a third of all rows.
    rows = [(name, i) for i, name in enumerate([*EXPECTED, *EXPECTED])]
    rows += [("DRUM AGED SPIRIT", 100 + i) for i in range(17)]
    return spark.createDataFrame(rows, "category_name string, n int")


@pytest.mark.parametrize("apply", [cat.categorize, cat.categorize_by_lookup])
def test_first_matching_rule_decides(names, apply):
    rows = apply(names).collect()
    assert len(rows) == names.count()
    assert {(row.category_name, row.major_category) for row in rows} == set(EXPECTED.items())


def test_label_after_aggregation_equals_label_before(names):
    early = cat.by_category(names, {"rows": n_rows(), "total": F.sum("n")})
    late = cat.categorize(names).groupBy("major_category").agg(
        n_rows().alias("rows"), F.sum("n").alias("total")
    )
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, late.collect()))


def test_distribution_covers_every_row(names):
    rows = cat.category_distribution(names).collect()
    assert sum(row.n_sales for row in rows) == names.count()
    assert rows[0].major_category == "RUM"


def test_audit_lists_what_no_rule_matches(names):
    got = [tuple(row) for row in cat.uncategorized_audit(names).collect()]
    assert got == [(None, 2), ("", 2), ("UNKNOWN THING", 2)]


def test_pairs_and_distinct_values(names):
    assert cat.category_mapping_pairs(names).count() == len(EXPECTED)
    values = [row[0] for row in cat.distinct_values(names, "category_name").collect()]
    assert values[0] is None and values[1:] == sorted(v for v in EXPECTED if v is not None)


def test_own_rules(spark):
    df = spark.createDataFrame([("red wine",), ("beer",)], "category_name string")
    rules = (cat.Rule("WINE", "WINE"),)
    got = [row[1] for row in cat.categorize(df, rules=rules, default="OTHER").collect()]
    assert got == ["WINE", "OTHER"]


# One text for each alternative of every rule, with the label it must get.
ALTERNATIVES = {
    "WHISKEY": "A WHISKEY|TWO WHISKIES|A WHISKY|BOURBON|SCOTCH",
    "VODKA": "VODKA",
    "RUM": "RUM",
    "TEQUILA & MEZCAL": "TEQUILA|MEZCAL",
    "GIN": "GIN",
    "BRANDY & COGNAC": "BRANDY|BRANDIES|COGNAC",
    "SCHNAPPS": "SCHNAPPS",
    "LIQUEURS & CORDIALS": "AMARETTO|CORDIAL|LIQUEUR|ANISETTE|CREME|ROCK & RYE|TRIPLE SEC",
    "SPECIALTY & OTHER SPIRITS": "AMERICAN ALCOHOL|AMERICAN DISTILLED SPIRITS|DISTILLED SPIRITS SPECIALTY|IMPORTED DISTILLED SPIRITS|NEUTRAL GRAIN SPIRITS",
    "READY-TO-DRINK": "COCKTAIL|RTD",
    "CRAFT/LOCAL": "IOWA DISTILLER",
    "ADMINISTRATIVE/NON-PRODUCT": "DECANTERS|DELISTED|SPECIAL ORDER|HIGH PROOF BEER|HOLIDAY VAP|TEMPORARY",
}


def test_every_alternative_has_its_label(spark):
    texts = {text: label for label, line in ALTERNATIVES.items() for text in line.split("|")}
    assert len(texts) == sum(len(rule.words.split("|")) for rule in cat.LIQUOR_RULES)
    rows = [(t,) for t in texts] + [(f"x{t.lower()}x",) for t in texts]
    found = cat.categorize(spark.createDataFrame(rows, "category_name string")).collect()
    assert all(r.major_category == texts[r.category_name.strip("x").upper()] for r in found)
