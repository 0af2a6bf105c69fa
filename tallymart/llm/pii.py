"""Personal data: fixed patterns, and terms that corpus co-occurrence shows to reveal an entity.

All steps are DataFrame operations. Patterns find emails, IP addresses, card and phone numbers. Each
distinct value is a protected entity ``e``. A term ``t`` close to it reveals it to the degree

    PMI(t, e) / IC(e),   PMI = log2(N * df(t, e) / (df(t) * df(e))),   IC = log2(N / df(e))

with document counts over the whole corpus: ``df(t, e)`` documents have the term near the entity. The
degree is 1 for a term that occurs nowhere else, also for an entity of a single document. Terms at or
over ``DISCLOSURE`` are spans of kind ``term`` wherever they occur in any text, unless chance explains that they meet: the probability of
``df(t, e)`` or more common documents, given the counts, must be at most ``CHANCE``. In sanitised text,
entities are generalised to their kind and terms are removed.

Java's ``find`` and ``split`` walk over the same matches, so the lengths of the pieces between the
matches give their places in code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.session import materialize

# The patterns of the contract, kinds in the order in which ties are written. Repeated
# groups are possessive, since nothing follows them: Java then needs no stack for long matches. The
# look-behind of the email keeps the search from starting again inside a run that failed before.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts in which the search for a kind can be left out at once.
POSSIBLE = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9]",
}

WINDOW_CHARS = 80
TERM = r"[\p{L}\p{N}]{3,}"
CHANCE = 0.01
DISCLOSURE = 0.9
BROADCAST_BYTES = 4 << 20
MATCH_BLOCK = 64
CHUNK_CHARS = 1_000

_NO_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, pattern: str) -> Column:
    """Structs (start, end, value) of the leftmost non-overlapping matches, places in code points.

    Matches are placed block by block: each block is walked from where the one before ended, so no long
    array is copied for every match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.zip_with(pieces, found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    no_spans = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>")
    moved = lambda x: x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0))

    def placed(block: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("start"), (acc["at"] + moved(x)).alias("end"), x["value"].alias("value"))
            spans = F.when(x["value"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span)))
            return F.struct((acc["at"] + moved(x)).alias("at"), spans.alias("spans"))

        return F.aggregate(block, F.struct(at.alias("at"), no_spans.alias("spans")), step, lambda acc: acc["spans"])

    def in_blocks(steps: Column) -> Column:
        last = F.floor((F.size(steps) - 1) / MATCH_BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(steps, i * MATCH_BLOCK + 1, F.lit(MATCH_BLOCK)))

    def from_blocks(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + moved(x)))
        before = F.aggregate(sizes, F.array(F.lit(0)), lambda a, size: F.concat(a, F.array(F.element_at(a, -1) + size)))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), placed))

    return _once(_once(steps, in_blocks), from_blocks)


def _luhn(digits: Column) -> Column:
    single = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    values = F.transform(
        single, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.substring(F.lit("0246813579"), x.cast("int") + 1, F.lit(1)).cast("int"))
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.length(p) <= 3
        return F.forall(
            F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "")),
            lambda p: small(p) & (F.lpad(p, 3, "0") <= "255"),
        )
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _spans_of_kind(text: Column, rank: int, kind: str) -> Column:
    found = F.transform(
        F.filter(_matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"])),
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")
        ),
    )
    return F.when(text.rlike(POSSIBLE[kind]), found).otherwise(F.array().cast(_NO_SPANS))


def base_spans(text: Column) -> Column:
    """Array of structs (start, rank, end, kind, value) of all kinds, sorted by start, then kind."""
    each = [_spans_of_kind(text, rank, kind) for rank, kind in enumerate(KINDS)]
    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(*each))).otherwise(F.array().cast(_NO_SPANS))


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda x: F.lower(x))


def _chunks(text: Column) -> Column:
    """The text cut into pieces of CHUNK_CHARS code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK_CHARS}}}"), F.lit(0))


def _part(start: Column, length: Column) -> Column:
    """``length`` code points (at most CHUNK_CHARS) of the column ``chunks`` from ``start`` on."""
    chunk = F.floor(start / CHUNK_CHARS).cast("int")
    both = F.concat(F.coalesce(F.get("chunks", chunk), F.lit("")), F.coalesce(F.get("chunks", chunk + 1), F.lit("")))
    return F.substring(both, start - chunk * CHUNK_CHARS + 1, length)


def _near(rows: DataFrame) -> DataFrame:
    """One row per entity occurrence and term next to it: row_id, doc_id, text_key, entity, term, start, end.

    Terms cut by the border of the window, and terms that overlap another entity, are left out. Windows are
    cut out of the text before it is exploded, and overlaps come from a running maximum over the sorted
    places of a text, so the work follows the text's length however many entities it has.
    """

    def sides(s: Column) -> Column:
        low = F.greatest(s["start"] - WINDOW_CHARS, F.lit(0))
        return F.struct(
            F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"),
            F.array(
                F.struct(low.alias("at"), _part(low, s["start"] - low).alias("part"), (low > 0).alias("cut_left"), F.lit(False).alias("cut_right")),
                F.struct(
                    s["end"].alias("at"),
                    _part(s["end"], F.lit(WINDOW_CHARS)).alias("part"),
                    F.lit(False).alias("cut_left"),
                    (F.col("n_chars") > s["end"] + WINDOW_CHARS).alias("cut_right"),
                ),
            ).alias("sides"),
        )

    keys = ["row_id", "doc_id", "text_key"]
    entity = rows.select(*keys, F.explode(F.transform("spans", sides)).alias("e"))
    side = entity.select(*keys, F.col("e.entity").alias("entity"), F.explode("e.sides").alias("side"))
    found = side.select(*keys, "entity", "side", F.explode(_matches(F.col("side.part"), TERM)).alias("t"))
    whole = ~(F.col("side.cut_left") & (F.col("t.start") == 0)) & ~(F.col("side.cut_right") & (F.col("t.end") == F.length("side.part")))
    term = found.where(whole).select(
        *keys, "entity", F.lower("t.value").alias("term"),
        (F.col("side.at") + F.col("t.start")).alias("start"), (F.col("side.at") + F.col("t.end")).alias("end"),
    )
    # An entity overlaps if it starts before the term's end and ends after its start.
    nothing = F.lit(None)
    spans = rows.select("row_id", F.explode("spans").alias("s")).select(
        "row_id", nothing.cast("long").alias("doc_id"), nothing.cast("long").alias("text_key"), nothing.cast("string").alias("entity"),
        nothing.cast("string").alias("term"), F.col("s.start").alias("start"), F.col("s.end").alias("end"),
        (2 * F.col("s.start")).alias("place"), F.col("s.end").alias("reach"),
    )
    placed = term.withColumns({"place": 2 * F.col("end") - 1, "reach": nothing.cast("int")}).unionByName(spans)
    up_to = Window.partitionBy("row_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = placed.withColumn("reach", F.max("reach").over(up_to)).where("term is not null")
    return reached.where(F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))).drop("place", "reach")


def _surprise(n: Column, df_t: Column, df_e: Column, df_te: Column) -> Column:
    """A lower bound of -ln P(df_te or more of df_t documents are among the df_e of n), by Hoeffding.

    Exact where df_t = df_te = 1: a word of one document meets an entity of one with probability 1 / n.
    """
    share, expected = df_te / df_t, df_e / n
    missed = F.when(df_te < df_t, (1 - share) * F.ln((1 - share) / (1 - expected))).otherwise(F.lit(0.0))
    return df_t * (share * F.ln(share / expected) + missed)


def disclosing_terms(near: DataFrame, texts: DataFrame, entities: DataFrame, chance: float, disclosure: float) -> DataFrame:
    """(entity, term) whose degree of disclosure reaches the threshold, and is not explained by chance.

    Term counts go over every word of every text, partially in the map tasks.
    """
    pairs = materialize(near.groupBy("entity", "term").agg(F.countDistinct("row_id").alias("df_te")), "term_pairs")
    words = texts.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("df_t"))
    total = texts.agg(F.count("*").alias("n"))
    surprise = _surprise(F.col("n"), F.col("df_t"), F.col("df_e"), F.least("df_te", "df_t"))
    degree = F.log2(F.col("n") * F.col("df_te") / (F.col("df_t") * F.col("df_e"))) / F.log2(F.col("n") / F.col("df_e"))
    return (
        pairs.join(counts, "term").join(entities, "entity").join(F.broadcast(total))  # one row
        .where((F.col("n") > F.col("df_e")) & (degree >= disclosure) & (surprise >= -math.log(chance)))
        .select("entity", "term")
    )


def _term_spans(keyed: DataFrame, rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """added_id, added_key and added: the places of flagged terms in every text, outside base spans.

    Texts with a flagged term are found by their distinct words; only these are cut into places. Up to
    BROADCAST_BYTES of terms are broadcast, beyond that words and terms are joined. Terms inside a base span
    are told by a running maximum over the text's places in order.
    """
    flagged = materialize(flagged.select("term").distinct(), "flagged")
    size = flagged.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    wanted = F.broadcast(flagged) if size <= BROADCAST_BYTES else flagged
    words = keyed.select("doc_id", "text_key", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    has = words.join(wanted, "term", "left_semi").select(F.col("doc_id").alias("added_id"), F.col("text_key").alias("added_key"))
    has = materialize(has.distinct(), "texts-with-terms")
    same = F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("text_key") == F.col("added_key"))
    texts = keyed.join(has, same).select("added_id", "added_key", F.explode(_matches(F.col("text"), TERM)).alias("t"))
    places = texts.select("added_id", "added_key", "t.start", "t.end", F.lower("t.value").alias("term"))
    found = places.join(wanted, "term", "left_semi").distinct()
    spans = rows.select(F.col("doc_id").alias("added_id"), F.col("text_key").alias("added_key"), F.explode("spans").alias("s"))
    spans = spans.select("added_id", "added_key", "s.start", "s.end", F.lit(None).cast("string").alias("term"), F.col("s.end").alias("reach"))
    both = found.withColumn("reach", F.lit(None).cast("int")).unionByName(spans)
    up_to = Window.partitionBy("added_id", "added_key").orderBy("start", F.col("term").asc_nulls_first())
    up_to = up_to.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outside = both.withColumn("reach", F.max("reach").over(up_to)).where("term is not null")
    outside = outside.where(F.coalesce(F.col("reach") < F.col("end"), F.lit(True)))
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit("term").alias("kind"), F.col("term").alias("value"))
    return outside.groupBy("added_id", "added_key").agg(F.collect_list(span).alias("added"))


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chance: float = CHANCE, disclosure: float = DISCLOSURE
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and span_list of every row.

    ``spans`` is ``kind:start:end`` in code points, by start and then kind, comma-joined; terms come
    last among kinds, and one inside an entity is part of it. ``span_list`` holds the same as structs.
    NULL counts as empty: no spans, empty string. Rows that agree in id and text get the same spans; ids
    may be NULL. Other columns are not read.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    marked = keyed.withColumn("spans", base_spans(F.col("text")))
    marked = marked.withColumns({"row_id": F.monotonically_increasing_id(), "n_chars": F.length("text")})
    rows = materialize(marked.withColumn("chunks", F.when(F.size("spans") > 0, _chunks(F.col("text")))).drop("text"), "entities")

    near = materialize(_near(rows.where("size(spans) > 0")), "near")
    names = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    held = rows.where("size(spans) > 0").select(F.explode(names).alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("df_e"))
    flagged = disclosing_terms(near, texts, entities, chance, disclosure)
    added = _term_spans(keyed, rows.where("size(spans) > 0"), flagged)
    same = F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("text_key") == F.col("added_key"))
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), lambda x: x == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    out = rows.drop("chunks").join(added, same, "left")
    out = out.withColumn("every", F.array_sort(F.concat("spans", F.coalesce("added", F.array().cast(_NO_SPANS)))))
    return out.select(
        "doc_id", *counts, F.sha2(written(F.col("spans")), 256).alias("base_sha256"), written(F.col("every")).alias("spans"), F.col("every").alias("span_list")
    )


def sanitised(text: Column, span_list: Column) -> Column:
    """The text with every span replaced: entities by ``[KIND]``, terms by nothing.

    Of spans that overlap, the later ones are cut at the end of the earlier.
    """
    done = F.aggregate(
        span_list,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["end"] <= acc["at"], acc["out"])
            .otherwise(
                F.concat(
                    acc["out"],
                    F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                    F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))),
                )
            )
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(span_list) > 0, done).otherwise(text)
