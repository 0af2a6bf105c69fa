"""The pipeline against plain versions of its stages."""

import base64
import importlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_near_dedup import groups
from test_secrets import base, plain_entropy_spans

from tallymart.llm import decontaminate, quality_model
from tallymart.llm import textbatch as tb
from tallymart.llm.common import is_held_out

pipeline = pytest.importorskip("corpus_pipeline")


def redacted(text):
    """The text with a mark for every run of overlapping secrets, by the plain definition of secrets."""
    places = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in [*base(text), *plain_entropy_spans(text)]))
    out, at = "", 0
    for k, (a, b) in enumerate(places):
        if k == 0 or a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


@pytest.fixture(scope="module")
def plain(spark, small):
    """doc_id -> text after each stage. The classifier's scores and the index are the operators' own (their
    tests hold them against plain versions); near-duplicates and secrets are done anew by definition.
    """
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    weights = quality_model.fit(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), labels, ~is_held_out(F.col("doc_id")))
    scores = {d: quality_model._scores(tb.from_arrow(pa.array([t])), weights)[0] for d, t in docs.items()}
    steps = [{d: t for d, t in docs.items() if scores[d] >= 0.7}]
    component = groups(list(steps[-1].items()), 5, 80)
    steps.append({d: t for d, t in steps[-1].items() if component[d][1] == d})
    index = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    steps.append({d: t for d, t in steps[-1].items() if not index.matches(tb.from_arrow(pa.array([t])))})
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not any(item in flat(t) for t in steps[-1].values() for item in items)
    assert any(item in flat(t) for t in steps[-2].values() for item in items)
    steps.append({d: redacted(t) for d, t in steps[-1].items()})
    return steps


def test_stages(spark, small, plain, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in docs.collect()} == plain[k]
            assert docs.where("n_chars <> length(text)").count() == 0
    rows = docs.collect()
    assert {r.doc_id: r.text for r in rows} == plain[3]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.decodes and r.token_ids == library.encode_ordinary(r.text or "") for r in rows)
    assert {len(plain[k]) for k in range(3)} != {len(plain[0])}


def test_run_gives_the_same(spark, small, plain):
    assert {r.doc_id: r.text for r in pipeline.run(spark, small).select("doc_id", "text").collect()} == plain[3]


def test_stage_names_and_registration():
    assert [name for name, _ in pipeline.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "secret_scan", "byte_bpe"]
    entry = importlib.import_module("__spark_entry__")
    numbers = {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert numbers == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()


def test_odd_rows_pass_every_stage(spark, odd, small):
    docs = odd
    for _, stage in pipeline.STAGES[1:]:
        docs = stage(spark, docs, small)
    assert docs.where("doc_id is null").count() == 2
    assert np.all([r.decodes for r in docs.collect()])


def test_columns_of_the_stages_own_names(spark, odd, small):
    """Columns named as the last stage's are replaced, and a table without n_chars passes."""
    docs = odd.withColumns({"token_ids": F.lit("x"), "decodes": F.lit(1)}).drop("n_chars")
    for _, stage in pipeline.STAGES[3:]:
        docs = stage(spark, docs, small)
    assert sorted(docs.columns) == sorted([*odd.drop("n_chars").columns, "token_ids", "decodes"])
    assert all(r.decodes is True for r in docs.collect())
