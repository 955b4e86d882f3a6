"""The pipeline and the registered queries."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from test_op4_neardedup import classes  # noqa: E402
from test_op9_decontaminate import plain as hits_of  # noqa: E402
from test_op9_decontaminate import words  # noqa: E402

from flowloom.llm import op1_quality  # noqa: E402
from flowloom.llm.queries import ORACLES, QUERIES  # noqa: E402
from flowloom.plans.check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_beside_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9000, None, None, "x", 0), (9001, "12 34 " * 30, None, "x", 9), (9002, "!" * 40, "en", "x", 40)], docs.schema)
    docs = docs.union(extra)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "quality_rules", "near_dedup", "decontamination", "sentencepiece"]

    told = stage["language_id"](spark, docs, SF)
    assert told.columns == docs.columns
    rows = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id: r.text for r in told.collect()} == rows

    good = stage["quality_rules"](spark, told, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in op1_quality.quality_rules(told).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    rows = {k: rows[k] for k in sorted(kept)}

    one = stage["near_dedup"](spark, good, SF)
    assert one.columns == docs.columns
    first = sorted({list(rows)[i] for i in classes(list(rows.values()))})
    assert sorted(r.doc_id for r in one.collect()) == first
    rows = {k: rows[k] for k in first}

    clean = stage["decontamination"](spark, one, SF)
    assert clean.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    for doc, n, hit, _, _ in hits_of(list(rows.items()), bench):
        if not hit:
            assert left.pop(doc) == rows[doc]
        elif doc in left:
            text = left.pop(doc)
            assert 2 * hit < n and len(words(text)) == n - hit
        else:
            assert 2 * hit >= n
    assert not left

    ids = stage["sentencepiece"](spark, clean, SF)
    assert ids.filter("round_trip").count() == clean.count()
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, key):
    con = connect(SF)
    assert compare(spark, con, QUERIES[key], ORACLES[key], SF).startswith("ok (")
    con.close()


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_stages_that_keep_rows_send_a_text_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in ("language_id", "quality_rules"):
        plan = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)._jdf.queryExecution().optimizedPlan().toString()
        sent = plan[plan.index("MapInArrow") :].split("\n")[1]
        assert "_row" in sent and "_text" not in sent, sent
