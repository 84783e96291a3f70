"""The pipeline stage by stage on the smallest tables, and the registered queries that have SQL."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from compare import differences, duck
from test_operators import component_ids

import __spark_entry__ as entry
import corpus_pipeline
from lingospan.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gave, stored and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_are_the_five_in_order(stages):
    assert list(stages) == ["documents", "quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    columns = stages["documents"].columns
    assert all(stages[n].columns == columns for n in list(stages)[1:-1])
    assert stages["sharding"].columns == [*columns, "shard", "slot"]


def test_quality_drops_toxic_documents(spark, stages):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = texts(stages["quality"])
    right = [(d in kept) == (r.quality == 1 and r.toxic == 0) for d, r in labels.items()]
    assert sum(right) >= 0.9 * len(right) and set(kept) <= set(texts(stages["documents"]))


def test_one_of_each_group_stays(stages):
    before = texts(stages["quality"])
    parts = component_ids(before.items(), 5)
    assert set(texts(stages["near_duplicates"])) == {d for d, (_, least) in parts.items() if d == least}


def test_benchmark_items_go(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages["near_duplicates"]), texts(stages["decontamination"])
    assert not [d for d, t in after.items() if any(i in t for i in items)]
    assert len(after) >= len(before) - sum(any(i[:60] in t for i in items) for t in before.values())


def test_the_mix_repeats_whole_documents(stages):
    before, after = texts(stages["decontamination"]), texts(stages["mixing"])
    times = Counter(r.doc_id for r in stages["mixing"].select("doc_id").collect())
    assert max(times.values()) <= 3 and all(before[d] == t for d, t in after.items())


def test_shards_hold_every_row_once(stages):
    slots = defaultdict(list)
    for r in stages["sharding"].select("doc_id", "shard", "slot").collect():
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert sum(sizes) == stages["mixing"].count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and set(QUERIES) <= set(names) and set(ORACLES) <= set(entry.oracle_sql())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) == []


def test_no_cross_joins(spark):
    for name in ("op2_forest_components", "op8_simhash_decontamination", "op9_golden_mix", "op4_hypergeometric_shards"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
