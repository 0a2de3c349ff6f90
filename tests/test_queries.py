"""Every registered query against its SQL on the small tables, and plan rules."""

import re

import pytest

import oracle
from prefmill.plans import catalog


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, con, folder, name):
    assert oracle.compare(spark, con, catalog.QUERIES[name], catalog.ORACLES.get(name), folder) is None


PYTHON = re.compile("ArrowEvalPython|BatchEvalPython|FlatMapGroupsIn|FlatMapCoGroupsIn|MapInPandas|MapInArrow|PythonMapInArrow")
# Lengths-only packing, the common-subsequence counter, and dense algebra use Python inside tasks.
WITH_PYTHON = {"pack_knapsack", "rouge_l", "gram", "singular_values", "topk_singular", "nullspace_basis",
               "lowrank_product", "pack_totals"}
# Streaming jobs, written files and built bases return plain reads or run several jobs.
SKIP = {n for n in catalog.QUERIES if n.startswith(("stream_", "src_", "sink_"))}


# Windows without a partition may order one row per slot of a numbered table (``_slot``), or what these queries bound:
# one row per length step; at most 1024 block totals; one row per adapter.
FEW = {"length_cdf", "loss_bco", "accuracy_by_rank"}


def whole_table_windows(physical):
    """Windows whose rows all meet in one task."""
    lines = physical.splitlines()
    return [line for i, line in enumerate(lines) if "Window [" in line and "windowspecdefinition(_slot#" not in line and any("Exchange SinglePartition" in x for x in lines[i + 1:i + 3])]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SKIP))
def test_plan_rules(spark, folder, name):
    plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[-1]
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    assert bool(PYTHON.search(physical)) == (name in WITH_PYTHON)
    assert not whole_table_windows(physical) or name in FEW


@pytest.mark.parametrize("name, columns", [
    ("drop_overlong", "doc_id:bigint,n_chars:bigint"), ("shard_replica", "doc_id:bigint"),
    ("harmless_rate", "doc_id:bigint,toxic:int"), ("split_ratio", "doc_id:bigint"), ("weighted_avg", "event_id:bigint,user_id:bigint,event_type:string,value:double")])
def test_scans_read_only_what_is_used(spark, folder, name, columns):
    plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: struct<{columns}>" in plan


@pytest.mark.parametrize("name", ["mix_interleave_over", "mix_interleave_prob_under", "sample_num", "kl_shift", "pack_blocks", "ema_smooth",
                                  "running_moments", "mcq_prompt", "media_resolve", "vocab_build", "stack_pairs", "loss_bco"])
def test_partition_count_does_not_matter(spark, folder, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for partitions in (1, 4, 17):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            df = catalog.QUERIES[name](spark, folder)
            results.append(oracle.rows_of(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2] and results[0][1]
