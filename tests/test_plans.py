"""Plans are the ones meant: pruned and pushed scans, limits before shuffles, no single partition, no needless Python."""

import re

import pytest

from tilespark.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_limited_before_the_shuffle(spark):
    p = plan(catalogue.queries()["segmented_topk_large"](spark, SF))
    assert p.count("WindowGroupLimit") == 2 and "Partial" in p


@pytest.fixture
def all_plans(monkeypatch):
    """Plans of tables that a query writes on its way, and its own."""
    from tilespark.operators import relational

    made, write = [], relational.written
    monkeypatch.setattr(relational, "written", lambda df, label: made.append(plan(df)) or write(df, label))

    def run(query, spark):
        made.clear()
        made.append(plan(query(spark, SF)))
        return made

    return run


@pytest.mark.parametrize("name", ["exclusive_scan_global", "exclusive_scan_wide", "kind_stream_offsets", "contiguity_violations", "neighbour_delta_coding"])
def test_global_scans_have_no_single_partition_of_rows(spark, all_plans, name):
    written, result = all_plans(catalogue.queries()[name], spark)
    assert "rangepartitioning" in written and "SinglePartition" not in written
    # the only one is over one row a range
    assert result.count("Exchange SinglePartition") <= 1
    for line in re.findall(r"Exchange SinglePartition.*?\n.*?\n", result):
        assert "Aggregate" in line


def test_scans_are_pruned_and_filters_pushed(spark, all_plans):
    p = all_plans(catalogue.queries()["compact_flags"], spark)[0]
    assert "EqualTo(event_type,purchase)" in p and re.search(r"ReadSchema: struct<event_id:bigint,event_type:string>", p)
    p = plan(catalogue.queries()["distinct_counts"](spark, SF))
    assert "props" not in p


@pytest.mark.parametrize("name", ["leaderboard", "pareto_front", "mse_psnr", "gradient_field_encode", "sparse_atoms", "blend_layers", "srgb_roundtrip", "argmin_per_segment"])
def test_expressions_stay_in_the_engine(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(catalogue.queries()[name](spark, SF)))


@pytest.mark.parametrize("name", ["dct8_quantize", "half_plane_model_fit", "bicubic_fit_eval", "edge_iou"])
def test_kernels_need_no_shuffle(spark, name):
    assert "Exchange" not in plan(catalogue.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["residual_restored", "residual_mixed_sizes"])
def test_residual_tiles_go_to_python_as_vectors_not_samples(spark, name):
    before = plan(catalogue.queries()[name](spark, SF)).split("MapInArrow", 1)[1]
    assert "embedding" in before and "lambda" not in before
