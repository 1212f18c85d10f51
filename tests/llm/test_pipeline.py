import corpus_pipeline
from tilespark.llm import store
from tests.llm.conftest import rows


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = store.table(stage(spark, docs, sf), name)
        seen[name] = (before.count(), docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert seen["quality_rules"][1] < seen["quality_rules"][0]
    assert seen["near_duplicates"][1] <= seen["near_duplicates"][0]
    assert seen["repeated_phrases"][0] == seen["repeated_phrases"][1]
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)


def test_components(spark):
    from tilespark.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in rows(components(spark.createDataFrame(chain, "u long, v long")))}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100}


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_sql(spark):
    import oracle

    from tilespark.llm import catalogue

    con = oracle.connection("/root/testdata/sf0.001")
    for name, sql in catalogue.oracle_sql().items():
        assert not oracle.difference(catalogue.queries()[name](spark, "/root/testdata/sf0.001"), sql, con)
