"""Every core query that has SQL gives the rows of its SQL."""

import pytest

from caseloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, tiny, oracle, same, name):
    same(registry.QUERIES[name](spark, tiny), oracle, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, tiny, name):
    df = registry.QUERIES[name](spark, tiny)
    assert df.columns and df.count() >= 0


def test_region_tag_far_into_a_body(spark, tmp_path):
    tag = '"@odata.context": "http://x/2.0.xml/UK/$metadata"'
    rows = [(1, f'{{"note": "{"x" * 5000}", {tag}}}'), (2, f"{{{tag}}}"), (3, "{}"), (4, None)]
    spark.createDataFrame(rows, "raw_id long, body string").write.parquet(f"{tmp_path}/vic_raw.parquet")
    got = registry.QUERIES["s32_region_tag"](spark, str(tmp_path)).collect()
    assert sorted((r.raw_id, r.region) for r in got if r.region) == [(1, "UK"), (2, "UK")] and len(got) == 3
