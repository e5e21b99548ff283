"""The relational store over Derby, which comes with Spark."""

import pytest
from pyspark.sql import functions as F

from vecshift.sources.jdbc import JdbcStore, pgvector

URL, DRIVER = "jdbc:derby:memory:vecshift;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def store(spark):
    # keys far apart, so that ranges between the least and the largest key would be uneven
    rows = [(i if i < 90 else 10**12 + i, float(i % 50), f"it's text {i}") for i in range(100)] + [(7000, None, None)]
    spark.createDataFrame(rows, "k long, x double, t string").write.mode("overwrite").jdbc(URL, "items", properties={"driver": DRIVER})
    return JdbcStore(spark, URL, "items", '"k"', '"x"', '"t"', "l2", distance=lambda c, q: f"ABS({c} - {q[0]!r})", driver=DRIVER)


def test_pages_are_even(store):
    assert store.size() == 101
    ends = store.pages(25)
    assert len(ends) == 5 and ends[0] == 24 and ends[-1] == 10**12 + 99
    x = store.rows(page=25)
    assert x.rdd.getNumPartitions() == 5 and x.columns == ["doc_id", "x", "t"] and x.count() == 101
    sizes = [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(sizes) == [1, 25, 25, 25, 25]
    assert store.ids(40).columns == ["doc_id"] and store.repeated().count() == 0


def test_search_is_pushed_down(store):
    found = store.search([("a", [3.2]), ("b", [49.0])], 4)
    got = {q: [(r.doc_id, round(r.score, 6)) for r in sorted(found.where(F.col("query_id") == q).collect(), key=lambda r: r["rank"])] for q in ("a", "b")}
    assert got == {"a": [(3, -0.2), (53, -0.2), (4, -0.8), (54, -0.8)], "b": [(49, 0.0), (10**12 + 99, 0.0), (48, -1.0), (10**12 + 98, -1.0)]}
    plan = found._jdf.queryExecution().toString()
    assert "FETCH FIRST 4 ROWS ONLY" in plan and "ORDER BY distance" in plan
    for bad in (0, True, "3"):
        with pytest.raises(ValueError):
            store.search([("a", [1.0])], bad)
    with pytest.raises(ValueError):
        store.search([("a", [float("nan")])], 3)
    with pytest.raises(ValueError):
        store.search([], 3)


def test_fetch_by_blocks(spark, store):
    ids = spark.createDataFrame([(i,) for i in [*range(30), 10**12 + 95, 5, 7000, 8888]], "doc_id long")
    x = store.fetch(ids, at_once=10)
    assert x.rdd.getNumPartitions() == 4
    got = {r.doc_id: r.t for r in x.collect()}
    assert len(got) == 32 and got[10**12 + 95] == "it's text 95" and got[7000] is None
    assert store.fetch(ids.limit(0)).count() == 0


def test_text_keys_repeats_and_empty_tables(spark):
    rows = [("a'b",), ("c",), ("c",), ("d",)]
    spark.createDataFrame(rows, "k string").withColumn("x", F.lit(1.0)).write.mode("overwrite").jdbc(URL, "named", properties={"driver": DRIVER, "createTableColumnTypes": "k VARCHAR(20)"})
    s = JdbcStore(spark, URL, "named", '"k"', '"x"', distance=lambda c, q: f"ABS({c} - {q[0]!r})", driver=DRIVER)
    assert s.pages(1) == ["a'b", "c", "d"] and s.rows(page=1).count() == 4
    assert [r.doc_id for r in s.repeated(2).collect()] == ["c"]
    with pytest.raises(Exception, match="comes twice"):
        s.search([("q", [1.0])], 4).collect()
    spark.createDataFrame([], "k long, x double").write.mode("overwrite").jdbc(URL, "nothing", properties={"driver": DRIVER})
    none = JdbcStore(spark, URL, "nothing", '"k"', '"x"', driver=DRIVER)
    assert none.size() == 0 and none.pages(5) == [] and none.rows().count() == 0


def test_names_and_distances(spark):
    with pytest.raises(ValueError):
        JdbcStore(spark, URL, "items; DROP TABLE items", "K")
    assert pgvector("cosine")("v", [1.0, -2.5]) == "v <=> '[1.0,-2.5]'::vector"
