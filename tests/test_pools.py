"""Papers whose names are all in their pool."""

from pyspark.sql import functions as F

from onomast.plans import serve

NAMES = [(1, 0, "Zhang Wei"), (1, 1, "Wang Hao"), (1, 2, "Yan Li"), (2, 0, "Li Ming"), (2, 1, "北京大学"), (3, 0, "Xiaoming Chen"), (3, 1, None), (4, 0, "Li Bao")]


def test_papers_in_pools(spark):
    names = spark.createDataFrame(NAMES, "paper_id long, pos int, name string")
    # Paper 4 has no pool, paper 1 is twice in its one; names that are null have no place in a pool.
    pool_of = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (3, "y")], "paper_id long, pool_id string")
    pools = names.join(pool_of.distinct(), "paper_id").withColumn("pool_pos", F.col("paper_id") * 10 + F.col("pos"))
    got = serve.papers_in_pools(names, pool_of)
    rows = {(r["paper_id"], r["pos"]): r for r in got.collect()}
    assert len(rows) == got.count() == 7
    assert rows["2", 1]["router_prediction"] == "not_person" and rows["1", 0]["final_result"] == "Wei Zhang"
    some = "name IS NOT NULL"
    want = {(r["paper_id"], r["pos"]): r for r in serve.papers_and_pools(names.where(some), pools.where(some)).collect()}
    assert {k: r for k, r in rows.items() if k != ("3", 1)} == want
