from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill.operators.splits import assign_folds, quotas, split, split_sizes


def _table(spark, n=1003):
    # one class holds more than half of the rows, one is rare
    g = F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 3 == 0, "mid").otherwise("hot")
    return spark.range(n).withColumn("g", g)


def test_sizes():
    assert split_sizes(150, 0.2) == [120, 0, 30]
    # 0.1 + 0.2 is a little above 0.3, so 45 is rounded up
    assert split_sizes(150, 0.2, 0.1) == [104, 15, 31]
    assert split_sizes(1309, 0.2, 0.1) == [916, 131, 262]
    for bad in ((10, 0.0, None), (10, 1.0, None), (10, 0.5, 0.5), (10, 0.2, 1.5), (1, 0.2, None)):
        with pytest.raises(ValueError):
            split_sizes(*bad)


def test_quotas():
    assert quotas({"a": 5, "b": 3, "c": 2}, 5) == {"a": 3, "b": 1, "c": 1}
    assert sum(quotas({"a": 7, None: 3, "c": 1}, 4).values()) == 4


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_and_repeatable(spark, parts):
    df = _table(spark)
    one = {r["id"]: r["split"] for r in split(df, "g", 0.2, 0.1, key=["id"]).collect()}
    two = {r["id"]: r["split"] for r in split(df.repartition(parts), "g", 0.2, 0.1, key=["id"]).collect()}
    assert one == two
    assert Counter(one.values()) == {"train": 702, "validation": 100, "test": 201}
    other = {r["id"]: r["split"] for r in split(df, "g", 0.2, 0.1, 7, key=["id"]).collect()}
    assert other != one


def test_stratified(spark):
    df = _table(spark)
    out = split(df, "g", 0.2, 0.1, stratify=True, key=["id"])
    total = dict(df.groupBy("g").count().collect())
    for row in out.groupBy("g", "split").count().collect():
        share = {"train": 0.7, "validation": 0.1, "test": 0.2}[row["split"]]
        assert abs(row["count"] - share * total[row["g"]]) <= 2
    assert out.count() == 1003


def test_without_key_and_with_missing_class(spark):
    df = _table(spark, 300).select(F.when(F.col("g") != "rare", F.col("g")).alias("g"))
    out = split(df, "g", 0.25, stratify=True)
    counts = {(r["g"], r["split"]): r["count"] for r in out.groupBy("g", "split").count().collect()}
    assert sum(counts.values()) == 300
    assert counts[(None, "train")] + counts[(None, "test")] == 6
    assert sum(n for (_, s), n in counts.items() if s == "test") == 75


def test_split_faults(frame, spark):
    with pytest.raises(ValueError, match="at least 2"):
        split(frame("k int, y string", [(1, "a"), (2, "b"), (3, "b")]), "y", 0.4, stratify=True, key=["k"])
    with pytest.raises(ValueError, match="per class"):
        split(frame("k int, y int", [(i, i // 2) for i in range(10)]), "y", 0.2, stratify=True, key=["k"])
    with pytest.raises(KeyError):
        split(spark.range(10), "y")


def test_folds(spark):
    df = _table(spark)
    plain = assign_folds(df, "g", 4, False, key=["id"]).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in plain) == [250, 251, 251, 251]
    for row in assign_folds(df, "g", 4, True, key=["id"]).groupBy("g").pivot("fold").count().collect():
        sizes = [row[str(i)] for i in range(4)]
        assert max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError, match="cv"):
        assign_folds(df, "g", 1, False)


def test_no_shuffle_of_rows(spark, tmp_path):
    """A split is a projection of the scan: no exchange, no window."""
    _table(spark).write.parquet(f"{tmp_path}/t")
    out = split(spark.read.parquet(f"{tmp_path}/t"), "g", 0.2, key=["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    strat = split(spark.read.parquet(f"{tmp_path}/t"), "g", 0.2, stratify=True, key=["id"])
    plan = strat._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan and "hashpartitioning" not in plan
