"""Strata, versions and files where the small way would not do."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from conftest import values
from tidemill.functions import ranking
from tidemill.operators import splits, strata
from tidemill.plans.snapshots import SnapshotStore
from tidemill.sources import DatasetRef, load
from tidemill.sources import readers


@pytest.fixture
def groups(spark):
    """Classes of 2 to 40 rows, one of 900, one missing; a column of a name used inside."""
    rows, k = [], 0
    for g, n in [(f"g{i}", 2 + (i * 7) % 39) for i in range(60)] + [("hot", 900), (None, 11)]:
        for _ in range(n):
            rows.append((k, g, "x"))
            k += 1
    return spark.createDataFrame(rows, "id bigint, g string, _n string").repartition(5)


@pytest.mark.parametrize("large", [strata.LARGE, 100])
@pytest.mark.parametrize("shares", [(0.3, None), (0.25, 0.2)])
def test_a_table_of_quotas_splits_like_the_driver(groups, monkeypatch, large, shares):
    want = values(splits.split(groups, "g", *shares, stratify=True, key=["id"]), "id", "split")
    monkeypatch.setattr(strata, "LARGE", large)
    real = ranking.HashOrder.totals
    monkeypatch.setattr(ranking, "GROUPS", 10)
    monkeypatch.setattr(ranking, "CELLS", 10)
    if large == 100:  # the hot class is cut at places, which needs its own small totals
        monkeypatch.setattr(ranking.HashOrder, "totals", lambda self, group=None: _many(self, group, real))
    got = splits.split(groups, "g", *shares, stratify=True, key=["id"])
    assert got.columns == [*groups.columns, "split"]
    assert values(got, "id", "split") == want


def _many(order, group, real):
    raise ranking.TooManyGroups("many")


@pytest.mark.parametrize("folds", [2, 3, 7])
def test_a_table_of_folds_is_the_drivers(groups, monkeypatch, folds):
    want = values(splits.assign_folds(groups, "g", folds, True, key=["id"]), "id", "fold")
    monkeypatch.setattr(ranking, "GROUPS", 10)
    monkeypatch.setattr(ranking, "CELLS", 10)
    assert values(splits.assign_folds(groups, "g", folds, True, key=["id"]), "id", "fold") == want


def test_faults_of_many_strata(groups, spark, monkeypatch):
    monkeypatch.setattr(ranking, "GROUPS", 10)
    monkeypatch.setattr(ranking, "CELLS", 10)
    one = groups.unionByName(spark.createDataFrame([(10**6, "alone", "x")], groups.schema))
    with pytest.raises(ValueError, match="alone"):
        splits.split(one, "g", 0.3, stratify=True, key=["id"])
    with pytest.raises(ValueError, match="per class"):
        splits.split(groups, "g", 0.01, stratify=True, key=["id"])
    with pytest.raises(ValueError, match="cv=1000"):
        splits.assign_folds(groups, "g", 1000, True, key=["id"])


def test_rows_without_a_key(groups, monkeypatch):
    slim = groups.select("g")
    monkeypatch.setattr(ranking, "GROUPS", 10)
    monkeypatch.setattr(ranking, "CELLS", 10)
    got = splits.split(slim, "g", 0.3, stratify=True)
    assert got.count() == slim.count() and got.where("split = 'test'").count() == -(-slim.count() * 3 // 10)


def test_two_writers_get_two_numbers(spark, sample, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.create(sample, "people")
    found, gate = [], threading.Barrier(2)

    real = SnapshotStore._claims

    def claims(self, name):  # both have looked before either has written
        out = real(self, name)
        if threading.current_thread() is not threading.main_thread() and not hasattr(gate, threading.current_thread().name):
            setattr(gate, threading.current_thread().name, True)
            out = spark.createDataFrame(out.collect(), "version int, id string")
            gate.wait(60)
        return out

    monkeypatch.setattr(SnapshotStore, "_claims", claims)
    writers = [threading.Thread(target=lambda: found.append(store.create(sample, "people")["version"])) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(found) == 2 and len(set(found)) == 2 and min(found) > 1
    assert sorted(r["version"] for r in store.list("people").collect()) == sorted([1, *found])


def test_the_index_is_put_together(spark, sample, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    ids = [store.create(sample, "people")["id"] for _ in range(3)]
    store.delete(ids[0])
    before = values(store.list(), "id", "version")
    store.compact()
    assert len(store._events().inputFiles()) == 1 and values(store.list(), "id", "version") == before
    assert store.create(sample, "people")["version"] == 4


def test_differences_as_rows(spark, frame, tmp_path):
    a = frame("k int, v double, t int, gone int", [(1, 1.0, 1, 1), (2, None, 2, 1)])
    b = frame("k int, v double, t bigint, new int", [(1, 1.5, 1, 1), (2, None, 2, 1)])
    store = SnapshotStore(spark, str(tmp_path / "s"))
    one, two = (store.create(x, "t")["id"] for x in (a, b))
    got = {(r["kind"], r["column"]): (r["before"], r["after"]) for r in store.differences(one, two, ["k"]).collect()}
    assert got.pop(("hash", None))[0] != ""
    assert got == {
        ("removed", "gone"): ("int", None), ("added", "new"): (None, "int"), ("type", "t"): ("int", "bigint"),
        ("values", "v"): (None, "1"), ("values", "t"): (None, "2"),
    }
    assert store.differences(one, one, ["k"]).count() == 0


def test_json_is_split_where_lines_are_records(spark, tmp_path):
    rows = "\n".join(json.dumps({"x": i, "s": "y" * 50}) for i in range(4_000))
    (tmp_path / "l.json").write_text("\n" + rows)
    (tmp_path / "a.json").write_text("[\n" + rows.replace("\n", ",\n") + "\n]")
    (tmp_path / "o.json").write_text('{\n "x": 1,\n "s": "z"}')
    (tmp_path / "e.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        lines, array = load(spark, str(tmp_path / "l.json")), load(spark, str(tmp_path / "a.json"))
        assert lines.rdd.getNumPartitions() > 4 and array.rdd.getNumPartitions() == 1
        assert values(lines) == values(array.select(lines.columns))
        assert load(spark, str(tmp_path / "o.json")).count() == 1
        assert readers.json_lines(spark, str(tmp_path / "e.json"))
        table = "a,b\n" + "\n".join(f'{i},"x, {i}"' for i in range(9_000))
        (tmp_path / "p.csv").write_text(table)
        (tmp_path / "q.csv").write_text(table + '\n1,"two\nlines"\n')
        plain, odd = load(spark, str(tmp_path / "p.csv")), load(spark, str(tmp_path / "q.csv"))
        assert plain.rdd.getNumPartitions() > 2 and odd.rdd.getNumPartitions() == 1
        assert plain.count() == 9_000 and odd.where(F.col("b") == "two\nlines").count() == 1
        told = load(spark, DatasetRef(str(tmp_path / "p.csv"), options={"multiLine": True}))
        assert told.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_default_split_of_a_folder(frame, spark, tmp_path):
    df = frame("x int, split string", [(1, "train"), (2, "test")])
    df.write.partitionBy("split").parquet(f"{tmp_path}/d")
    assert values(load(spark, f"{tmp_path}/d")) == [(1,)]
    df.where("x = 2").write.partitionBy("split").parquet(f"{tmp_path}/one")
    assert values(load(spark, f"{tmp_path}/one")) == [(2,)]
    df.write.parquet(f"{tmp_path}/plain")  # a column of the rows is just a column
    assert load(spark, f"{tmp_path}/plain").count() == 2


def test_grids_without_a_refit(spark, sample):
    from tidemill.plans.experiment import check_spec

    spec = {"target": "bought", "model_name": "logistic_regression", "param_config": {"grid": {"C": [1.0]}, "refit": False}}
    with pytest.raises(ValueError, match="refit=False"):
        check_spec(spec)
