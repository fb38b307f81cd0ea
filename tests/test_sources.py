import json

import pytest
from conftest import values

from tidemill.sources import DatasetRef, TableRegistry, json_records, load, write_table
from tidemill.sources.readers import concat_chunks


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    text = 'x,y,s,f,e\n1,NA,"a, ""b""\nc",True,\n2,0.5,none,False,\n3,nan,null,True,\n'
    df = load(spark, _write(tmp_path / "t.csv", text))
    assert dict(df.dtypes) == {"x": "bigint", "y": "double", "s": "string", "f": "boolean", "e": "double"}
    assert values(df, "x", "y", "s") == [(1, None, 'a, "b"\nc'), (2, 0.5, "none"), (3, None, None)]
    assert values(df, "f", "e") == [(False, None), (True, None), (True, None)]
    fixed = load(spark, DatasetRef(str(tmp_path / "t.csv"), options={"schema": "x double, y double, s string"}))
    assert dict(fixed.dtypes)["x"] == "double"
    other = load(spark, DatasetRef(_write(tmp_path / "u.csv", "a;b\n1;2\n"), options={"sep": ";"}))
    assert values(other) == [(1, 2)]


def test_number_like_text_stays_text(spark, tmp_path):
    df = load(spark, _write(tmp_path / "t.csv", "a,b\n1d,99999999999999999999\n2,1\n"))
    assert dict(df.dtypes) == {"a": "string", "b": "double"}


def test_json(spark, tmp_path):
    records = [{"x": 1, "y": 2.5}, {"x": 2, "y": None}]
    df = load(spark, _write(tmp_path / "t.json", json.dumps(records)))
    assert values(df, "x", "y") == [(1, 2.5), (2, None)]
    lines = "\n".join(map(json.dumps, records))
    ref = DatasetRef(_write(tmp_path / "l.json", lines), options={"multiLine": False})
    assert load(spark, ref).count() == 2


def test_xml(spark, tmp_path):
    text = "<data><row><x>1</x><s>a</s></row><row><x>2</x><s>b</s></row></data>"
    assert values(load(spark, _write(tmp_path / "t.xml", text)), "x", "s") == [(1, "a"), (2, "b")]


def test_nan_becomes_missing(frame, spark, tmp_path):
    frame("v double, s string", [(float("nan"), "a"), (1.0, None)]).write.parquet(f"{tmp_path}/p")
    assert load(spark, f"{tmp_path}/p").where("v is null").count() == 1
    assert load(spark, DatasetRef(f"{tmp_path}/p", nan_free=True)).where("v is null").count() == 0


def test_faults(spark, tmp_path):
    for name in ("gone.csv", "gone.parquet", "gone.json"):
        with pytest.raises(FileNotFoundError, match="Dataset not found"):
            load(spark, str(tmp_path / name))
    with pytest.raises(ValueError, match="Supported formats"):
        load(spark, str(tmp_path / "t.sav"))


def test_splits(frame, spark, tmp_path):
    df = frame("x int, split string", [(1, "train"), (2, "test"), (3, "test")])
    df.write.partitionBy("split").parquet(f"{tmp_path}/d")
    from tidemill.sources import load_split

    assert values(load_split(spark, f"{tmp_path}/d")) == [(1,)]
    test = load(spark, DatasetRef(f"{tmp_path}/d", split="test"))
    assert values(test) == [(2,), (3,)]
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="Available: test, train"):
        load_split(spark, f"{tmp_path}/d", "nope")
    df.where("split = 'test'").write.partitionBy("split").parquet(f"{tmp_path}/only")
    assert load_split(spark, f"{tmp_path}/only").count() == 2
    with pytest.raises(FileNotFoundError):
        load_split(spark, f"{tmp_path}/none")


def test_registry(spark, tmp_path):
    registry = TableRegistry(spark, f"{tmp_path}/tables")
    source = _write(tmp_path / "my file.csv", "a,b\n1,x\n2,NA\n")
    info = registry.ingest(source)
    assert (info["name"], info["rows"], info["columns"]) == ("my_file", 2, ["a", "b"])
    assert registry.load("my_file").count() == 2
    assert spark.sql("select count(*) from my_file").first()[0] == 2
    assert registry.resolve(source).path == source
    with pytest.raises(ValueError, match="Available"):
        registry.resolve("nope")
    with pytest.raises(ValueError, match="Unsupported"):
        registry.ingest(str(tmp_path / "x.xyz"))


def test_sinks(gaps, spark, tmp_path):
    write_table(gaps, f"{tmp_path}/c", "csv")
    assert values(load(spark, DatasetRef(f"{tmp_path}/c", "csv"))) == values(gaps)
    with pytest.raises(ValueError, match="output format"):
        write_table(gaps, f"{tmp_path}/x", "xls")
    first = json.loads(json_records(gaps, 1, ["a"]).first()["record"])
    assert first == {"a": None, "b": 2.0, "c": "y"} or first == {"a": None, "b": 4.0, "c": "z"}


def test_chunks(frame):
    out = concat_chunks([frame("a int, b int", [(1, 2)]), frame("b int, a int", [(3, 4)])])
    assert values(out) == [(1, 2), (4, 3)]
    with pytest.raises(ValueError):
        concat_chunks([])


@pytest.mark.parametrize(
    "name, kind, source", [("read_json", "json", "customer"), ("read_xml", "xml", "supplier")]
)
def test_whole_tables_are_written_and_read(spark, tmp_path, monkeypatch, name, kind, source):
    from tidemill.catalog import REGISTERED, sources

    monkeypatch.setattr(sources, "_fresh", lambda spark, stem: str(tmp_path / stem))
    out = REGISTERED[name].run(spark, "/root/testdata/sf0.001")
    whole = spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet")
    options = {"multiLine": False} if kind == "json" else {}
    written = load(spark, DatasetRef(str(tmp_path / kind), kind, options=options))
    assert set(written.columns) == set(whole.columns) and out.count() == whole.count()
    key = f"{source[0]}_nationkey"
    assert written.agg({key: "sum"}).first()[0] == whole.agg({key: "sum"}).first()[0]
