"""Readers and writers: each query writes a test table out and reads it back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tidemill.catalog.base import query, table
from tidemill.session import shared_dir
from tidemill.sources import DatasetRef, TableRegistry, json_records, load, write_table
from tidemill.plans.snapshots import SnapshotStore


def _fresh(spark, stem: str) -> str:
    return f"{shared_dir(spark)}/tidemill-{stem}-{uuid4().hex}"


@query("read_parquet", "SELECT * FROM supplier")
def read_parquet(spark, sf):
    return load(spark, f"{sf}/supplier.parquet")


@query(
    "read_csv",
    """SELECT p_partkey, concat('the "', p_brand, '", ', p_type, chr(10), 'end') AS note, CASE WHEN p_size > 1 THEN p_size::BIGINT END AS p_size,
  CASE WHEN p_brand <> 'Brand#11' THEN p_brand END AS p_brand, p_retailprice, p_size > 20 AS big FROM part""",
)
def read_csv(spark, sf):
    """Quotes, commas and line breaks inside fields; several texts for missing."""
    p = table(spark, sf, "part")
    out = p.select(
        "p_partkey",
        F.concat(F.lit('the "'), "p_brand", F.lit('", '), "p_type", F.lit("\nend")).alias("note"),
        F.when(F.col("p_size") > 1, F.col("p_size").cast("string")).otherwise("NA").alias("p_size"),
        F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).otherwise("null").alias("p_brand"),
        "p_retailprice",
        F.when(F.col("p_size") > 20, "True").otherwise("False").alias("big"),
    )
    path = _fresh(spark, "csv")
    write_table(out, path, "csv")
    return load(spark, DatasetRef(path, "csv"))


@query("read_json", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_json(spark, sf):
    """A record per line: found out from the head of a file, which is then split."""
    path = _fresh(spark, "json")
    table(spark, sf, "customer").write.json(path)
    return load(spark, DatasetRef(path, "json"))


@query("read_json_array", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def read_json_array(spark, sf):
    """All records in one array over several lines."""
    path = _fresh(spark, "json")
    rows = table(spark, sf, "supplier")
    records = rows.select(F.to_json(F.struct(*rows.columns)).alias("r")).agg(F.collect_list("r").alias("all"))
    records.select(F.concat(F.lit("[\n"), F.concat_ws(",\n", "all"), F.lit("\n]")).alias("value")).write.text(path)
    return load(spark, DatasetRef(path, "json"))


@query("read_csv_lines", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def read_csv_lines(spark, sf):
    """No field has a line break, so the file is split at line ends."""
    path = _fresh(spark, "csv")
    write_table(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path, "csv")
    return load(spark, DatasetRef(path, "csv"))


@query("read_xml", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def read_xml(spark, sf):
    path = _fresh(spark, "xml")
    table(spark, sf, "supplier").write.format("xml").option("rowTag", "row").save(path)
    return load(spark, DatasetRef(path, "xml"))


@query("read_default_split", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def read_default_split(spark, sf):
    """Without a name: ``train``, else the first one by name."""
    path = _fresh(spark, "split")
    o = table(spark, sf, "orders")
    o.withColumn("split", F.col("o_orderstatus")).write.partitionBy("split").parquet(path)
    return load(spark, DatasetRef(path, "parquet"))


@query("read_split", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def read_split(spark, sf):
    path = _fresh(spark, "split")
    o = table(spark, sf, "orders")
    o.withColumn("split", F.col("o_orderstatus")).write.partitionBy("split").parquet(path)
    return load(spark, DatasetRef(path, "parquet", split="F"))


@query("registry_ingest", "SELECT * FROM nation")
def registry_ingest(spark, sf):
    registry = TableRegistry(spark, _fresh(spark, "tables"))
    registry.ingest(f"{sf}/nation.parquet", "the nations")
    return registry.load("the_nations")


@query(
    "json_records",
    """SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey, 'gone': NULL}) AS VARCHAR) AS record
FROM nation ORDER BY n_nationkey LIMIT 20""",
)
def records(spark, sf):
    n = table(spark, sf, "nation").withColumn("gone", F.lit(None).cast("string"))
    return json_records(n, 20, ["n_nationkey"])


@query("snapshot_restore", "SELECT * FROM customer")
def snapshot_restore(spark, sf):
    """A snapshot is taken, written out as a table of its own, and read."""
    store = SnapshotStore(spark, _fresh(spark, "snapshots"))
    entry = store.create(table(spark, sf, "customer"), "customer")
    target = _fresh(spark, "restored")
    store.restore(entry["id"], target)
    return load(spark, target)
