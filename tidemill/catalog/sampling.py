"""Shuffles, samples, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.base import LINEITEM_KEY, query, table
from tidemill.functions.ranking import row_hash
from tidemill.operators import rows, splits, strata

_H = "md5(concat_ws('|', '42', event_id))"
_EVENTS = f"SELECT *, row_number() OVER (ORDER BY {_H}) AS rk, count(*) OVER () AS n FROM events"
_EVENT_COLUMNS = "event_id, ts, user_id, event_type, value, props"


@query(
    "shuffle_rank",
    """SELECT h, o_orderkey, o_custkey FROM (SELECT md5(concat_ws('|', '7', o_orderkey)) AS h, * FROM orders) ORDER BY h""",
)
def shuffle_rank(spark, sf):
    shuffled = rows.shuffle(table(spark, sf, "orders"), 7, ["o_orderkey"])
    return shuffled.select(row_hash(["o_orderkey"], 7).alias("h"), "o_orderkey", "o_custkey")


@query("sample_n", f"SELECT {_EVENT_COLUMNS} FROM ({_EVENTS}) WHERE rk <= 1234")
def sample_n(spark, sf):
    return rows.sample_rows(table(spark, sf, "events"), n=1234, key=["event_id"])


_LI_RANK = "row_number() OVER (ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)))"


@query(
    "sample_frac",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM
   (SELECT *, {_LI_RANK} AS rk, count(*) OVER () AS n FROM lineitem) WHERE rk <= round_even(0.3 * n, 0)""",
)
def sample_frac(spark, sf):
    li = table(spark, sf, "lineitem")
    return rows.sample_rows(li, frac=0.3, key=LINEITEM_KEY).select(*LINEITEM_KEY)


@query(
    "sample_repeated_rows",
    """WITH t AS (SELECT event_type, props FROM events), h AS (
  SELECT *, md5(concat_ws('|', '42', event_type, props)) AS h FROM t),
 k AS (SELECT *, row_number() OVER (ORDER BY h) AS rk, count(*) OVER () AS n FROM h)
SELECT event_type, props, count(*) AS copies FROM k WHERE rk <= round_even(0.4 * n, 0) GROUP BY 1, 2""",
)
def sample_repeated_rows(spark, sf):
    """Without a key: copies of one row lie on both sides of the cut."""
    t = table(spark, sf, "events").select("event_type", "props")
    return rows.sample_rows(t, frac=0.4).groupBy("event_type", "props").agg(F.count("*").alias("copies"))


# texts that hold the separator of the row hash and its escape, at fixed places
_PIPES = """pipes AS (SELECT lang || CASE WHEN doc_id % 3 = 0 THEN '|' ELSE '' END AS a,
  CASE WHEN doc_id % 3 = 1 THEN '|' WHEN doc_id % 3 = 2 THEN '\\' ELSE '' END || lang AS b FROM documents),
marked AS (SELECT a, b, md5(concat_ws('|', '42', replace(replace(a, '\\', '\\\\'), '|', '\\|'),
  replace(replace(b, '\\', '\\\\'), '|', '\\|'))) AS h FROM pipes),
placed AS (SELECT a, b, row_number() OVER (ORDER BY h) AS rk, count(*) OVER () AS n FROM marked)"""


def _pipes(spark, sf):
    third = F.col("doc_id") % 3
    tail = F.when(third == 0, "|").otherwise("")
    front = F.when(third == 1, "|").when(third == 2, "\\").otherwise("")
    docs = table(spark, sf, "documents")
    return docs.select(F.concat("lang", tail).alias("a"), F.concat(front, "lang").alias("b"))


@query(
    "sample_pipe_text",
    f"WITH {_PIPES} SELECT a, b, count(*) AS copies FROM placed WHERE rk <= round_even(0.4 * n, 0) GROUP BY 1, 2",
)
def sample_pipe_text(spark, sf):
    sampled = rows.sample_rows(_pipes(spark, sf), frac=0.4)
    return sampled.groupBy("a", "b").agg(F.count("*").alias("copies"))


@query(
    "split_pipe_text",
    f"""WITH {_PIPES} SELECT a, b, CASE WHEN rk <= n - ceil(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS split,
  count(*) AS copies FROM placed GROUP BY 1, 2, 3""",
)
def split_pipe_text(spark, sf):
    parts = splits.split(_pipes(spark, sf), "a", 0.2)
    return parts.groupBy("a", "b", "split").agg(F.count("*").alias("copies"))


@query("stride_sample", f"SELECT {_EVENT_COLUMNS} FROM ({_EVENTS}) WHERE n <= 300 OR (rk - 1) % greatest(n // 300, 1) = 0")
def stride_sample(spark, sf):
    return rows.stride_sample(table(spark, sf, "events"), key=["event_id"])


_OH = "md5(concat_ws('|', '42', o_orderkey))"


@query(
    "split_two_way",
    f"""SELECT o_orderkey, CASE WHEN rk <= n - ceil(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_OH}) AS rk, count(*) OVER () AS n FROM orders)""",
)
def split_two_way(spark, sf):
    o = table(spark, sf, "orders")
    return splits.split(o, "o_orderstatus", 0.2, key=["o_orderkey"]).select("o_orderkey", "split")


_SIZES = """s AS (SELECT n, ceil(n * (0.1::DOUBLE + 0.2::DOUBLE)) AS held FROM (SELECT count(*) AS n FROM orders)),
p AS (SELECT n, held, ceil(held * (0.2::DOUBLE / (0.1::DOUBLE + 0.2::DOUBLE))) AS test FROM s),
z AS (SELECT CAST(n AS BIGINT) AS n, CAST(n - held AS BIGINT) AS train, CAST(held - test AS BIGINT) AS val, CAST(test AS BIGINT) AS test FROM p)"""


@query(
    "split_three_way",
    f"""WITH {_SIZES} SELECT o_orderkey,
   CASE WHEN rk <= train THEN 'train' WHEN rk <= train + val THEN 'validation' ELSE 'test' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_OH}) AS rk FROM orders), z""",
)
def split_three_way(spark, sf):
    o = table(spark, sf, "orders")
    return splits.split(o, "o_orderstatus", 0.2, 0.1, key=["o_orderkey"]).select("o_orderkey", "split")


@query(
    "split_stratified",
    f"""WITH {_SIZES}, c AS (SELECT o_orderpriority AS g, count(*) AS nc FROM orders GROUP BY 1),
q1 AS (SELECT g, nc, train * nc // n AS base, row_number() OVER (ORDER BY train * nc % n DESC, g) AS o,
              train - sum(train * nc // n) OVER () AS rest FROM c, z),
t AS (SELECT g, nc, base + CASE WHEN o <= rest THEN 1 ELSE 0 END AS tr FROM q1),
h AS (SELECT g, tr, nc - tr AS hc, (SELECT val FROM z) AS val, (SELECT val + test FROM z) AS ht FROM t),
q2 AS (SELECT g, tr, val * hc // ht AS base, row_number() OVER (ORDER BY val * hc % ht DESC, g) AS o,
              val - sum(val * hc // ht) OVER () AS rest FROM h),
v AS (SELECT g, tr, base + CASE WHEN o <= rest THEN 1 ELSE 0 END AS va FROM q2)
SELECT o_orderkey, o_orderpriority,
   CASE WHEN rk <= tr THEN 'train' WHEN rk <= tr + va THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_OH}) AS rk FROM orders) x
JOIN v ON v.g = x.o_orderpriority""",
)
def split_stratified(spark, sf):
    o = table(spark, sf, "orders")
    parted = splits.split(o, "o_orderpriority", 0.2, 0.1, stratify=True, key=["o_orderkey"])
    return parted.select("o_orderkey", "o_orderpriority", "split")


def _quotas_sql(source: str, group: str) -> str:
    """Rows of each class in train and validation, by largest remainder."""
    return f"""s AS (SELECT n, ceil(n * (0.1::DOUBLE + 0.2::DOUBLE)) AS held FROM (SELECT count(*) AS n FROM {source})),
p AS (SELECT n, held, ceil(held * (0.2::DOUBLE / (0.1::DOUBLE + 0.2::DOUBLE))) AS test FROM s),
z AS (SELECT CAST(n AS BIGINT) AS n, CAST(n - held AS BIGINT) AS train, CAST(held - test AS BIGINT) AS val, CAST(test AS BIGINT) AS test FROM p),
c AS (SELECT {group} AS g, count(*) AS nc FROM {source} GROUP BY 1),
q1 AS (SELECT g, nc, train * nc // n AS base, row_number() OVER (ORDER BY train * nc % n DESC, g) AS o,
              train - sum(train * nc // n) OVER () AS rest FROM c, z),
t AS (SELECT g, nc, base + CASE WHEN o <= rest THEN 1 ELSE 0 END AS tr FROM q1),
h AS (SELECT g, tr, nc - tr AS hc, (SELECT val FROM z) AS val, (SELECT val + test FROM z) AS ht FROM t),
q2 AS (SELECT g, tr, val * hc // ht AS base, row_number() OVER (ORDER BY val * hc % ht DESC, g) AS o,
              val - sum(val * hc // ht) OVER () AS rest FROM h),
v AS (SELECT g, tr, base + CASE WHEN o <= rest THEN 1 ELSE 0 END AS va FROM q2)"""


@query(
    "split_many_strata",
    f"""WITH big AS (SELECT *, CAST(o_custkey AS VARCHAR) AS g0 FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 2),
{_quotas_sql("big", "g0")}
SELECT o_orderkey, o_custkey, CASE WHEN rk <= tr THEN 'train' WHEN rk <= tr + va THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY g0 ORDER BY {_OH}) AS rk FROM big) x JOIN v ON v.g = x.g0""",
)
def split_many_strata(spark, sf):
    """A stratum per customer (of two orders or more), with the quotas in a table."""
    o = table(spark, sf, "orders")
    often = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 2").select("o_custkey")
    rows = o.join(often, "o_custkey")
    counts = strata.count_strata(rows, "o_custkey")
    sizes = splits.split_sizes(rows.count(), 0.2, 0.1)
    dealt = strata.deal(rows, "o_custkey", strata.split_quotas(counts, sizes), ["o_orderkey"], 42, "part")
    names = F.array(*map(F.lit, splits.PARTS))
    return dealt.select("o_orderkey", "o_custkey", F.element_at(names, F.col("part") + 1).alias("split"))


@query(
    "cv_folds_many_strata",
    """WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS g, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT unnest(range(4)) AS fold),
 s AS (SELECT g, n, coalesce(sum(n % 4) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 4 AS start FROM c),
 e AS (SELECT g, fold, CAST(n // 4 + CASE WHEN (fold - start + 4) % 4 < n % 4 THEN 1 ELSE 0 END AS BIGINT) AS rows FROM s, f)
SELECT CAST(g AS BIGINT) AS o_custkey, CAST(fold AS BIGINT) AS fold, rows FROM e WHERE rows > 0""",
)
def cv_folds_many_strata(spark, sf):
    o = table(spark, sf, "orders")
    ends = strata.fold_ends(strata.count_strata(o, "o_custkey"), 4)
    folded = strata.deal(o, "o_custkey", ends, ["o_orderkey"], 42, "fold")
    counts = folded.groupBy(F.col("o_custkey").cast("bigint").alias("o_custkey"), F.col("fold").cast("bigint").alias("fold"))
    return counts.agg(F.count("*").alias("rows"))


@query(
    "cv_folds",
    f"""SELECT o_orderkey, CASE WHEN rk <= (n % 4) * (n // 4 + 1) THEN (rk - 1) // (n // 4 + 1)
     ELSE n % 4 + (rk - 1 - (n % 4) * (n // 4 + 1)) // (n // 4) END AS fold
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_OH}) AS rk, count(*) OVER () AS n FROM orders)""",
)
def cv_folds(spark, sf):
    o = table(spark, sf, "orders")
    folded = splits.assign_folds(o, "o_totalprice", 4, False, key=["o_orderkey"])
    return folded.select("o_orderkey", F.col("fold").cast("bigint").alias("fold"))


@query(
    "cv_folds_stratified",
    """WITH c AS (SELECT o_orderpriority AS g, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT unnest(range(4)) AS fold),
 s AS (SELECT g, n, coalesce(sum(n % 4) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 4 AS start FROM c)
SELECT g AS o_orderpriority, CAST(fold AS BIGINT) AS fold,
  CAST(n // 4 + CASE WHEN (fold - start + 4) % 4 < n % 4 THEN 1 ELSE 0 END AS BIGINT) AS rows FROM s, f""",
)
def cv_folds_stratified(spark, sf):
    o = table(spark, sf, "orders")
    folded = splits.assign_folds(o, "o_orderpriority", 4, True, key=["o_orderkey"])
    counts = folded.groupBy("o_orderpriority", F.col("fold").cast("bigint").alias("fold"))
    return counts.agg(F.count("*").alias("rows"))
