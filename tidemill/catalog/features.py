"""Feature preparation, scalers, encoders, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.base import EVENTS_DIRTY, LINEITEM_KEY, events_dirty, query, rounded, table
from tidemill.operators import features
from tidemill.plans import prepare

_KEY = ", ".join(LINEITEM_KEY)


@query(
    "dummies",
    """SELECT p_partkey, """
    + ", ".join(
        f"CAST(p_type = '{t}' AS INT) AS \"p_type_{t}\""
        for t in ["LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    )
    + " FROM part",
)
def dummies(spark, sf):
    return features.dummies(table(spark, sf, "part").select("p_partkey", "p_type"), ["p_type"])


@query(
    "label_codes",
    """SELECT p_brand AS "value", row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY 1""",
)
def label_codes(spark, sf):
    return prepare.label_codes(table(spark, sf, "part"), "p_brand", ["p_partkey"])


@query(
    "prepare_xy",
    f"""WITH {EVENTS_DIRTY}, base AS (SELECT event_id, user_id, value, coalesce(event_type, (SELECT event_type FROM dirty WHERE event_type IS NOT NULL
   GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type, CASE WHEN user_id > 70 THEN 'high' ELSE 'low' END AS target FROM dirty),
codes AS (SELECT target, row_number() OVER (ORDER BY min(event_id)) - 1 AS label FROM base GROUP BY 1)
SELECT event_id, round(coalesce(value, (SELECT median(value) FROM dirty)), 6) AS value,
  {", ".join(f"CAST(event_type = '{t}' AS DOUBLE) AS event_type_{t}" for t in ["error", "purchase", "signup", "view"])},
  label FROM base JOIN codes USING (target)""",
)
def prepare_xy(spark, sf):
    d = events_dirty(spark, sf)
    d = d.withColumn("target", F.when(F.col("user_id") > 70, "high").otherwise("low"))
    d = d.withColumn("empty", F.lit(None).cast("double")).drop("ts")
    plan = prepare.fit_prepare(d, "target", key=["event_id"], drop=["props", "user_id"])
    return rounded(plan.apply(d, ["event_id"]), ["value"])


_ORDERS = """c AS (SELECT *, 'o' || l_orderkey AS o FROM lineitem),
d AS (SELECT o, row_number() OVER (ORDER BY o) - 1 AS code FROM (SELECT DISTINCT o FROM c))"""


def _with_orders(spark, sf):
    """Line items with their order as a text: a category of a quarter as many values as rows."""
    order = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    return table(spark, sf, "lineitem").select(*LINEITEM_KEY, "l_quantity", "l_returnflag", order.alias("o"))


@query(
    "label_codes_many",
    """SELECT DISTINCT 'o' || l_orderkey AS "value", dense_rank() OVER (ORDER BY l_orderkey) - 1 AS code FROM lineitem""",
)
def label_codes_many(spark, sf):
    return prepare.label_codes(_with_orders(spark, sf), "o", ["l_orderkey"])


@query(
    "prepare_sparse",
    f"""WITH {_ORDERS}
SELECT {_KEY}, (SELECT count(*) FROM d) AS width, CASE WHEN code > 0 THEN 2 ELSE 1 END AS n, CASE WHEN code > 0 THEN code ELSE 0 END AS place,
  l_quantity AS quantity, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS label FROM c JOIN d USING (o)""",
)
def prepare_sparse(spark, sf):
    """One number and a block of places for the orders but the first; a text label."""
    rows = _with_orders(spark, sf)
    plan = prepare.fit_prepare(rows, "l_returnflag", key=LINEITEM_KEY, order="alphabet", sparse=True)
    f = F.col("features")
    return plan.apply(rows, LINEITEM_KEY).select(
        *LINEITEM_KEY, f["size"].cast("bigint").alias("width"), F.size(f["indices"]).alias("n"),
        F.array_max(f["indices"]).cast("bigint").alias("place"), f["values"][0].alias("quantity"), "label",
    )


@query(
    "transform_sparse",
    f"""WITH {_ORDERS}, seen AS (SELECT o, row_number() OVER (ORDER BY o) - 1 AS code FROM (SELECT DISTINCT o FROM c WHERE l_quantity > 10)),
m AS (SELECT min(l_quantity) AS a, max(l_quantity) - min(l_quantity) AS w FROM c WHERE l_quantity > 10)
SELECT {_KEY}, round((l_quantity - a) / w, 6) AS quantity, CAST(coalesce(code, -1) AS DOUBLE) AS o, l_returnflag
FROM c LEFT JOIN seen USING (o), m""",
)
def transform_sparse(spark, sf):
    """Scaled numbers and order codes, fitted on some rows and applied to all of them."""
    rows = _with_orders(spark, sf)
    plan = features.fit_transformer(
        rows.where("l_quantity > 10"), ["l_quantity"], ["o"], categorical_encoding="ordinal",
        scaling="minmax", remainder="passthrough", sparse=True,
    )
    out = plan.apply(rows, LINEITEM_KEY)
    f = F.col("features")
    value = lambda i: F.coalesce(F.get(f["values"], F.array_position(f["indices"], i).cast("int") - 1), F.lit(0.0))
    return rounded(out.select(*LINEITEM_KEY, value(0).alias("quantity"), value(1).alias("o"), "l_returnflag"), ["quantity"])


def _scale_sql(offset: str, scale: str) -> str:
    cells = ", ".join(
        f"round(({c} - {offset.format(c=c)}) / (SELECT CASE WHEN s = 0 THEN 1 ELSE s END FROM (SELECT {scale.format(c=c)} AS s FROM lineitem)), 6) AS {c}"
        for c in ("l_quantity", "l_extendedprice")
    )
    return f"SELECT {_KEY}, {cells} FROM lineitem"


def _scale(spark, sf, kind):
    columns = ["l_quantity", "l_extendedprice"]
    li = table(spark, sf, "lineitem").select(*LINEITEM_KEY, *columns)
    return rounded(features.apply_scaler(li, features.fit_scaler(li, columns, kind)), columns)


@query("scale_standard", _scale_sql("(SELECT avg({c}) FROM lineitem)", "stddev_pop({c})"))
def scale_standard(spark, sf):
    return _scale(spark, sf, "standard")


@query("scale_minmax", _scale_sql("(SELECT min({c}) FROM lineitem)", "max({c}) - min({c})"))
def scale_minmax(spark, sf):
    return _scale(spark, sf, "minmax")


@query(
    "scale_robust",
    _scale_sql("(SELECT median({c}) FROM lineitem)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
)
def scale_robust(spark, sf):
    return _scale(spark, sf, "robust")


@query("scale_maxabs", _scale_sql("0", "max(abs({c}))"))
def scale_maxabs(spark, sf):
    return _scale(spark, sf, "maxabs")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "one_hot",
    f"""WITH m AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM part)
SELECT p_partkey, round((p_size - m) / s, 6) AS p_size, {", ".join(f"CAST(p_type = '{t}' AS INT) AS p_type_{t}" for t in _TYPES)} FROM part, m""",
)
def one_hot(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_type")
    plan = features.fit_transformer(p, ["p_size"], ["p_type"])
    return rounded(plan.apply(p, ["p_partkey"]), ["p_size"])


@query(
    "ordinal",
    f"""WITH {EVENTS_DIRTY}, filled AS (SELECT event_id, value, user_id, coalesce(event_type, 'missing') AS event_type FROM dirty)
SELECT event_id, round((coalesce(value, 0) - (SELECT min(coalesce(value, 0)) FROM dirty)) / (SELECT max(coalesce(value, 0)) - min(coalesce(value, 0)) FROM dirty), 6) AS value,
   CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS event_type, user_id FROM filled""",
)
def ordinal(spark, sf):
    d = events_dirty(spark, sf).select("event_id", "value", "event_type", "user_id")
    plan = features.fit_transformer(
        d, ["value"], ["event_type"], "constant", "constant", "ordinal", "minmax", "passthrough"
    )
    return rounded(plan.apply(d, ["event_id"]), ["value"])


@query(
    "ordinal_unknown",
    """WITH f AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part WHERE p_size > 25 AND p_type <> 'PROMO'))
SELECT p_partkey, CAST(coalesce(code, -1) AS INT) AS p_type FROM part LEFT JOIN f USING (p_type)""",
)
def ordinal_unknown(spark, sf):
    """Fitted on one part of the table, applied to all of it."""
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    seen = p.where("p_size > 25 and p_type <> 'PROMO'")
    plan = features.fit_transformer(seen, [], ["p_type"], categorical_encoding="ordinal")
    return plan.apply(p, ["p_partkey"])


_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query(
    "variance_scores",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(var_pop({c}), 4) AS variance FROM lineitem" for c in _FEATURES[:3]
    ),
)
def variance_scores(spark, sf):
    return rounded(features.variance_scores(table(spark, sf, "lineitem"), _FEATURES[:3]), ["variance"], 4)


def _anova(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 4) AS score
FROM (SELECT l_linenumber, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM lineitem) AS gm FROM lineitem GROUP BY 1)"""


@query("anova_f", " UNION ALL ".join(map(_anova, _FEATURES)))
def anova_f(spark, sf):
    found = features.anova_scores(table(spark, sf, "lineitem"), _FEATURES, "l_linenumber")
    return rounded(found, ["score"], 4)


@query(
    "regress_f",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(pow(corr({c}, l_extendedprice), 2) * (count(*) - 2) / (1 - pow(corr({c}, l_extendedprice), 2)), 3) AS score FROM lineitem"
        for c in _FEATURES[:3]
    ),
)
def regress_f(spark, sf):
    found = features.regression_scores(table(spark, sf, "lineitem"), _FEATURES[:3], "l_extendedprice")
    return rounded(found, ["score"], 3)


@query(
    "polynomial",
    f"""SELECT {_KEY}, 1.0::DOUBLE AS "1", l_quantity, l_discount, round(l_quantity * l_quantity, 6) AS "l_quantity^2",
  round(l_quantity * l_discount, 6) AS "l_quantity l_discount", round(l_discount * l_discount, 6) AS "l_discount^2" FROM lineitem""",
)
def polynomial(spark, sf):
    out = features.polynomial_features(
        table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], 2, True, LINEITEM_KEY
    )
    made = ["l_quantity^2", "l_quantity l_discount", "l_discount^2"]
    return out.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if c in made else F.col(f"`{c}`") for c in out.columns])
