"""URL filters: host rules first, then boosted trees on lexical features.

The rules decide some URLs, and those are the labelled ones: trees learn from them what
blocked URLs look like, and judge the rest. Both verdicts weigh the same in the fit. The
trees see how long a suffix is and whether it is rare, but not what the rules say of it: rules
are mostly about suffixes, and the rest of a suffix would only inherit them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import ascii_lower

FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "symbol_ratio", "entropy",
    "parameters", "query_length", "fragment", "secure", "suffix_length", "suffix_rare",
]


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class FitPlan:
    """``max_rows``: labelled rows that the trees are fitted on, the ones with the smallest
    hash of their URL. ``rare``: share of all pages below which a suffix is rare."""

    max_rows: int = 200_000
    trees: int = 20
    depth: int = 4
    rare: float = 0.01
    seed: int = 7


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, NULL if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character; an empty text has none."""
    n = F.char_length(text)

    def one(c: Column) -> Column:
        p = (n - F.char_length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    letters = F.array_distinct(F.split(text, ""))
    return F.when(n > 0, F.aggregate(F.transform(F.filter(letters, lambda c: c != ""), one), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, path, suffix`` and the features that one URL has by itself."""
    url = F.coalesce("url", F.lit(""))
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.char_length(url), F.lit(1))
    count = lambda pattern, text=url: F.regexp_count(text, F.lit(pattern)).cast("double")
    made = {
        "suffix": F.substring_index("host", ".", -1),
        "url_length": F.char_length(url),
        "host_length": F.char_length("host"),
        "path_length": F.char_length("path"),
        "depth": count("/+[^/]", F.col("path")),
        "labels": count(r"[^.]+", F.col("host")),
        "digit_ratio": count("[0-9]") / n,
        "symbol_ratio": count("[^A-Za-z0-9]") / n,
        "entropy": entropy(url),
        "parameters": count("[^&]+", query),
        "query_length": F.char_length(query),
        "fragment": F.instr(url, "#") > 0,
        "secure": F.startswith(url, F.lit("https:")),
    }
    return rows.withColumns({k: v if k == "suffix" else v.cast("double") for k, v in made.items()})


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, plan: FitPlan = FitPlan()) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, score``: the rule's verdict, else the
    trees' (block from a score of one half).

    A NULL url or one without ``://`` has an empty host and path, so no rule fits it and the
    trees judge it. If the rules label rows of one verdict only, the others get the same; if
    they label none, ``allow``. Repeated rows each get a row; no rows give none. Columns
    other than page_id and url are ignored.
    """
    rows, sums = _labelled(pages, rules)
    total = sums.agg(F.sum("_n").alias("n"), F.sum("_labelled").alias("l"), F.sum("_bad").alias("b")).first()
    labelled, bad = total["l"] or 0, total["b"] or 0.0
    if not labelled or bad in (0.0, float(labelled)):
        other = "block" if labelled and bad else "allow"
        score = F.lit(float(other == "block"))
        return rows.select(
            "page_id", "url", "host", "path", "rule", F.coalesce("_verdict", F.lit(other)).alias("verdict"), score.alias("score")
        )
    ready = _features(rows, sums, total["n"], plan)
    model = _fit(ready.where(F.col("label").isNotNull()), labelled, bad, plan)
    scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    told = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "url", "host", "path", "rule", F.coalesce("_verdict", told).alias("verdict"), "score")


def _labelled(pages: DataFrame, rules: tuple[UrlRule, ...]) -> tuple[DataFrame, DataFrame]:
    """Pages with the rules' labels, and one row per suffix with its counts."""
    rows = lexical(pages)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "_verdict": verdict})
    blocked = F.when(F.col("_verdict") == "block", 1.0).when(F.col("_verdict") == "allow", 0.0)
    rows = rows.withColumn("label", blocked)
    sums = rows.groupBy("suffix").agg(
        F.count("*").alias("_n"), F.count("label").alias("_labelled"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("_bad")
    )
    return rows, sums


def _features(rows: DataFrame, sums: DataFrame, pages: int, plan: FitPlan) -> DataFrame:
    # suffixes that are not rare are few: at most one in ``rare``
    common = sums.where(F.col("_n") >= plan.rare * pages).select(F.col("suffix").alias("_common"))
    known = rows.join(F.broadcast(common), F.col("suffix") == F.col("_common"), "left")
    made = {"suffix_length": F.char_length("suffix").cast("double"), "suffix_rare": F.col("_common").isNull().cast("double")}
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known.withColumns(made))


def _fit(rows: DataFrame, labelled: int, bad: float, plan: FitPlan):
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(plan.seed), "url"), 11).cast("double") / float(1 << 53)
    sample = rows.where(unit < min(1.0, plan.max_rows / labelled))
    weight = F.when(F.col("label") == 1, labelled / (2 * bad)).otherwise(labelled / (2 * (labelled - bad)))
    trees = GBTClassifier(maxIter=plan.trees, maxDepth=plan.depth, seed=plan.seed, maxBins=64, weightCol="weight")
    return trees.fit(sample.select("label", "features", weight.alias("weight")))


def held_out_accuracy(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, plan: FitPlan = FitPlan()) -> DataFrame:
    """``label, n, right``: how the trees judge the labelled URLs of a fifth of the hosts (by a
    hash of the host), when they learn from the others only."""
    rows, sums = _labelled(pages, rules)
    ready = _features(rows, sums, rows.count(), plan).where(F.col("label").isNotNull())
    away = F.pmod(F.xxhash64("host", F.lit(plan.seed)), F.lit(5)) == 0
    learned = ready.where(~away)
    counts = learned.agg(F.count("*").alias("l"), F.sum("label").alias("b")).first()
    scored = _fit(learned, counts["l"], counts["b"], plan).transform(ready.where(away))
    right = (F.col("prediction") == F.col("label")).cast("long")
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.sum(right).alias("right"))


def run(spark, sf: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf}/pages.parquet"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")
