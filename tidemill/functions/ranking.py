"""Repeatable random order, and exact cuts in it, without sorting the table.

A row's place is the order of ``md5(seed|key...)``. It does not depend on how the
table is partitioned. To find the row at a given place, rows are counted per hash
prefix, only the prefixes that hold a wanted place are counted again one step
deeper, and the few hashes left are read. What remains for the table itself is a
comparison of the hash with literals: no shuffle of rows and no window.

Without a key, identical rows are first merged into one row with a count, so that a
row repeated very often stays one row; the copies are dealt out arithmetically.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import col, free_name, require_columns
from tidemill.session import spread_small

LEAVES = 100_000
CELLS = 131_072
GROUPS = 50_000
COPIES_PER_ROW = 100_000


def row_hash(key: Sequence[str], seed: int | str) -> Column:
    """``md5`` of the seed and the key values, joined by ``|``; NULL is written ``\\N``.

    Inside a value, ``\\`` and ``|`` get a ``\\`` before them, so that different rows stay
    different once they are joined.
    """
    escaped = [F.replace(F.replace(col(k).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for k in key]
    parts = [F.coalesce(e, F.lit("\\N")) for e in escaped]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


@dataclass(frozen=True)
class Mark:
    """The row at one place: its hash, the rows before it and its number of copies."""

    hash: str
    before: int
    copies: int


class TooManyGroups(ValueError):
    """More groups than the driver should hold."""


class HashOrder:
    """A table with a hash column, ready to be cut at exact places."""

    def __init__(self, df: DataFrame, key: Sequence[str] | None, seed: int | str) -> None:
        self.columns = df.columns
        self.first: dict[str | None, tuple] = {}
        self.unique = key is not None
        if key is not None:
            require_columns(df, list(key))
            self.weight = None
            base = df
        else:
            self.weight = free_name(df, "_copies")
            base = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias(self.weight))
        self.hash = free_name(df, "_hash")
        self.key = list(key) if key is not None else df.columns
        self.seed = seed
        self.base = base
        self.df = base.withColumn(self.hash, row_hash(self.key, seed))

    def _counts(self, rows: DataFrame, by: list[str]) -> DataFrame:
        n = F.sum("_w") if not self.unique else F.count("*")
        return rows.groupBy(*by).agg(n.alias("_n"), F.count("*").alias("_d"))

    def _slim(self, group: str | None) -> DataFrame:
        """Hash, group and number of copies: all that counting needs to read."""
        names = list(dict.fromkeys([*self.key, *([group] if group else [])]))
        picked = [col(c) for c in names]
        if not self.unique:
            picked.append(F.col(self.weight).alias("_w"))
        rows = spread_small(self.base.select(*picked))
        out = [
            row_hash(self.key, self.seed).alias("_h"),
            (col(group).cast("string") if group else F.lit("")).alias("_g"),
        ]
        return rows.select(*out, *([] if self.unique else ["_w"]))

    def totals(self, group: str | None = None) -> dict[str | None, int]:
        """Rows per group. The same count, kept per hash prefix, is where ``marks`` starts."""
        digits = 2 if group else 3
        rows = self._prefix_counts(self._slim(group), digits).limit(CELLS + 1).collect()
        if len(rows) > CELLS:  # many groups: count them alone first
            digits = 0
            rows = self._prefix_counts(self._slim(group), 0).limit(GROUPS + 1).collect()
            if len(rows) > GROUPS:
                raise TooManyGroups(f"more than {GROUPS} different values in {group!r}")
        self.first[group] = (digits, rows)
        totals: dict[str | None, int] = {} if group else {"": 0}
        for r in rows:
            totals[r["_g"]] = totals.get(r["_g"], 0) + r["_n"]
        return totals

    def _prefix_counts(self, rows: DataFrame, digits: int) -> DataFrame:
        prefix = F.substring("_h", 1, digits) if digits else F.lit("")
        return self._counts(rows.withColumn("_p", prefix), ["_g", "_p"])

    def marks(self, places: dict[str | None, list[int]], group: str | None = None) -> dict:
        """``{(group value, place): Mark}`` for 0-based places in hash order."""
        slim = self._slim(group)
        found: dict[tuple[str | None, int], Mark] = {}
        # (group, prefix) -> (rows before the prefix within the group, places inside)
        cells = {(g, ""): (0, sorted(set(p))) for g, p in places.items() if p}
        depth = 0
        rows_left: int | None = None
        while cells:
            last = rows_left is not None and rows_left <= LEAVES
            if depth == 0 and group in self.first and self.first[group][0]:
                step, counted = self.first[group]
            else:
                step = 32 - depth if last else min(_digits(len(cells)), 32 - depth)
                rows = slim if depth == 0 else self._inside(slim, cells, depth, group)
                counted = self._prefix_counts(rows, depth + step).collect()
            deeper = depth + step
            per_cell: dict[tuple, list[tuple[str, int, int]]] = {}
            for r in counted:
                entry = (r["_p"], r["_n"], r["_d"])
                per_cell.setdefault((r["_g"], r["_p"][:depth]), []).append(entry)
            following: dict[tuple, tuple[int, list[int]]] = {}
            rows_left = 0
            for (g, prefix), (before, wanted) in cells.items():
                wanted = list(wanted)
                for p, n, distinct in sorted(per_cell.get((g, prefix), [])):
                    mine = []
                    while wanted and wanted[0] < before + n:
                        mine.append(wanted.pop(0))
                    if mine and len(p) == 32:
                        if self.unique and n > 1:
                            raise ValueError("row key is not unique")
                        for place in mine:
                            found[(g, place)] = Mark(p, before, n)
                    elif mine:
                        following[(g, p)] = (before, mine)
                        rows_left += distinct
                    before += n
                if wanted:
                    raise ValueError(f"place {wanted[0]} is outside the table")
            cells, depth = following, deeper
        return found

    @staticmethod
    def _inside(slim: DataFrame, cells: dict, depth: int, group: str | None) -> DataFrame:
        """Rows whose group and hash prefix is one of ``cells`` (bounded by the places asked)."""
        if group is None and len(cells) <= 1_000:
            return slim.where(F.substring("_h", 1, depth).isin([p for _, p in cells]))
        schema = T.StructType(
            [T.StructField("_g", T.StringType()), T.StructField("_p", T.StringType())]
        )
        known = slim.sparkSession.createDataFrame(list(cells), schema)
        keyed = slim.withColumn("_p", F.substring("_h", 1, depth))
        match = keyed["_g"].eqNullSafe(known["_g"]) & (keyed["_p"] == known["_p"])
        return keyed.join(F.broadcast(known), match, "left_semi").drop("_p")

    def deal(self, sizes: dict[str | None, list[int]], part: str, group: str | None = None) -> DataFrame:
        """Number the rows of each group by part: the first ``sizes[0]`` rows in hash
        order get 0, the next ``sizes[1]`` get 1, and so on."""
        places: dict[str | None, list[int]] = {}
        for g, counts in sizes.items():
            upto, places[g] = 0, []
            for n in counts[:-1]:
                upto += n
                if n:
                    places[g].append(upto - 1)
        marks = self.marks(places, group)
        cuts: dict[str | None, list[tuple[str, int]]] = {}
        for g, counts in sizes.items():
            upto, cuts[g] = 0, []
            for n in counts[:-1]:
                upto += n
                if upto == 0:
                    cuts[g].append(("", 0))
                else:
                    mark = marks[(g, upto - 1)]
                    cuts[g].append((mark.hash, upto - mark.before))
        return self._deal_cuts(cuts, part, group)

    def _deal_cuts(self, cuts: dict, part: str, group: str | None) -> DataFrame:
        h = F.col(self.hash)
        if group is None:
            pairs = [(F.lit(c), F.lit(take)) for c, take in next(iter(cuts.values()))]
            table = self.df
        else:
            table, pairs = self._with_cuts(cuts, group)
        if self.unique:
            number = sum([(h > c).cast("int") for c, _ in pairs], F.lit(0))
            return table.withColumn(part, number).select(*[col(c) for c in self.columns], part)
        # copies of one row may lie on both sides of a cut
        copies = F.col(self.weight)
        upto = [
            F.when(h < c, copies).when(h == c, take.cast("long")).otherwise(F.lit(0).cast("long"))
            for c, take in pairs
        ] + [copies]
        shares, before = [], F.lit(0).cast("long")
        for i, edge in enumerate(upto):
            shares.append(F.struct(F.lit(i).alias("part"), (edge - before).alias("n")))
            before = edge
        dealt = table.withColumn("_share", F.explode(F.array(*shares))).where("_share.n > 0")
        return repeat_rows(dealt, F.col("_share.n")).select(
            *[col(c) for c in self.columns], F.col("_share.part").alias(part)
        )

    def _with_cuts(self, cuts: dict, group: str):
        width = len(next(iter(cuts.values())))
        fields = [T.StructField("_cg", T.StringType())]
        for i in range(width):
            fields += [T.StructField(f"_c{i}", T.StringType()), T.StructField(f"_t{i}", T.LongType())]
        rows = [[g, *[x for pair in c for x in pair]] for g, c in cuts.items()]
        known = self.df.sparkSession.createDataFrame(rows, T.StructType(fields))
        # one row per class; totals() has bounded their number
        table = self.df.join(F.broadcast(known), col(group).cast("string").eqNullSafe(F.col("_cg")))
        return table, [(F.col(f"_c{i}"), F.col(f"_t{i}")) for i in range(width)]

    def at(self, places: Sequence[int]) -> DataFrame:
        """The rows at the given 0-based places."""
        found = self.marks({"": list(places)})
        taken: dict[str, int] = {}
        for mark in found.values():
            taken[mark.hash] = taken.get(mark.hash, 0) + 1
        kept = self.df.where(F.col(self.hash).isin(list(taken)))
        if not self.unique:
            often = F.create_map(*[F.lit(x) for pair in taken.items() for x in pair])
            kept = repeat_rows(kept, often[F.col(self.hash)].cast("long"))
        return kept.select(*[col(c) for c in self.columns])


def repeat_rows(df: DataFrame, times: Column, number: str | None = None) -> DataFrame:
    """Each row ``times`` times, optionally with the number of the copy. Rows repeated
    very often are first split into chunks that are spread over the cluster, so no array
    and no task grows with the count."""
    cap = F.lit(COPIES_PER_ROW).cast("long")
    one = F.lit(1).cast("long")
    counted = df.withColumn("_left", times.cast("long"))
    few = counted.where((F.col("_left") > 0) & (F.col("_left") <= cap)).withColumns(
        {"_start": F.lit(0).cast("long"), "_size": F.col("_left")}
    )
    chunked = counted.where(F.col("_left") > cap).withColumn(
        "_chunk", F.explode(F.sequence(one, F.ceil(F.col("_left") / cap)))
    )
    many = (
        chunked.withColumn("_start", (F.col("_chunk") - 1) * cap)
        .withColumn("_size", F.least(cap, F.col("_left") - F.col("_start")))
        .repartition("_chunk", *[col(c) for c in df.columns])
        .drop("_chunk")
    )
    each = few.unionByName(many).withColumn("_copy", F.explode(F.sequence(one, F.col("_size"))))
    if number is not None:
        each = each.withColumn(number, F.col("_start") + F.col("_copy"))
    return each.drop("_left", "_start", "_size", "_copy")


def _digits(cells: int) -> int:
    """Hash digits to add so that all cells together stay within the driver's bound."""
    step = 3
    while step > 1 and cells * 16**step > CELLS:
        step -= 1
    return step
