"""Chat formatting: a state machine over roles, and a declarative template of segments.

The machine's state is the last role seen, so whether a turn may follow is a question of
two neighbouring rows. Each turn becomes segments of text, each with a flag that says
whether the model is to learn from it. Control strings inside texts are escaped, so that
the template's own marks are the only ones and the text can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class ChatTemplate:
    """``before`` and ``after``: the text around a turn, ``{role}`` being its role. ``learn``: roles whose text is learned. ``follows``: for each
    state (the last role, or ``start``), the roles that may come next. ``last``: roles a
    conversation may end on. ``control``: strings that texts must not contain as they are,
    besides the template's own marks, which are always escaped.
    """

    before: str = "<|turn|>{role}<|text|>"
    after: str = "<|end|>"
    learn: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    last: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]")

    def __post_init__(self) -> None:
        if self.before.count("{role}") != 1 or not self.after or any(len(c) < 2 for c in self.marks()):
            raise ValueError("a template needs one {role}, a mark after a turn, and marks of two characters or more")

    def marks(self) -> tuple[str, ...]:
        """All strings that are escaped: ``control`` and the template's own marks."""
        own = [*self.before.split("{role}"), self.after]
        return tuple(dict.fromkeys([*self.control, *[m for m in own if m]]))


def escape(text: Column, control: tuple[str, ...]) -> Column:
    """Doubles backslashes and puts one after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    if not control:
        return out
    any_of = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in control)
    return F.regexp_replace(out, f"({any_of})", "$1\\\\")


def unescape(text: Column) -> Column:
    """Takes one backslash away wherever the next character was escaped."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Per turn: ``conv_id, turn, role, text, valid, segments`` and ``ends``.

    ``segments`` is an array of (text, loss): the mark before, the escaped text, the mark
    after. ``valid`` says that the role may follow the one before it; ``ends`` is set on the
    last turn and says that the conversation may end there. Turns are ordered by turn (NULL
    first), ties by role and text. A NULL text or role is an empty string, a NULL conv_id a
    conversation of its own; a wrong order is flagged, never dropped. Repeated rows are
    turns. Columns other than these four are ignored.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    state = F.lag("role", 1, "start").over(order)
    allowed = [(state == s) & F.col("role").isin(list(roles)) for s, roles in template.follows.items()]
    legal = F.lit(False)
    for a in allowed:
        legal = legal | a
    final = F.lead("role").over(order).isNull()
    before, after = template.before.split("{role}")
    flag = F.col("role").isin(list(template.learn))
    role = escape(F.col("role"), template.marks())
    parts = F.array(
        F.struct(F.concat(F.lit(before), role, F.lit(after)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text"), template.marks()).alias("text"), flag.alias("loss")),
        F.struct(F.lit(template.after).alias("text"), F.lit(False).alias("loss")),
    )
    return rows.select(
        "*", legal.alias("valid"), F.when(final, F.col("role").isin(list(template.last))).alias("ends"),
        parts.alias("segments"), F.row_number().over(order).alias("place"),
    )


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Per conversation: ``conv_id, formatted, loss`` (runs of (start, length) in code points
    that the model learns from), ``valid`` (every turn may stand where it stands).

    The record of a conversation is one string, so it is gathered in one row; what
    ``segments`` returns is not, and serves conversations of any length.
    """
    each = segments(turns, template).select(
        "conv_id", "valid", "ends", "place", "segments"
    )
    whole = each.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "segments"))).alias("_turns"),
        F.bool_and(F.col("valid") & F.coalesce("ends", F.lit(True))).alias("valid"),
    )
    parts = F.flatten(F.col("_turns.segments"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("runs"))

    def step(s: Column, p: Column) -> Column:
        n = F.char_length(p["text"])
        run = F.array(F.struct(s["at"].alias("start"), n.alias("length")))
        return F.struct((s["at"] + n).alias("at"), F.when(p["loss"], F.concat(s["runs"], run)).otherwise(s["runs"]).alias("runs"))

    return whole.select(
        "conv_id",
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("formatted"),
        F.aggregate(parts, start, step, lambda s: s["runs"]).alias("loss"),
        "valid",
    )


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``conv_id, turns`` (array of role and text) and ``learned`` (the texts under the loss
    runs), read from ``formatted`` alone."""
    before, after = template.before.split("{role}")
    body = F.split(F.col("formatted"), re.escape(template.after))
    # the last mark ends the string, so that what follows it is empty
    pieces = F.slice(body, F.lit(1), F.size(body) - 1)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(before) + 1), F.char_length(piece))
        return F.struct(
            unescape(F.substring_index(inner, after, 1)).alias("role"),
            unescape(F.substring(inner, F.instr(inner, after) + len(after), F.char_length(inner))).alias("text"),
        )

    learned = F.transform("loss", lambda r: unescape(F.substring(F.col("formatted"), r["start"] + 1, r["length"])))
    return formatted.select("*", F.transform(pieces, turn).alias("turns"), learned.alias("learned"))


def run(spark, sf: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string"
    )
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    back = read_back(format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(role) + length(text) + length('<|turn|>') + length('<|text|>') + length('<|end|>')
    + len(regexp_extract_all(role || chr(31) || text, '\\|<\|turn\|>|<\|text\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]')) AS n
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
