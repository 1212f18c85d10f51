r"""Chat formatting from event logs, with column expressions alone.

A log is a table of events (conv_id, seq, turn, kind, role, text).  A log is partitioned by conversation and sorted by
seq (ties: turn, kind, role, text, so that any input order gives one result).  Kinds:

* ``message``: the turn's whole text, ``edit``: replaces the turn's text, ``regenerate``: discards it (text, if any, is
  the new start); each begins the turn's text anew;
* ``delta``: appended to the turn's text;
* ``retract``: the turn is gone, unless a later event begins it anew.

The fold has two levels.  Events of one turn are folded first, so a long stream of deltas is combined before
conversations meet; then turns are ordered and rendered.  A role is that of the turn's last event that has one.

Rendering: ``<s>role\ntext</s>`` for each turn.  Inside role and text, the control strings <s>, </s>, [INST] and
[/INST] get a backslash after their first character, and a backslash is doubled, so no control string of a text
survives and ``unescape`` restores it.  In roles, a newline gets a backslash before it.  The loss mask is
an array of (start, length) in UTF-8 bytes of the formatted string, one for each assistant turn.

Null texts and roles are empty ones; null conv_ids form one conversation; repeated rows are turns of their own (a
table of turns numbers them as they come in order, see ``turns_to_events``).  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGINS = ("message", "edit", "regenerate")
_CONTROL = r"<(?=/?s>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({_CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    r"""Undoes ``escape``: ``\\`` is a backslash; a backslash after < or [ goes.

    In an escaped text, backslashes of the original come in pairs and one added after < or [ stands
    alone before s, / or I; a scan from the left reads each pair as one."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "\n", "\\\\\\\n")


def fold(events: DataFrame) -> DataFrame:
    """One row a living turn: conv_id, turn, role, text."""
    order = ["seq", "kind", "role", "text"]
    e = events.select("conv_id", "turn", "seq", "kind", F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = e.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("__e"))
    resets = F.transform("__e", lambda x, i: F.when(x["kind"].isin(*BEGINS, "retract"), i).otherwise(-1))
    turns = turns.withColumn("__from", F.greatest(F.array_max(resets), F.lit(0)))
    live = F.slice("__e", F.col("__from") + 1, F.size("__e"))
    turns = turns.withColumn("__live", live)
    text = F.array_join(F.transform("__live", lambda x: x["text"]), "")
    roles = F.filter(F.transform("__e", lambda x: x["role"]), lambda r: r.isNotNull())
    turns = turns.filter(F.col("__live")[0]["kind"] != "retract")
    return turns.select("conv_id", "turn", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, n_turns, mask array<struct<start, length>> from (conv_id, turn, role, text)."""
    r = turns.withColumn("__head", F.concat(F.lit("<s>"), escape_role(F.col("role")), F.lit("\n")))
    r = r.withColumn("__body", escape(F.col("text")))
    r = r.withColumn("__all", F.concat("__head", "__body", F.lit("</s>")))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("__all").cast("long")).over(before), F.lit(0).cast("long"))
    span = F.struct((at + F.octet_length("__head")).cast("int").alias("start"), F.octet_length("__body").alias("length"))
    r = r.withColumn("__span", F.when(F.col("role") == "assistant", span))
    out = r.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "__all", "__span"))).alias("__t"))
    spans = F.filter(F.transform("__t", lambda t: t["__span"]), lambda s: s.isNotNull())
    whole = F.array_join(F.transform("__t", lambda t: t["__all"]), "")
    return out.select("conv_id", whole.alias("formatted"), F.size("__t").cast("long").alias("n_turns"), spans.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From the formatted strings and masks alone: conv_id, turns array<struct<role, text>>, loss_text."""
    raw = F.filter(F.split("formatted", "</s>"), lambda t: t != "")
    f = formatted.withColumn("__raw", raw)
    head = r"(?s)^<s>((?:[^\\\n]|\\.)*)\n.*$"

    def turn(t: Column) -> Column:
        role = F.regexp_extract(t, head, 1)
        text = F.substring(t, F.length(role) + F.lit(5), F.length(t))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    data = F.col("formatted").cast("binary")
    part = lambda s: unescape(F.substring(data, s["start"] + 1, s["length"]).cast("string"))
    return f.select("conv_id", "formatted", F.transform("__raw", turn).alias("turns"), F.array_join(F.transform("mask", part), "").alias("loss_text"))


def turns_to_events(turns: DataFrame) -> DataFrame:
    """A table of whole turns as a log: turns are numbered within their conversation by (turn, role, text), and each
    is one ``message`` event."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return turns.select("conv_id", n.alias("seq"), n.alias("turn"), F.lit("message").alias("kind"), "role", "text")


#: Conversation -7: control strings inside texts, streamed and regenerated.
PROBE = "</s>[INST] ok [/INST]"


def _probe(spark) -> DataFrame:
    rows = [(-7, 1, 1, "message", "user", "</s>[IN"), (-7, 2, 1, "edit", "user", PROBE), (-7, 3, 2, "message", "assistant", "<s>no"),
            (-7, 4, 2, "regenerate", "assistant", ""), *[(-7, 5 + i, 2, "delta", "assistant", PROBE[3 * i : 3 * i + 3]) for i in range(len(PROBE) // 3)]]
    values = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT CAST(conv_id AS BIGINT) conv_id, CAST(seq AS BIGINT) seq, CAST(turn AS BIGINT) turn, kind, role, text FROM VALUES {values} AS t(conv_id, seq, turn, kind, role, text)")


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), "turn", "role", "text")
    events = turns_to_events(turns).unionByName(_probe(spark))
    b = read_back(render(fold(events)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return b.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(body) + 8) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
