"""Prefix-target chat examples, in DataFrame expressions only.

Every assistant turn becomes an example of its own: all turns before it are context,
and only its own text is trainable. Turns after the last assistant turn make one more
example without a trainable part, so that the output holds the whole conversation.

Format: ``<s>``, then for each turn ``[INST]role[/INST]text</s>``. Control strings
inside roles and texts are escaped with a backslash and a letter, a backslash itself as
``\\-``; as no escape has a control string in it, and none of the control strings begins
with what another ends in, text can't be taken for a mark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    open: str = "[INST]"
    middle: str = "[/INST]"
    close: str = "</s>"
    trainable: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[tuple[str, str]]:
        """(string, its escape)."""
        return [("\\", "\\-"), (self.begin, "\\a"), (self.open, "\\b"), (self.middle, "\\c"), (self.close, "\\d")]


def escaped(c: Column, t: Template = Template()) -> Column:
    for plain, code in t.controls:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, t: Template = Template()) -> Column:
    for plain, code in reversed(t.controls):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def formatted_turn(role: Column, text: Column, t: Template = Template()) -> Column:
    return F.concat(F.lit(t.open), escaped(role, t), F.lit(t.middle), escaped(text, t), F.lit(t.close))


def examples(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """Rows conv_id, example_no (from 0), formatted, loss_start, loss_length (code points
    of the formatted text under the loss mask; 0, 0 in the last example of a conversation
    that doesn't end in a trainable turn) and last (the conversation's last example).

    Turns go by (turn, role, text); null roles and texts are empty; a null conv_id is a
    conversation of its own; repeated rows are repeated turns. An example's text holds
    all of its context: a conversation has to fit in a row.
    """
    made = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    grouped = made.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    piece = grouped.select("conv_id", F.transform("turns", lambda x: F.struct(formatted_turn(x["role"], x["text"], t).alias("made"), F.length(escaped(x["text"], t)).alias("n"), x["role"].isin(*t.trainable).alias("train"))).alias("parts"))
    n = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("parts", i)["train"] | (i == n))
    dealt = piece.select("conv_id", "parts", F.posexplode(ends).alias("example_no", "upto"))
    chosen = F.element_at("parts", F.col("upto"))
    text = F.concat(F.lit(t.begin), F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("upto")), lambda x: x["made"]), ""))
    built = dealt.select("conv_id", "example_no", text.alias("formatted"), F.when(chosen["train"], chosen["n"]).otherwise(0).alias("loss_length"), (F.col("upto") == n).alias("last"))
    return built.select(
        "conv_id",
        F.col("example_no").cast("long").alias("example_no"),
        "formatted",
        F.when(F.col("loss_length") > 0, F.length("formatted") - len(t.close) - F.col("loss_length")).otherwise(0).alias("loss_start"),
        "loss_length",
        "last",
    )


def parsed_turns(formatted: Column, t: Template = Template()) -> Column:
    """array of (role, text) read back from a formatted example."""
    body = F.substring(formatted, F.lit(len(t.begin) + 1), F.length(formatted))
    parts = F.filter(F.split(body, "\\Q" + t.close + "\\E", -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substring(p, F.lit(len(t.open) + 1), F.length(p)), t.middle, 1), t).alias("role"),
            unescaped(F.substring(p, F.call_function("instr", p, F.lit(t.middle)) + len(t.middle), F.length(p)), t).alias("text"),
        ),
    )


def read_back(made: DataFrame, t: Template = Template()) -> DataFrame:
    """A row for each conversation, from its examples alone: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars (code points of all its examples) and n_examples."""
    loss = F.when(F.col("loss_length") > 0, unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")), t)).otherwise("")
    turns = F.when(F.col("last"), parsed_turns(F.col("formatted"), t))
    told = made.select("conv_id", "example_no", loss.alias("loss"), F.length("formatted").cast("long").alias("chars"), turns.alias("turns"))
    told = told.select(
        "conv_id",
        "example_no",
        "loss",
        "chars",
        F.size("turns").cast("long").alias("n"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("sha"),
        F.col("turns").isNotNull().alias("last"),
    )
    grouped = told.groupBy("conv_id").agg(
        F.max(F.when(F.col("last"), F.col("n"))).alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_sort(F.collect_list(F.struct("example_no", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    together = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.length(together).cast("long").alias("loss_chars"), F.sha2(together, 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def _sql_escaped(c: str, t: Template = Template()) -> str:
    for plain, code in t.controls:
        c = f"replace({c}, '{plain}', '{code}')"
    return c


#: The query as DuckDB SQL: lengths and digests from the turns themselves.
ORACLE_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, {sum(map(len, (Template.open, Template.middle, Template.close)))} + length({_sql_escaped('role')}) + length({_sql_escaped('text')}) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n_all
  FROM rows_
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto + {len(Template.begin)}) FILTER (WHERE role = 'assistant' OR k = n_all) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (WHERE role = 'assistant' OR k = n_all) AS BIGINT) AS n_examples
FROM summed GROUP BY conv_id
"""
