"""Chat formatting with Spark expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one role are merged into a
block by array functions, and blocks are concatenated. The loss mask is a list of spans of the formatted
string. Control strings inside texts and roles are escaped, so that parse_chat() gives back every turn.

    <|im_start|>user<|im_sep|>text<|im_cont|>text of the next user turn<|im_end|>

One group-by shuffle of the turns; a conversation is one row of the result, so its own length, not the
table's, bounds a group.

Defined results: a null text or role is the empty string; turns are ordered by (turn, role, text) with
nulls first, so ties and repeated rows keep a fixed order and all of them appear; conversations with a
null conv_id form one conversation; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import read_table

START, SEP, CONT, END = "<|im_start|>", "<|im_sep|>", "<|im_cont|>", "<|im_end|>"
#: What a text may not hold unescaped: our own markers' opening, and the markers of other common templates.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?SYS>>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?SYS>>|/?INST\])"
TRAINED = "assistant"
PLANTED = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    """Puts a backslash after the first character of every control string; of escaped ones too."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _literal(marker: str) -> str:
    return r"\Q" + marker + r"\E"


def _last(i: Column, starts: Column, turns: Column) -> Column:
    """The index after the last turn of the block that begins at the i-th of starts."""
    return F.when(i + 1 < F.size(starts), F.get(starts, i + 1)).otherwise(F.size(turns))


def format_chat(frame: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = TRAINED) -> DataFrame:
    """conv_id, formatted, loss_mask (array of start, from 0, and length in code points): one row per conversation."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        escape(F.coalesce(F.col(role_col).cast("string"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"),
    )
    sorted_turns = frame.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get(F.col("turns"), i)["role"] != F.get(F.col("turns"), i - 1)["role"]),
    )
    blocks = F.transform(
        F.col("starts"),
        lambda s, i: F.struct(
            F.get(F.col("turns"), s)["role"].alias("role"),
            F.transform(F.slice(F.col("turns"), s + 1, _last(i, F.col("starts"), F.col("turns")) - s), lambda t: t["text"]).alias("texts"),
        ),
    )
    rendered = F.transform(F.col("blocks"), lambda b: F.concat(F.lit(START), b["role"], F.lit(SEP), F.array_join(b["texts"], CONT), F.lit(END)))
    # the place of every block, then of every trained text in it
    spans = F.aggregate(
        F.col("blocks"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
        lambda acc, b: F.aggregate(
            b["texts"],
            F.struct((acc["at"] + F.lit(len(START) + len(SEP)) + F.length(b["role"])).alias("at"), acc["spans"].alias("spans")),
            lambda own, text: F.struct(
                (own["at"] + F.length(text) + F.lit(len(CONT))).alias("at"),
                F.when(b["role"] == trained_role, F.concat(own["spans"], F.array(F.struct(own["at"].alias("start"), F.length(text).cast("long").alias("length"))))).otherwise(own["spans"]).alias("spans"),
            ),
            lambda own: F.struct((own["at"] - F.lit(len(CONT)) + F.lit(len(END))).alias("at"), own["spans"].alias("spans")),
        ),
        lambda acc: acc["spans"],
    )
    return (
        sorted_turns.withColumn("starts", starts)
        .withColumn("blocks", blocks)
        .select("conv_id", F.array_join(rendered, "").alias("formatted"), spans.alias("loss_mask"))
    )


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped, in order."""
    blocks = F.filter(F.split(formatted, _literal(END)), lambda b: b != "")
    turns = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(F.substring_index(b, SEP, -1), _literal(CONT)),
            lambda text: F.struct(unescape(F.replace(F.substring_index(b, SEP, 1), F.lit(START), F.lit(""))).alias("role"), unescape(text).alias("text")),
        ),
    )
    return F.flatten(turns)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, without anything between the spans."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"].cast("int") + 1, m["length"].cast("int")))), "")


def chat_digest(frame: DataFrame) -> DataFrame:
    out = format_chat(frame).withColumn("turns", parse_chat(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_mask")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(joined, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PLANTED).alias("text")) for i, role in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    return chat_digest(rows.unionByName(planted))


_T = r"regexp_replace(coalesce({0}, ''), '([<\[])(\\*)(\||/?s>|/?SYS>>|/?INST\])', '\1\\\2\3', 'g')"
ORACLE_SQL = {
    "op9_chat_format": rf"""
WITH rows_ AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {_T.format("role")} AS erole, {_T.format("text")} AS etext,
    lag(coalesce(role, '')) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_T.format("role")}, {_T.format("text")}) AS before
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, erole, etext)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, erole, etext), '')) AS loss_sha256,
  sum(length(etext) + CASE WHEN before IS NULL OR before <> role THEN length(erole) + {len(START) + len(SEP) + len(END)} ELSE {len(CONT)} END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""
}
QUERIES = {"op9_chat_format": op9_chat_format}
