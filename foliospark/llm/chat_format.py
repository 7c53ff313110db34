"""Chat formatting: prefix-target expansion with one trainable reply per example."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import table

#: The template: a turn is TURN role BODY text END.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that steer a model, the template's own among them. None survives inside a text.
ANGLED = r"<(?=/?s>|\|(?:turn|body|end)\|>)"
SQUARE = r"\[(?=/?INST\])"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    r"""text without control strings: \ becomes \\, and a control string's first character \l or \b."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, ANGLED, r"\\l"), SQUARE, r"\\b")


def unescaped(text: Column) -> Column:
    r"""The inverse of escaped. Between pairs of \\, each \l and \b is an escape."""
    bare = lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.array_join(F.transform(F.split(text, r"\\\\"), bare), "\\")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Training examples: each assistant turn with all turns before it.

    Only the reply's text is trainable: loss_start (from 0) and loss_length are its code points in
    `formatted`. What follows a conversation's last reply, or a conversation without one, becomes
    an example with nothing to train on, so that no turn is lost. Turns are ordered by turn, then
    role and text, so ties and repeated rows are kept in a defined order; null roles and texts
    count as empty; a null conversation is a conversation. Returns conv_id, example (from 0),
    formatted, loss_start, loss_length; an empty table gives an empty result, and other columns
    are not read.

    A conversation is gathered in one row: every example holds its prefix, so it has to fit there.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    role = F.coalesce(F.col(role_col), F.lit(""))
    gathered = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")))).alias("turns")
    )
    head = lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(BODY))
    rendered = gathered.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == ASSISTANT).alias("reply"))).alias("turns"),
    )
    at = F.col("turns")
    ends = F.filter(F.sequence(F.lit(1), F.size(at)), lambda k: F.get(at, k - 1)["reply"] | (k == F.size(at)))
    examples = rendered.select("conv_id", "turns", F.posexplode(ends).alias("example", "last"))
    prefix = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("last") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    target = F.get("turns", F.col("last") - 1)
    before = F.concat(prefix, target["head"])
    return examples.select("conv_id", "example", before.alias("before"), target["body"].alias("body"), target["reply"].alias("reply")).select(
        "conv_id", "example",
        F.concat("before", "body", F.lit(END)).alias("formatted"),
        F.char_length("before").alias("loss_start"),
        F.when(F.col("reply"), F.char_length("body")).otherwise(0).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example as an array of (role, text), read from the string alone."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    parts = lambda x: F.split(F.substring(x, len(TURN) + 1, 1 << 30), r"<\|body\|>")
    return F.transform(pieces, lambda x: F.struct(unescaped(F.get(parts(x), F.lit(0))).alias("role"), unescaped(F.get(parts(x), F.lit(1))).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples say, per conversation, as lengths and digests."""
    trained = unescaped(F.expr("substring(formatted, loss_start + 1, loss_length)"))
    read = examples.select("conv_id", "example", "formatted", trained.alias("trained"))
    merged = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", "trained"))).alias("trained"),
        F.sum(F.char_length("formatted").cast("long")).alias("formatted_chars"),
    )
    merged = merged.select(
        "conv_id", read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("trained", lambda x: x["trained"]), "").alias("trained"), "formatted_chars"
    )
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return merged.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '{0}'), (-7L, 1L, 'assistant', '{0}') AS t(conv_id, turn, role, text)".format(control)
    )
    return read_back(format_chats(turns.unionByName(extra)))


QUERIES = {"op9_chat_format": op9_chat_format}

ORACLE_SQL = {
    "op9_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<|turn|><|body|><|end|>') + length(role) + length(text)
    + length(regexp_replace(role || text, '[^\\]+', '', 'g'))
    + length(regexp_replace(text, '</?s>|<\|(turn|body|end)\|>|\[/?INST\]', '\0_', 'g')) - length(text)
    + length(regexp_replace(role, '</?s>|<\|(turn|body|end)\|>|\[/?INST\]', '\0_', 'g')) - length(role) AS size
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(so_far) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
}
