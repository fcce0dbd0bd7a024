"""Prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its reply is trainable.  Only DataFrame functions run here.

The template writes a turn as ``<s>role`` newline ``text</s>``.  Inside roles and
texts the backslash and both marks are written as a backslash and a digit, so
that a text can never end a turn and every text can be read back unchanged.

* A null role or text is empty.  Turns are ordered by turn number (null first),
  then role, then text, so repeated turn numbers have one defined order and
  repeated rows are repeated turns.  Rows without conversation id form one
  conversation with a null id.
* If a conversation does not end with an assistant turn, an example without a
  trainable part (``loss_chars`` 0, ``target_turn`` null) carries it whole, so
  the output holds every turn of every conversation.
* Prefixes make the output quadratic in the number of turns of a conversation;
  that is what the method yields.  A conversation is held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
# A character or mark, and what stands for it.
CODES = (("\\", "\\0"), (CLOSE, "\\1"), (OPEN, "\\2"), ("\n", "\\3"))


def escape(value: Column, newline: bool = False) -> Column:
    for plain, code in CODES[:4 if newline else 3]:
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def unescape(value: Column) -> Column:
    for plain, code in reversed(CODES):  # the backslash itself comes last
        value = F.replace(value, F.lit(code), F.lit(plain))
    return value


def prefix_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """Rows ``conv_id, target_turn, example_no, text, loss_start, loss_chars``;
    ``loss_start`` counts code points of ``text`` from 0."""
    part = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"),
                 F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = part.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = whole.withColumn("marked", F.transform("turns", lambda t: F.concat(
        F.lit(OPEN), escape(t["role"], newline=True), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (
        (F.get("turns", i - 1)["role"] == target_role) | (i == F.size("turns"))))
    each = written.select("conv_id", "turns", "marked", F.posexplode(ends).alias("example_no", "upto"))
    last = F.get("turns", F.col("upto") - 1)
    reply = F.length(escape(last["text"]))
    trains = last["role"] == target_role
    text = F.concat_ws("", F.slice("marked", F.lit(1), F.col("upto")))
    return (each.select("conv_id", F.when(trains, last["turn"]).alias("target_turn"), "example_no",
                        text.alias("text"), F.when(trains, reply).otherwise(0).alias("loss_chars"))
            .select("conv_id", "target_turn", "example_no", "text",
                    (F.length("text") - len(CLOSE) - F.col("loss_chars")).alias("loss_start"), "loss_chars"))


def read_turns(text: Column) -> Column:
    """Array of ``(role, text)`` of a formatted example."""
    parts = F.split(text, CLOSE)
    bare = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substring(p, len(OPEN) + 1, 2**31 - 1))
    return F.transform(bare, lambda p: F.struct(
        unescape(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))


def read_loss(text: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(text, start + 1, chars))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the examples hold, read back per conversation."""
    loss = F.struct("example_no", read_loss(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss"))
    per = examples.groupBy("conv_id").agg(
        F.max_by("text", "example_no").alias("whole"), F.sort_array(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    turns = read_turns(F.col("whole"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    trained = F.concat_ws("", F.transform("losses", lambda x: x["loss"]))
    return (per.withColumn("turns", turns).withColumn("said", said).withColumn("trained", trained)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(F.encode("said", "utf-8"), 256).alias("turns_sha256"),
                    F.length("trained").cast("long").alias("loss_chars"),
                    F.sha2(F.encode("trained", "utf-8"), 256).alias("loss_sha256"), "formatted_chars"))
