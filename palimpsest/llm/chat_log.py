"""Event-sourced conversations: logs are folded into final messages, rendered, and read back.

Events of a message: `start` names its role, `delta` adds text, `edit` puts a new text in place of
all before it, `regenerate` drops all before it. The template marks every turn and breaks control
strings inside texts with a private-use character, so that a mark is always a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from palimpsest.llm.expressions import let

BREAK = "\ue000"
#: role, opening mark, closing mark
MARKS = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
OTHER = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
CONTROL = (*[mark for _, *marks in MARKS for mark in marks], *OTHER)


def escape(text: Column) -> Column:
    """`text` without control strings: BREAK stands after their first character, and a `0` after every BREAK of the text itself."""
    out = F.replace(text, F.lit(BREAK), F.lit(BREAK + "0"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + BREAK + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark[0] + BREAK + mark[1:]), F.lit(mark))
    return F.replace(out, F.lit(BREAK + "0"), F.lit(BREAK))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv, message, role, text) of events (conv, message, seq, kind, role, text).

    Events of a message are put in the order of seq (equal ones by kind, then text). A message
    without `start` has an empty role; null texts are empty; unknown kinds and repeated starts after
    the first change nothing. Messages without any event do not exist.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    roles = F.min(F.when(F.col("kind") == "start", F.struct("seq", F.coalesce("role", F.lit("")).alias("role"))))
    whole = events.groupBy("conv", "message").agg(F.sort_array(F.collect_list(event)).alias("log"), roles.alias("role"))

    def final(log: Column) -> Column:
        resets = F.transform(log, lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(F.lit(-1)))
        return let(F.array_max(resets), lambda last: F.array_join(F.transform(log, lambda e, i: F.when(((i > last) & (e["kind"] == "delta")) | ((i == last) & (e["kind"] == "edit")), e["text"]).otherwise("")), ""))

    return whole.select("conv", "message", F.coalesce("role.role", F.lit("")).alias("role"), let(F.col("log"), final).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: conv, formatted, loss (start and length, in code points, of every assistant text).

    `messages` has conv, message (order), role, text; ties in the order go by role and text. Null
    texts and roles are empty. A null conv is a conversation of its own.
    """
    plain = messages.select("conv", "message", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    begin, end = F.concat(F.lit(OTHER[0]), escape(F.col("role")), F.lit(OTHER[1])), F.lit(OTHER[2])
    for role, opening, closing in MARKS:
        begin, end = F.when(F.col("role") == role, F.lit(opening)).otherwise(begin), F.when(F.col("role") == role, F.lit(closing)).otherwise(end)
    pieces = plain.withColumns({"begin": begin, "piece": F.concat(begin, "body", end)})
    before = Window.partitionBy("conv").orderBy("message", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(
        "conv", "message", "role", "piece",
        (F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("begin")).alias("start"),
        F.char_length("body").cast("bigint").alias("length"),
    )
    turns = placed.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("start", "role", "piece", "length"))).alias("turns"))
    return turns.select(
        "conv",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    opens = [opening for _, opening, _ in MARKS] + [OTHER[0]]
    at = "(?=" + "|".join(mark.replace("[", r"\[").replace("]", r"\]") for mark in opens) + ")"

    def read(chunk: Column) -> Column:
        role = F.substring_index(F.substring(chunk, len(OTHER[0]) + 1, 1 << 30), OTHER[1], 1)
        body = F.substring(chunk, F.lit(len(OTHER[0]) + len(OTHER[1]) + 1) + F.char_length(role), F.char_length(chunk))
        out = F.struct(unescape(role).alias("role"), unescape(F.substring(body, F.lit(1), F.char_length(body) - len(OTHER[2]))).alias("text"))
        for name, opening, closing in MARKS:
            text = F.substring(chunk, F.lit(len(opening) + 1), F.char_length(chunk) - len(opening) - len(closing))
            out = F.when(F.startswith(chunk, F.lit(opening)), F.struct(F.lit(name).alias("role"), unescape(text).alias("text"))).otherwise(out)
        return out

    return F.transform(F.filter(F.split(formatted, at), lambda c: c != ""), read)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return let(formatted, lambda f: F.array_join(F.transform(loss, lambda s: unescape(F.substring(f, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""))
