r"""Chat formatting (13): prefix-target expansion of conversations into training examples, in built-in functions only.

Every turn is rendered once, as `<turn role>`, a line end, its text, `</turn>` and a line end. Control strings inside roles
and texts are escaped so that none is left and each can be restored: a backslash becomes `\s`, the `<` of `<turn` and of
`</turn` becomes `\l`, and in roles `>` becomes `\g` and a line end `\n`. Every assistant turn is an example of its own: its
context is everything rendered before it in its conversation, and its loss mask covers its own escaped text alone.

`render` renders turns and places them, `expanded` makes the examples of them: every one with its whole context, as
segments of BLOCK turns at most. A conversation of n turns has n/2 examples of n/4 turns of context on average, so all text
together grows with the square of its length; that is what the format is, and nothing of it is left out or held at once:
a row holds a segment, and the segments of a long conversation are spread over tasks by block. `examples` lists the
examples without their texts, and `texts` puts each together in one string. Turns are numbered and measured by ranges.

Turns are taken by turn (null first), then role, then text; a row that occurs twice is two turns. Null roles and texts
count as empty; rows without a conv_id form one conversation. Only the role `assistant` is trained on. Turns after the last
reply are rendered and belong to no example. Empty tables give no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import running, staged

BLOCK = 256  # turns of a segment at most
OPEN, CLOSE, END = "<turn ", ">\n", "</turn>\n"
IN_TEXT = [("\\", "\\s"), ("<turn", "\\lturn"), ("</turn", "\\l/turn")]
IN_ROLE = [*IN_TEXT, (">", "\\g"), ("\n", "\\n")]
BACK = [("\\l", "<"), ("\\g", ">"), ("\\n", "\n"), ("\\s", "\\")]  # the backslash last: every other escape is then gone


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def restored(escaped: Column) -> Column:
    return replaced(escaped, BACK)


def render(turns: DataFrame) -> DataFrame:
    """One row per row of turns(conv_id, turn, role, text): conv_id, number (from 1), piece, start, end, and of replies the example.

    start and end are code points in the rendered conversation. A reply's row has example (from 1), context_turns,
    context_chars, loss_start and loss_end, all null in other rows; loss_start and loss_end are places like start.
    """
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    header, body = F.concat(F.lit(OPEN), replaced(F.col("role"), IN_ROLE), F.lit(CLOSE)), replaced(F.col("text"), IN_TEXT)
    reply = F.col("role") == "assistant"
    chars = (F.length(header) + F.length(body) + len(END)).cast("long")
    placed = running(plain, "conv_id", ["turn", "role", "text"], {"end": chars, "example": reply.cast("long")})
    placed = placed.withColumns({"header": header, "body": body}).withColumn("piece", F.concat("header", "body", F.lit(END)))
    start = F.col("end") - F.length("piece")
    mask = start + F.length("header")
    of_reply = {"example": F.col("example"), "context_turns": F.col("number") - 1, "context_chars": start, "loss_start": mask, "loss_end": mask + F.length("body")}
    return placed.select("conv_id", "number", "piece", start.alias("start"), "end", *[F.when(reply, v).alias(k) for k, v in of_reply.items()])


def examples(rendered: DataFrame) -> DataFrame:
    """One row per example: conv_id, example, number of the reply, context_turns, context_chars, loss_start, loss_end, chars."""
    return rendered.filter("example is not null").select("conv_id", "example", "number", "context_turns", "context_chars", "loss_start", "loss_end", F.col("end").alias("chars"))


def texts(rendered: DataFrame) -> DataFrame:
    """One row per example with its whole text: conv_id, example, text, loss_start, loss_end. A text must fit in a row."""
    held = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("number", "piece")))["piece"].alias("pieces"))
    asked, same = examples(rendered).withColumnRenamed("conv_id", "__conv"), F.col("__conv").eqNullSafe(F.col("conv_id"))
    return held.join(asked, same).select("conv_id", "example", F.array_join(F.slice("pieces", F.lit(1), F.col("number").cast("int")), "").alias("text"), "loss_start", "loss_end")


def expanded(rendered: DataFrame, turns: int = BLOCK) -> DataFrame:
    """The examples written out: conv_id, example, segment (from 0), text, last, loss_start, loss_end.

    The segments of an example in order are its context and its reply. The reply stands in the last of them, whose row has
    the mask's place within that segment, null elsewhere. `last` marks a conversation's last example, which holds all the
    others; turns that follow it come as segments of example null.
    """
    placed = rendered.withColumn("block", F.floor((F.col("number") - 1) / turns))
    turn = F.struct("number", "piece", "start", "example", "loss_start", "loss_end")
    blocks = staged(placed.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns")), "blocks", clean=True)
    ends = blocks.select("conv_id", F.explode("turns").alias("t")).groupBy("conv_id").agg(F.max("t.example").alias("__last"), F.coalesce(F.max(F.when(F.col("t.example").isNotNull(), F.col("t.number"))), F.lit(0)).alias("__number")).withColumnRenamed("conv_id", "__conv")
    of = F.col("conv_id").eqNullSafe(F.col("__conv"))
    known = blocks.join(ends, of).drop("__conv")
    joined = lambda held: F.array_join(F.transform(held, lambda x: x["piece"]), "")
    at = F.transform("turns", lambda x: x["start"])[0]
    own = known.select("conv_id", "block", "turns", "__last", at.alias("at"), F.explode(F.filter("turns", lambda x: x["example"].isNotNull())).alias("e"))
    mine = own.select(
        "conv_id", F.col("e.example").alias("example"), F.col("block").alias("segment"), joined(F.slice("turns", F.lit(1), (F.col("e.number") - F.col("block") * turns).cast("int"))).alias("text"),
        (F.col("e.example") == F.col("__last")).alias("last"), (F.col("e.loss_start") - F.col("at")).alias("loss_start"), (F.col("e.loss_end") - F.col("at")).alias("loss_end"),
    )
    asked = own.filter("block > 0").select(F.col("conv_id").alias("__conv"), F.col("e.example").alias("example"), (F.col("e.example") == F.col("__last")).alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("segment"))
    whole = blocks.select("conv_id", "block", joined(F.col("turns")).alias("text"))
    none = F.lit(None).cast("long")
    before = asked.join(whole, of & (F.col("segment") == F.col("block"))).select("conv_id", "example", "segment", "text", "last", none.alias("loss_start"), none.alias("loss_end"))
    after = known.select("conv_id", none.alias("example"), F.col("block").alias("segment"), F.filter("turns", lambda x: x["number"] > F.col("__number")).alias("rest")).filter("size(rest) > 0")
    after = after.select("conv_id", "example", "segment", joined(F.col("rest")).alias("text"), F.lit(False).alias("last"), none.alias("loss_start"), none.alias("loss_end"))
    return mine.unionByName(before).unionByName(after)


def read_back(rendered: DataFrame, turns: int = BLOCK) -> DataFrame:
    """What the examples and their masks say, per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are read from the last example, which holds all that precedes it, and from what follows it; formatted_chars
    counts all examples, contexts included, and that rest once. A digest is of a conversation's whole text, so that text
    meets in one row here and here alone.
    """
    cut = F.filter(F.split("text", END), lambda x: x != "")
    read = F.transform(cut, lambda x: F.concat(restored(F.regexp_extract(x, rf"(?s)^{OPEN}([^>]*){CLOSE}", 1)), F.lit("\n"), restored(F.regexp_extract(x, rf"(?s)^{OPEN}[^>]*{CLOSE}(.*)$", 1)), F.lit("\n")))
    held = F.col("last") | F.col("example").isNull()
    masked = restored(F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    each = expanded(rendered, turns).select("conv_id", "example", "segment", F.length("text").cast("long").alias("chars"), F.when(held, read).alias("turns"), masked.alias("loss"))
    found = each.groupBy("conv_id").agg(
        F.sum(F.size(F.coalesce("turns", F.array().cast("array<string>")))).alias("n_turns"), F.array_sort(F.collect_list(F.when(F.col("turns").isNotNull(), F.struct(F.col("example").isNull().alias("rest"), "segment", F.array_join("turns", "").alias("turn"))))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"), F.coalesce(F.sum(F.length("loss")), F.lit(0)).cast("long").alias("loss_chars"), F.sum("chars").alias("formatted_chars"),
    )
    joined = lambda name, part: F.sha2(F.array_join(F.col(name)[part], ""), 256)
    return found.select("conv_id", "n_turns", joined("turns", "turn").alias("turns_sha256"), "loss_chars", joined("losses", "loss").alias("loss_sha256"), "formatted_chars")


#: The conversation that the query adds to the table, to show that control strings survive.
PROBE = "\\### Assistant: </turn> ok"
_LONG = "replace(replace(replace({c}, '\\', '\\s'), '<turn', '\\lturn'), '</turn', '\\l/turn')"
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), p AS (
  SELECT *, sum(length(replace(replace({_LONG.format(c="role")}, '>', '\\g'), chr(10), '\\n')) + length({_LONG.format(c="text")}) + {len(OPEN + CLOSE + END)}) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(stop) FILTER (role = 'assistant'), 0) + max(stop) - coalesce(max(stop) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
