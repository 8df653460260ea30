"""Chat formatting: turns to one training text with a loss mask, and back, with DataFrame functions only.

A conversation is put together in two steps, blocks of consecutive turns first and then the blocks, so that
no task holds more than one block of a long conversation before its text is joined. Turns that are a block's by their
numbers, but too many (equal or null numbers), are counted in order over the whole cluster and dealt into blocks by
their places. In a block the sorted turns are folded to runs of one role; where two blocks meet inside a run,
the second goes on with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.staging import Stage, small_side
from millrace.operators.ordered import ordered_columns

#: The control strings of the template. A run of turns of one role is
#: ``[INST]role[/INST]text<s>text...</s>``; ``<s>`` parts turns that were merged.
OPEN, CLOSE, PART, END = "[INST]", "[/INST]", "<s>", "</s>"
#: A backslash goes before each backslash of a text and after the first character of each control string in it.
CONTROL = r"([<\[])(?=/?s>|/?INST\])"


@dataclass(frozen=True)
class ChatColumns:
    conv: str = "conv_id"
    turn: str = "turn"
    role: str = "role"
    text: str = "text"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, *, columns: ChatColumns = ChatColumns(), learn: str = "assistant", block: int = 64) -> DataFrame:
    """One row per conversation: the conversation's column, ``formatted`` and ``mask``.

    ``mask`` has a struct for each turn in order: ``skip`` code points of markup, then ``take`` code points of
    escaped text, which count for the loss if ``loss``. What is left over is the closing ``</s>``.

    Edge cases: turns are ordered by turn, nulls first, ties by role and text, so repeated rows stay and have a
    defined place; a null text or role is ``""``; rows with a null conversation are one conversation; an empty
    table gives an empty table; other columns are not read. A block has four times ``block`` rows at most, however
    many have one turn number, and however many are equal.
    """
    c = columns
    rows = turns.select(
        F.col(f"`{c.conv}`").alias("_c"),
        F.col(f"`{c.turn}`").alias("_n"),
        F.coalesce(F.col(f"`{c.role}`"), F.lit("")).alias("_r"),
        F.coalesce(F.col(f"`{c.text}`"), F.lit("")).alias("_x"),
    )
    rows = _in_blocks(rows.withColumn("_b", F.floor(F.col("_n") / block)), block)

    head = lambda role: F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE))
    # the markup before a block, by the role that the block before ends with
    lead = lambda before, role: F.when(before.isNull(), head(role)).when(before == role, F.lit(PART)).otherwise(F.concat(F.lit(END), head(role)))
    sorted_turns = F.sort_array(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("_r").alias("r"), F.col("_x").alias("x"))))
    blocks = rows.groupBy("_c", "_b", "_s").agg(sorted_turns.alias("_t"))
    nothing = F.array().cast("array<struct<r:string,x:array<string>>>")

    def merge(runs: Column, t: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        longer = F.struct(t["r"].alias("r"), F.concat(last["x"], F.array(t["x"])).alias("x"))
        more = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))
        return F.when(last["r"] == t["r"], more).otherwise(F.concat(runs, F.array(F.struct(t["r"].alias("r"), F.array(t["x"]).alias("x")))))

    blocks = blocks.select("_c", "_b", "_s", F.aggregate("_t", nothing, merge).alias("_u"))
    # inside a block the first turn's markup is left for the next step
    start = lambda i, role: F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit(END), head(role)))
    one = lambda u, i: F.transform(u["x"], lambda x, j: F.struct(F.when(j > 0, F.lit(PART)).otherwise(start(i, u["r"])).alias("m"), escape(x).alias("x"), (u["r"] == learn).alias("loss")))
    blocks = blocks.select("_c", "_b", "_s", F.element_at("_u", 1)["r"].alias("first"), F.element_at("_u", -1)["r"].alias("last"), F.flatten(F.transform("_u", one)).alias("_p"))
    body = F.array_join(F.transform("_p", lambda p: F.concat(p["m"], p["x"])), "")
    mask = F.transform("_p", lambda p: F.struct(F.char_length(p["m"]).alias("skip"), F.char_length(p["x"]).alias("take"), p["loss"].alias("loss")))
    blocks = blocks.select("_c", F.struct("_b", "_s", "first", "last", body.alias("body"), mask.alias("mask")).alias("_s"))
    chats = blocks.groupBy("_c").agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    chats = chats.withColumn("_lead", F.transform("_s", lambda s, i: lead(F.get(F.col("_s"), i - 1)["last"], s["first"])))
    joined = F.array_join(F.zip_with("_lead", F.transform("_s", lambda s: s["body"]), lambda a, b: F.concat(a, b)), "")
    grow = lambda m, extra: F.transform(m, lambda x, i: F.struct((x["skip"] + F.when(i == 0, extra).otherwise(0)).alias("skip"), x["take"].alias("take"), x["loss"].alias("loss")))
    masks = F.flatten(F.transform("_s", lambda s, i: grow(s["mask"], F.char_length(F.get(F.col("_lead"), i)))))
    return chats.select(F.col("_c").alias(c.conv), F.concat(joined, F.lit(END)).alias("formatted"), masks.alias("mask"))


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with the part ``_s`` of their block ``_b`` of conversation ``_c``: 0 unless the block has too many rows.

    Rows of such a block are counted in order; equal rows are one row with their number until they have their places.
    """
    stage = Stage(rows.sparkSession, "chat_format")
    many = stage.write(rows.groupBy(F.col("_c").alias("_mc"), F.col("_b").alias("_mb")).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > 4 * block).drop("_m"), "many")
    plain = rows.withColumn("_s", F.lit(0).cast("long"))
    if many.isEmpty():
        return plain
    few = small_side(many)
    same = F.col("_c").eqNullSafe(F.col("_mc")) & F.col("_b").eqNullSafe(F.col("_mb"))
    own = ("_n", "_r", "_x")
    large = rows.join(few, same, "left_semi").groupBy("_c", "_b", *own).agg(F.count(F.lit(1)).alias("_m"))
    placed = ordered_columns(large, by=("_c", "_b"), order=own, running={"_upto": F.col("_m")})
    each = placed.withColumn("_at", F.explode(F.sequence(F.col("_upto") - F.col("_m"), F.col("_upto") - 1)))
    return rows.join(few, same, "left_anti").withColumn("_s", F.lit(0).cast("long")).unionByName(each.select("_c", *own, "_b", F.floor(F.col("_at") / block).cast("long").alias("_s")))


def read_chats(chats: DataFrame, *, columns: ChatColumns = ChatColumns(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Back from ``formatted`` and ``mask``: the conversation's column, ``turns`` (role, text, loss), ``loss_text``.

    ``loss_text`` joins, unescaped, the texts that the mask counts; columns in ``keep`` are carried along. Every
    ``skip`` must be the length of the markup that stands there and every ``take`` that of the text, so that
    what lies under the mask is these texts; a mask that does not fit raises. A null ``formatted`` or ``mask`` raises too, and
    an empty table gives an empty table.
    """
    runs = F.split(F.expr(f"substring(formatted, 1, char_length(formatted) - {len(END)})"), END)
    halves = F.transform(runs, lambda r: F.split(F.substring(r, len(OPEN) + 1, 2**30), "\\[/INST\\]"))
    markup = lambda role, r: F.when(r > 0, len(END)).otherwise(0) + len(OPEN) + F.char_length(role) + len(CLOSE)
    part = lambda h, r: F.transform(F.split(h[1], PART), lambda x, j: F.struct(unescape(h[0]).alias("role"), x.alias("x"), F.when(j > 0, len(PART)).otherwise(markup(h[0], r)).alias("skip")))
    parts = F.flatten(F.transform(halves, part))
    carried = [F.col(f"`{c}`") for c in (columns.conv, *keep)]
    read = chats.select(*carried, parts.alias("_p"), "mask")
    each = F.zip_with("_p", "mask", lambda p, m: F.coalesce((p["skip"] == m["skip"]) & (F.char_length(p["x"]) == m["take"]), F.lit(False)))
    fits = F.coalesce((F.size("_p") == F.size("mask")) & F.forall(each, lambda x: x), F.lit(False))
    checked = read.withColumn("_p", F.when(fits, F.col("_p")).otherwise(F.raise_error(F.lit("the mask does not fit the text")).cast("array<struct<role:string,x:string,skip:int>>")))
    turns = F.zip_with("_p", "mask", lambda p, m: F.struct(p["role"].alias("role"), unescape(p["x"]).alias("text"), m["loss"].alias("loss")))
    told = checked.select(*carried, turns.alias("turns"))
    return told.withColumn("loss_text", F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), ""))
