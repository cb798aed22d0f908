"""Operator 12 [native]: chat formatting in budgeted windows.

A conversation becomes windows of at most `budget` tokens. Each window holds the leading system turn, some turns of history
that earlier windows hold already, and new turns; only new assistant turns are under its loss mask, so every assistant
text is a target once. Turns are never cut.

Spans of new turns come from prefix sums of the turns' tokens, not from a walk over the conversation: with `room` tokens a
window for new turns, a turn that ends at e tokens belongs to cell (e - 1) div room. Only the first turn of a cell can
have begun in an earlier one; if the cell's turns exceed room, that turn is a window of its own, otherwise the whole cell
is one. History are the turns that end before a span starts and began at most `history` tokens earlier. All of it is
sums and equality joins on (conversation, cell), so no task sees a conversation as a whole: prefix sums of a conversation
of more than `block` turns are taken in blocks between quantiles of its turn numbers, then over the blocks' totals.

The text of a window is its rendered turns, one after the other:

    <|im_start|>role\\ntext<|im_end|>\\n

Inside texts "<", any number of backslashes and "|" get one more backslash after "<", which `unescaped` takes away again;
roles write "%", "<" and line feeds as %25, %3C and %0A. So no text can end its turn or open another one.

Defined results: a null text or role is empty; a null conversation id is a conversation; turns are ordered by turn (null
first), role and text, so repeated rows are turns that repeat; a turn longer than room is a window of its own and a long
system turn leaves at least a quarter of the budget for others, so `n_tokens` may exceed the budget then; a system turn is
retained only if it is the first turn; an empty table has no windows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hinted

#: Fixed values of the format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Tokens of a turn's markers.
MARKERS = 4
#: Parts of a conversation whose prefix sums are taken side by side, at most.
QUANTILES = 1000
#: Windows of a conversation that share one copy of its system turn until they are joined.
SHARE = 64


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    for plain, code in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescaped_role(role: Column) -> Column:
    for plain, code in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def _div(a, b) -> Column:
    return F.floor(a / b).cast("long")  # exact below 2 ** 53 tokens


def _blocks(rows: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """rows with `block`: consecutive parts of a long conversation, 0 elsewhere."""
    cuts = F.array_distinct(F.percentile_approx("turn", [k / QUANTILES for k in range(1, QUANTILES)]))
    long = scratch.write(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("conv"), "long")
    long = rows.select("conv", "turn").join(hinted(long, 64), "conv", "left_semi")
    long = scratch.write(long.groupBy("conv").agg(cuts.alias("cuts")), "cuts")
    held = rows.join(hinted(long, F.size("cuts") * 8 + 64), "conv", "left")
    below = F.size(F.filter("cuts", lambda c: c < F.col("turn")))
    part = F.when(F.col("cuts").isNull() | F.col("turn").isNull(), 0).otherwise(below)
    return held.withColumn("block", part).withColumn("parts", F.col("cuts").isNotNull()).drop("cuts")


def _placed(rows: DataFrame, scratch: Scratch, budget: int, history: int, block: int) -> DataFrame:
    """conv, role, text, tokens, lead (is it the retained system turn), begin, end, room: begin and end are the tokens of
    the turns before and with it, those of the system turn left out."""
    order = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    first = F.when((F.col("block") == 0) & (F.row_number().over(order) == 1) & (F.col("role") == "system"), F.col("tokens"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    within = _blocks(rows, scratch, block).withColumns({"upto": F.sum("tokens").over(so_far), "lead": first})
    within = within.withColumn("system", F.coalesce(F.first("lead").over(so_far), F.lit(0)))
    within = within.withColumn("lead", F.col("lead").isNotNull()).select("conv", "block", "parts", "role", "text", "tokens", "upto", "lead", "system")
    within = scratch.write(within, "within")
    totals = within.where("parts").groupBy("conv", "block").agg(F.sum("tokens").alias("total"), F.max("system").alias("own"))
    blocks = Window.partitionBy("conv").orderBy("block")
    before = F.sum("total").over(blocks.rowsBetween(Window.unboundedPreceding, -1))
    retained = F.max("own").over(Window.partitionBy("conv"))
    totals = scratch.write(totals.select("conv", "block", F.coalesce(before, F.lit(0)).alias("before"), retained.alias("retained")), "totals")
    placed = within.join(hinted(totals, 96), ["conv", "block"], "left")
    retained = F.coalesce("retained", "system")
    end = F.coalesce("before", F.lit(0)) + F.col("upto") - retained
    room = F.greatest(F.lit(budget - history) - retained, F.lit(max(1, budget // 4))).cast("long")
    begin = F.when(F.col("lead"), 0).otherwise(end - F.col("tokens"))
    return placed.select("conv", "role", "text", "tokens", "lead", begin.cast("long").alias("begin"), end.alias("end"), room.alias("room"))


def _assigned(turns: DataFrame, scratch: Scratch, history: int) -> DataFrame:
    """turns: conv, tokens, lead, begin, end, room. Returns conv, begin, end, window, new: the windows that show a turn, and
    the one of them in which it is new."""
    cell = _div(F.greatest(F.col("end") - 1, F.lit(0)), F.col("room"))
    celled = turns.withColumn("cell", cell).withColumn("crosses", _div(F.col("begin"), F.col("room")) < F.col("cell"))
    inside = F.when(~F.col("crosses"), F.col("begin"))
    size = F.sum(F.when(F.col("lead"), 0).otherwise(F.col("tokens")))
    cells = celled.groupBy("conv", "cell", "room").agg(
        F.min("begin").alias("at"), F.min(inside).alias("inside"), F.max("crosses").alias("crosses"), size.alias("size")
    )
    split = F.col("crosses") & F.col("inside").isNotNull() & (F.col("size") > F.col("room"))
    cells = scratch.write(cells.withColumn("split", split), "cells")
    new = celled.join(cells.select("conv", "cell", "split"), ["conv", "cell"])
    window = F.col("cell") * 2 + (F.col("split") & ~F.col("crosses")).cast("long")
    new = new.select("conv", "begin", "end", window.alias("window"), F.lit(True).alias("new"))

    starts = F.array(*(F.struct(F.lit(k).alias("second"), F.col(c).alias("start")) for k, c in enumerate(("at", "inside"))))
    windows = cells.select("conv", "cell", "room", F.explode(F.when(F.col("split"), starts).otherwise(F.slice(starts, 1, 1))).alias("w"))
    near = _div(F.col("w.start"), F.col("room"))
    windows = windows.select("conv", (F.col("cell") * 2 + F.col("w.second")).alias("window"), F.col("w.start").alias("start"), near.alias("near"))
    windows = scratch.write(windows, "windows")

    reach = F.sequence(_div(F.col("end"), F.col("room")), _div(F.col("begin") + history, F.col("room")))
    past = turns.where(~F.col("lead") & (F.col("tokens") <= history)).withColumn("near", F.explode(reach))
    past = past.join(windows, ["conv", "near"]).where("end <= start").where(F.col("begin") >= F.col("start") - history)

    # The system turn goes to its conversation's windows by runs of them, as a conversation may have any number.
    last = windows.groupBy("conv").agg(F.max("window").alias("last"))
    runs = F.sequence(F.lit(0).cast("long"), _div(F.col("last"), F.lit(SHARE)))
    lead = turns.where("lead").join(last, "conv").withColumn("run", F.explode(runs))
    kept = lead.join(windows.where("window > 0").withColumn("run", _div(F.col("window"), F.lit(SHARE))), ["conv", "run"])
    again = [t.select("conv", "begin", "end", "window", F.lit(False).alias("new")) for t in (past, kept)]
    return new.unionByName(again[0]).unionByName(again[1])


def chat_windows(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokens: Column | None = None,
    budget: int = 1024,
    history: int = 256,
    block: int = 4096,
) -> DataFrame:
    """(conv, window, n_tokens, n_repeated, text, loss): a row for each window, numbered in order (numbers may be left out).

    The first n_repeated turns of text are the system turn and history; loss lists the spans of new assistant texts, as
    half-open ranges of code points of text. tokens: a turn's tokens without its markers, by default an estimate."""
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    scratch = Scratch(df.sparkSession, "windows")
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in (text_col, role_col))
    count = F.coalesce((token_estimate(text) if tokens is None else tokens).cast("long"), F.lit(0)) + MARKERS
    # A conversation's key is a structure, so that a null id is a key like any other.
    key = F.struct(F.col(conv_col).alias("id")).alias("conv")
    rows = df.select(key, F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), count.alias("tokens"))
    placed = scratch.write(_placed(rows, scratch, budget, history, block), "placed")
    assigned = _assigned(placed.drop("role", "text"), scratch, history)
    shown = placed.select("conv", "begin", "end", "role", "text", "tokens").join(assigned, ["conv", "begin", "end"])

    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n")).alias("head")
    target = (F.col("role") == "assistant").alias("target")
    turn = shown.select("conv", "window", "begin", "end", "tokens", "new", target, head, escaped("text").alias("body"))
    order = Window.partitionBy("conv", "window").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)
    width = F.length("head") + F.length("body") + len(CLOSE) + 1
    turn = turn.withColumn("to", (F.sum(width).over(order) - len(CLOSE) - 1).cast("int"))
    span = F.struct((F.col("to") - F.length("body")).alias("begin"), F.col("to").alias("end"))
    part = F.concat("head", "body", F.lit(CLOSE + "\n")).alias("part")
    parts = F.sort_array(F.collect_list(F.struct("begin", "end", part)))
    made = turn.groupBy("conv", "window").agg(
        F.sum("tokens").alias("n_tokens"),
        F.count_if(~F.col("new")).cast("int").alias("n_repeated"),
        F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"),
        F.sort_array(F.collect_list(F.when(F.col("new") & F.col("target"), span))).alias("loss"),
    )
    return made.select(F.col("conv.id").alias(conv_col), "window", "n_tokens", "n_repeated", "text", "loss")


def turns_of(text: Column) -> Column:
    """array<struct<role, text>>: what a window's text says, read back."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - F.lit(len(CLOSE) + 2))
        return F.struct(unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    parts = F.split(text, r"<\|im_start\|>")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def target_text(text: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, s["begin"] + 1, s["end"] - s["begin"]))), "")


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of the windows, from their texts and masks.

    A digest of a whole conversation needs the whole conversation in one value: this row grows with it, the windows do not."""
    every = turns_of(F.col("text"))
    new = F.slice(every, F.col("n_repeated") + 1, F.size(every))
    said = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = windows.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"),
        "window",
        F.size(new).alias("n"),
        said.alias("said"),
        target_text(F.col("text"), F.col("loss")).alias("target"),
        F.length("text").alias("chars"),
    )
    parts = F.sort_array(F.collect_list(F.struct("window", "said", "target")))
    sums = (F.sum(c).cast("long").alias(name) for c, name in (("n", "n_turns"), ("chars", "formatted_chars")))
    whole = each.groupBy("conv").agg(parts.alias("parts"), *sums)
    joined = {c: F.array_join(F.transform("parts", lambda p: p[c]), "") for c in ("said", "target")}  # noqa: B023
    return whole.select(
        F.col("conv.id").alias(conv_col),
        "n_turns",
        F.sha2(joined["said"], 256).alias("turns_sha256"),
        F.length(joined["target"]).cast("long").alias("loss_chars"),
        F.sha2(joined["target"], 256).alias("loss_sha256"),
        "formatted_chars",
    )
