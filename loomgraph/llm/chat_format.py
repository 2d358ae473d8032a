"""Budgeted chat windows (DataFrame functions only).

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens
cut it: the turns whose sum before them falls in the same multiple of a step
form a span. The step is chosen for each conversation so that the system turn,
the repeated history, a step and the longest turn fit the budget together. A
turn too long for a step of a quarter of the history beside it is not counted
there: it begins a span of its own, with the turns after it that fit. Only where
a system turn and one turn exceed the budget is a window longer. Every window
begins with the system turn, then repeats the last turns before its span, as
far as the history and the room that its own turns leave allow. Loss falls on assistant texts of the
span alone: each is a target once, repeated ones are masked.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a ``<``
before any backslashes and a ``|`` gets one backslash more, so that no control
string can arise; taking one away restores the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import store

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Turns are summed in blocks of so many turn numbers, so that a long conversation is not one task.
BLOCK = 1024


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _role_out(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def count_tokens(text: Column) -> Column:
    """Words and other characters that aren't white space."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]"))


@dataclass(frozen=True)
class Budget:
    tokens: int = 1024
    history: int = 256


def windows(turns: DataFrame, budget: Budget = Budget(), tokens: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """Stored (conv_id, window, text, n_turns, n_repeated, loss_spans) from rows (conv_id, turn, role, text).

    ``loss_spans``: array of (start, length) in code points. ``n_repeated``: how
    many leading turns were in an earlier window. Turns are ordered by turn,
    then role, then text; repeated rows are turns of their own. Null texts and
    roles are empty, null turns come first, rows with a null conv_id are one
    conversation. Other columns are not looked at.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    piece = F.concat(F.lit(BEGIN), _role_out(role), F.lit("\n"), escape(text), F.lit(END))
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("ck"), "conv_id", F.col("turn"), role.alias("role"), text.alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).alias("block"), piece.alias("piece"),
        F.char_length(F.concat(F.lit(BEGIN), _role_out(role), F.lit("\n"))).alias("head"), F.char_length(escape(text)).alias("body"),
    ).withColumn("c", tokens(F.col("piece")).cast("long"))
    local = Window.partitionBy("ck", "block").orderBy("turn", "role", "text")
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"rn": F.row_number().over(local), "sum": F.coalesce(F.sum("c").over(before), F.lit(0))}).drop("text")
    blocks = rows.groupBy("ck", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min_by(F.struct("role", "c"), "rn").alias("first"))
    whole, earlier = Window.partitionBy("ck"), Window.partitionBy("ck").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min_by("first", "block").over(whole)
    blocks = blocks.select(
        "ck", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"),
        (F.lit(budget.tokens) - F.when(first["role"] == "system", first["c"]).otherwise(0)).alias("room"), F.when(first["role"] == "system", first["c"]).otherwise(0).alias("system"),
    )
    rows = rows.join(blocks, ["ck", "block"]).withColumn("ord", F.col("n0") + F.col("rn"))
    is_system = (F.col("ord") == 1) & (F.col("role") == "system")
    fits = F.col("c") <= F.col("room") - budget.history - max(1, budget.history // 4)
    rows = rows.withColumns({"sys": is_system, "p": F.when(is_system, 0).otherwise(F.col("c0") + F.col("sum") - F.col("system")), "fits": fits, "long": ~is_system & ~fits})
    rows = store(rows.select("ck", "conv_id", "block", "ord", "sys", "p", "c", "fits", "long", "room", "piece", "head", "body", (F.col("role") == "assistant").alias("target")), "chat-rows")
    blocks = rows.groupBy("ck", "block").agg(F.count_if("long").alias("longs"), F.max(F.when(F.col("long"), F.col("p"))).alias("long_p"), F.max(F.when(F.col("fits"), F.col("c"))).alias("most"))
    blocks = blocks.select(
        "ck", "block", F.coalesce(F.sum("longs").over(earlier), F.lit(0)).alias("longs0"), F.max("long_p").over(earlier).alias("long_p0"), F.coalesce(F.max("most").over(whole), F.lit(0)).alias("most"),
    )
    upto = Window.partitionBy("ck", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"longs": F.count_if("long").over(upto), "long_p": F.max(F.when(F.col("long"), F.col("p"))).over(upto)}).join(blocks, ["ck", "block"])
    rows = rows.withColumns({
        "longs": F.col("longs0") + F.col("longs"), "long_p": F.coalesce("long_p", "long_p0"), "step": F.greatest(F.lit(1), F.col("room") - F.col("most") - budget.history),
    })
    # numbers of spans grow along the conversation, and by one at least where a span of a long turn begins or ends
    with_long = ~F.col("sys") & ((F.col("p") == F.col("long_p")) | (F.col("p") + F.col("c") - F.col("long_p") <= F.col("room")))
    k = F.when(with_long, F.floor(F.col("long_p") / F.col("step")) + 2 * F.col("longs") - 1).otherwise(F.floor(F.col("p") / F.col("step")) + 2 * F.col("longs"))
    rows = store(rows.select("ck", "conv_id", k.alias("k"), "ord", "sys", "p", "c", "room", "piece", "head", "body", "target"), "chat-turns")
    spans = rows.where("not sys").groupBy("ck", "k").agg(F.min("p").alias("from"), F.least(F.lit(budget.history), F.max("room") - F.sum("c")).alias("history"))
    out = ["ck", "conv_id", "k", "ord", "piece", "head", "body", "target"]
    cell = max(1, budget.history)
    at = F.floor(F.col("p") / cell)
    again = rows.where("not sys").select(*(c for c in out if c != "k"), "p", F.explode(F.array(at, at + 1)).alias("cell"), F.col("k").alias("own"))
    again = again.join(spans.withColumn("cell", F.floor(F.col("from") / cell)), ["ck", "cell"]).where((F.col("k") > F.col("own")) & (F.col("from") - F.col("p") <= F.col("history"))).select(*out)
    # of the windows that a system turn opens it is new in the first
    heads = rows.where("sys").drop("k").join(spans.select("ck", "k", "from"), "ck", "left").withColumns({"k": F.coalesce("k", F.lit(0)), "new": F.coalesce("from", F.lit(0)) == 0})
    shown = rows.where("not sys").select(*out, F.lit(True).alias("new")).union(again.withColumn("new", F.lit(False))).union(heads.select(*out, "new"))
    placed = shown.withColumn("at", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(Window.partitionBy("ck", "k").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    loss = F.when(F.col("new") & F.col("target"), F.struct((F.col("at") + F.col("head")).alias("start"), F.col("body").cast("long").alias("length")))
    # a window's turns are bounded by the budget
    gathered = placed.groupBy("ck", "conv_id", "k").agg(
        F.sort_array(F.collect_list(F.struct("ord", "piece"))).alias("turns"), F.sort_array(F.collect_list(loss)).alias("loss_spans"), F.sum((~F.col("new")).cast("int")).alias("n_repeated")
    )
    return store(gathered.select("conv_id", F.col("k").alias("window"), F.array_join(F.col("turns.piece"), "").alias("text"), F.size("turns").alias("n_turns"), "n_repeated", "loss_spans"), "chat-windows")


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, at, role, text): the original turns, each once, parsed from the formatted texts."""
    pieces = F.slice(F.split("text", r"<\|im_start\|>", -1), F.col("n_repeated") + 2, F.greatest(F.lit(0), F.col("n_turns") - F.col("n_repeated")))
    one = formatted.select("conv_id", "window", F.posexplode(pieces).alias("at", "piece"))
    body = F.expr(f"substring(piece, 1, char_length(piece) - {len(END)})")
    return one.withColumn("piece", body).select(
        "conv_id", "window", "at", _role_in(F.substring_index("piece", "\n", 1)).alias("role"), unescape(F.expr("substring(piece, locate('\n', piece) + 1)")).alias("text")
    )


def read_targets(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, at, text): the unescaped texts under the loss mask."""
    spans = formatted.select("conv_id", "window", "text", F.posexplode("loss_spans").alias("at", "s"))
    return spans.select("conv_id", "window", "at", unescape(F.expr("substring(text, cast(s.start as int) + 1, cast(s.length as int))")).alias("text"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows."""
    key = F.col("conv_id")
    in_order = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", "at", c.alias("x")))), lambda s: s["x"]), "")
    turns = read_turns(formatted).groupBy(key).agg(F.count(F.lit(1)).alias("n_turns"), F.sha2(in_order(F.concat("role", F.lit("\n"), "text", F.lit("\n"))), 256).alias("turns_sha256"))
    loss = read_targets(formatted).groupBy(key).agg(in_order(F.col("text")).alias("t")).select("conv_id", F.char_length("t").cast("long").alias("loss_chars"), F.sha2("t", 256).alias("loss_sha256"))
    size = formatted.groupBy(key).agg(F.sum(F.char_length("text").cast("long")).alias("formatted_chars"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    both = turns.join(size, same(turns, size)).drop(size["conv_id"])
    return both.join(loss, same(both, loss), "left").select(
        both["conv_id"], "n_turns", "turns_sha256", F.coalesce("loss_chars", F.lit(0).cast("long")).alias("loss_chars"), F.coalesce("loss_sha256", F.sha2(F.lit(""), 256)).alias("loss_sha256"), "formatted_chars"
    )
