"""Chat formatting: conversations as windows of whole turns under a token budget, with a loss mask.

Built-in functions only. A turn reads ``<s>role[INST]text</s>``. Control strings inside roles and texts get a backslash
behind their first character (one more, if there are some already), so no control string is left there and the texts can be
read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfpace.llm.sqltext import let, one_space

BUDGET = 384  # tokens of a window
HISTORY_TURNS = 2  # turns of the window before that are repeated at most
HISTORY_BUDGET = 128  # their tokens at most
TURN_TOKENS = 4  # of the marks around a turn

# Control strings of the template and of other common templates, without their first character.
CONTROL = r"(?=/?s>|/?INST\]|<?/?SYS>>|\|im_start\|>|\|im_end\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2")


def n_tokens(text: Column) -> Column:
    """Tokens of a turn, estimated as its words and the marks around it."""
    return F.size(F.filter(F.split(one_space(text), " "), lambda w: w != "")) + TURN_TOKENS


def _starts(turns: Column, budget: int, history_turns: int, history_budget: int) -> Column:
    """(history, first) per window: the first repeated and the first new turn.

    ``upto`` of a turn is the sum of tokens up to and with it, so any span costs one difference. A turn joins the window
    if the system turn, the history and the span up to it fit the budget; else it opens a window, with as many of the
    turns before as the limits allow. A turn above the budget stands alone: it is not cut.
    """
    head = F.when(F.get(turns, F.lit(0))["role"] == "system", 1).otherwise(0)
    fixed = F.when(head == 1, F.get(turns, F.lit(0))["tokens"]).otherwise(0)

    def span(a: Column, b: Column) -> Column:  # tokens of turns a .. b
        return F.get(turns, b)["upto"] - F.get(turns, a)["upto"] + F.get(turns, a)["tokens"]

    def opened(i: Column) -> Column:
        h = i
        for k in range(1, history_turns + 1):
            allowed = (i - k >= head) & (span(i - k, i - 1) <= history_budget) & (fixed + span(i - k, i) <= budget)
            h = F.when(F.coalesce(allowed, F.lit(False)) & (h == i - k + 1), i - k).otherwise(h)
        return F.struct(h.cast("int").alias("history"), i.cast("int").alias("first"))

    def step(windows: Column, i: Column) -> Column:
        fits = (F.size(windows) > 0) & (fixed + span(F.element_at(windows, -1)["history"], i) <= budget)
        return F.when(F.coalesce(fits, F.lit(False)), windows).otherwise(F.concat(windows, F.array(opened(i))))

    none = F.array().cast("array<struct<history:int,first:int>>")
    body = F.when(F.size(turns) > head, F.sequence(head, F.size(turns) - 1)).otherwise(F.array().cast("array<int>"))
    windows = F.aggregate(body, none, step)
    # A conversation of a system turn alone is one window without further turns.
    return F.when(F.size(turns) > head, windows).otherwise(F.array(F.struct(F.lit(1).alias("history"), F.lit(1).alias("first"))))


def _render(turns: Column, repeated: Column) -> Column:
    """(formatted, loss): the text of a window, and the code-point spans (end exclusive) of its new assistant texts."""
    start = F.struct(F.lit("").alias("formatted"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"), F.lit(0).alias("k"))

    def step(acc: Column, t: Column) -> Column:
        opening = F.concat(F.lit("<s>"), escape(t["role"]), F.lit("[INST]"))
        at = F.length(acc["formatted"]) + F.length(opening)
        target = (t["role"] == "assistant") & (acc["k"] >= repeated)
        span = F.struct(at.alias("start"), (at + F.length(escape(t["text"]))).alias("end"))
        return F.struct(
            F.concat(acc["formatted"], opening, escape(t["text"]), F.lit("</s>")).alias("formatted"),
            F.when(target, F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"]).alias("loss"),
            (acc["k"] + 1).alias("k"),
        )

    return F.aggregate(turns, start, step)


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_budget: int = HISTORY_BUDGET) -> DataFrame:
    """conv_id, window, n_repeated, formatted, loss: one row per window.

    Turns are ordered by turn, then role and text. The system turn opens every window; the other repeated turns
    (``n_repeated`` with it, after the first window) are history. Each assistant text is under the loss mask once, where it is new.
    A conversation is the unit that is formatted: its turns meet in one row.

    Null text or role: an empty string. Null turns come first; repeated rows are turns of their own; rows with a null conv_id
    form one conversation. Other columns are not read. An empty table gives an empty result.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", n_tokens(F.col("text")))
    order = ["turn", "role", "text"]
    upto = F.sum("tokens").over(Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    convs = rows.withColumn("upto", upto).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*order, "upto", "tokens"))).alias("turns"))

    def cut(windows: Column) -> Column:
        turns = F.col("turns")
        head = F.when(F.get(turns, F.lit(0))["role"] == "system", 1).otherwise(0)

        def one(w: Column, k: Column) -> Column:
            end = F.coalesce(F.get(windows, k + 1)["first"], F.size(turns))
            part = F.concat(F.slice(turns, F.lit(1), head), F.slice(turns, w["history"] + 1, end - w["history"]))
            again = F.when(k > 0, head).otherwise(0) + w["first"] - w["history"]
            return F.struct(k.cast("int").alias("window"), again.alias("n_repeated"), part.alias("part"))

        return F.transform(windows, one)

    cuts = convs.select("conv_id", F.explode(let(_starts(F.col("turns"), budget, history_turns, history_budget), cut)).alias("w"))
    shown = cuts.select("conv_id", "w.window", "w.n_repeated", F.inline(F.array(_render(F.col("w.part"), F.col("w.n_repeated")))))
    return shown.select("conv_id", "window", "n_repeated", "formatted", "loss")


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted window."""
    turn = r"(?s)<s>(.*?)\[INST\](.*?)</s>"
    pairs = F.arrays_zip(F.regexp_extract_all(formatted, F.lit(turn), 1).alias("role"), F.regexp_extract_all(formatted, F.lit(turn), 2).alias("text"))
    return F.transform(pairs, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """Text under the loss mask of a window, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, read back from them: turns and target texts as digests."""
    parts = windows.select(
        "conv_id",
        F.struct(
            "window",
            F.transform(let(read_turns(F.col("formatted")), lambda t: F.slice(t, F.col("n_repeated") + 1, F.size(t))), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))).alias("turns"),
            read_loss(F.col("formatted"), F.col("loss")).alias("loss"),
            F.length("formatted").cast("long").alias("chars"),
        ).alias("p"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    turns, loss = F.flatten(F.col("p.turns")), F.array_join("p.loss", "")
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("p.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"),
        F.size("p").cast("long").alias("n_windows"),
    )
