"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of whole turns. Prefix sums of turn tokens choose the spans: a window
takes turns while they fit the budget. Every window opens with the system turn; later ones repeat as much of the
history as their limit allows. The loss mask covers the text of each assistant turn once: repeated turns
carry none.

Template: ``<|im_start|>`` role, newline, text, ``<|im_end|>``, newline. In texts ``^`` is written ``^^`` and ``<|`` is
written ``<^|``, so a text cannot hold a control string, and reading turns it back. Roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import need

START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "^"
BUDGET, HISTORY = 512, 128
# a turn's tokens: pieces of up to four characters of its words, and four for the template
PIECE, TEMPLATE_TOKENS = r"[^\x20\x09-\x0D]{1,4}", 4


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit("<|"), F.lit(f"<{ESCAPE}|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"<{ESCAPE}|"), F.lit("<|")), F.lit(ESCAPE * 2), F.lit(ESCAPE))


def turn_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PIECE)) + TEMPLATE_TOKENS


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, n_repeated, loss (array of start and length in code points): one row per window.

    ``turns`` needs conv_id, turn, role and text; other columns are not read. Turns of a conversation are sorted by
    turn, then role and text; a null turn comes first. Null texts and roles are empty. Rows without conv_id are one
    conversation. Repeated rows are turns of their own. A first turn with the role ``system`` opens every
    window. A turn that does not fit the budget alone has a window of its own. ``n_repeated`` turns at a window's
    start were in earlier windows. An empty table gives an empty one.
    """
    rows = need(turns, "conv_id", "turn", "role", "text").withColumns({
        "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit("")),
    })
    per_conv = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", turn_tokens(F.col("text")).alias("tokens")))).alias("t"))
    # totals[i]: tokens of the turns before turn i
    totals = F.aggregate(
        F.col("t.tokens"), F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))
    first = F.when(F.element_at(F.col("t"), 1)["role"] == "system", 1).otherwise(0)
    per_conv = per_conv.withColumn("p", totals).withColumn("s", first)
    system = F.when(F.col("s") == 1, F.col("p")[1]).otherwise(0)
    state = lambda spans, context, begin: F.struct(spans.alias("spans"), context.alias("context"), begin.alias("begin"))
    span = lambda context, begin, end: F.array(F.struct(context.alias("context"), begin.alias("begin"), end.alias("end")))

    def step(now: Column, i: Column) -> Column:
        used = F.col("sys") + F.get("p", i + 1) - F.get("p", now["context"])
        room = F.least(F.lit(history), budget - F.col("sys") - (F.get("p", i + 1) - F.get("p", i)))
        # prefix sums rise: as many of the earlier turns are left out as start too far before turn i
        context = F.col("s") + F.size(F.filter(
            F.slice("p", F.col("s") + 1, i - F.col("s")), lambda before: F.get("p", i) - before > room))
        closed = F.concat(now["spans"], span(now["context"], now["begin"], i))
        return F.when((used <= budget) | (i == now["begin"]), now).otherwise(state(closed, context, i))

    none = F.array().cast("array<struct<context:int,begin:int,end:int>>")
    last = F.aggregate(
        F.slice(F.sequence(F.lit(0), F.size("t")), F.col("s") + 1, F.size("t") - F.col("s")),
        state(none, F.col("s"), F.col("s")), step)
    per_conv = per_conv.withColumn("sys", system).withColumn("_last", last)
    spans = F.concat(F.col("_last.spans"), span(F.col("_last.context"), F.col("_last.begin"), F.size("t")))
    windows = per_conv.select("conv_id", "t", "s", F.posexplode(spans).alias("window", "span"))

    turns_in = F.concat(
        F.slice("t", 1, F.when(F.col("s") == 1, 1).otherwise(0)),
        F.slice("t", F.col("span.context") + 1, F.col("span.end") - F.col("span.context")))
    repeated = F.col("span.begin") - F.col("span.context") + F.when((F.col("window") > 0) & (F.col("s") == 1), 1).otherwise(0)
    # the opening system turn of a first window is new although it stands before the span
    windows = windows.select("conv_id", "window", repeated.alias("n_repeated"), F.transform(
        turns_in, lambda x: F.struct(
            (x["role"] == "assistant").alias("target"),
            F.concat(F.lit(START), F.url_encode(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body")),
    ).alias("parts"))
    block = lambda x: F.concat(x["head"], x["body"], F.lit(f"{END}\n"))
    none = F.array().cast("array<struct<start:int,length:int>>")
    masks = F.aggregate(
        F.transform("parts", lambda x, i: F.struct(
            (x["target"] & (i >= F.col("n_repeated"))).alias("on"), F.length(x["head"]).alias("head"),
            F.length(x["body"]).alias("body"))),
        F.struct(F.lit(0).alias("at"), none.alias("masks")),
        lambda now, x: F.struct(
            (now["at"] + x["head"] + x["body"] + len(END) + 1).alias("at"),
            F.when(x["on"], F.concat(now["masks"], F.array(F.struct((now["at"] + x["head"]).alias("start"), x["body"].alias("length")))))
            .otherwise(now["masks"]).alias("masks")))
    return windows.select(
        "conv_id", "window", F.array_join(F.transform("parts", block), "").alias("text"), "n_repeated", masks["masks"].alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text), loss_text, formatted_chars: what the formatted windows say."""

    def turn(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - (len(END) + 1))
        return F.struct(F.url_decode(head).alias("role"), unescape(body).alias("text"))

    blocks = F.split("text", r"<\|im_start\|>")
    fresh = F.slice(blocks, F.col("n_repeated") + 2, F.greatest(F.size(blocks) - 1 - F.col("n_repeated"), F.lit(0)))
    masked = F.array_join(F.transform("loss", lambda m: unescape(F.substring("text", m["start"] + 1, m["length"]))), "")
    per_window = windows.select(
        "conv_id", "window", F.transform(fresh, turn).alias("turns"), masked.alias("loss"), F.length("text").alias("chars"))
    ordered = F.array_sort(F.collect_list(F.struct("window", "turns", "loss")))
    return per_window.groupBy("conv_id").agg(ordered.alias("_w"), F.sum("chars").alias("formatted_chars")).select(
        "conv_id", F.flatten(F.col("_w.turns")).alias("turns"), F.array_join(F.col("_w.loss"), "").alias("loss_text"),
        "formatted_chars")
