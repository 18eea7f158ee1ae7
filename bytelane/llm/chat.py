"""Chat formatting in budgeted, turn-aligned windows (DataFrame functions only).

Input: one row per turn (`conv_id, turn, role, text`). Every turn is rendered
as

    <|turn|> role <|text|> text <|end|>          (without the blanks)

Control strings that occur inside a role or a text are escaped reversibly: one
backslash is put behind their first character, and one more if backslashes
stand there already.

Windows. With `n` tokens a turn, prefix sums give each turn a token interval
`[a, b)` of its conversation (without a leading system turn). The token axis
is cut into stretches of `budget - history - system` tokens. Turns that lie
inside one stretch share a window; a turn that crosses a cut has a window of
its own. A window is therefore turn-aligned and keeps within the budget,
unless one turn alone exceeds its stretch (`over_budget`). Every window starts
with the conversation's system turn and repeats the turns that start at most
`history` tokens before it. Repeated turns never enter the loss, so each
assistant turn is a target exactly once.

All steps group by `conv_id` or by columns that include it: the texts are
shuffled once.

Defined results: null role or text counts as empty; a null `conv_id` is a
conversation like any other; rows with equal `turn` are ordered by role, then
text; repeated rows stay repeated turns; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

# Control strings, by what follows their first character ("<" or "[").
TAILS = r"\|turn\|>|\|text\|>|\|end\|>|/?s>|/?INST\]"

MARKS_PER_TURN = 3
BUDGET = 512
HISTORY = 128


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)({TAILS})", r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*)({TAILS})", "$1$2$3")


def word_tokens(text: Column) -> Column:
    """Default token count of a turn: its words and the three marks."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + MARKS_PER_TURN


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=word_tokens) -> DataFrame:
    """One row per window: `conv_id, window, formatted, spans, n_tokens, over_budget`.

    `spans` has one struct a turn, in order: `start`, `end` (code points of the
    escaped text inside `formatted`, end exclusive), `fresh` (not repeated from
    an earlier window) and `loss` (the text is a training target).
    """
    if budget <= history or history < 1:
        raise ValueError("the budget must exceed the history, and the history be positive")
    conv = Window.partitionBy("conv_id")
    t = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    t = t.withColumn("seq", F.row_number().over(conv.orderBy("turn", "role", "text")))
    t = t.withColumn("n", tokens(F.col("text")))
    t = t.withColumn("lead", (F.col("seq") == 1) & (F.col("role") == "system"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    t = t.select(
        "conv_id", "seq", "n", "lead",
        (F.col("role") == "assistant").alias("target"),
        F.concat(head, body, F.lit(END)).alias("piece"),
        F.length(head).alias("off"),
        F.length(body).alias("len"),
    )
    item = F.struct("seq", "n", "target", "piece", "off", "len")
    # the system turn, on every row of its conversation
    t = t.withColumn("system", F.max(F.when(F.col("lead"), item)).over(conv))
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("system.n"), F.lit(0)), F.lit(1))
    t = t.withColumn("room", room)
    t = t.withColumn("b", F.sum(F.when(F.col("lead"), 0).otherwise(F.col("n"))).over(
        conv.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = t.withColumn("a", F.col("b") - F.col("n"))
    # what may be repeated before a window that begins at this turn
    before = conv.orderBy("a").rangeBetween(-history, -1)
    t = t.withColumn("past", F.collect_list(F.when(~F.col("lead"), item)).over(before))
    first, last = F.floor(F.col("a") / F.col("room")), F.floor((F.col("b") - 1) / F.col("room"))
    t = t.withColumn("window", F.when(F.col("lead"), F.lit(-1)).otherwise(2 * first + (first < last).cast("long")))
    # a conversation of nothing but its system turn is one window
    t = t.withColumn("only", F.max("window").over(conv) == -1)
    t = t.where(~F.col("lead") | F.col("only"))
    w = t.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(item)).alias("own"),
        F.min_by("past", "seq").alias("past"),
        F.first("system").alias("system"),
        F.first("room").alias("room"),
        F.min("a").alias("a"),
    )

    def marked(items: Column, fresh: Column) -> Column:
        return F.transform(items, lambda x: F.struct(
            x["piece"].alias("piece"), x["off"].alias("off"), x["len"].alias("len"), x["n"].alias("n"),
            fresh.alias("fresh"), (fresh & x["target"]).alias("loss")))

    none = F.slice(F.col("own"), 1, 0)
    system = F.when(F.col("system").isNotNull() & (F.col("window") >= 0), F.array("system")).otherwise(none)
    # the system turn counts as new in the conversation's first window only
    w = w.withColumn("items", F.concat(
        marked(system, F.col("a") == 0), marked(F.array_sort("past"), F.lit(False)), marked(F.col("own"), F.lit(True))))
    w = w.select(
        "conv_id", "window", "items",
        F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"),
        F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_tokens"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr(
        "cast(array() as array<struct<start:int,end:int,fresh:boolean,loss:boolean>>)").alias("out"))
    walk = F.aggregate("items", start, lambda s, x: F.struct(
        (s["at"] + F.length(x["piece"])).alias("at"),
        F.concat(s["out"], F.array(F.struct(
            (s["at"] + x["off"]).alias("start"), (s["at"] + x["off"] + x["len"]).alias("end"),
            x["fresh"].alias("fresh"), x["loss"].alias("loss")))).alias("out")))
    return w.select(
        "conv_id", "window", "formatted", walk["out"].alias("spans"), "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Digest per conversation, parsed from the formatted windows alone.

    `n_turns`, `turns_sha256`, `loss_chars`, `loss_sha256`, `formatted_chars`.
    """
    turn = rf"(?s){_literal(TURN)}(.*?){_literal(TEXT)}(.*?){_literal(END)}"
    p = windows.select(
        "conv_id", "window", "formatted", "spans",
        F.regexp_extract_all("formatted", F.lit(turn), F.lit(1)).alias("roles"),
        F.regexp_extract_all("formatted", F.lit(turn), F.lit(2)).alias("texts"),
    )
    fresh = F.filter(F.arrays_zip("spans", "roles", "texts"), lambda x: x["spans"]["fresh"])
    p = p.select(
        "conv_id", "window", F.length("formatted").cast("long").alias("chars"),
        F.size(fresh).cast("long").alias("n"),
        F.array_join(F.transform(fresh, lambda x: F.concat(
            unescape(x["roles"]), F.lit("\n"), unescape(x["texts"]), F.lit("\n"))), "").alias("turns"),
        F.array_join(F.transform(F.filter("spans", lambda s: s["loss"]), lambda s: unescape(
            F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "").alias("loss"),
    )
    g = p.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"))
    turns = F.array_join(F.transform("parts", lambda x: x["turns"]), "")
    loss = F.array_join(F.transform("parts", lambda x: x["loss"]), "")
    return g.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _literal(s: str) -> str:
    return s.replace("|", r"\|")
