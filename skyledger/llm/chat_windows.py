"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned windows. A window begins with the system turn and with
as much of the turns before it as the history budget allows; both are marked as repeated, so that every assistant
turn is a target of the loss exactly once. Control strings inside texts are escaped, and reading back undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.quality_rules import let

BUDGET = 1024
HISTORY = 256
#: The marks of a turn of the window's own and of a repeated one are equally long.
OWN, REPEATED, TEXT, END = "<|turn|>", "<|seen|>", "<|text|>", "<|end|>"
ASSISTANT, SYSTEM = "assistant", "system"


def escaped(text: Column) -> Column:
    r"""The text without ``<`` or ``[``, so that no mark of this or of other templates is in it.

    ``\`` becomes ``\e``, ``<`` becomes ``\l`` and ``[`` becomes ``\b``; every backslash then has its letter.
    """
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\e"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescaped(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\b"), F.lit("[")), F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def token_count(text: Column) -> Column:
    """Tokens of a turn: runs of letters and digits, and other visible characters one by one."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def _starts(turns: Column, budget: int) -> Column:
    """Where windows begin: a turn that would take the window's prefix sum past the budget begins the next one."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("before"), F.array(F.lit(0)).alias("starts"))

    def step(state: Column, turn: Column) -> Column:
        over = (turn["upto"] - state["before"] > budget) & (state["i"] > F.element_at(state["starts"], -1))
        return F.struct(
            (state["i"] + 1).alias("i"),
            F.when(over, turn["upto"] - turn["tokens"]).otherwise(state["before"]).alias("before"),
            F.when(over, F.concat(state["starts"], F.array(state["i"]))).otherwise(state["starts"]).alias("starts"),
        )

    return F.aggregate(turns, zero, step, lambda s: s["starts"])


def _again(turn: Column) -> Column:
    return F.concat(F.lit(REPEATED), F.substring(turn["shown"], len(OWN) + 1, 1 << 30))


def _window(turns: Column, starts: Column, k: Column, history: int) -> Column:
    """The ``k``-th window: its text, and the spans of its own assistant texts in code points."""
    first = F.get(starts, k)
    after = F.coalesce(F.get(starts, k + 1), F.size(turns))
    # two windows in a row hold more than a window's budget, so no history reaches back further
    back = F.coalesce(F.get(starts, F.greatest(k - 2, F.lit(0))), F.lit(0))
    has_system = F.get(turns, F.lit(0))["role"] == SYSTEM
    head = F.when((k > 0) & has_system, _again(F.get(turns, F.lit(0)))).otherwise("")
    upto = F.get(turns, first - 1)["upto"]
    recent = F.slice(turns, back + 1, first - back)
    recent = F.filter(recent, lambda t: (upto - t["upto"] + t["tokens"] <= history) & ~((t["at"] == 0) & (t["role"] == SYSTEM)))
    lead = F.concat(head, F.array_join(F.transform(recent, _again), ""))

    def place(own: Column, lead: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,end:int>>")
        zero = F.struct(F.length(lead).alias("at"), empty.alias("spans"))

        def step(state: Column, turn: Column) -> Column:
            start = state["at"] + turn["lead"]
            span = F.struct(start.alias("start"), (start + turn["length"]).alias("end"))
            return F.struct(
                (state["at"] + F.length(turn["shown"])).alias("at"),
                F.when(turn["role"] == ASSISTANT, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
            )

        text = F.concat(lead, F.array_join(F.transform(own, lambda t: t["shown"]), ""))
        return F.struct(k.alias("window"), text.alias("text"), F.aggregate(own, zero, step, lambda s: s["spans"]).alias("spans"))

    return let(F.slice(turns, first + 1, after - first), lambda own: let(lead, lambda x: place(own, x)))


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, window, text, spans`` from ``turns(conv_id, turn, role, text)``.

    Turns go by ``turn`` (nulls first), then role and text. A turn is never cut: one over the budget is a window by
    itself. Null texts and roles are empty ones. Rows of a null ``conv_id`` are one conversation. Repeated rows are
    turns each. Other columns are not looked at. The only shuffle is that by conversation; a conversation has to fit
    a row, as its digest is that of one string.
    """
    role = F.coalesce("role", F.lit(""))
    shown = F.concat(F.lit(OWN), escaped(role), F.lit(TEXT), escaped(F.col("text")), F.lit(END))
    rows = turns.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tokens": token_count(F.col("text")), "shown": shown, "length": F.length(escaped(F.col("text")))})
    rows = rows.withColumn("lead", F.length(escaped(F.col("role"))) + len(OWN) + len(TEXT))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumns({"at": F.row_number().over(order) - 1, "upto": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    gathered = numbered.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "role", "tokens", "upto", "shown", "lead", "length"))).alias("turns")
    )

    def windows(found: Column) -> Column:
        return let(
            _starts(found, budget),
            lambda starts: F.transform(F.sequence(F.lit(0), F.size(starts) - 1), lambda k: _window(found, starts, k, history)),
        )

    return gathered.select("conv_id", F.explode(let(F.col("turns"), windows)).alias("w")).select("conv_id", "w.window", "w.text", "w.spans")


def read_back(windows: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (role and text, unescaped, repeated ones left out), ``targets`` (the texts under the loss
    mask) and ``formatted_chars`` from windows alone."""
    gathered = windows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "text", "spans"))).alias("w"))
    end, split = "<\\|end\\|>", len(OWN) + 1

    def turn(shown: Column) -> Column:
        role = F.substring_index(F.substring(shown, split, 1 << 30), TEXT, 1)
        text = F.substring(shown, F.length(role) + split + len(TEXT), F.lit(1 << 30))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    own = F.flatten(F.transform("w", lambda w: F.filter(F.split(w["text"], end), lambda s: F.startswith(s, F.lit(OWN)))))
    targets = F.flatten(
        F.transform("w", lambda w: F.transform(w["spans"], lambda s: unescaped(F.substring(w["text"], s["start"] + 1, s["end"] - s["start"]))))
    )
    length = F.aggregate("w", F.lit(0).cast("long"), lambda n, w: n + F.length(w["text"]))
    return gathered.select("conv_id", F.transform(own, turn).alias("turns"), targets.alias("targets"), length.alias("formatted_chars"))
