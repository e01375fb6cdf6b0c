r"""Chat formatting with a checked grammar round trip.

A conversation becomes one text: ``<|im_start|>ROLE\nTEXT<|im_end|>\n`` for each turn. A deterministic
parser reads it back: it splits at the marks, cuts the role at the first line break and undoes escapes.
Each turn is first rendered as it is and parsed again; a turn that does not come back identical is
escaped. If the whole conversation then does not parse to its source, all its turns are escaped, for
which the round trip always holds, because no mark can be left inside.

The escape adds one backslash between ``<`` and ``|`` wherever any number of backslashes stands there;
the parser takes one away. A line break in a role is written as ``<|nl|>``, which no escaped role can
contain. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template.
START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def render(turns: Column, escaped) -> Column:
    """Text of an array of (role, text); ``escaped`` says of each turn whether to escape it."""

    def one(t: Column) -> Column:
        plain = F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(f"{END}\n"))
        safe = F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n"), escape(t["text"]), F.lit(f"{END}\n"))
        return F.when(escaped(t), safe).otherwise(plain)

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Array of (role, text) that a formatted text says; the inverse of a rendering that passed."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.when(p.endswith(f"{END}\n"), F.substring(p, F.lit(1), F.length(p) - len(END) - 1)).otherwise(p)
        cut = F.instr(body, "\n")
        role = F.when(cut > 0, F.substring(body, F.lit(1), cut - 1)).otherwise(body)
        text = F.when(cut > 0, F.substring(body, cut + 1, F.length(body))).otherwise("")
        return F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def _kept(turn: Column) -> Column:
    """Whether a turn, rendered as it is, comes back identical and alone."""
    whole = F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(f"{END}\n"))
    marks = lambda mark: (F.length(whole) - F.length(F.replace(whole, F.lit(mark), F.lit("")))) / len(mark)
    same = F.element_at(parse(whole), 1) == F.struct(turn["role"].alias("role"), turn["text"].alias("text"))
    return (marks(START) == 1) & (marks(END) == 1) & same


def format_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, spans``.

    ``spans`` are the parts of ``formatted`` under the loss mask, as (start, length) in code points from
    1: the texts of the turns of role ``assistant``, without marks. Turns stand in the order of their
    number (null first; ties by role, then text); repeated rows are turns of their own. A null role or
    text counts as empty, and null conv_ids make one conversation. An empty table gives an empty result.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    gathered = rows.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    source = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    convs = gathered.groupBy("conv_id").agg(source.alias("source"))
    convs = convs.withColumn("marked", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (~_kept(t)).alias("conflict"))))
    convs = convs.withColumn("tried", render(F.col("marked"), lambda t: t["conflict"]))
    passed = parse(F.col("tried")) == F.col("source")
    convs = convs.withColumn("formatted", F.when(passed, F.col("tried")).otherwise(render(F.col("marked"), lambda t: F.lit(True))))
    return convs.select("conv_id", "formatted", spans(F.col("formatted")).alias("spans"))


def spans(formatted: Column) -> Column:
    """(start, length) of the assistant's texts in a formatted conversation, read from its marks."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    first = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        head = len(START) + len("assistant\n")
        span = F.struct((a["at"] + head).alias("start"), (F.length(p) - len("assistant\n") - len(END) - 1).alias("length"))
        here = p.startswith("assistant\n")
        return F.struct((a["at"] + len(START) + F.length(p)).alias("at"), F.when(here, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, first, step)["out"]


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted conversations (conv_id, formatted, spans) say.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``: the turns as parsed,
    and the text under the loss mask, cut out by its spans and unescaped.
    """
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))), "")
    out = formatted.withColumn("turns", turns).withColumn("said", said).withColumn("loss", loss)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
