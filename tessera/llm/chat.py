"""Chat formatting by a grammar round trip, in DataFrame functions only.

A turn is rendered as ``<s>[INST] role \\n text  [/INST]</s>`` (without the blanks around the newline).  The parser is
deterministic and strict: it cuts at ``</s>``, wants the exact opening and closing marks around each piece, and rejects a
body that holds any control string.  A turn is rendered with the first of LEVELS (plain, escaped) whose parse is exactly its
source, and the whole conversation is parsed again and compared (`verified`).

Escaping puts ESC inside a control string, turns a real ESC into ESC + "e", and a newline of a role into ESC + "n"; what follows
an ESC ("e", "n", or the rest of a control string) tells the three apart.  An escaped body holds no control string, because
every one is broken up and no removal of characters can make a new one, and an escaped role holds no newline: so the parse of
an escaped turn is always its source, and the loop ends there.

Defined cases: null text or role counts as empty; a null conv_id is a conversation of its own; turns are ordered by turn
(nulls first), then role, then text, and repeated rows are turns of their own; very long texts are formatted whole; other
columns, also those named like working columns, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, SHUT, END = "<s>[INST] ", " [/INST]", "</s>"
ESC = "␛"
CONTROLS = r"(<|\[)(/?s>|/?INST\])"
STRAY = rf"{ESC}|<s>|</s>|\[INST\]|\[/INST\]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(ESC), F.lit(ESC + "e")), CONTROLS, f"$1{ESC}$2")


def unescaped(text: Column) -> Column:
    lines = F.replace(F.regexp_replace(text, f"{ESC}(?![en])", ""), F.lit(ESC + "n"), F.lit("\n"))
    return F.replace(lines, F.lit(ESC + "e"), F.lit(ESC))


#: Ways to render (role, text), in the order in which they are tried.
LEVELS = (lambda role, text: (role, text), lambda role, text: (F.replace(escaped(role), F.lit("\n"), F.lit(ESC + "n")), escaped(text)))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(SHUT + END))


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in `formatted`; a piece that breaks the grammar gives a null entry."""
    pieces = F.split(formatted, END, -1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece) - len(OPEN) - len(SHUT))
        cut = F.instr(body, "\n")
        good = piece.startswith(OPEN) & piece.endswith(SHUT) & (cut > 0) & ~body.rlike(r"<s>|\[INST\]|\[/INST\]")
        return F.when(good, F.struct(unescaped(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescaped(F.substring(body, cut + 1, F.length(body))).alias("text")))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask, verified.

    loss_mask has, per assistant turn, the index of the turn (from 0), the text's absolute start in `formatted`, its
    offset within its turn and its length, all in code points; the mask covers escaped texts and nothing between them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    ways = [level(F.col("role"), F.col("text")) for level in LEVELS]
    chosen = F.struct(*(c.alias(n) for c, n in zip(ways[-1], ("role", "text"), strict=True)))
    for way in reversed(ways[:-1]):
        again = parsed(rendered(*way))
        same = (F.size(again) == 1) & F.coalesce((again[0]["role"] == F.col("role")) & (again[0]["text"] == F.col("text")), F.lit(False))
        chosen = F.when(same, F.struct(*(c.alias(n) for c, n in zip(way, ("role", "text"), strict=True)))).otherwise(chosen)
    rows = rows.withColumn("way", chosen).withColumns({"out_role": F.col("way.role"), "out_text": F.col("way.text")})
    rows = rows.withColumn("out", rendered(F.col("out_role"), F.col("out_text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.lit(len(OPEN) + 1) + F.length("out_role")
    start = F.sum(F.length("out").cast("long")).over(upto) - F.length("out") + offset
    rows = rows.select("conv_id", F.struct("place", "role", "text", "out", start.alias("start"), offset.alias("offset"), F.length("out_text").alias("n")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("t", lambda t: t["out"]), ""))
    same = F.coalesce(parsed(F.col("formatted")) == F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))
    mask = F.transform(F.filter("t", lambda t: t["role"] == "assistant"), lambda t: F.struct((t["place"] - 1).alias("turn"), t["start"].alias("start"), t["offset"].alias("offset"), t["n"].alias("length")))
    return whole.select("conv_id", "formatted", mask.alias("loss_mask"), same.alias("verified"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted output says when it is read back: turns, loss text and sizes of each conversation."""
    turns = parsed(F.col("formatted"))
    pieces = F.split("formatted", END, -1)
    read = formatted.select(
        "conv_id",
        "formatted",
        "verified",
        F.size(turns).cast("long").alias("n_turns"),
        F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(F.transform("loss_mask", lambda m: unescaped(F.substring(F.element_at(pieces, m["turn"] + 1), m["offset"] + 1, m["length"]))), "").alias("loss"),
    )
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "verified",
    )
