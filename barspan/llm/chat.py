"""Conversations as marked-up text that reads back exactly, in DataFrame functions only.

A turn is ``<|im_start|>`` role, line feed, text, ``<|im_end|>``, line feed; a conversation is its turns in order.
In the grammar no role or text holds ``<|``, and no role a line feed, so a deterministic parser finds the
turns. Formatting is a round trip: the text is rendered, parsed again and compared with the source turns;
where they differ, the turns that don't survive alone are escaped and it is rendered anew; if even that differs,
all turns are; a conversation that still came back otherwise would stop the job, never pass.

Escaping puts a backslash behind the ``<`` of any ``<|``, ``<\\|``, ``<\\\\|`` and so on; reading takes one away. A
line feed in a role becomes ``<n|`` (and ``<n|`` itself gets the backslash).

The loss mask lists, for each assistant turn, the turn's number and the code points of its text, counted from the
turn's first mark.

Rows meet per conversation once, since the result is one text for each; rendering and checks are plain
expressions on that row.

Defined cases: a null text or role is an empty one; turns come in order of turn, role and text, nulls first, so
repeated turn numbers are all kept; rows without a conversation id are one conversation; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barspan.llm.rules import let

START, END = "<|im_start|>", "<|im_end|>"
#: Role whose texts are learned.
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(role, r"<([\\n]*)\|", r"<\\$1|"), F.lit("\n"), F.lit("<n|"))


def unescaped_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<n|"), F.lit("\n")), r"<\\([\\n]*)\|", r"<$1|")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def _join(parts: Column) -> Column:
    return F.array_join(parts, "")


def pieces(formatted: Column) -> Column:
    """What follows each start mark."""
    return let(F.split(formatted, r"<\|im_start\|>", -1), lambda p: F.slice(p, 2, F.size(p)))


def _parts(piece: Column) -> Column:
    """struct(role, text) of a piece as they stand there; null if it isn't one turn of the grammar."""

    def of(cut: Column) -> Column:
        whole = cut[0]
        good = (F.size(cut) == 2) & (cut[1] == "\n") & F.contains(whole, F.lit("\n")) & ~F.contains(whole, F.lit("<|"))
        role = F.substring_index(whole, "\n", 1)
        text = F.substring(whole, F.char_length(role) + F.lit(2), F.char_length(whole))
        return F.when(good, F.struct(role.alias("role"), text.alias("text")))

    return let(F.split(piece, r"<\|im_end\|>", -1), of)


def parsed(formatted: Column) -> Column:
    """array<struct<role,text>> of a conversation's turns; null where the text isn't of the grammar."""

    def turn(piece: Column) -> Column:
        return let(_parts(piece), lambda t: F.when(t.isNotNull(), F.struct(unescaped_role(t["role"]).alias("role"), unescaped(t["text"]).alias("text"))))

    turns = let(F.transform(pieces(formatted), turn), lambda ts: F.when(F.forall(ts, lambda t: t.isNotNull()), ts))
    return F.when(F.startswith(formatted, F.lit(START)) | (formatted == ""), turns)


def _same(formatted: Column, turns: Column) -> Column:
    return F.coalesce(parsed(formatted) == turns, F.lit(False))


def formatted(turns: Column) -> Column:
    """The text of ``turns`` (array<struct<role,text>>, no nulls) that parses to exactly them."""
    plain = lambda t: rendered(t["role"], t["text"])
    safe = lambda t: rendered(escaped_role(t["role"]), escaped(t["text"]))

    def checked(text: Column, otherwise: Column) -> Column:
        return let(text, lambda x: F.when(_same(x, turns), x).otherwise(otherwise))

    never = F.raise_error(F.lit("a conversation doesn't read back")).cast("string")
    everything = checked(_join(F.transform(turns, safe)), never)
    conflicting = checked(_join(F.transform(turns, lambda t: let(plain(t), lambda x: F.when(_same(x, F.array(t)), x).otherwise(safe(t))))), everything)
    return checked(_join(F.transform(turns, plain)), conflicting)


def loss_spans(text: Column, learned: str = LEARNED) -> Column:
    """array<struct<turn,start,end>> of a formatted conversation: the code points that are learned."""

    def span(piece: Column, turn: Column) -> Column:
        def of(t: Column) -> Column:
            start = (F.lit(len(START) + 1) + F.char_length(t["role"])).cast("long")
            return F.when(
                unescaped_role(t["role"]) == learned,
                F.struct(turn.cast("long").alias("turn"), start.alias("start"), (start + F.char_length(t["text"])).alias("end")),
            )

        return let(_parts(piece), of)

    return F.filter(F.transform(pieces(text), span), lambda s: s.isNotNull())


def under_mask(text: Column, spans: Column) -> Column:
    """The texts under the mask, unescaped, one after another."""
    return let(
        pieces(text),
        lambda p: _join(F.transform(spans, lambda s: unescaped(F.substring(p[s["turn"].cast("int")], (s["start"] - F.lit(len(START) - 1)).cast("int"), (s["end"] - s["start"]).cast("int"))))),
    )


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted and loss (array<struct<turn,start,end>>) of every conversation of ``rows``."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), whole(role_col).alias("role"), whole(text_col).alias("text"))
    met = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    turns = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    # inline() keeps the optimizer from copying one expression into all its uses.
    made = met.select("conv_id", F.inline(F.array(F.struct(let(turns, formatted).alias("formatted")))))
    return made.select("conv_id", "formatted", loss_spans(F.col("formatted")).alias("loss"))
