r"""Chat formatting with a grammar round trip, in DataFrame operations.

    conversation = turn* "</s>"
    turn         = "[INST]" role "\n" text "[/INST]"

`role` is URL-encoded, so it holds neither line ends nor control strings. `text` holds no control string ([INST],
[/INST], <s>, </s>): a backslash goes behind the first character of each, and of each that already has some there,
so every text can be read back exactly and texts without such strings stay as they are.

`render` writes the conversation plainly, parses it, and compares the turns with the source; where they differ,
conflicting content is escaped and the result parsed again. The parser is deterministic: split at "[/INST]", then
at the first line end; a turn that does not begin with "[INST]" or holds a control string inside fits no grammar.

Rows are ordered by turn, then role and text. Null texts and roles are empty. A null conv_id is a conversation
of its own. Repeated rows are turns of their own. Empty tables give no rows. Very long texts are written and read whole.
Other columns of turns are not looked at. Turns of a conversation meet in one row, as its formatted text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: The first character of a control string, and the rest.
_PARTS = ((r"\[", "[", r"/?INST\]"), ("<", "<", "/?s>"))
LEARN = "assistant"


def escape(text: Column) -> Column:
    for pattern, first, rest in _PARTS:
        text = F.regexp_replace(text, f"{pattern}(\\\\*{rest})", f"{first}\\\\$1")
    return text


def unescape(text: Column) -> Column:
    for pattern, first, rest in _PARTS:
        text = F.regexp_replace(text, f"{pattern}\\\\(\\\\*{rest})", f"{first}$1")
    return text


def _turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit("\n"), body, F.lit(CLOSE))


def _written(turns: Column, body) -> Column:
    return F.concat(F.concat_ws("", F.transform(turns, lambda t: _turn(t["role"], body(t["text"])))), F.lit(END))


def _pieces(formatted: Column) -> Column:
    """What is before each CLOSE; without the END, nothing is behind the last."""
    pieces = F.split(F.regexp_replace(formatted, r"</s>\z", ""), r"\[/INST\]", -1)
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def _read(piece: Column) -> tuple[Column, Column]:
    """The role of a piece, null where the grammar does not fit, and the escaped text."""
    inside = F.substring(piece, len(OPEN) + 1, 1 << 30)
    at = F.instr(inside, "\n")
    body = F.substring(inside, at + 1, F.lit(1 << 30))
    fits = piece.startswith(OPEN) & (at > 0) & ~F.rlike(body, F.lit(r"\[/?INST\]|</?s>"))
    return F.when(fits, F.try_url_decode(F.substring(inside, F.lit(1), at - 1))), body


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; null roles where the grammar does not fit."""

    def turn(piece: Column) -> Column:
        role, body = _read(piece)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(_pieces(formatted), turn)


def render(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. One row per conversation: conv_id, formatted, loss_spans (code points
    [start, end) of what is learned), round_trip."""
    rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    length = lambda c: F.char_length(c).cast("long")
    rows = rows.withColumns({"_head": length(F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))), "_body": length(escape(F.col("text")))})
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum(F.col("_head") + F.col("_body") + len(CLOSE)).over(before), F.lit(0)) + F.col("_head"))
    fields = F.struct("turn", "role", "text", "_start", (F.col("_start") + F.col("_body")).alias("_end"))
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(fields)).alias("_all"))
    df = df.withColumn("_turns", F.transform("_all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    plain = _written(F.col("_turns"), lambda x: x)
    df = df.withColumn("_plain", plain).withColumn("formatted", F.when(parse(F.col("_plain")).eqNullSafe(F.col("_turns")), F.col("_plain")).otherwise(_written(F.col("_turns"), escape)))
    spans = F.transform(F.filter("_all", lambda t: t["role"] == LEARN), lambda t: F.struct(t["_start"].alias("start"), t["_end"].alias("end")))
    return df.select("conv_id", "formatted", spans.alias("loss_spans"), parse(F.col("formatted")).eqNullSafe(F.col("_turns")).alias("round_trip"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of render()'s output, from `formatted` and `loss_spans` alone. A turn's place in the text follows from
    the lengths of the pieces before it. The loss mask covers what is between the places of each span: the span meets
    the turn whose text begins and ends there, and its loss is that text, unescaped. If a span's places are not those of
    one turn's text, loss_chars and loss_sha256 are null. So places are found by sorting turns, not by counting through
    the text for each span."""
    key = formatted.select("conv_id", "formatted", "loss_spans")
    turns = key.select("conv_id", F.char_length("formatted").cast("long").alias("chars"), F.posexplode_outer(_pieces(F.col("formatted"))).alias("pos", "piece"))
    role, body = _read(F.col("piece"))
    turns = turns.withColumns({"role": role, "body": body, "long": F.coalesce(F.char_length("piece") + len(CLOSE), F.lit(0)).cast("long")})
    none = lambda t: F.lit(None).cast(t)
    spans = key.select("conv_id", F.explode("loss_spans").alias("s")).select("conv_id", none("long").alias("chars"), none("int").alias("pos"), none("string").alias("role"), none("string").alias("body"), F.lit(0).cast("long").alias("long"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    rows = turns.select("conv_id", "chars", "pos", "role", "body", "long", none("long").alias("start"), none("long").alias("end")).union(spans)
    upto = Window.partitionBy("conv_id").orderBy(F.col("pos").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum("long").over(upto) - len(CLOSE)
    rows = rows.withColumns({"_stop": stop}).withColumns({"end": F.coalesce("end", "_stop"), "start": F.coalesce("start", F.col("_stop") - F.char_length("body"))})
    place = Window.partitionBy("conv_id", "start", "end")
    is_turn, is_span = F.col("pos").isNotNull(), F.col("pos").isNull() & F.col("chars").isNull()
    rows = rows.withColumns({"_masked": F.sum(is_span.cast("int")).over(place), "_turns": F.sum(is_turn.cast("int")).over(place)})
    # a turn without text has the place of no other: CLOSE lies between them
    fields = F.struct("pos", "role", unescape(F.col("body")).alias("text"), (F.col("_masked") > 0).alias("loss"))
    df = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(is_turn, fields))).alias("_all"),
        F.max("chars").alias("formatted_chars"),
        F.count(F.when(is_span & (F.col("_turns") != 1), 1)).alias("_lost"),
        F.count(F.when(is_turn & (F.col("_masked") > 1), 1)).alias("_twice"),
    )
    said = F.concat_ws("", F.transform("_all", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform(F.filter("_all", lambda t: t["loss"]), lambda t: t["text"]))
    df = df.withColumn("_loss", F.when((F.col("_lost") == 0) & (F.col("_twice") == 0), loss))
    return df.select(
        "conv_id",
        F.size("_all").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
