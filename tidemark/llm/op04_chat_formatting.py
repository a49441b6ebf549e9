r"""Chat formatting checked by a grammar round trip, in built-in functions only.

    conversation := turn*
    turn         := "<|im_start|>" role "\n" text "<|im_end|>" "\n"

Neither role nor text may hold a control string. A turn is rendered as it is
and parsed; if the parser doesn't give back exactly that turn, its content is
escaped and it is rendered and parsed again. Escaping puts one backslash more
between `<` and `|` (and, in a role, writes a line feed as `<n>`); the parser
always takes one away, so the step can be undone for every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"<\|im_(?:start|end)\|>"


def escape_text(c: Column) -> Column:
    """No `<|` is left; see the module's text."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(c: Column) -> Column:
    """Undoes escape_text."""
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    """As escape_text; a line feed becomes `<n>`."""
    return F.replace(F.regexp_replace(escape_text(c), r"<(\\*)n>", r"<\\$1n>"), F.lit("\n"), F.lit("<n>"))


def unescape_role(c: Column) -> Column:
    """Undoes escape_role."""
    return unescape_text(F.regexp_replace(F.replace(c, F.lit("<n>"), F.lit("\n")), r"<\\(\\*)n>", "<$1n>"))


def render(role: Column, text: Column) -> Column:
    """One turn, its content as given."""
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation, or null where the grammar doesn't hold."""
    pieces = F.split(formatted, _CONTROL, -1)
    bodies = F.filter(pieces, lambda _, i: i % 2 == 1)
    between = F.filter(pieces, lambda _, i: (i % 2 == 0) & (i > 0))
    turns = F.transform(
        bodies,
        lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape_text(b.substr(F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))).alias("text"),
        ),
    )
    well_formed = (F.element_at(pieces, 1) == "") & F.forall(between, lambda x: x == "\n") & (F.size(pieces) % 2 == 1) & F.forall(bodies, lambda b: F.contains(b, F.lit("\n")))
    return F.when(well_formed, turns)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, n_turns, loss_spans, n_escaped, round_trip: one row per conversation.

    loss_spans holds (start, length) in code points of formatted, one for each
    non-empty text of `loss_role`. round_trip says that the parser gives back
    every turn of the source. A null role or text counts as empty; a null turn
    number comes first; turns with the same number are ordered by role, then
    text, and repeated rows stay repeated; rows without a conv_id form one
    conversation; other columns are left out; an empty table gives no rows. A
    conversation is one string, so it must fit a cell. One shuffle, by conv_id.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bare = render(F.col("role"), F.col("text"))
    same = F.coalesce(parse(F.col("bare")) == F.array(F.struct("role", "text")), F.lit(False))
    rows = rows.withColumn("bare", bare).withColumn("fits", same)
    rows = rows.withColumn("rendered", F.when(F.col("fits"), F.col("bare")).otherwise(render(escape_role(F.col("role")), escape_text(F.col("text")))))
    rows = rows.withColumn("size", F.length("rendered")).withColumn("head", F.when(F.col("fits"), F.length("role")).otherwise(F.length(escape_role(F.col("role")))) + len(START) + 1)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("begins", F.coalesce(F.sum("size").over(before), F.lit(0)))
    span = F.when((F.col("role") == loss_role) & (F.col("text") != ""), F.struct((F.col("begins") + F.col("head")).cast("long").alias("start"), (F.col("size") - F.col("head") - len(END) - 1).cast("long").alias("length")))
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "role", "text", "rendered", span.alias("span")))).alias("turns"),
        F.sum(F.when(F.col("fits"), 0).otherwise(1)).alias("n_escaped"),
    )
    out = grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        "n_escaped",
    )
    return out.select("conv_id", "formatted", F.size("source").cast("long").alias("n_turns"), "loss_spans", "n_escaped", F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False)).alias("round_trip"))


def loss_text(formatted: DataFrame) -> DataFrame:
    """The rows with loss_text: what stands under the loss spans, unescaped, in order.

    Without spans it is empty; a null conversation or null spans give null;
    repeated rows stay repeated, a null conv_id is kept, an empty table stays
    empty; a column of that name is replaced.
    """
    cut = F.transform("loss_spans", lambda s: unescape_text(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("loss_text", F.array_join(cut, ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, round_trip of format_conversations' output.

    Turns are parsed again from `formatted`, and the loss columns are those of
    the text under its loss spans. A conversation the grammar doesn't hold for
    has null turns; one without loss spans has an empty loss text. Repeated
    rows stay repeated, a null conv_id is kept, an empty table gives no rows.
    """
    parsed = loss_text(formatted).withColumn("turns", parse(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
