"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation = turn*
    turn         = OPEN role "\\n" text CLOSE        role: no "\\n"; role, text: no control string

Each turn is rendered as it is and parsed again. A turn that doesn't come back as the same single
turn is rendered with its fields escaped, which always comes back: escaped fields hold no character
that a control string begins with, and unescaping restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprofile.llm.common import pick

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that tokenizers of chat models take for control tokens.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Characters and what stands for them in an escaped field; & comes first.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;")]


def escape(field: Column) -> Column:
    for plain, entity in ESCAPES:
        field = F.replace(field, F.lit(plain), F.lit(entity))
    return field


def unescape(field: Column) -> Column:
    for plain, entity in reversed(ESCAPES):
        field = F.replace(field, F.lit(entity), F.lit(plain))
    return field


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(rendered: Column) -> Column:
    """The turns of a rendered text as an array of (role, text); null if it is not of the grammar."""
    pieces = F.split(rendered, f"\\Q{CLOSE}\\E")

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(OPEN) + 1))
        cut = F.instr(body, "\n")
        role, text = F.substr(body, F.lit(1), cut - 1), F.substr(body, cut + 1)
        clean = F.lit(True)
        for string in CONTROL:
            clean = clean & ~F.contains(body, F.lit(string))
        return F.struct((F.startswith(piece, F.lit(OPEN)) & (cut > 0) & clean).alias("ok"),
                        unescape(role).alias("role"), unescape(text).alias("text"))

    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)
    whole = (F.element_at(pieces, -1) == "") & F.forall(turns, lambda t: t["ok"])
    return F.when(whole, F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", trained: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans, n_turns, n_escaped, identical.

    loss_spans: (start, length) in code points, from 1, of the text of each turn whose role is
    `trained`. identical: parsing `formatted` gives the source's roles and texts, in order.
    Null role or text is empty. Turns are ordered by turn, then role, then text, nulls first;
    repeated rows are turns of their own. Rows with a null conv_id are one conversation. An empty
    table gives no rows; other columns are not read. One shuffle, on conv_id; a conversation is one
    row of the result, so its turns meet in one task, and nothing else of its size is held.
    """
    source = pick(df, conv_id=conv_id, turn=turn, role=role, text=text).select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    same = F.array(F.struct("role", "text"))
    plain = render(F.col("role"), F.col("text"))
    turns = source.withColumn("fits", F.coalesce(parse(plain) == same, F.lit(False))).withColumn(
        "written_role", F.when(F.col("fits"), F.col("role")).otherwise(escape(F.col("role")))).withColumn(
        "written", F.when(F.col("fits"), F.col("text")).otherwise(escape(F.col("text"))))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("written_role") + F.length("written") + len(OPEN) + 1 + len(CLOSE)
    before = F.coalesce(F.sum(size).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.select(
        "conv_id", F.struct(F.row_number().over(ordered).alias("n"), "role", "text",
                            render(F.col("written_role"), F.col("written")).alias("rendered"), "fits",
                            (before + len(OPEN) + F.length("written_role") + 2).alias("start"), F.length("written").alias("length")).alias("t"))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", "t", F.array_join(F.transform("t", lambda t: t["rendered"]), "").alias("formatted"))
    spans = F.transform(F.filter("t", lambda t: t["role"] == trained), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    turns_of = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select(
        F.col("conv_id").alias(conv_id), "formatted", spans.alias("loss_spans"), F.size("t").cast("long").alias("n_turns"),
        F.size(F.filter("t", lambda t: ~t["fits"])).cast("long").alias("n_escaped"),
        F.coalesce(parse(F.col("formatted")) == turns_of, F.lit(False)).alias("identical"))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["length"]))), "")
