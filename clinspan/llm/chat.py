"""Chat formatting of messages made of typed content parts, in DataFrame functions only.

A turn's content is a list of parts ``{kind, text, ref, width, height, seconds, pages}``. A visitor has
one rule per kind: text is escaped and kept, an image, audio or document part becomes the placeholder
``<|kind:turn.part|>`` and leaves its reference and the number of tokens it expands to. A conversation
reads ``<|turn|>role<|body|>content<|end|>\\n`` for each turn. In roles and texts ``\\`` and ``|`` get a
backslash before them, so no text can hold a mark, and :func:`unescape` gives the text back.

The loss mask lists the text parts of the loss roles, as ranges of code points both in the whole
conversation (``start``) and in their turn (``turn``, ``offset``).

Running sums over a conversation are window sums, so the work is linear (up to sorting) in its length;
all parts of one conversation end up in one row, as that row is the result.

Defined cases: null roles and texts count as empty; null or empty lists of parts make a turn with an
empty body; null sizes count as 0 and expand to one token at least; null parts and unknown kinds keep
nothing but an empty text; turns with equal numbers go by role, then by a hash of the content; repeated
rows are repeated turns; null numbers come first; rows with a null conversation id make one
conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
LOSS_ROLES = ("assistant",)
IMAGE_PATCH = 28          # an image expands to one token per patch of so many pixels square
AUDIO_PER_SECOND = 12.5   # tokens
DOCUMENT_PER_PAGE = 512   # tokens
WORD = r"\w+|[^\w\s]"     # a text expands to its words and marks


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """One text part."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def _patches(size: Column) -> Column:
    return F.ceil(F.coalesce(size, F.lit(0)) / IMAGE_PATCH)


EXPANSIONS = {
    "image": lambda p: _patches(p["width"]) * _patches(p["height"]),
    "audio": lambda p: F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_PER_SECOND),
    "document": lambda p: F.coalesce(p["pages"], F.lit(0)) * DOCUMENT_PER_PAGE,
}


def visit(part: Column, turn: Column, place: Column) -> dict[str, Column]:
    """What a part leaves: its piece of the conversation, token count, and attachment if it is one."""
    attached = part["kind"].isin(*EXPANSIONS)
    text = F.coalesce(F.when(part["kind"] == "text", part["text"]), F.lit(""))
    piece, tokens = escape(text), F.regexp_count(text, F.lit(WORD)).cast("long")
    for kind, expand in EXPANSIONS.items():
        here = part["kind"] == kind
        piece = F.when(here, F.concat(F.lit(f"<|{kind}:"), turn, F.lit("."), place, F.lit("|>"))).otherwise(piece)
        tokens = F.when(here, F.greatest(expand(part).cast("long"), F.lit(1).cast("long"))).otherwise(tokens)
    return {"piece": piece, "tokens": tokens, "attached": F.coalesce(attached, F.lit(False))}


def format_chat(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    parts_col: str = "parts", loss_roles: tuple[str, ...] = LOSS_ROLES,
) -> DataFrame:
    """One row per conversation: id, ``formatted``, ``n_turns``, ``n_tokens``, ``loss_spans``, ``attachments``."""
    rows = turns.select(
        F.col(conv_col).alias("__conv"), F.col(turn_col).alias("__turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("__role"), F.col(parts_col).alias("__parts"))
    by_turn = Window.partitionBy("__conv").orderBy("__turn", "__role", F.xxhash64("__parts"))
    rows = rows.withColumn("turn", F.row_number().over(by_turn))
    parts = rows.select(
        "__conv", "turn", "__role", F.greatest(F.coalesce(F.size("__parts"), F.lit(1)), F.lit(1)).alias("count"),
        F.posexplode_outer("__parts").alias("part", "item"))
    parts = parts.withColumn("part", F.coalesce("part", F.lit(0)) + 1)
    parts = parts.withColumns(visit(F.col("item"), F.col("turn").cast("string"), F.col("part").cast("string")))
    head = F.when(F.col("part") == 1, F.concat(F.lit(TURN), escape(F.col("__role")), F.lit(BODY))).otherwise("")
    parts = parts.withColumn("head", head).withColumn("text", F.concat(
        "head", "piece", F.when(F.col("part") == F.col("count"), F.lit(END)).otherwise("")))
    by_part = Window.partitionBy("__conv").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("begin", F.sum(F.char_length("text")).over(by_part) - F.char_length("text"))
    parts = parts.withColumn("of_turn", F.max(F.when(F.col("part") == 1, F.col("begin"))).over(by_part))
    start = F.col("begin") + F.char_length("head")
    span = F.struct(
        "turn", (start - F.col("of_turn")).alias("offset"), start.alias("start"),
        F.char_length("piece").cast("long").alias("length"))
    attachment = F.struct(
        "turn", "part", F.col("item.kind").alias("kind"), F.col("item.ref").alias("ref"), "tokens", start.alias("start"))
    in_loss = F.col("__role").isin(*loss_roles) & ~F.col("attached") & (F.char_length("piece") > 0)
    whole = parts.groupBy("__conv").agg(
        F.sort_array(F.collect_list(F.struct("turn", "part", "text"))).alias("texts"),
        F.sort_array(F.collect_list(F.when(in_loss, span))).alias("loss_spans"),
        F.sort_array(F.collect_list(F.when(F.col("attached"), attachment))).alias("attachments"),
        F.max("turn").cast("long").alias("n_turns"), F.sum("tokens").alias("n_tokens"))
    return whole.select(
        F.col("__conv").alias(conv_col), F.array_join(F.transform("texts", lambda t: t["text"]), "").alias("formatted"),
        "n_turns", "n_tokens", "loss_spans", "attachments")


def turn_texts(formatted: Column) -> Column:
    """The turns of a formatted conversation, without their first mark."""
    return F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)


def read_chat(formatted: Column) -> Column:
    """The turns read back: array of {role, text}, placeholders left as they stand."""
    def turn(x: Column) -> Column:
        fields = F.split(x, r"<\|body\|>")
        body = F.element_at(fields, 2)
        return F.struct(
            unescape(F.element_at(fields, 1)).alias("role"),
            unescape(F.left(body, F.char_length(body) - len(END))).alias("text"))
    return F.transform(turn_texts(formatted), turn)


def masked_texts(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    turns = turn_texts(formatted)
    return F.transform(loss_spans, lambda s: unescape(F.substring(
        F.element_at(turns, s["turn"]), (s["offset"] - len(TURN) + 1).cast("int"), s["length"].cast("int"))))
