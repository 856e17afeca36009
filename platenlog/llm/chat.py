"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, neighbours of
the same role are merged into one block by array functions, and the blocks are
joined to one text:

    <|im_start|>role\\nfirst text<|im_more|>second text<|im_end|>\\n

``<|im_more|>`` stands between merged turns, so that nothing is lost by merging.
Inside texts and roles ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, so a
text can hold no marker; in roles a line end becomes ``&#10;``. Both are undone
by :func:`read_back`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MORE, END = "<|im_start|>", "<|im_more|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
# Pieces of a conversation whose sizes are summed together.
BLOCK = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_conversations(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned_role: str = LEARNED_ROLE,
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` holds, in code points of ``formatted``, the start (from 0) and
    the length of each text of ``learned_role``, in order.

    Rows are taken in order of turn, then role, then text; a null turn comes
    first, and equal rows are all kept. A null text or role reads as empty, a
    null conversation id is a conversation of its own, and an empty table gives
    no rows. Columns besides the four named are ignored. A conversation is one
    output text, so its turns meet in one row; different conversations do not.
    """
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("said"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    at = F.sequence(F.lit(0), F.size("turns") - 1)
    opens = turns.withColumn(
        "opens",
        F.filter(
            at,
            lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
        ),
    )
    blocks = opens.withColumn(
        "blocks",
        F.transform(
            "opens",
            lambda first, k: F.struct(
                F.get("turns", first)["role"].alias("role"),
                F.transform(
                    F.slice("turns", first + 1, F.coalesce(F.get("opens", k + 1), F.size("turns")) - first),
                    lambda said: escape(said["text"]),
                ).alias("texts"),
            ),
        ),
    )
    # The pieces of the output, each with what it is: a marker or a text of some role.
    pieces = blocks.select(
        "conv_id",
        F.flatten(
            F.transform(
                "blocks",
                lambda block: F.concat(
                    F.array(_piece(F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n")), F.lit(False))),
                    F.flatten(
                        F.transform(
                            block["texts"],
                            lambda body, k: F.when(
                                k > 0,
                                F.array(
                                    _piece(F.lit(MORE), F.lit(False)), _piece(body, block["role"] == learned_role)
                                ),
                            ).otherwise(F.array(_piece(body, block["role"] == learned_role))),
                        )
                    ),
                    F.array(_piece(F.lit(END + "\n"), F.lit(False))),
                ),
            )
        ).alias("pieces"),
    )
    # Where each piece starts is summed inside blocks, and block by block: a fold copies
    # what it has so far with every item it adds.
    cuts = F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / BLOCK).cast("int"))
    blocked = pieces.withColumn("cut", F.transform(cuts, lambda k: F.slice("pieces", k * BLOCK + 1, F.lit(BLOCK))))
    sums = blocked.withColumn(
        "ahead",
        _starts(F.transform("cut", lambda own: F.aggregate(own, F.lit(0), lambda n, piece: n + F.length(piece["text"])))),
    )
    spans = F.flatten(
        F.zip_with(
            "cut",
            "ahead",
            lambda own, ahead: F.transform(
                F.filter(
                    F.zip_with(
                        own,
                        _starts(F.transform(own, lambda piece: F.length(piece["text"]))),
                        lambda piece, at: F.struct(
                            piece["learned"].alias("learned"),
                            (ahead + at).alias("start"),
                            F.length(piece["text"]).alias("length"),
                        ),
                    ),
                    lambda span: span["learned"],
                ),
                lambda span: F.struct(span["start"].alias("start"), span["length"].alias("length")),
            ),
        )
    )
    return sums.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda piece: piece["text"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def _starts(sizes: Column) -> Column:
    """Array of what comes before each of the sizes."""
    none = F.array().cast("array<int>")
    return F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), none.alias("starts")),
        lambda so_far, size: F.struct(
            (so_far["at"] + size).alias("at"), F.concat(so_far["starts"], F.array(so_far["at"])).alias("starts")
        ),
        lambda so_far: so_far["starts"],
    )


def _piece(text: Column, learned: Column) -> Column:
    return F.struct(text.alias("text"), learned.alias("learned"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (array of role and text, as before merging) and ``loss_text``.

    Both come from the formatted text alone: the turns by its markers, the loss
    text by the spans of the mask.
    """
    # What follows the last end marker is empty and is not a block.
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda block: block != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda block: F.transform(
                F.split(F.substr(block, F.length(F.substring_index(block, "\n", 1)) + 2), r"<\|im_more\|>"),
                lambda body: F.struct(
                    unescape_role(F.substr(F.substring_index(block, "\n", 1), F.lit(len(START) + 1))).alias("role"),
                    unescape(body).alias("text"),
                ),
            ),
        )
    )
    # Four bytes a code point, so that a span is cut where it lies and not counted off from the start.
    # The lit character keeps a text that begins with a byte order mark from losing it.
    mark = F.encode(F.lit("x"), "UTF-32")
    learned = F.flatten(
        F.transform(
            F.array(F.encode("formatted", "UTF-32")),
            lambda points: F.transform(
                "loss_spans",
                lambda span: unescape(
                    F.substr(
                        F.decode(F.concat(mark, F.substr(points, span["start"] * 4 + 1, span["length"] * 4)), "UTF-32"),
                        F.lit(2),
                    )
                ),
            ),
        )
    )
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(learned, "").alias("loss_text"), "formatted")
