"""Chat formatting: conversations as template text with a loss mask, and back. Spark expressions only.

Template: a block per run of turns with one role, ``<|im_start|>role\\ntext<|im_end|>\\n``; texts inside a block are
parted by ``<|im_next|>``, so merging adjacent turns loses nothing. No text can hold a control string: one backslash
goes between each ``<`` (with the backslashes after it) and ``|``, and reading takes it out again. In roles, ``%``,
line ends and ``|`` are percent-encoded.

Defined results: a null text or role counts as empty; a null turn sorts first; rows with equal turns are ordered by
role, then text; repeated rows are turns of their own; rows with a null conv_id form one conversation of their own;
no rows give no conversations; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for plain, code in (("%", "%25"), ("\n", "%0A"), ("|", "%7C")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in (("|", "%7C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, n_blocks, formatted, mask: the text and its loss mask, (start, length) in code points of
    ``formatted``, in order: just the texts of ``loss_roles``, empty ones left out.

    Escaping runs per row, before rows meet; the only shuffle is by conv_id, and a task holds one conversation at a
    time, which is one output row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select(
        "conv_id",
        F.struct(
            "turn",
            role.alias("role"),
            text.alias("text"),
            escape_role(role).alias("head"),
            escape_text(text).alias("body"),
            role.isin(*loss_roles).alias("loss"),
        ).alias("t"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # A block starts where the role differs from the turn before; its turns are a slice up to the next start.
    begun = sorted_turns.withColumn(
        "begins",
        F.filter(
            F.sequence(F.lit(1), F.size("turns")),
            lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
        ),
    )
    blocks = begun.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.transform("begins", lambda b, j: F.slice("turns", b, F.coalesce(F.get("begins", j + 1), F.size("turns") + 1) - b)).alias("blocks"),
    )

    def parts(block: Column) -> Column:
        """Header, then texts parted by NEXT, then the end; each with its loss flag."""
        first = F.element_at(block, 1)
        texts = F.transform(
            block,
            lambda t, k: F.array(
                F.struct(F.when(k == 0, F.concat(F.lit(START), first["head"], F.lit("\n"))).otherwise(F.lit(NEXT)).alias("text"), F.lit(False).alias("loss")),
                F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
            ),
        )
        return F.concat(F.flatten(texts), F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss"))))

    segmented = blocks.select("conv_id", "n_turns", F.size("blocks").cast("long").alias("n_blocks"), F.flatten(F.transform("blocks", parts)).alias("segments"))
    sized = segmented.withColumn("sizes", F.transform("segments", lambda s: F.char_length(s["text"])))
    placed = sized.withColumn("starts", running_totals("sizes"))
    spans = F.transform("segments", lambda s, k: F.when(s["loss"], F.struct(F.get("starts", k).alias("start"), F.get("sizes", k).alias("length"))))
    return placed.select(
        "conv_id", "n_turns", "n_blocks", F.array_join(F.col("segments.text"), "").alias("formatted"), F.filter(spans, lambda m: m["length"] > 0).alias("mask")
    )


#: Elements whose totals are worked out from one start.
STRIDE = 128


def running_totals(numbers: str) -> Column:
    """The sum of what comes before each element, by way of the sums before every ``STRIDE``-th one."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    strides = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / STRIDE).cast("int")), lambda b: total(F.slice(numbers, b * STRIDE + 1, F.lit(STRIDE))))
    heads = F.aggregate(strides, F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))
    within = lambda k: total(F.slice(numbers, F.floor(k / STRIDE).cast("int") * STRIDE + 1, k % STRIDE))
    each = lambda h: F.transform(numbers, lambda _, k: F.get(h, F.floor(k / STRIDE).cast("int")) + within(k))
    return F.get(F.transform(F.array(heads), each), 0)  # a variable for the heads, so that they are made once


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), each turn on its own again."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def of(block: Column) -> Column:
        inner = F.substring(block, F.lit(len(START) + 1), F.length(block))
        role = unescape_role(F.substring_index(inner, "\n", 1))
        body = F.substring(inner, F.instr(inner, "\n") + 1, F.length(inner))
        return F.transform(F.split(body, r"<\|im_next\|>"), lambda t: F.struct(role.alias("role"), unescape_text(t).alias("text")))

    return F.flatten(F.transform(blocks, of))


def loss_text(formatted: str, mask: str) -> Column:
    """All text under the mask, cut from the formatted text and unescaped. The text is cut in stretches of ``STRIDE`` spans
    first, since finding a code point means counting from the start."""
    last = lambda spans: F.element_at(spans, -1)["start"] + F.element_at(spans, -1)["length"]

    def stretch(b: Column) -> Column:
        spans = F.slice(mask, b * STRIDE + 1, F.lit(STRIDE))
        first = F.element_at(spans, 1)["start"]
        return F.struct(first.alias("first"), F.substring(formatted, first + 1, last(spans) - first).alias("text"), spans.alias("spans"))

    cut = lambda s: F.transform(s["spans"], lambda m: unescape_text(F.substring(s["text"], m["start"] - s["first"] + 1, m["length"])))
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(mask) - 1) / STRIDE).cast("int")), stretch)
    return F.when(F.size(mask) > 0, F.array_join(F.flatten(F.transform(stretches, cut)), "")).otherwise("")
