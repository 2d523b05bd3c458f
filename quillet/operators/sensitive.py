"""Sensitive tokens: labelled runs of digits and codes (K9, G2), and words near known secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet import vocab
from quillet.functions.scalar import B, E, alnum_upper, let, near_secret, strip_edges, word
from quillet.operators.lines import group_lines, union_box, with_previous

#: A run of numbers stops once it has so many digits; so it has as many words at most.
RUN_DIGITS = 20
_NUMBERED = word(vocab.NUMBERED) + rf"|(?i){B}{vocab.NUMBER_SIGNS[0]}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){vocab.NUMBER_SIGNS[1]}(?=[A-Za-z0-9_])"
_REFERENCE, _LOYALTY = word(vocab.REFERENCE), word(vocab.LOYALTY)


def _run(words: Column, i: Column) -> Column:
    """struct(n words, digits) of the numbers that start at word i (1-based)."""
    state = F.struct(F.lit(0).alias("n"), F.lit("").alias("digits"), F.lit(True).alias("open"))

    def step(s: Column, w: Column) -> Column:
        t = w["text"]
        core = F.regexp_replace(t, r"^[^A-Za-z0-9]+|[^A-Za-z0-9.,]+$", "")
        fits = s["open"] & core.rlike(r"^[0-9]+[.,]?\z") & ~t.rlike(vocab.TIME_SHAPE) & ~t.rlike(vocab.MONEY_SHAPE)
        digits = F.when(fits, F.concat(s["digits"], F.regexp_replace(t, "[^0-9]", ""))).otherwise(s["digits"])
        return F.struct((s["n"] + fits.cast("int")).alias("n"), digits.alias("digits"), (fits & (F.length(digits) < RUN_DIGITS)).alias("open"))

    return F.aggregate(F.slice(words, i, F.lit(RUN_DIGITS)), state, step)


def find_sensitive(words: DataFrame) -> DataFrame:
    """doc_id, li, first, last (1-based words of the line), reason, text, box: what must be hidden, line by line.

    What a word would be flagged as does not depend on what was flagged before it, so that comes first for every word;
    then one pass from the left takes each flag that starts after the one before has ended.
    """
    lines = with_previous(group_lines(words))
    here = lambda p: F.col("text").rlike(p)
    near = lambda p: F.col("text").rlike(p) | F.col("prev").rlike(p)
    # Labels are looked up once a line: bound to a variable, so that a pushed filter cannot copy them into the words' lambda.
    labels = F.struct(near(_LOYALTY).alias("loyal"), here(_LOYALTY).alias("loyal_here"), near(_NUMBERED).alias("numbered"), near(_REFERENCE).alias("referenced"))

    def number(run: Column, k: Column, label: Column) -> Column:
        n = F.length(run["digits"])
        dated = (n == 8) & run["digits"].rlike(vocab.DATE_SHAPE)
        reason = F.when(label["loyal"] & (n >= 6), "frequent-flyer").when((n >= 8) & ~dated, "ticket-number").when((n >= 6) & label["numbered"] & ~dated, "ticket-number")
        return F.struct(reason.alias("reason"), (k + 1).alias("first"), (k + run["n"]).alias("last"))

    def flag(w: Column, k: Column, label: Column) -> Column:
        return let(strip_edges(w["text"]), lambda raw: F.when(F.length(raw) >= 4, let(F.upper(raw), lambda tok: of(raw, tok, k, label))))

    def of(raw: Column, tok: Column, k: Column, label: Column) -> Column:
        code = tok.rlike(r"^[A-Z0-9]{5,8}\z") & ~tok.rlike(vocab.DATE_SHAPE) & ~tok.rlike(vocab.SEAT_SHAPE) & ~tok.rlike(vocab.TIME_SHAPE)
        flown = tok.rlike(r"^[A-Z]{2}[0-9]{3,4}\z") & ~label["referenced"]
        mixed = tok.rlike("[0-9]") & code & tok.rlike("[A-Z]") & ~flown
        letters = label["referenced"] & (raw == tok) & tok.rlike(r"^[A-Z]{6}\z") & code
        prefix = label["loyal_here"] & F.coalesce(F.get("words", k + 1)["text"], F.lit("")).rlike(r"^[0-9]{6,}\z")
        found = lambda reason, size: F.struct(reason.alias("reason"), (k + 1).alias("first"), (k + size).alias("last"))
        return (
            F.when(tok.rlike(r"^[0-9]+\z"), let(_run(F.col("words"), k + 1), lambda run: number(run, k, label)))
            .when(mixed, found(F.when(label["loyal"], "frequent-flyer").otherwise("booking-ref"), F.lit(1)))
            .when(letters, found(F.lit("booking-ref"), F.lit(1)))
            .when(prefix, found(F.lit("frequent-flyer"), F.lit(2)))
        )

    flags = let(labels, lambda label: F.filter(F.transform("words", lambda w, k: flag(w, k, label)), lambda f: f["reason"].isNotNull()))
    flagged = lines.withColumn("flags", flags)
    none = F.array().cast("array<struct<reason:string,first:int,last:int>>")
    take = lambda a, f: F.when((F.size(a) == 0) | (f["first"] > F.coalesce(F.get(a, F.size(a) - 1)["last"], F.lit(0))), F.concat(a, F.array(f))).otherwise(a)
    kept = flagged.where(F.size("flags") > 0).select("doc_id", "li", "words", F.explode(F.aggregate("flags", none, take)).alias("f"))
    part = F.slice("words", F.col("f.first"), F.col("f.last") - F.col("f.first") + 1)
    cut = kept.select("doc_id", "li", "f.first", "f.last", "f.reason", part.alias("part"))
    return cut.select("doc_id", "li", "first", "last", "reason", F.array_join(F.col("part.text"), " ").alias("text"), union_box(F.col("part")).alias("box"))


def find_known(words: DataFrame, secrets: DataFrame) -> DataFrame:
    """The words near a known secret of their document (doc_id, secret); the equality on doc_id is the join."""
    want = secrets.select("doc_id", alnum_upper(F.col("secret")).alias("secret")).where(F.length("secret") >= 5).distinct()
    said = words.withColumn("plain", alnum_upper(F.col("text"))).where(F.length("plain") >= 5)
    hit = (said["doc_id"] == want["doc_id"]) & near_secret(said["plain"], want["secret"])
    return said.join(want, hit, "left_semi").drop("plain")
