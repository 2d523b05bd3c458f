"""Fixed-width boarding-pass text: decode (K1, J4), day of year (K2), and its encoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet import vocab
from quillet.functions.scalar import drop_zeros, filled, hex_prefix, let
from quillet.schemas import LEG

LEG_CHARS, FIRST_LEG = 37, 24


def decode(raw: Column) -> Column:
    """struct(name, legs), or null. Up to four legs; the conditional section after a leg moves the next one.

    A leg that is short ends the text; a leg with bad airports or day ends it too, with the legs before it.
    """
    return let(F.regexp_replace(raw, r"\r?\n", ""), _decode)


def _decode(s: Column) -> Column:
    good = (F.length(s) >= 60) & F.substring(s, 1, 1).eqNullSafe(F.lit("M")) & F.substring(s, 2, 1).rlike(r"^[1-4]\z")
    cut = lambda p, a, n: F.substring(s, p + a, F.lit(n))

    def leg(p: Column) -> Column:
        return F.struct(
            F.trim(cut(p, 0, 7)).alias("pnr"), cut(p, 7, 3).alias("from"), cut(p, 10, 3).alias("to"), F.trim(cut(p, 13, 3)).alias("carrier"),
            drop_zeros(F.trim(cut(p, 16, 5))).alias("flight"), F.coalesce(filled(F.regexp_extract(cut(p, 21, 3), r"^ *(\d{1,3}) *$", 1)).cast("int"), F.lit(0)).alias("julian"),
            cut(p, 24, 1).alias("cabin"), drop_zeros(F.trim(cut(p, 25, 4))).alias("seat"),
        )

    def step(state: Column, _: Column) -> Column:
        p = state["p"]

        def move(use: Column, now: Column) -> Column:
            return F.struct(
                F.when(use, p + LEG_CHARS + hex_prefix(cut(p, 35, 2))).otherwise(p).alias("p"), use.alias("open"),
                F.when(use, F.concat(state["legs"], F.array(now))).otherwise(state["legs"]).alias("legs"),
            )

        def judge(now: Column) -> Column:
            fine = now["from"].rlike(r"^[A-Z]{3}\z") & now["to"].rlike(r"^[A-Z]{3}\z") & now["julian"].between(1, 366)
            return let(state["open"] & (F.length(s) >= p + LEG_CHARS - 1) & fine, lambda use: move(use, now))

        return let(leg(p), judge)

    start = F.struct(F.lit(FIRST_LEG).alias("p"), F.lit(True).alias("open"), F.array().cast(f"array<{LEG}>").alias("legs"))
    count = F.coalesce(filled(F.regexp_extract(s, "^M([1-4])", 1)).cast("int"), F.lit(1))
    legs = F.aggregate(F.sequence(F.lit(1), count), start, step, lambda state: state["legs"])
    name = F.trim(F.substring(s, 3, 20))
    return F.when(good & (F.size(legs) > 0), F.struct(name.alias("name"), legs.alias("legs")))


def carrier_name(code: Column) -> Column:
    """The name of a known carrier code, else null."""
    names = F.create_map(*[F.lit(x) for pair in vocab.CARRIERS.items() for x in pair])
    return F.try_element_at(names, code)


def encode(name: Column, pnr: Column, origin: Column, destination: Column, carrier: Column, flight: Column, julian: Column, cabin: Column, seat: Column, sequence: Column) -> Column:
    """One leg, 60 characters."""
    pad = lambda c, n: F.rpad(F.substring(c.cast("string"), 1, n), n, " ")
    return F.concat(
        F.lit("M1"), pad(name, 20), F.lit("E"), pad(pnr, 7), pad(origin, 3), pad(destination, 3), pad(carrier, 3), pad(F.lpad(flight.cast("string"), 4, "0"), 5),
        F.lpad(julian.cast("string"), 3, "0"), pad(cabin, 1), pad(F.lpad(seat, 4, "0"), 4), pad(F.lpad(sequence.cast("string"), 4, "0"), 5), F.lit("100"),
    )
