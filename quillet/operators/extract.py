"""Typed fields from recognised text and decoded barcodes, with provenance and confidence."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet import vocab
from quillet.functions.scalar import B, E, as_date, filled, fold_accents, half_up, iso_date, julian_date, let, month_number, tidy, word
from quillet.operators import bcbp

_MARK = "\u0001"
NAMES = ("type", "title", "origin", "destination", "date", "carrier", "seat")


def matches(text: Column, pattern: str) -> Column:
    """array of (at, text): matches from left to right, none overlapping, with their places (0-based characters)."""
    pieces = F.split(F.regexp_replace(F.translate(text, _MARK, " "), pattern, f"{_MARK}$0{_MARK}"), _MARK)
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast("array<struct<at:int,text:string>>").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        found = F.when(state["k"] % 2 == 1, F.concat(state["found"], F.array(F.struct(state["at"].alias("at"), piece.alias("text"))))).otherwise(state["found"])
        return F.struct((state["at"] + F.length(piece)).alias("at"), (state["k"] + 1).alias("k"), found.alias("found"))

    return F.aggregate(pieces, empty, step, lambda state: state["found"])


def find_date(text: Column, as_of) -> Column:
    """K3: the first possible date in the text that is at most 400 days after as_of; empty if none."""
    return let(fold_accents(text), lambda t: _first_date(t, as_of))


def _first_date(t: Column, as_of) -> Column:
    number = lambda x, p, g: filled(F.regexp_extract(x, p, g)).cast("int")

    def ymd(x: Column) -> Column:
        p = r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})$"
        return iso_date(number(x, p, 1), number(x, p, 2), number(x, p, 3))

    def dmy(x: Column) -> Column:
        p = r"^(\d{1,2})[./-](\d{1,2})[./-](\d+)$"
        a, b, y = (number(x, p, g) for g in (1, 2, 3))
        return F.when((a > 12) | (b <= 12), iso_date(y, b, a)).otherwise(iso_date(y, a, b))

    def day_month(x: Column) -> Column:
        p = r"^(\d{1,2})\s?([A-Za-z]+)\.?\s?(\d+)$"
        return iso_date(number(x, p, 3), month_number(F.regexp_extract(x, p, 2)), number(x, p, 1))

    def month_day(x: Column) -> Column:
        p = r"^([A-Za-z]+)\.?\s(\d{1,2}),?\s(\d{4})$"
        return iso_date(number(x, p, 3), month_number(F.regexp_extract(x, p, 1)), number(x, p, 2))

    families = ((vocab.YMD, ymd), (vocab.DMY, dmy), (vocab.DAY_MONTH, day_month), (vocab.MONTH_DAY, month_day))

    def candidates(family: int, pattern: str, read) -> Column:
        return F.transform(matches(t, pattern), lambda m: F.struct(m["at"].alias("at"), F.lit(family).alias("family"), read(m["text"]).alias("v")))

    found = F.concat(*[candidates(k, p, read) for k, (p, read) in enumerate(families)])
    limit = F.date_format(F.date_add(as_date(as_of), 400), "yyyy-MM-dd")
    return F.coalesce(F.get(F.array_sort(F.filter(found, lambda c: c["v"] <= limit)), 0)["v"], F.lit(""))


def kind_hits(text: Column) -> dict[str, Column]:
    """distinct lower-cased keywords of each kind."""
    hits = lambda p: F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(word(p)), F.lit(0)), lambda h: F.lower(h))))
    return {kind: hits(p) for kind, p in vocab.KIND_WORDS.items()}


def vote_kind(text: Column) -> Column:
    """K6: struct(kind, hits); the earlier kind wins ties, a bus makes anything but a flight other."""

    def vote(by: Column) -> Column:
        top = F.array_max(by)
        kind = F.when(top == 0, "other").otherwise(F.element_at(F.array(*map(F.lit, vocab.KIND_WORDS)), F.array_position(by, top).cast("int")))
        bus = (kind != "flight") & text.rlike(vocab.BUS)
        return F.struct(F.when(bus, "other").otherwise(kind).alias("kind"), top.alias("hits"))

    return let(F.array(*kind_hits(text).values()), vote)


def find_seat(text: Column) -> Column:
    """K5: section, row and seat; coach and seat in columns; coach and seat; a plain seat."""
    sec, head, below, coach = vocab.SECTION_ROW_SEAT, vocab.COACH_SEAT_HEAD, vocab.COACH_SEAT_BELOW, vocab.COACH_SEAT
    near, after = vocab.SEAT_NEAR, vocab.SEAT_AFTER
    get = lambda p, g: F.regexp_extract(text, p, g)
    return (
        F.when(text.rlike(sec), F.format_string("Sec %s, Row %s, Seat %s", get(sec, 1), get(sec, 2), get(sec, 3)))
        .when(text.rlike(head) & text.rlike(below), F.format_string("Coach %s, seat %s", get(below, 1), get(below, 2)))
        .when(text.rlike(coach), F.format_string("Coach %s, seat %s", get(coach, 1), get(coach, 2)))
        .when(text.rlike(near), F.upper(get(near, 1)))
        .when(text.rlike(after), F.upper(get(after, 1)))
        .otherwise("")
    )


def find_route(lines: Column) -> Column:
    """K4: struct(origin, destination) or null, of an array of line texts: an arrow, labelled lines, two place codes."""
    clean = lambda s: tidy(F.regexp_replace(s, r"^[^A-Za-z0-9]+|[^A-Za-z0-9.)]+\z", ""))
    pair = lambda a, b: F.struct(a.alias("origin"), b.alias("destination"))
    group = lambda s, p, g: F.regexp_extract(s, p, g)

    def by_arrow(hit: Column) -> Column:
        return F.when((hit != "") & ~hit.rlike(word(vocab.NO_ROUTE)), pair(clean(group(hit, vocab.ARROW, 1)), clean(group(hit, vocab.ARROW, 2))))

    def by_code(hit: Column) -> Column:
        one, two = group(hit, vocab.CODE_PAIR, 1), group(hit, vocab.CODE_PAIR, 2)
        return F.when((hit != "") & (one != two) & ~one.rlike(f"^(?:{vocab.NOT_A_CODE})$"), pair(one, two))

    def head(line: Column, i: Column) -> Column:
        said = lambda label, words: label["a"].rlike(f"(?i)^(?:{words})$") | label["b"].rlike(f"(?i)^(?:{words})$")
        label = lambda t: F.struct(t.alias("t"), group(t, vocab.LABELLED, 1).alias("a"), group(t, vocab.LABELLED, 2).alias("b"))
        flags = lambda l: F.struct(i.alias("i"), l["t"].alias("t"), said(l, vocab.FROM).alias("from"), said(l, vocab.TO).alias("to"))
        return let(let(F.trim(line), label), flags)

    def place(t: Column) -> Column:
        return t.rlike("[A-Za-z]{3}") & (F.length(F.regexp_replace(t, "[^A-Za-z]", "")) >= F.length(F.regexp_replace(t, r"\s", "")) * 0.6)

    def valued(h: Column) -> Column:
        below = F.get(F.filter(F.transform(F.slice(lines, h["i"] + 2, F.lit(3)), lambda x: F.trim(x)), place), 0)
        value = F.coalesce(filled(F.trim(group(h["t"], vocab.LABELLED, 3))), below, F.lit(""))
        return F.struct(h["i"].alias("i"), value.alias("value"), h["from"].alias("from"), h["to"].alias("to"))

    def ends(rows: Column) -> Column:
        start = F.get(F.filter(rows, lambda r: r["from"]), 0)

        def with_start(s: Column) -> Column:
            end = F.get(F.filter(rows, lambda r: r["to"] & ~(r["from"] & (r["i"] <= F.coalesce(s["i"], F.lit(2**30))))), 0)
            return let(end, lambda e: F.when(s.isNotNull() & e.isNotNull(), pair(clean(s["value"]), clean(e["value"]))))

        return let(start, with_start)

    heads = F.filter(F.transform(lines, head), lambda h: h["from"] | h["to"])
    by_label = let(F.filter(F.transform(heads, valued), lambda r: r["value"] != ""), ends)
    found = lambda t: F.coalesce(let(group(t, vocab.ARROW, 0), by_arrow), by_label, let(group(t, vocab.CODE_PAIR, 0), by_code))
    return let(F.array_join(lines, "\n"), found)


def confidence(fields: Column, sources: Column) -> Column:
    """1 for each wanted field from a barcode, 0.7 from elsewhere, over the fields that the kind should have."""
    want = F.when(fields["type"] == "event", F.array(F.lit("title"), F.lit("carrier"), F.lit("date"))).when(fields["type"] == "subway", F.array(F.lit("carrier"), F.lit("date"))).otherwise(F.array(*map(F.lit, ("origin", "destination", "date", "carrier"))))
    value = F.create_map(*[x for n in NAMES for x in (F.lit(n), fields[n])])
    score = F.aggregate(want, F.lit(0.0), lambda a, k: a + F.when(F.element_at(value, k) == "", 0.0).when(F.try_element_at(sources, k) == "barcode", 1.0).otherwise(0.7))
    return half_up(score / F.size(want))


def parse_tickets(pages: DataFrame, as_of) -> DataFrame:
    """K8: doc_id, fields, sources, confidence of pages (doc_id, lines of (text, height, conf), barcodes of texts).

    A barcode's values stand; text fills the rest: kind by vote, date, route, seat, then carrier or venue and title from
    the lines printed largest. Every step is an expression over the row.
    """
    lines = F.coalesce("lines", F.array().cast("array<struct<li:int,text:string,height:double,conf:double>>"))
    base = pages.select("doc_id", lines.alias("lines"), F.get(F.filter(F.transform(F.coalesce("barcodes", F.array().cast("array<string>")), bcbp.decode), lambda p: p.isNotNull()), 0).alias("pass"))
    base = base.withColumn("text", F.array_join(F.col("lines.text"), "\n"))
    leg = F.get("pass.legs", 0)
    known = bcbp.carrier_name(leg["carrier"])
    coded = F.col("pass").isNotNull()
    base = base.select(
        "*", coded.alias("coded"), leg["from"].alias("b_origin"), F.element_at("pass.legs", -1)["to"].alias("b_destination"), filled(julian_date(leg["julian"], as_of)).alias("b_date"),
        known.alias("b_carrier"), F.when(known.isNull(), leg["carrier"]).alias("spare"), F.concat(leg["carrier"], F.lit(" "), leg["flight"]).alias("b_title"), filled(leg["seat"]).alias("b_seat"),
    )
    # Text is searched only for what the barcode leaves open: rows that a barcode decides do not pay for the rules.
    open_ = lambda *names: functools.reduce(lambda x, y: x | y, [F.col(n).isNull() for n in names])
    base = base.select(
        "*", F.when(~F.col("coded"), vote_kind(F.col("text"))).alias("vote"), F.when(open_("b_date"), find_date(F.col("text"), as_of)).alias("text_date"),
        F.when(open_("b_origin", "b_destination"), find_route(F.col("lines.text"))).alias("route"), F.when(open_("b_seat"), find_seat(F.col("text"))).alias("text_seat"),
    )
    r = base.withColumns(
        {
            "type": F.when(F.col("coded"), "flight").otherwise(F.col("vote.kind")),
            "origin": F.coalesce("b_origin", "route.origin", F.lit("")),
            "destination": F.coalesce("b_destination", "route.destination", F.lit("")),
        }
    )
    text_of = lambda l: l["text"]
    in_route = lambda t: F.exists(F.array("origin", "destination"), lambda p: (p != "") & F.contains(F.lower(t), F.lower(p)))
    sure = lambda l: (l["conf"] >= 75) & text_of(l).rlike("[A-Za-z]{3,}") & ~F.trim(text_of(l)).rlike(f"(?i)^(?:{vocab.BOILERPLATE})$")
    shown = lambda l: text_of(l).rlike("[A-Za-z]{3}") & (F.length(text_of(l)) <= 40) & ~in_route(text_of(l)) & ~text_of(l).rlike(rf"(?i)^(?:{vocab.NO_TITLE}){E}") & ~F.trim(text_of(l)).rlike(r"^[A-Za-z]+\s*/\s*[A-Za-z]+$")
    tall = F.array_sort(F.transform(F.filter("lines", shown), lambda l: F.struct((-l["height"]).alias("down"), l["li"].alias("li"), l["text"].alias("text"), l["conf"].alias("conf"))))
    named = open_("b_title", "b_carrier")  # what is left to find among the lines
    r = r.withColumn("tall", F.when(named, tall))
    venue = F.get(F.filter("lines", lambda l: text_of(l).rlike(word(vocab.VENUE))), 0)
    brand = F.get(F.filter("lines", lambda l: text_of(l).rlike(word(vocab.BRAND)) & (F.length(text_of(l)) <= 40)), 0)
    r = r.withColumns({"venue": F.when(named, venue), "brand": F.when(open_("b_carrier"), brand)})
    act = F.get(F.filter("tall", lambda l: ~l["li"].eqNullSafe(F.col("venue.li")) & sure(l) & ~text_of(l).rlike(word(vocab.NO_ACT))), 0)
    solid = F.get(F.filter("tall", lambda l: sure(l) & (l["conf"] >= 80) & text_of(l).rlike("[A-Za-z]{4,}") & ~text_of(l).rlike(r"\d{2}")), 0)
    flight = vocab.FLIGHT_NUMBER
    flown = F.when((F.col("type") == "flight") & (F.regexp_extract("text", flight, 0) != ""), F.concat_ws(" ", F.regexp_extract("text", flight, 1), F.regexp_extract("text", flight, 2)))
    event = F.col("type") == "event"
    branded = tidy(F.regexp_replace(F.col("brand.text"), rf"(?i)\s*{B}(?:{vocab.BRAND_TAIL}){E}.*\z", ""))
    by_text = F.when(event, tidy(F.col("venue.text"))).when(F.col("brand").isNotNull(), branded).when(F.col("spare").isNull(), tidy(solid["text"]))
    r = r.select(
        "doc_id", "type", "origin", "destination", "coded", "vote", "b_origin", "b_destination", "b_date", "b_carrier", "b_title", "b_seat", "text_date", "text_seat", "spare",
        F.when(open_("b_carrier"), filled(by_text)).alias("t_carrier"), F.when(open_("b_title"), filled(F.when(event, tidy(act["text"])).otherwise(flown))).alias("t_title"),
    )
    pick = lambda b, t: F.coalesce(F.col(b), filled(F.col(t)), F.lit(""))
    fields = F.struct(
        "type", F.coalesce("b_title", "t_title", F.lit("")).alias("title"), "origin", "destination", pick("b_date", "text_date").alias("date"),
        F.coalesce("b_carrier", "t_carrier", filled(F.col("spare")), F.lit("")).alias("carrier"), pick("b_seat", "text_seat").alias("seat"),
    )
    r = r.withColumn("fields", fields)
    origin_of = {"type": F.when(F.col("coded"), "barcode").when(F.col("vote.hits") > 0, "text")}
    for name in NAMES[1:]:
        if name == "carrier":
            src = F.when(F.col("b_carrier").isNotNull(), "barcode").when(F.col("t_carrier").isNotNull(), "text").when(F.col("fields.carrier") != "", "barcode")
        else:
            src = F.when(F.col(f"b_{name}").isNotNull(), "barcode").when(F.col(f"fields.{name}") != "", "text")
        origin_of[name] = src
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), s.alias("value")) for n, s in origin_of.items()]), lambda e: e["value"].isNotNull())
    r = r.withColumn("sources", F.map_from_entries(entries))
    return r.select("doc_id", "fields", "sources", confidence(F.col("fields"), F.col("sources")).alias("confidence"))


def user_wins(parsed: Column, edited: Column, touched: Column) -> Column:
    """The parsed value only for fields that the user has not touched."""
    return F.struct(*[F.when(F.array_contains(touched, n), edited[n]).otherwise(parsed[n]).alias(n) for n in NAMES])


def mark_user(sources: Column, touched: Column) -> Column:
    """Touched fields come from the user."""
    others = F.map_filter(sources, lambda k, _: ~F.array_contains(touched, k))
    return F.map_concat(others, F.map_from_arrays(touched, F.transform(touched, lambda _: F.lit("user"))))
