"""Extraction against plain Python: generated passes, dates, routes, seats, tickets and lines whose answer is known."""

import datetime as dt
import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from quillet import vocab
from quillet.functions import scalar
from quillet.operators import bcbp, extract, lines, scan, sensitive
from quillet.schemas import BARCODES, OCR_WORDS

TODAY = dt.date(2031, 5, 20)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def results(spark, values, kind, expression):
    """The expression of each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")
    return [r["r"] for r in sorted(rows.select("k", expression(F.col("v")).alias("r")).collect(), key=lambda r: r["k"])]


# ---- passes ----------------------------------------------------------------------------------------------------------


def draw_leg(rng):
    letters = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    return {
        "pnr": letters(rng.choice((6, 7))), "from": letters(3), "to": letters(3), "carrier": letters(rng.choice((2, 3))), "flight": str(rng.randrange(1, 9999)),
        "julian": rng.randrange(1, 367), "cabin": rng.choice("YCF"), "seat": f"{rng.randrange(1, 99)}{rng.choice('ABCDEFGHK')}",
    }


def print_pass(name, legs, extras):
    """Passes as carriers print them: a fixed part of 37 characters a leg, then as many as its last two hex digits say."""
    text = f"M{len(legs)}{name:20.20}E"
    for leg, extra in zip(legs, extras, strict=True):
        flight, seat = leg["flight"].zfill(4), leg["seat"].zfill(4)
        text += f"{leg['pnr']:7}{leg['from']}{leg['to']}{leg['carrier']:3}{flight:5}{leg['julian']:03d}{leg['cabin']}{seat:4}{rng_seq(leg):5}1{len(extra):02X}{extra}"
    return text


def rng_seq(leg):
    return f"{leg['julian'] * 7 % 9999:04d}"


def test_passes_come_back_as_they_were_printed(spark):
    rng = random.Random(5)
    printed, want = [], []
    for _ in range(60):
        name = rng.choice(("OKAFOR/ADA", "DE LA CRUZ/MARIA INES X", "NG/LI"))
        legs = [draw_leg(rng) for _ in range(rng.randrange(1, 5))]
        extras = ["".join(rng.choice("0123456789ABC ^>") for _ in range(rng.choice((0, 0, 5, 27, 200)))) for _ in legs]
        printed.append(print_pass(name, legs, extras))
        want.append((name[:20].strip(), legs))
    got = results(spark, printed, "string", bcbp.decode)
    assert [(p["name"], [leg.asDict() for leg in p["legs"]]) for p in got] == want
    assert results(spark, [p[:30] + "\r\n" + p[30:] for p in printed[:3]], "string", bcbp.decode) == got[:3]


def test_what_is_no_pass(spark):
    rng = random.Random(6)
    good = print_pass("OKAFOR/ADA", [draw_leg(rng), draw_leg(rng)], ["", ""])
    short, bad_day = good[:70], good[:44] + "999" + good[47:]
    second_bad = good[: 23 + 37 + 7] + "1" + good[23 + 37 + 8 :]
    got = results(spark, [None, "", "M1", "N" + good[1:], "M5" + good[2:], "web://pass/" + "7" * 60, bad_day, short, second_bad], "string", bcbp.decode)
    assert got[:7] == [None] * 7
    assert [len(p["legs"]) for p in got[7:]] == [1, 1]  # what is cut off or wrong ends the text, with the legs before it


def test_day_of_year(spark):
    def latest(day):
        for year in range(TODAY.year + 1, TODAY.year - 12, -1):
            date = dt.date(year, 1, 1) + dt.timedelta(day - 1)
            if date.year == year and date <= TODAY + dt.timedelta(60):
                return date.isoformat()

    days = list(range(1, 367))
    assert results(spark, days, "int", lambda d: scalar.julian_date(d, TODAY)) == [latest(d) for d in days]


# ---- dates -----------------------------------------------------------------------------------------------------------


def print_date(rng, date):
    """A date in one of the ways that tickets say it."""
    name = rng.choice([m for m, n in vocab.MONTHS.items() if n == date.month and len(m) <= 9])  # as the pattern has it
    name = rng.choice((name, name.upper(), name.title()))
    sep = rng.choice("-./")
    numbers = f"{date.day}{sep}{date.month}{sep}{date.year}" if date.day > 12 or date.day == date.month else f"{date.year}{sep}{date.month:02d}{sep}{date.day:02d}"
    return rng.choice((numbers, f"{date.day} {name} {date.year}", f"{date.day:02d}{name}{date.year % 100:02d}", f"{name} {date.day}, {date.year}", f"{name}. {date.day} {date.year}"))


def test_dates_come_back_as_they_were_printed(spark):
    rng = random.Random(7)
    texts, want = [], []
    for _ in range(300):
        date = TODAY - dt.timedelta(rng.randrange(-390, 4000))
        before = rng.choice(("", "Gate B12, ", "30/02/2030 or ", "1.1.2099, then ", "n. 123456 "))
        texts.append(f"{before}{print_date(rng, date)} {rng.choice(('10:35', 'at noon', '', f'({date.year - 30}-01-01)'))}")
        want.append(date.isoformat())
    got = results(spark, texts, "string", lambda t: extract.find_date(t, TODAY))
    assert got == want, [x for x in zip(texts, got, want, strict=True) if x[1] != x[2]][:5]


def test_dates_that_are_none(spark):
    texts = ["", "no day", "31.04.2030", "29 feb 2030", "2030-13-01", "5/6", "12 gates 2030", "1/1/2039", "99999999", "3 brumaire 2030"]
    assert results(spark, texts, "string", lambda t: extract.find_date(t, TODAY)) == [""] * len(texts)
    accents = ["7 août 2029", "9 FÉVRIER 2028", "le 2 décembre 2027"]
    assert results(spark, accents, "string", lambda t: extract.find_date(t, TODAY)) == ["2029-08-07", "2028-02-09", "2027-12-02"]


def test_ambiguous_days_come_before_months(spark):
    texts = [f"{a:02d}/{b:02d}/2029" for a in range(1, 32) for b in range(1, 32) if a <= 12 or b <= 12]

    def read(text):
        a, b, y = map(int, text.split("/"))
        day, month = (a, b) if b <= 12 else (b, a)
        try:
            return dt.date(y, month, day).isoformat()
        except ValueError:
            return ""

    assert results(spark, texts, "string", lambda t: extract.find_date(t, TODAY)) == [read(t) for t in texts]


# ---- routes and seats ------------------------------------------------------------------------------------------------

PLACES = ("Oslo", "Puerto Natales", "Saint-Malo", "Kandy Fort", "Ulan Bator (East)")


def test_routes_come_back_as_they_were_printed(spark):
    rng = random.Random(8)
    pages, want = [], []
    for k in range(120):
        a, b = rng.sample(PLACES, 2)
        shape = k % 4
        if shape == 0:
            pages.append(["x9", f"{a} {rng.choice(('→', '->', '=>', '>', '—', '–', 'to'))} {b}"])
        elif shape == 1:
            pages.append([f"{rng.choice(('From', 'DE', 'von', 'Partenza'))}: {a}", f"{rng.choice(('To', 'NACH', 'para', 'Arrivo'))}: {b}"])
        elif shape == 2:
            pages.append(["Origen / From", "1 2", a, "Destino / To", "*", b])
        else:
            a, b = rng.sample(("OSL", "PNT", "KDY", "ULN"), 2)
            pages.append([f"7 {a}{rng.choice((' .. ', ' / ', '  '))}{b} 22"])
        want.append((a, b))
    pages += [["Seat -> Gate"], ["nothing"], [], ["THE 1 END"], ["From", "", "12"], None]
    got = results(spark, pages, "array<string>", extract.find_route)
    assert [r and tuple(r) for r in got] == want + [None] * 6


def test_seats_come_back_as_they_were_printed(spark):
    rng = random.Random(9)
    texts, want = [], []
    for k in range(80):
        row, letter, coach = rng.randrange(1, 99), rng.choice("ABCDEFGHJK"), rng.randrange(1, 30)
        text, seat = (
            (f"Gate 3\nSeat {row}{letter} boarding", f"{row}{letter}"),
            (f"seat\n{row}{letter.lower()}", f"{row}{letter}"),
            (f"Section {letter}\nfloor 2 Row {row}\nSeat {coach}", f"Sec {letter}, Row {row}, Seat {coach}"),
            (f"Wagen / Platz\nMonday\n{coach} / {row}\n", f"Coach {coach}, seat {row}"),
            (f"Coach {coach}, seat {row}", f"Coach {coach}, seat {row}"),
            (f"row {row} only", ""),
        )[k % 6]
        texts.append(text)
        want.append(seat)
    assert results(spark, texts, "string", extract.find_seat) == want


# ---- whole tickets ---------------------------------------------------------------------------------------------------


def word_rows(doc, texts, height=24.0, conf=95.0):
    """Words as a reader lands them: order, line and boxes from left to right."""
    rows = []
    for number, line in enumerate(texts, 1):
        edge = 5.0
        for word in line.split():
            rows.append((doc, len(rows), word, conf, number, edge, 50.0 * number, 11.0 * len(word), height))
            edge += 11.0 * len(word) + 9
    return rows


def test_tickets(spark):
    rng = random.Random(10)
    leg = {**draw_leg(rng), "carrier": "ZZ", "julian": 100}
    boarding = print_pass("OKAFOR/ADA", [leg], [""])
    concert = ["VELVET COMET LIVE", "Riverside Hall, Leeds", "3 May 2031", "Section B Row 4 Seat 17", "no refunds"]
    rows = word_rows(1, ["MERIDIAN AIRWAYS BOARDING PASS", "GATE B7"]) + word_rows(3, concert[:1], 60.0) + [(d, o + 50, w, c, n + 1, *b) for d, o, w, c, n, *b in word_rows(3, concert[1:])]
    pages = lines.pages_of_lines(lines.group_lines(spark.createDataFrame(rows, OCR_WORDS)))
    codes = spark.createDataFrame([(1, ["not a pass", boarding]), (2, None), (3, [])], "doc_id long, barcodes array<string>")
    got = {r["doc_id"]: r for r in extract.parse_tickets(codes.join(pages, "doc_id", "left"), TODAY).collect()}
    flight = got[1]["fields"]
    assert flight.asDict() == {
        "type": "flight", "title": f"ZZ {leg['flight']}", "origin": leg["from"], "destination": leg["to"], "date": "2031-04-10", "carrier": "Meridian Airways", "seat": leg["seat"],
    }
    assert got[1]["sources"]["carrier"] == "text" and {got[1]["sources"][n] for n in ("origin", "date", "seat")} == {"barcode"}
    assert got[1]["confidence"] == 0.93  # three of four wanted fields from the code, one from text
    assert got[2]["fields"]["type"] == "other" and got[2]["confidence"] == 0 and dict(got[2]["sources"]) == {}
    show = got[3]["fields"]
    assert (show["type"], show["title"], show["date"], show["seat"]) == ("event", "Velvet Comet Live", "2031-05-03", "Sec B, Row 4, Seat 17") and show["carrier"].startswith("Riverside Hall")


def test_kinds_by_votes(spark):
    def vote(text):
        hits = {kind: len({m.lower() for m in re.findall(rf"(?i)(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])", text)}) for kind, p in vocab.KIND_WORDS.items()}
        top = max(hits.values())
        kind = next((k for k in hits if hits[k] == top), "other") if top else "other"
        return ("other" if kind != "flight" and re.search(r"(?i)\bbus\b|autobus", text) else kind), top

    rng = random.Random(11)
    said = "gate boarding train coach metro zone tube admit row doors bus autobus terminal platform theatre Train GATE quiet".split()
    texts = [" ".join(rng.choices(said, k=rng.randrange(0, 8))) for _ in range(150)]
    assert [tuple(r) for r in results(spark, texts, "string", extract.vote_kind)] == [vote(t) for t in texts]


# ---- sensitive words -------------------------------------------------------------------------------------------------


def test_sensitive_words(spark):
    rng = random.Random(12)
    pages, want = [], []
    digits = lambda n: "".join(rng.choice("3456789") for _ in range(n))
    for k in range(60):
        code = "".join(rng.choice("BCDFGHJKLM") for _ in range(3)) + digits(3)
        page, reasons = (
            ([f"Reservation {code}"], ["booking-ref"]),
            ([f"your code is {code}"], ["booking-ref"]),
            ([f"{digits(5)} {digits(4)} here"], ["ticket-number"]),
            (["Ticket number", digits(6)], ["ticket-number"]),
            (["Miles", f"card {digits(4)} {digits(3)}"], ["frequent-flyer"]),
            ([f"pay {digits(2)}.{digits(2)} at 10:45 on 12/11/2030 seat 14C, total {digits(5)}"], []),
        )[k % 6]
        pages.append(page)
        want.append(reasons)
    words = spark.createDataFrame([w for d, p in enumerate(pages) for w in word_rows(d, p)], OCR_WORDS)
    got = [[] for _ in pages]
    for r in sorted(sensitive.find_sensitive(words).collect(), key=lambda r: (r["doc_id"], r["li"], r["first"])):
        got[r["doc_id"]].append(r["reason"])
        assert r["box"]["h"] == 24 and r["box"]["w"] >= 11 * len(r["text"].replace(" ", ""))
    assert got == want, [x for x in zip(pages, got, want, strict=True) if x[1] != x[2]][:3]


def test_known_secrets(spark):
    secret = "HK7WP2D"
    near = ["hk7wp2d", "HK7WP2", "HK7XP2D", "HK7WPP2D", "no:HK7WP2D!", "ref-HK7WP2D-99"]
    far = ["HK7XX2D", "HK7W", "ECONOMY", "2DHK7WP"]
    words = spark.createDataFrame(word_rows(1, [" ".join(near + far)]) + word_rows(2, ["ECONOMY CLASS"]), OCR_WORDS)
    secrets = spark.createDataFrame([(1, secret), (1, "abcd"), (2, None), (2, secret)], "doc_id long, secret string")
    assert sorted(r["text"] for r in sensitive.find_known(words, secrets).collect()) == sorted(near)


# ---- the scan as a whole ---------------------------------------------------------------------------------------------


def test_scan_puts_all_sources_together(spark):
    box = lambda x, y, w, h: {"x": float(x), "y": float(y), "w": float(w), "h": float(h)}
    schema = "doc_id long, ord int, reason string, box struct<x:double,y:double,w:double,h:double>"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    found = scan.union_sources(
        decoded=frame((1, 0, "barcode", box(0, 0, 100, 50))), regions=frame((1, 0, "barcode", box(2, 2, 100, 50)), (2, 0, "barcode", box(9, 9, 9, 9))),
        flagged=frame((1, 1, "booking-ref", box(200, 0, 60, 20)), (1, 0, "ticket-number", box(300, 0, 60, 20))), again=frame((1, 0, "known", box(205, 0, 60, 20)), (1, 1, "known", box(400, 0, 5, 5))),
    )
    got = {r["doc_id"]: [(b["reason"], b["box"]["x"]) for b in r["boxes"]] for r in scan.scan_boxes(found).collect()}
    assert got == {1: [("barcode", 0), ("ticket-number", 300), ("booking-ref", 200), ("known", 400)], 2: [("barcode", 9)]}

    words = spark.createDataFrame(word_rows(1, ["code AB12CD more", "AB12CD"]), OCR_WORDS)
    flags = sensitive.find_sensitive(words).withColumn("box_id", F.concat_ws(":", "li", "first"))
    inside = scan.words_inside(words, flags.select("doc_id", "box_id", "box"))
    assert sorted(r["text"] for r in inside.collect()) == ["AB12CD", "AB12CD"]
    boarding = print_pass("A/B", [draw_leg(random.Random(1))], [""])
    codes = spark.createDataFrame([(1, 0, True, "QRCode", boarding, None), (1, 1, True, "QRCode", "other", None)], BARCODES)
    assert {r["secret"] for r in scan.secrets(codes, inside).collect()} == {"AB12CD", boarding[23:30].strip()}


def test_boxes_grow_until_nothing_is_left(spark):
    box = lambda x, w: F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("xywh", (x, 0, w, 10))])
    grown = one(spark, scan.grow_hit(F.array(box(0, 10), box(50, 10)), box(52, 10), F.lit(0.25)))
    assert [(b["x"], b["w"], b["h"]) for b in grown] == [(0, 10, 10), (47.5, 15, 20)]
    assert [(b["x"], b["w"]) for b in one(spark, scan.grow_hit(F.array(box(0, 10)), box(90, 10), F.lit(0.5)))] == [(0, 10), (85, 20)]
    bars = [[255] * 8, [0, 255] * 4, [0, 255] * 4, [0, 255] * 4, [255, 255, 0, 255] * 2]
    lines_ = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in bars])
    assert tuple(one(spark, scan.grow_linear(lines_, F.lit(2), F.lit(2)))) == (1, 3)
    removed = F.filter(F.array(F.struct(F.lit("a").alias("id")), F.struct(F.lit("b").alias("id"))), lambda b: F.lit(True))
    assert [b["id"] for b in one(spark, scan.live_boxes(removed, F.array(F.lit("a"))))] == ["b"]
    assert one(spark, scan.join_masks(F.array(F.lit(True), F.lit(False)), F.array(F.lit(True), F.lit(True)), "and")) == [True, False]


# ---- scalars and plans -----------------------------------------------------------------------------------------------


def test_scalars(spark):
    assert one(spark, scalar.client_key("key", "asset", F.lit("10.0.0.7"))) == "asset:" + hmac.new(b"key", b"10.0.0.7", hashlib.sha256).hexdigest()[:32]
    assert results(spark, ["2030-12-01", "x", ""], "string", scalar.show_date) == ["1 Dec 2030", "", ""]
    pairs = {("A", "B"): "A → B", ("A", ""): "A", ("", "B"): "B", ("", ""): ""}
    assert {p: one(spark, scalar.route_line(*map(F.lit, p))) for p in pairs} == pairs
    assert one(spark, scalar.client_ip(F.lit(" 8.8.4.4 ,1"), F.lit("2"))) == "8.8.4.4" and one(spark, scalar.client_ip(F.lit(None).cast("string"), F.lit(""))) == "local"
    assert results(spark, ["KEY WEST~~SFO | x", "THE_NY=EXPRESS", "NY GA"], "string", scalar.tidy) == ["KEY WEST SFO x", "The NY Express", "NY GA"]
    token = one(spark, scalar.seeded_token(F.lit("s")))
    assert re.fullmatch("[0-9A-Za-z]{22}", token) and token == one(spark, scalar.seeded_token(F.lit("s")))
    assert results(spark, ["2F", " 0a", "G1", ""], "string", scalar.hex_prefix) == [47, 10, 0, 0]
    assert results(spark, [[5, 1, 9], [4, 2], [7]], "array<int>", scalar.upper_median) == [5, 4, 7]
    assert results(spark, ["Ürümqi café ǅ ŁÓDŹ Ἀθῆναι é", None], "string", scalar.fold_accents) == ["Urumqi cafe ǅ ŁODZ Αθηναι e", None]


@pytest.mark.parametrize(
    "make,most",
    [
        (lambda c: bcbp.decode(c), {"regexp_replace": 5}),
        (lambda c: extract.vote_kind(c), {"regexp_extract_all": 4}),
        (lambda c: extract.find_route(F.split(c, "\n")), {"regexp_replace": 50, "regexp_extract": 20}),
        (lambda c: extract.find_date(c, TODAY), {"translate": 6}),
    ],
)
def test_shared_values_are_worked_out_once(spark, make, most):
    """What several parts of an expression use is bound, not copied."""
    plan = spark.createDataFrame([("x",)], "t string").select(make(F.col("t")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(f"{name}(") <= n for name, n in most.items()), {name: plan.count(f"{name}(") for name in most}
