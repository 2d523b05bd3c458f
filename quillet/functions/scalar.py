"""Scalar functions over columns: text, dates, digests, numbers. All are built-in expressions."""

from __future__ import annotations

import datetime as dt
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet import vocab
from quillet.vocab import B, E

#: What NFD parts from its base letter.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def _folds() -> tuple[str, str]:
    """Every letter that NFD makes of one base letter and marks, and the bases; then the marks, which go."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(m in MARKS for m in parts[1:]):
            pairs[chr(code)] = parts[0]
    return "".join(pairs) + MARKS, "".join(pairs.values())


FOLD = _folds()


def word(pattern: str, flags: str = "(?i)") -> str:
    return f"{flags}{B}(?:{pattern}){E}"


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once: a lambda's variable, where a plain expression would be copied."""
    return F.get(F.transform(F.array(value), then), 0)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as limits on texts count them: two for what lies beyond the basic plane."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def whole_text(row: Column) -> Column:
    """A row as text that tells rows apart: JSON with its null fields."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def as_date(day: str | dt.date | Column) -> Column:
    return day if isinstance(day, Column) else F.lit(str(day)).cast("date")


def fold_accents(text: Column) -> Column:
    """Base letters for accented Latin, Greek and Cyrillic ones, composed or not: NFD without its marks."""
    return F.translate(text, *FOLD)


def tidy(text: Column) -> Column:
    """Rules and runs of space out; a shouted line in title case, place codes kept."""
    return let(F.trim(F.regexp_replace(F.regexp_replace(text, r"[|_~=*]+", " "), r"\s+", " ")), _unshouted)


def _unshouted(plain: Column) -> Column:
    up = lambda p: F.when(p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))).otherwise(p)
    title = F.array_join(F.transform(F.split(F.lower(plain), r"(?<![a-z0-9_])(?=[a-z])"), up), "")
    for code in vocab.PLACE_CODES:
        title = F.regexp_replace(title, f"{B}{code}{E}", code.upper())
    return F.when(plain == F.upper(plain), title).otherwise(plain)


def strip_edges(text: Column) -> Column:
    """J6."""
    return F.regexp_replace(text, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")


def alnum_upper(text: Column) -> Column:
    """ASCII letters and digits, upper case."""
    return F.regexp_replace(F.upper(text), r"[^A-Z0-9]", "")


def drop_zeros(text: Column) -> Column:
    """Leading zeros go, one digit stays."""
    return F.regexp_replace(text, r"^0+(?=\d)", "")


def within_one_edit(a: Column, b: Column) -> Column:
    """J8."""
    return F.levenshtein(a, b, 1) >= 0


def near_secret(word: Column, secret: Column) -> Column:
    """One misread character, or the secret inside a longer word."""
    return within_one_edit(word, secret) | ((F.length(word) > F.length(secret)) & F.contains(word, secret))


def iso_date(y: Column, m: Column, d: Column) -> Column:
    """Calendar check; two-digit years turn at 70; null if impossible."""
    year = let(y, lambda y: F.when(y < 100, y + F.when(y > 70, 1900).otherwise(2000)).otherwise(y))

    def checked(v: Column) -> Column:
        text = F.concat_ws("-", F.lpad(v["y"].cast("string"), 4, "0"), F.lpad(v["m"].cast("string"), 2, "0"), F.lpad(v["d"].cast("string"), 2, "0"))
        return F.when(v["y"].between(1950, 2100) & v["m"].between(1, 12) & v["d"].between(1, 31), F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"))

    return let(F.struct(year.alias("y"), m.alias("m"), d.alias("d")), checked)


def month_number(name: Column) -> Column:
    """Of a month's name in six languages; null for other words."""
    names = F.create_map(*[F.lit(x) for pair in vocab.MONTHS.items() for x in pair])
    return F.try_element_at(names, F.lower(name))


def julian_date(day: Column, as_of) -> Column:
    """The latest date with this day of the year that is at most 60 days after as_of; ten years are tried."""
    ahead = F.date_add(as_date(as_of), 60)
    date = lambda back: F.date_add(F.make_date(F.year(ahead) - back, F.lit(1), F.lit(1)), day.cast("int") - 1)
    leap = lambda back: F.dayofyear(F.make_date(F.year(ahead) - back, F.lit(12), F.lit(31))) == 366
    fits = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda back: (date(back) <= ahead) & ((day != 366) | leap(back)))
    return F.date_format(F.get(F.transform(fits, date), 0), "yyyy-MM-dd")


def show_date(iso: Column) -> Column:
    """14 Mar 2026; empty for anything but an ISO date."""
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), "d MMM yyyy")).otherwise("")


def filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def route_line(origin: Column, destination: Column) -> Column:
    """Both with an arrow, or either, or nothing."""
    both = F.when((origin != "") & (destination != ""), F.concat(origin, F.lit(" → "), destination))
    return F.coalesce(both, filled(origin), filled(destination), F.lit(""))


def summary(fields: Column) -> Column:
    """Route, else title, else carrier, else the word Ticket."""
    return F.coalesce(filled(route_line(fields["origin"], fields["destination"])), filled(fields["title"]), filled(fields["carrier"]), F.lit("Ticket"))


def carrier_label(kind: Column) -> Column:
    """J13."""
    return F.when(kind == "event", "Venue").when(kind == "other", "Carrier or venue").otherwise("Carrier")


def title_label(kind: Column) -> Column:
    return F.when(kind == "event", "Event").when(kind == "flight", "Flight").when(kind == "train", "Train").otherwise("Title")


def back_text(*parts: Column) -> Column:
    """What is not empty, joined by a dot."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " · ")


def slug(text: Column) -> Column:
    """J14."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def client_ip(forwarded: Column, real: Column) -> Column:
    """First forwarded hop, else the real address, else the word local."""
    return F.coalesce(filled(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))), filled(F.trim(real)), F.lit("local"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, of two sha2 calls; a key over 64 bytes is hashed first."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.sha2(F.concat(pad(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def client_key(secret: str, scope: str, ip: Column) -> Column:
    """Scope and 32 hex digits; the address itself is not kept."""
    return F.concat(F.lit(scope + ":"), F.substring(hmac_sha256(secret.encode(), ip), 1, 32))


def seeded_token(seed: Column, length: int = 22) -> Column:
    """Base-62 characters from digests of the seed, so that reruns agree."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    at = lambda i: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), i.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long"), F.lit(62)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(F.lit(digits), at(i) + 1, F.lit(1))), "")


def upper_median(values: Column) -> Column:
    """the middle of the sorted values, the later of two."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def half_up(x: Column, digits: int = 2) -> Column:
    """rounds halves up."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def hex_prefix(text: Column) -> Column:
    """The number that a text starts with in base 16, else 0."""
    return F.coalesce(F.conv(filled(F.regexp_extract(text, r"^\s*([0-9A-Fa-f]+)", 1)), 16, 10).cast("int"), F.lit(0))
