"""Benchmark decontamination by template windows.

A text's words become a template: numbers in digits or words, units after numbers (of four languages), and names
(capitalised words inside a sentence, of any script with capitals in two bytes) give way to typed placeholders, other words to their hash in lower case. Windows of ``WINDOW`` template words (the whole template
of a shorter item) are hashed and looked up in the benchmark's hash table. A window with more placeholders than other
words says too little by itself: it is hashed with the words that the placeholders stand for. Windows with the same
shift against an item are one alignment; it goes on to either side as far as the templates agree, placeholders of any
value included. Its slots are the item's placeholders that it covers, and it counts only if equal slot values of the
item stand for equal values in the document (``CONSISTENT`` of the slots at least). An item leaks into a document if the
consistent alignments cover ``COVER`` of its words. So verbatim copies of any item are caught, and copies with other
numbers, names and units of all that have one window of mostly plain words. (An item of numbers and names alone with all
of them changed is no copy that could be told from any other list.)

The benchmark is a stated query set: it is taken in blocks of about ``BLOCK_WORDS`` words (by item hash; one item at
least), each block's table is sent to the executors, and every document is read once per block. Nothing is shuffled.

Defined results: a null text is empty; an item with fewer than ``LEAST_WORDS`` words never leaks; items that repeat an
id or a text are items of their own; a row with a null doc_id or item_id is judged like others; repeated document rows
each give their rows; no rows give no rows; other columns come along in ``clean``, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.llm.arrays import spread
from quillet.llm.common import KIND, LOWER, mix64, range_hashes, slices, tokens, utf8

WINDOW, LEAST_WORDS, COVER, CONSISTENT = 8, 4, 0.5, 0.8
BLOCK_WORDS = 2_000_000
#: Pairs of windows, or of words, that are looked at together; one text's windows stay together.
PAIRS = 1 << 20
# Words that are units after a number, and words that are numbers (articles left out), of four languages.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years usd eur gbp dollar dollars euro euros pound pounds cent cents percent "
    "mph kmh kph hz khz mhz ghz w kw mw v kv a ma j kj cal kcal k c f bit bits byte bytes kb mb gb tb meter meters metre metres "
    "sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren pfund prozent liter kilo kilos gramm "
    "seconde secondes heure heures jour jours semaine semaines mois an ans année années mètre mètres litre litres livre livres centime centimes "
    "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años metro metros litro litros gramo gramos libra libras céntimo céntimos"
).split()
NUMERALS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil"
).split()
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0xA11CE5, 0xB0B5, 0xCAB1E5))

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63]] = True  # line end ! . : ?
#: Of code points up to U+07FF, all that one or two bytes hold: capital letters and small ones.
_CAPITAL, _SMALL = (np.array([f(chr(c)) for c in range(0x800)]) for f in (str.isupper, str.islower))


def _hash_words(words: list[str]) -> np.ndarray:
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    at = np.cumsum([0, *(len(w.encode()) for w in words)])
    return range_hashes(buf, at[:-1], at[1:])


_UNIT_HASHES, _NUMERAL_HASHES = (np.unique(_hash_words(x)) for x in (UNITS, NUMERALS))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _letter(buf: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point that starts at each place, 0 if outside or of three bytes or more, and the place after it."""
    at = np.minimum(at, len(buf) - 1)
    one, two = buf[at].astype(np.int64), buf[np.minimum(at + 1, len(buf) - 1)].astype(np.int64)
    double = (one >= 0xC2) & (one <= 0xDF)
    point = np.where(one < 0x80, one, np.where(double, ((one & 31) << 6) | (two & 63), 0))
    return np.where(inside, point, 0), at + 1 + double


@dataclass(frozen=True)
class Template:
    """Of all words of a batch of texts: template value, hash of the lower-cased word, whether a slot, row."""

    value: np.ndarray
    surface: np.ndarray
    slot: np.ndarray
    row: np.ndarray
    first: np.ndarray  # by row: its first word; one more at the end


def template(buf: np.ndarray, at: np.ndarray) -> Template:
    starts, ends, row = tokens(buf, at)
    if len(starts):
        word = KIND[buf[starts]] == 1
        starts, ends, row = starts[word], ends[word], row[word]
    n = len(starts)
    if n == 0:
        return Template(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), row, np.zeros(len(at), np.int64))
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    number = digits[ends] - digits[starts] == ends - starts
    # 3.5 and 1,000 are one number: a number one mark after another goes into it.
    glued = np.zeros(n, bool)
    glued[1:] = number[1:] & number[:-1] & (row[1:] == row[:-1]) & (starts[1:] == ends[:-1] + 1) & np.isin(buf[np.minimum(ends[:-1], len(buf) - 1)], [44, 46])
    if glued.any():
        head = np.flatnonzero(~glued)
        last = np.append(head[1:], n) - 1
        starts, ends, row, number = starts[head], ends[last], row[head], number[head]
        n = len(starts)
    surface = range_hashes(LOWER[buf], starts, ends)
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
    opens = np.ones(n, bool)
    opens[1:] = (row[1:] != row[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    head, after = _letter(buf, starts, np.ones(n, bool))
    number |= _among(surface, _NUMERAL_HASHES)
    name = _CAPITAL[head] & _SMALL[_letter(buf, after, after < ends)[0]] & ~opens & ~number
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & ~number[1:] & (row[1:] == row[:-1])
    unit &= _among(surface, _UNIT_HASHES)
    value = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, surface)))
    return Template(value, surface, number | name | unit, row, np.searchsorted(row, np.arange(len(at))))


def windows(t: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of ``size`` words inside a row; of their templates, or of the words themselves if
    more than half are slots."""
    n = len(t.value)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - size + 1)
    slots = np.concatenate([[0], np.cumsum(t.slot)])
    plain = size - (slots[at + size] - slots[at])
    inside = t.row[at] == t.row[at + size - 1]
    by_template, by_words = at[inside & (plain * 2 >= size)], at[inside & (plain * 2 < size)]
    hashes = [mix64(range_hashes(mix64(v), k, k + size) + np.uint64(salt + size)) for v, k, salt in ((t.value, by_template, 0), (t.surface, by_words, 4096))]
    return np.concatenate([by_template, by_words]), np.concatenate(hashes)


class Items:
    """The hash table of a block of benchmark items."""

    def __init__(self, ids: list[int | None], texts: list[str]) -> None:
        raw = [x.encode() for x in texts]
        buf, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        self.ids, self.t = ids, template(buf, at)
        self.words = np.diff(self.t.first)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        self.sizes = sorted({min(WINDOW, int(n)) for n in self.words if n >= LEAST_WORDS})
        for size in self.sizes:
            start, h = windows(self.t, size)
            n = self.words[self.t.row[start]]
            mine = n >= WINDOW if size == WINDOW else n == size
            found.append((start[mine], h[mine]))
        start, h = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, d) for k, d in ((0, np.int64), (1, np.uint64)))
        order = np.argsort(h, kind="stable")
        self.start, self.hash, self.size = start[order], h[order], np.minimum(self.words[self.t.row[start[order]]], WINDOW)
        self.filter = np.zeros(1 << 22, bool)  # by the low bits of the hashes; a bound on memory, not on matches
        self.filter[self.hash & np.uint64(len(self.filter) - 1)] = True

    def alignment(self, item: int, met: set[int], t: Template, row: int, shift: int) -> set[int]:
        """The item's words of the windows that were met, and those before and after them as far as the templates agree."""
        low, high = int(self.t.first[item]), int(self.t.first[item + 1])
        low, high = max(low, int(t.first[row]) - shift), min(high, int(t.first[row + 1]) - shift)
        agree = self.t.value[low:high] == t.value[low + shift : high + shift]
        runs = np.cumsum(~agree)
        at = np.fromiter(met, np.int64) - low
        reached = np.unique(runs[at[agree[at]]])
        return met | set((low + np.flatnonzero(agree & np.isin(runs, reached))).tolist())

    def looked_up(self, t: Template) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By size: the first words of the text's windows that the table has, and where its entries begin, and how many."""
        out = []
        for size in self.sizes:
            start, h = windows(t, size)
            maybe = self.filter[h & np.uint64(len(self.filter) - 1)]
            start, h = start[maybe], h[maybe]
            low = np.searchsorted(self.hash, h, "left")
            count = np.searchsorted(self.hash, h, "right") - low
            out.append((size, *(x[count > 0] for x in (start, low, count))))
        return out

    def agreeing(self, t: Template, row: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """How many words of each item agree with the text at that shift: no alignment covers more."""
        low = np.maximum(self.t.first[item], t.first[row] - shift)
        size = np.maximum(np.minimum(self.t.first[item + 1], t.first[row + 1] - shift) - low, 0)
        out = np.zeros(len(row), np.int64)
        total, at = np.cumsum(size), 0
        while at < len(row):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            of = np.repeat(np.arange(at, end), size[at:end])
            place = low[of] + spread(size[at:end])
            out[at:end] = np.bincount(of - at, self.t.value[place] == t.value[place + shift[of]], minlength=end - at)
            at = end
        return out

    def promising(self, t: Template, met: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, shift, first word in the item, size) of the windows that met, of the texts and items whose alignments
        could cover enough of the item: a text that shares no more than a frame with an item goes no further."""
        sizes = np.concatenate([np.full(int(count.sum()), size) for size, _, _, count in met])
        k = np.concatenate([np.repeat(start, count) for _, start, _, count in met])
        j = np.concatenate([np.repeat(low, count) + spread(count) for _, _, low, count in met])
        fits = self.size[j] == sizes
        k, j, size = k[fits], j[fits], sizes[fits]
        row, item, shift, start = t.row[k], self.t.row[self.start[j]], k - self.start[j], self.start[j]
        order = np.lexsort((shift, item, row))
        row, item, shift, start, size = (x[order] for x in (row, item, shift, start, size))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])
        other = np.ones(len(row), bool)
        other[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        first = np.flatnonzero(new)
        bound = self.agreeing(t, row[first], item[first], shift[first])
        pair = np.cumsum(other) - 1
        most = np.bincount(pair[first], bound)
        keep = (most >= COVER * self.words[item[other]])[pair]
        return list(zip(*(x[keep].tolist() for x in (row, item, shift, start, size)), strict=True))

    def leaks(self, buf: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, words covered, slots, slots with another value) of every leak in a batch of texts."""
        if len(self.hash) == 0:
            return []
        t = template(buf, at)
        hits: dict[tuple[int, int], dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        met = self.looked_up(t)
        pairs = sum(int(count.sum()) for *_, count in met)
        if pairs == 0:
            return []
        if pairs > PAIRS and len(at) > 2:  # a frame that many items share: fewer texts at a time
            half = len(at) // 2
            rest = self.leaks(buf[at[half] :], at[half:] - at[half])
            return self.leaks(buf[: at[half]], at[: half + 1]) + [(row + half, *leak) for row, *leak in rest]
        for row, item, shift, start, size in self.promising(t, met):
            hits[row, item][shift].update(range(start, start + size))
        out = []
        for (row, item), shifts in sorted(hits.items()):
            covered, n_slots, changed = set(), 0, 0
            for shift, met in sorted(shifts.items()):
                places = self.alignment(item, met, t, row, shift)
                meaning: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
                slots = [p for p in places if self.t.slot[p]]
                for p in slots:
                    meaning[int(self.t.surface[p])][int(t.surface[p + shift])] += 1
                agree = sum(max(x.values()) for x in meaning.values())
                if agree >= CONSISTENT * len(slots):
                    n_slots += len(slots)
                    changed += sum(self.t.surface[p] != t.surface[p + shift] for p in slots)
                    covered |= places
            if len(covered) >= COVER * self.words[item]:
                out.append((row, item, len(covered), n_slots, int(changed)))
        return out


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's items, a bounded block at a time."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = sized.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"\S+"))), F.lit(0))).collect()[0][0]
    n = -(-int(total) // BLOCK_WORDS)
    for k in range(n):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, words_covered, slots, slots_changed: one row per document and item that leaks."""
    schema = "doc_id long, item_id long, item_words long, words_covered long, slots long, slots_changed long"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # BLOCK_WORDS words at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = []
                for first, _, buf, at in slices(*utf8(batch.column("text"))):
                    found += [(ids[first + r], block.ids[i], int(block.words[i]), c, s, x) for r, i, c, s, x in block.leaks(buf, at)]
                names = ["doc_id", "item_id", "item_words", "words_covered", "slots", "slots_changed"]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(6)], names)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item leaks into, all columns, without a shuffle."""
    own = docs.columns
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # BLOCK_WORDS words at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, _, buf, at in slices(*utf8(batch.column("body"))):
                    keep[[first + leak[0] for leak in shared.value.leaks(buf, at)]] = False
                yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(keep))], ["row"])

        inner = docs.select(F.col("text").alias("body"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
        docs = inner.mapInArrow(run, T.StructType([inner.schema["row"]])).select(*[F.col(f"row.`{c}`") for c in own])
    return docs
