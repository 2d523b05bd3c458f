"""URL filters: all glob rules at once over each canonical URL, by a bit-parallel Shift-And automaton.

Each rule becomes a row of cells; a cell takes one byte (a literal or a class), a star loops on its place. The cells of
all rules are packed side by side into 64-bit words, so one step of the automaton is, for every URL of a batch,
``(state << 1 | first) & accepts[byte] | state & loops[byte]`` with the carry between words. A step costs words x rows,
whatever the rules; there is no shuffle and no state beyond one Arrow batch.

The canonical URL is ``.host`` + path. Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path:
then up to ``? #`` or the end. A null URL, or one without ``://``, has an empty host and path.
Defined results: such rows still get a row; repeated rows are judged alike; no rows give no rows; other columns are
passed by; very long URLs are read to their end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import slices, utf8


@dataclass(frozen=True)
class Rule:
    """glob over the canonical URL: ``*`` any bytes, ``%`` any bytes but ``/``, ``?`` one byte; the rest is literal."""

    name: str
    verdict: str
    glob: str
    explicit: bool = True

    @staticmethod
    def site(verdict: str, host_and_path: str) -> Rule:
        """For a host with all its subdomains and the paths that start as given, as in ``example.com/de/``."""
        return Rule(host_and_path, verdict, f"%.{host_and_path}*")


#: Wildcard rules of the method itself, for URLs that no explicit rule fits.
PATTERNS = tuple(Rule(x, "block", x, False) for x in ("*casino*", "*cheap-pills*", "*free-bets*", "*ads-track*", "*.adult.*", "*/ads/*"))


class ShiftAnd:
    """The packed masks of a rule list; ``match`` runs them over many byte strings side by side."""

    def __init__(self, globs: Iterable[str]) -> None:
        cells: list[tuple[int | None, bool, bool]] = []  # byte or None for any, loops before it, loops but on "/"
        self.firsts: list[int] = []
        self.lasts: list[int] = []
        starts_loop: list[tuple[bool, bool]] = []
        for glob in globs:
            loop = slash_free = False
            self.firsts.append(len(cells))
            for b in glob.encode():
                if b in b"*%":
                    loop, slash_free = loop or b == ord("*"), slash_free or b == ord("%")
                else:
                    cells.append((None if b == ord("?") else b, loop, slash_free))
                    loop = slash_free = False
            cells.append((-1, loop, slash_free))  # end cell: takes nothing; a star at the end lives on in it
            self.lasts.append(len(cells) - 1)
            starts_loop.append((loop, slash_free))
        # Bit i stands for "all cells before i have been taken"; it advances on the byte of cell i.
        self.words = max(1, -(-len(cells) // 64))
        self.accepts, self.loops = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for i, (byte, loop, slash_free) in enumerate(cells):
            word, bit = i // 64, np.uint64(1) << np.uint64(i % 64)
            if byte is None:
                self.accepts[:, word] |= bit
            elif byte >= 0:
                self.accepts[byte, word] |= bit
            if loop:
                self.loops[:, word] |= bit
            elif slash_free:
                self.loops[np.arange(256) != ord("/"), word] |= bit
        for i in self.firsts:
            self.start[i // 64] |= np.uint64(1) << np.uint64(i % 64)

    def match(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows x rules: whether the whole row fits the rule."""
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")  # the longest first: rows that still run are a prefix
        begin, size = at[:-1][order], size[order]
        state = np.repeat(self.start[None, :], len(order), 0)
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, "left"))
            now, byte = state[:live], buf[begin[:live] + step]
            taken = now & self.accepts[byte]
            moved = taken << one
            moved[:, 1:] |= taken[:, :-1] >> top
            state[:live] = moved | (now & self.loops[byte])
        out = np.empty((len(order), len(self.lasts)), bool)
        last = np.array(self.lasts, np.int64)
        out[order] = (state[:, last // 64] >> (last % 64).astype(np.uint64)) & one == one
        return out


def judge(pages: DataFrame, rules: Iterable[Rule], patterns: Iterable[Rule] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict. Of the explicit rules that fit, the longest name wins, then the smaller one.

    Without one, rule is null and the verdict is ``block`` if any wildcard pattern fits, else ``allow``.
    """
    explicit = sorted(rules, key=lambda r: (-len(r.name), r.name))
    extra = list(patterns)
    masks = ShiftAnd([r.glob for r in (*explicit, *extra)])
    names = np.array([r.name for r in explicit] + [None], dtype=object)
    verdicts = np.array([r.verdict for r in explicit] + ["allow"], dtype=object)
    schema = "page_id long, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rule, verdict = [], []
            for _, _, buf, at in slices(*utf8(batch.column("canonical"))):
                fits = masks.match(buf, at)
                own = np.concatenate([fits[:, : len(explicit)], np.ones((len(fits), 1), bool)], 1).argmax(1)
                said = verdicts[own]
                said[(own == len(explicit)) & fits[:, len(explicit) :].any(1)] = "block"
                rule += list(names[own])
                verdict += list(said)
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    url = F.coalesce("url", F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract("after", r"^[^/?#]*", 0)
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), after.alias("after")).select(
        "page_id",
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("after", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    return parts.select("page_id", "host", "path", F.concat(F.lit("."), "host", "path").alias("canonical")).mapInArrow(run, schema)
