"""Benchmark decontamination by pigeonhole edit matching.

A test item of L characters with an error budget of k edits is split into k + 1 pieces: a passage within k edits of
it holds at least one piece unchanged. An Aho-Corasick automaton finds the exact hits of all pieces in one pass over
a text; around each hit, Myers' bit-parallel algorithm finds the best edit distance of the whole item. Documents
are never shuffled. Items reach the executors in broadcast blocks of bounded size, one scan of the documents a block; a
Python worker builds a block's automaton once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import _text as tx

_TOKEN = re.compile(r"[^\W_]+")
#: Characters that an item needs, after normalising: shorter ones are words that any text may hold.
SHORTEST = 8
#: Characters of test items that go to the executors at once; more make further blocks, each with a scan of its own.
BLOCK_CHARS = 8_000_000


def normalise(text: str) -> str:
    """Lower-cased runs of letters and digits with one space between."""
    return " ".join(_TOKEN.findall(text.lower().replace("\u03c2", "\u03c3")))


def positions(text: str) -> tuple[str, list[tuple[int, int]]]:
    """``normalise(text)`` and each of its characters' span in the text."""
    lower, origin = [], []
    for i, c in enumerate(text):
        for x in c.lower().replace("\u03c2", "\u03c3"):
            lower.append(x)
            origin.append(i)
    out, spans = [], []
    for m in _TOKEN.finditer("".join(lower)):
        if out:
            out.append(" ")
            spans.append((spans[-1][1], origin[m.start()]))
        out.append(m[0])
        spans += [(origin[i], origin[i] + 1) for i in range(*m.span())]
    return "".join(out), spans


def budget(length: int, rate: float, least: int) -> int:
    """Edits allowed for an item; none if it is shorter than ``least`` characters."""
    return int(length * rate) if length >= least else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces of the item, with their offsets, as equal in length as possible."""
    cuts = [round(i * len(item) / (k + 1)) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a substring of the text, and the substring's first possible end."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        right = down | ~(diagonal | up) & full
        left = up & diagonal
        if right & high:
            score += 1
        elif left & high:
            score -= 1
        right = right << 1 & full
        left = left << 1 & full
        up = left | ~(diagonal | right) & full
        down = right & diagonal
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds items within their budgets in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, least: int, shortest: int = SHORTEST):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if (norm := normalise(text or "")) and len(norm) >= shortest:
                k = budget(len(norm), rate, least)
                for at, piece in pieces(norm, k):
                    found.setdefault(piece, []).append((len(self.items), at))
                self.items.append((item_id, norm, k))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, start, end) of the best match of each item, by position in the given text."""
        norm = normalise(text)
        if not self.items or not norm:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(norm):
            for i, at in where:
                _, item, k = self.items[i]
                if not k and (last + 1 < len(norm) and norm[last + 1] != " " or last >= size and norm[last - size] != " "):
                    continue  # without a budget, it must be whole words
                lo = max(0, last + 1 - size - at - k)
                hi = min(len(norm), last + 1 - size - at + len(item) + k)
                spans = windows.setdefault(i, [])
                if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        out, spans = [], None
        for i, places in windows.items():
            item_id, item, k = self.items[i]
            best = min(((*myers(item, norm[lo:hi]), lo) for lo, hi in places), key=lambda x: (x[0], x[2]))
            if best[0] <= k:
                end = best[2] + best[1]
                _, back = myers(item[::-1], norm[max(0, end - len(item) - k) : end][::-1])
                spans = spans or positions(text)[1]
                out.append((item_id, best[0], k, spans[end - back][0] if back else spans[end - 1][0], spans[end - 1][1]))
        return sorted(out, key=lambda hit: hit[3:])


_built: list = []


def _matcher(block) -> Matcher:
    """The matcher of a broadcast block (items, rate, least, shortest), kept by the worker until another block comes."""
    if not _built or _built[0] is not block.value:
        _built[:] = [block.value, Matcher(*block.value)]
    return _built[1]


def _blocks(items: DataFrame, item_id: str, item_text: str, most: int, *options) -> Iterator:
    """Broadcasts of (items, *options) with about ``most`` characters of items each; one at least."""
    block, size, made, sc = [], 0, False, items.sparkSession.sparkContext
    for i, text in items.select(F.col(item_id).cast("long"), F.col(item_text)).toLocalIterator(prefetchPartitions=True):
        block.append((i, text or ""))
        size += len(text or "") + 1
        if size >= most:
            yield sc.broadcast((block, *options))
            block, size, made = [], 0, True
    if block or not made:
        yield sc.broadcast((block, *options))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.05, least: int = 40, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and test item within its budget: ``id_col``, ``item_id``, ``distance``, ``budget``, ``start``, ``end``.

    Both sides are compared as lower-cased letters and digits with single spaces. An item of L such characters may
    have ``rate`` * L edits; one below ``least`` characters has none and must be whole words of the text; one below
    ``shortest`` matches nothing. The best match gives the distance and the span, in code points of the original text.
    Null or empty items and texts match nothing; repeated items, and items with a null id, are reported each.
    """
    tx.small_batches(docs.sparkSession)
    out = None
    for block in _blocks(items, item_id, item_text, block_chars, rate, least, shortest):

        def emit(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block)
            for b in batches:
                rows = [(i, *hit) for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True) if text for hit in matcher.find(text)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

        names = ["id", "item_id", "distance", "budget", "start", "end"]
        schema = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        part = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(emit, "id long, item_id long, distance int, budget int, start long, end long")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.05, least: int = 40, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no test item by ``contaminated``'s rule; nothing is shuffled."""
    tx.small_batches(docs.sparkSession)
    for block in _blocks(items, item_id, item_text, block_chars, rate, least, shortest):

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block)
            for b in batches:
                yield b.filter(pa.array([not (t and matcher.find(t)) for t in b.column(text_col).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
