"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from riskloom.llm.shared import saved, sliced

Q, RATE, LEAST = 8, 0.1, 24
#: Shared q-grams that are held at a time, however many items have a common one.
HELD = 1 << 21
#: Benchmark characters that are searched for in one pass over the documents; a larger benchmark takes more passes.
PASS_CHARS = 4 << 20
LEAKS = ArrayType(StructType([StructField("item_id", LongType()), StructField("distance", IntegerType()), StructField("start", LongType()), StructField("stop", LongType())]))
_LEAK_LIST = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))

_SPACES = np.zeros(0x3001, dtype=bool)
_SPACES[[c for c in range(0x3001) if chr(c).isspace()]] = True


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points, white space as single blanks, none at the ends; and the place of each in the text."""
    points = np.frombuffer(_lower(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = _SPACES[np.minimum(points, 0x3000)] & (points <= 0x3000)
    kept = ~space
    kept[1:] |= ~space[:-1]
    at = np.flatnonzero(kept)
    if len(at) and space[at[0]]:
        at = at[1:]
    if len(at) and space[at[-1]]:
        at = at[:-1]
    return np.where(space[at], np.uint32(32), points[at]), at


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of the 8 characters from each place on."""
    h, width, factor = points.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while width < Q and len(h) > width:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    return h * np.uint64(0xD1342543DE82EF95) if width == Q else h[:0]


def budget(size: int, rate: float = RATE) -> int:
    """Edits that an item of this size may have: a share of it, and so few that the lemma still asks for a shared q-gram."""
    return max(0, min(int(rate * size), (size - Q) // Q))


@dataclass
class Items:
    """Benchmark items with an index of their q-grams; those of fewer than ``least`` characters are found by exact words instead."""

    ids: list[int]
    points: list[np.ndarray]
    rate: float
    least: int = LEAST

    def __post_init__(self) -> None:
        self.sizes = np.array([len(p) for p in self.points], dtype=np.int64)
        self.edits = np.array([budget(n, self.rate) for n in self.sizes], dtype=np.int64)
        self.asked = self.sizes - Q + 1 - Q * self.edits  # the q-gram lemma: so many q-grams are shared at least
        short = self.sizes < self.least
        self.short: dict[str, list[int]] = {}
        for n in np.flatnonzero(short & (self.sizes > 0)).tolist():
            self.short.setdefault("".join(map(chr, self.points[n].tolist())), []).append(n)
        hashes = [gram_hashes(p) if not few else np.zeros(0, np.uint64) for p, few in zip(self.points, short, strict=True)]
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.concatenate((first, [len(every)]))
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """All short items; each worker builds it from the shared items when it first meets a text."""
        made = ahocorasick.Automaton()
        for item, numbers in self.short.items():
            made.add_word(item, (item, numbers))
        made.make_automaton()
        return made

    def hits(self, points: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, item, place in the item) of each q-gram that a text shares with an item, about ``HELD`` at a time."""
        h = gram_hashes(points)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        at = at[at + Q <= starts[np.searchsorted(starts, at, side="right")]]
        gram = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[gram] == h[at]
        at, gram = at[same], gram[same]
        times = self.first[gram + 1] - self.first[gram]
        part = np.cumsum(times) // HELD
        for low, high in zip(np.searchsorted(part, np.unique(part)), np.searchsorted(part, np.unique(part), side="right"), strict=True):
            some, offsets = times[low:high], np.cumsum(times[low:high]) - times[low:high]
            posting = np.repeat(self.first[gram[low:high]] - offsets, some) + np.arange(some.sum())
            yield np.repeat(at[low:high], some), self.item[posting], self.place[posting]

    def bands(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (text, item, first diagonal): bands that hold as many different q-grams of an item as its edits leave.

        A band spans two steps of edits + 1 diagonals and begins at each step, so the diagonals of any
        alignment within the budget, which differ by at most the edits, lie in one band together.
        """
        key = np.zeros((4, 0), dtype=np.int64)  # text, item, cell of diagonals, q-gram of the item: each once
        for place, item, inner in self.hits(points, starts):
            text = np.searchsorted(starts, place, side="right") - 1
            cell = (place - starts[text] - inner) // (self.edits[item] + 1)
            key = np.concatenate((key, np.stack((text, item, cell, inner))), axis=1)
            key = key[:, np.lexsort(key[::-1])]
            new = np.ones(key.shape[1], dtype=bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            key = key[:, new]
        key = key[:3]
        edge = np.ones(key.shape[1], dtype=bool)
        edge[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        cells, at = key[:, edge], np.flatnonzero(edge)
        counts = np.diff(np.concatenate((at, [key.shape[1]])))
        after = np.zeros(len(counts), dtype=np.int64)  # q-grams of the next cell, if that is the neighbour
        if len(counts):
            near = (cells[:2, 1:] == cells[:2, :-1]).all(axis=0) & (cells[2, 1:] == cells[2, :-1] + 1)
            after[:-1][near] = counts[1:][near]
            alone = np.ones(len(counts), dtype=bool)
            alone[1:] = ~near
        else:
            alone = np.zeros(0, dtype=bool)
        asked = self.asked[cells[1]]
        both = counts + after >= asked
        before = alone & (counts >= asked) & ~both  # a band that begins a step earlier holds no more than its cell
        chosen = np.flatnonzero(both | before)
        return np.stack((cells[0, chosen], cells[1, chosen], cells[2, chosen] * (self.edits[cells[1, chosen]] + 1)), axis=1)


def aligned(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, start, stop) of the best alignment of the whole item in each region, over diagonals 0..width.

    ``regions`` has a row of len(item) + width points each (0 where there is no text).
    """
    size = len(item)
    width = regions.shape[1] - size
    unit = 1 << 20
    slope = np.arange(width + 1, dtype=np.int64) * unit
    cost = np.broadcast_to(np.arange(width + 1, dtype=np.int64), (len(regions), width + 1)).copy()  # cost * unit + first diagonal
    for k in range(size):
        straight = cost + unit * ((regions[:, k : k + width + 1] if k + width + 1 <= regions.shape[1] else np.pad(regions[:, k:], ((0, 0), (0, 1)))) != item[k])
        straight[:, :-1] = np.minimum(straight[:, :-1], cost[:, 1:] + unit)
        cost = np.minimum.accumulate(straight - slope, axis=1) + slope
    best = cost.argmin(axis=1)
    value = cost[np.arange(len(regions)), best]
    return value // unit, value % unit, best + size


def _short(items: Items, points: np.ndarray, out: dict[int, tuple]) -> None:
    """Adds the short items that stand in a text exactly, as whole words: the first place of each.

    One automaton meets all items in one pass over the text; an item's matches come in the order of their places.
    """
    text = points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    for last, (item, numbers) in items.automaton.iter(text):
        at, after = last + 1 - len(item), text[last + 1 : last + 2]
        if numbers[0] not in out and not (text[max(0, at - 1) : at].isalnum() and item[0].isalnum() or after.isalnum() and item[-1].isalnum()):
            out.update((n, (0, at, last + 1)) for n in numbers)


def found(items: Items, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """For each text the leaks (item id, distance, start, stop), the best alignment of each item."""
    parts = [normalised(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(p) for p, _ in parts])))
    points = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.uint32)
    out: list[dict[int, tuple]] = [{} for _ in texts]
    for k in range(len(texts)) if items.short else ():
        _short(items, points[starts[k] : starts[k + 1]], out[k])
    bands = items.bands(points, starts) if len(points) >= Q and len(items.keys) else np.zeros((0, 3), np.int64)
    for number in np.unique(bands[:, 1]):
        some = bands[bands[:, 1] == number]
        edits, item = int(items.edits[number]), items.points[number]
        margin, width = edits, 2 * (edits + 1) + 2 * edits
        for at in range(0, len(some), 256):
            rows = some[at : at + 256]
            first = rows[:, 2] - margin
            place = first[:, None] + np.arange(len(item) + width)
            length = (starts[1:] - starts[:-1])[rows[:, 0]]
            inside = (place >= 0) & (place < length[:, None])
            regions = np.where(inside, points[np.where(inside, place + starts[rows[:, 0]][:, None], 0)], np.uint32(0))
            distance, begin, end = aligned(item, regions)
            for k in np.flatnonzero(distance <= edits):
                text = int(rows[k, 0])
                span = (max(0, int(first[k] + begin[k])), min(int(length[k]), int(first[k] + end[k])))
                leak = (int(distance[k]), *span)
                if number not in out[text] or leak < out[text][number]:
                    out[text][number] = leak
    return [[(items.ids[n], d, int(where[a]), int(where[b - 1]) + 1) for n, (d, a, b) in sorted(x.items())] for x, (_, where) in zip(out, parts, strict=True)]


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_col: str = "text", rate: float = RATE, least: int = LEAST, pass_chars: int = PASS_CHARS) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items that a passage of the whole text is, but for a few edits.

    Letters are compared lower-cased, white space as single blanks. An item of n characters is found
    where its edit distance to a passage is at most ``rate`` x n, and at most (n - 8) / 8 (see
    :func:`budget`); each leak has the item's id, the distance, and the passage's characters in the text
    as it was given (the best passage of each item; ties: the first). Items of fewer than ``least``
    characters are found where they stand exactly, as whole words. Null and blank items are nowhere.

    Items are searched for in passes of about ``pass_chars`` characters. A benchmark of one pass marks the
    rows as they are read; a larger one writes each pass's hits before the next is broadcast, so one
    pass's items are held at a time, and joins them by the texts' 128-bit hashes. A row of the benchmark that
    repeats another counts once, so that copies cannot fill a pass; items of one text under several ids
    are each found. Repeated documents and null ids pass through, null texts have no leaks; a column named ``leaks`` is
    replaced. An empty benchmark leaves no leaks.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(item_col).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    passes = -(-total // pass_chars) or 1
    kept = [c for c in docs.columns if c.lower() != "leaks"]
    docs = docs.select(*kept)

    def shared_items(number: int) -> Broadcast:
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == number).collect()
        some = sorted(((r["id"], normalised(r["text"])[0]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1].tobytes()))
        return spark.sparkContext.broadcast(Items([x for x, _ in some], [p for _, p in some], rate, least))

    def searched(rows: DataFrame, shared: Broadcast, column: str) -> DataFrame:
        names = ("item_id", "distance", "start", "stop")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some, raw in sliced(batches, column, 1 << 20):
                lists = [[dict(zip(names, x, strict=True)) for x in one] for one in found(shared.value, [x.decode() for x in raw])]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lists, _LEAK_LIST)], names=[*some.schema.names, "leaks"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("leaks", LEAKS)]))

    if passes == 1:
        return searched(docs, shared_items(0), text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = {"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(7), text)}
    keyed = docs.select(*[c.alias(k) for k, c in keys.items()], text.alias("text"))
    parts = []
    for number in range(passes):
        shared = shared_items(number)
        parts.append(saved(searched(keyed, shared, "text").where(F.size("leaks") > 0).select("__k1", "__k2", F.explode("leaks").alias("leak")).distinct()))
        shared.unpersist()
    listed = functools.reduce(DataFrame.union, parts).groupBy("__k1", "__k2").agg(F.sort_array(F.collect_list("leak")).alias("leaks"))
    marked = docs.withColumns(keys).join(listed, ["__k1", "__k2"], "left")
    return marked.select(*kept, F.coalesce("leaks", F.array().cast(LEAKS)).alias("leaks"))


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds; clean documents have none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
