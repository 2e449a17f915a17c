"""Exact removal of repeated token strings by a depth-limited radix ordering of sampled suffixes.

A token is a byte or a word. Every string of ``length`` tokens that starts in two places is to be found.
Suffixes are ordered only to that depth, most significant digits first: a first pass groups suffixes by
a digit of their first tokens, later passes split equal groups by what follows (and precedes), and a
suffix that is alone in its group leaves. At the last pass a group holds equal windows of the full
length: the repeated ones. Within a task, each group's windows are compared token by token before they
are accepted; groups that are accepted across tasks have equal 128-bit hashes.

Not all suffixes enter the first pass. An *anchor* is a place whose first digit's hash is the least among
the places of some window, so each window of ``length`` tokens holds, at a place that its own tokens
decide, an anchor; two equal windows hold theirs alike. An anchor stands for the windows that begin in a
block of places before it (256 places for 400 tokens). The tokens that all those windows share are the
digit of the first pass; where also the tokens that they cover together are equal to another anchor's,
all of them are repeated and leave at once. Else the block of windows is split in four, each part with a
longer common digit, down to single windows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from riskloom.llm.shared import dropped, joined_bytes, release, saved, sliced

SPLIT = 4  # parts that a block is split into
#: Anchors of one digit that are resolved together in a task. A larger group is dealt anew by the next, longer digit of each
#: part of its blocks; a part's group that is still larger is resolved by a distributed count of its windows.
TOGETHER = 1 << 12
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Tokens that are hashed together.
PORTION = 1 << 18
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


_KEPT: dict[int, np.ndarray] = {}


def powers(count: int, base: int) -> np.ndarray:
    """base^0 .. base^(count - 1), mod 2^64; up to 2^19 of them are kept for the next call."""
    out = _KEPT.get(base, np.ones(1, dtype=np.uint64))
    while len(out) < count:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
        if len(out) <= 1 << 19:
            _KEPT[base] = out
    return out[:count]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Tokens:
    """What is compared: strings of ``length`` bytes or words, in blocks of windows."""

    length: int
    words: bool = False

    @property
    def block(self) -> int:
        """Windows of an anchor: the largest power of two up to two thirds of the length, at most 512."""
        return min(512, 1 << max(0, (2 * self.length // 3).bit_length() - 1))

    @property
    def digit(self) -> int:
        return self.length - self.block + 1

    @property
    def kind(self) -> type:
        return np.uint64 if self.words else np.uint8

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts in one array (a word is a hash of its bytes), and where each text's begin."""
        data, starts = joined_bytes(texts)
        if not self.words:
            return data, starts
        begin, end = _bounds(data, starts)
        hashes, low = np.zeros(len(begin), dtype=np.uint64), 0
        while low < len(begin):  # some words at a time, so that memory does not follow the longest text
            high = max(low + 1, int(np.searchsorted(end, begin[low] + PORTION, side="right")))
            first, some = begin[low], data[begin[low] : end[high - 1]]
            sums = np.zeros(len(some) + 1, dtype=np.uint64)
            np.cumsum(BYTE[some] * powers(len(some), FACTOR), out=sums[1:])
            a, b = begin[low:high] - first, end[low:high] - first
            hashes[low:high] = _mixed((sums[b] - sums[a]) * powers(len(some) + 1, INVERSE)[a])
            low = high
        return hashes, np.searchsorted(begin, starts)

    def values(self, tokens: np.ndarray) -> np.ndarray:
        return tokens if self.words else BYTE[tokens]


def _bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of concatenated texts begins and ends; white space and the texts' ends part words."""
    word = np.concatenate(([False], ~SPACE[data], [False]))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    return np.flatnonzero(word[1:] & (~word[:-1] | edge)), np.flatnonzero(word[:-1] & (~word[1:] | edge))


def anchors(tokens: np.ndarray, starts: np.ndarray, of: Tokens) -> np.ndarray:
    """Places of the anchors in concatenated texts, found a portion at a time."""
    reach, out = of.block + of.length, [np.zeros(0, dtype=np.int64)]
    long = np.flatnonzero(np.diff(starts) >= of.length)
    first, last = starts[long], starts[long + 1] - of.length  # the windows of each text
    for low in range(0, len(tokens), PORTION):
        begin, end = max(0, low - reach), min(len(tokens), low + PORTION + reach)
        here = (last >= begin) & (first <= end - of.length)
        found = _anchors(tokens[begin:end], np.maximum(first[here], begin) - begin, np.minimum(last[here], end - of.length) - begin, of) + begin
        out.append(found[(found >= low) & (found < low + PORTION)])
    return np.concatenate(out)


def _anchors(tokens: np.ndarray, first: np.ndarray, last: np.ndarray, of: Tokens) -> np.ndarray:
    """Places of the anchors of the windows first..last of some texts."""
    length, block, digit = of.length, of.block, of.digit
    count = len(tokens) - length + 1
    if count <= 0 or not len(first):
        return np.zeros(0, dtype=np.int64)
    sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(of.values(tokens) * powers(len(tokens), FACTOR), out=sums[1:])
    hashes = (sums[digit:] - sums[:-digit]) * powers(len(tokens) - digit + 1, INVERSE)
    hashes = (_mixed(hashes) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    least, width = hashes, 1
    while width < block:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    inside = np.zeros(count + 1, dtype=np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    least = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, least, np.uint32(0))
    edge, width = np.zeros(block - 1, dtype=np.uint32), 1
    most = np.concatenate((edge, least, edge))
    while width < block:
        most = np.maximum(most[:-width], most[width:])
        width *= 2
    return np.flatnonzero(most == hashes)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _anchor_rows(keyed: DataFrame, of: Tokens) -> DataFrame:
    """``core, span, k1, k2, place``: each anchor's digit, all its tokens, its text, and (place, nearest and farthest window) packed."""
    length, block, wide = of.length, of.block, np.dtype(of.kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core_of, span_of = xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
        for rows, texts in sliced(batches, "text", 1 << 19):
            tokens, starts = of.of(texts)
            at = anchors(tokens, starts, of)
            text = np.searchsorted(starts, at, side="right") - 1
            far = at - np.maximum(at - block + 1, starts[text])
            near = at - np.minimum(at, starts[text + 1] - length)
            whole = tokens.tobytes()
            core = [_signed(core_of(whole[p : p + of.digit * wide])) for p in (at * wide).tolist()]
            span = [_signed(span_of(whole[p:q], a << 9 | b)) for p, q, a, b in zip(((at - far) * wide).tolist(), ((at - near + length) * wide).tolist(), near.tolist(), far.tolist(), strict=True)]
            place = (at - starts[text]) << 18 | near << 9 | far
            keys = [rows.column(k).take(pa.array(text)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(span, pa.int64()), *keys, pa.array(place, pa.int64())], names=["core", "span", "k1", "k2", "place"])

    return keyed.select("k1", "k2", "text").mapInArrow(run, "core long, span long, k1 long, k2 long, place long")


def _contexts(texts: DataFrame, of: Tokens) -> DataFrame:
    """``core, k1, k2, place, bytes``: around each listed anchor, all tokens of its windows (what lies outside the text as zeros)."""
    length, block, wide = of.length, of.block, np.dtype(of.kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw in sliced([batch], "text", 1 << 19):
                listed = rows.column(3)
                flat = listed.flatten()
                owner = np.repeat(np.arange(rows.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
                place = flat.field(1).to_numpy(zero_copy_only=False)
                tokens, starts = of.of(raw)
                whole, around = tokens.tobytes(), []
                at = starts[owner] + (place >> 18)
                first, last = at - block + 1, at + length
                left, right = np.maximum(first, starts[owner]), np.minimum(last, starts[owner + 1])
                for f, a, b, e in zip(first.tolist(), left.tolist(), right.tolist(), last.tolist(), strict=True):
                    around.append(bytes((a - f) * wide) + whole[a * wide : b * wide] + bytes((e - b) * wide))
                keys = [rows.column(k).take(pa.array(owner)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([flat.field(0), *keys, flat.field(1), pa.array(around, pa.binary())], names=["core", "k1", "k2", "place", "bytes"])

    return texts.select("k1", "k2", "text", "anchors").mapInArrow(run, "core long, k1 long, k2 long, place long, bytes binary")


def _sums(around: list[bytes], of: Tokens) -> np.ndarray:
    """Prefix hashes of equally long token strings, a row each."""
    values = of.values(np.frombuffer(b"".join(around), dtype=of.kind).reshape(len(around), -1))
    sums = np.zeros((len(around), values.shape[1] + 1), dtype=np.uint64)
    np.cumsum(values * powers(values.shape[1], FACTOR), axis=1, out=sums[:, 1:])
    return sums


def _ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry: the number of its value, how many entries share it, and the place of the first of them."""
    _, first, number, counts = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
    return number, counts[number], first[number]


def repeated_windows(around: list[bytes], group: np.ndarray, near: np.ndarray, far: np.ndarray, of: Tokens, keep_first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): windows that begin first..last tokens before the row's anchor and are repeated in its group.

    With ``keep_first``, without the windows of the first row that has them.
    """
    length, block, wide = of.length, of.block, np.dtype(of.kind).itemsize
    sums, inverse = _sums(around, of), powers(block + length, INVERSE)
    row, offset, size, found = np.arange(len(around)), np.zeros(len(around), dtype=np.int64), block, []
    group = _mixed(group.astype(np.uint64))
    whole = True
    while (size > 1 or whole) and len(row):
        parts, whole = min(SPLIT, size), False
        size //= parts
        row = np.repeat(row, parts)
        offset = (offset[:, None] + size * np.arange(parts)).ravel()
        a, b = np.maximum(offset, near[row]), np.minimum(offset + size - 1, far[row])
        row, offset, a, b = (x[a <= b] for x in (row, offset, a, b))

        def key(begin: np.ndarray, end: np.ndarray, salt: np.ndarray, row: np.ndarray = row) -> np.ndarray:
            return _mixed((sums[row, end] - sums[row, begin]) * inverse[begin] ^ salt)

        at = block - 1
        core = key(at - offset, at - offset - size + 1 + length, _mixed(group[row] + offset.astype(np.uint64)))
        number, shared, _ = _ranks(core)
        row, offset, a, b, core, number = (x[shared > 1] for x in (row, offset, a, b, core, number))
        span = key(at - b, at - a + length, core + (a << 9 | b).astype(np.uint64), row)
        _, same, lead = _ranks(span)
        here = np.arange(len(row))
        equal = np.ones(len(row), dtype=bool)  # compared token by token
        for k in np.flatnonzero((same > 1) & (lead != here)).tolist():
            low, high = (at - b[k]) * wide, (at - a[k] + length) * wide
            equal[k] = around[row[k]][low:high] == around[row[lead[k]]][low:high]
        again = np.zeros(len(row), dtype=bool)
        again[lead[equal & (lead != here)]] = True
        hit = equal & (lead != here) | (again & (not keep_first))
        kinds = np.bincount(number[(lead == here) | ~equal], minlength=number.max(initial=0) + 1)[number]
        found.append((row[hit], a[hit], b[hit]))
        more = (kinds > 1) & ((lead == here) | ~equal)
        row, offset = row[more], offset[more]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def _resolved(contexts: DataFrame, of: Tokens, keep_first: bool) -> DataFrame:
    """``k1, k2, start, stop``: repeated token ranges; rows come partitioned by ``core`` and in the order of texts and places."""
    names = ["k1", "k2", "start", "stop"]

    def solve(rows: pa.Table) -> pa.RecordBatch:
        place = rows["place"].to_numpy()
        row, first, last = repeated_windows(rows["bytes"].to_pylist(), rows["core"].to_numpy(), place >> 9 & 511, place & 511, of, keep_first)
        at = (place >> 18)[row]
        keys = [rows[k].combine_chunks().take(pa.array(row)) for k in ("k1", "k2")]
        return pa.RecordBatch.from_arrays([*keys, pa.array(at - last), pa.array(at - first + of.length)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < 4096:
                continue
            table = pa.Table.from_batches(held)
            core = table["core"].to_numpy()
            cut = int(np.flatnonzero(core != core[-1])[-1]) + 1 if core[0] != core[-1] else 0
            for lo, hi in _pieces(core[:cut]):
                yield solve(table.slice(lo, hi - lo))
            held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            for lo, hi in _pieces(table["core"].to_numpy()):
                yield solve(table.slice(lo, hi - lo))

    return contexts.repartition("core").sortWithinPartitions("core", "k1", "k2", "place").mapInArrow(run, "k1 long, k2 long, start long, stop long")


def _pieces(core: np.ndarray, most: int = 4096) -> Iterator[tuple[int, int]]:
    """Slices of sorted digits of about ``most`` rows that don't part a group."""
    edges = np.concatenate((np.flatnonzero(core[1:] != core[:-1]) + 1, [len(core)])) if len(core) else []
    start = 0
    for k, edge in enumerate(edges):
        if k == len(edges) - 1 or edges[k + 1] - start > most:
            yield start, int(edge)
            start = int(edge)


def _window_rows(contexts: DataFrame, of: Tokens) -> DataFrame:
    """``k1, k2, start, w1, w2``: each window of the given anchors with a 128-bit hash of its tokens."""
    length, block, wide = of.length, of.block, np.dtype(of.kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                place, around = some.column(3).to_numpy(), some.column(4).to_pylist()
                back = [np.arange(a, b + 1) for a, b in zip((place >> 9 & 511).tolist(), (place & 511).tolist(), strict=True)]
                row = np.repeat(np.arange(len(around)), [len(x) for x in back])
                back = np.concatenate(back)
                digests = b"".join(xxhash.xxh3_128_digest(around[k][(block - 1 - x) * wide : (block - 1 - x + length) * wide]) for k, x in zip(row.tolist(), back.tolist(), strict=True))
                hashes = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
                keys = [some.column(k).take(pa.array(row)) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array((place >> 18)[row] - back), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())], names=["k1", "k2", "start", "w1", "w2"])

    return contexts.mapInArrow(run, "k1 long, k2 long, start long, w1 long, w2 long")


def _parts(contexts: DataFrame, of: Tokens) -> DataFrame:
    """The next pass: each anchor's block in four parts, a row each, under a hash of the part's longer digit."""
    length, block, wide, parts = of.length, of.block, np.dtype(of.kind).itemsize, min(SPLIT, of.block)
    size = block // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                place, around, core = some.column(3).to_numpy(), some.column(4).to_pylist(), some.column(0).to_numpy()
                row = np.repeat(np.arange(len(around)), parts)
                offset = np.tile(size * np.arange(parts), len(around))
                near, far = np.maximum(offset, (place >> 9 & 511)[row]), np.minimum(offset + size - 1, (place & 511)[row])
                row, offset, near, far = (x[near <= far] for x in (row, offset, near, far))
                digit = [around[k][(block - 1 - o) * wide : (block - o - size + length) * wide] for k, o in zip(row.tolist(), offset.tolist(), strict=True)]
                key = [_signed(xxhash.xxh64_intdigest(d, int(c) & 0xFFFFFFFF ^ o)) for d, c, o in zip(digit, core[row].tolist(), offset.tolist(), strict=True)]
                keys = [some.column(k).take(pa.array(row)) for k in (1, 2)]
                packed = (place[row] >> 18) << 18 | near << 9 | far
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *keys, pa.array(packed), some.column(4).take(pa.array(row))], names=["core", "k1", "k2", "place", "bytes"])

    return contexts.mapInArrow(run, "core long, k1 long, k2 long, place long, bytes binary")


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))
_SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _token_spans(docs: DataFrame, keys: dict, text: Column, of: Tokens, keep_first: bool, together: int) -> DataFrame:
    """``k1, k2, spans``: for each text (known by a 128-bit hash) the maximal ranges of tokens in repeated windows."""
    spark, length = docs.sparkSession, of.length
    keyed = docs.select(text.alias("text")).where(F.octet_length("text") >= (2 * length - 1 if of.words else length)).select(*(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), F.col("text")).alias("k2")), "text")

    first = saved(_anchor_rows(keyed, of))
    cores = saved(first.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    alive = first.join(cores, "core")
    alive = saved(alive.distinct() if keep_first else alive)
    dropped(first, cores)
    release(spark)
    spans = saved(alive.groupBy("core", "span").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("lead")))
    at, near, far = F.shiftright("place", 18), F.shiftright("place", 9).bitwiseAND(F.lit(511)), F.col("place").bitwiseAND(F.lit(511))
    equal = alive.join(spans.where("n > 1").select("core", "span", "lead"), ["core", "span"])
    if keep_first:
        equal = equal.where(F.struct("k1", "k2", "place") != F.col("lead"))
    equal = saved(equal.select("k1", "k2", (at - far).alias("start"), (at - near + length).alias("stop")))
    kinds = saved(spans.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    mixed = saved(spans.join(kinds, "core").select("core", "lead.*", "kinds"))
    dropped(alive, spans, kinds)
    release(spark)

    once = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    lists = mixed.groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "place")).alias("anchors"))
    around = _contexts(once.join(lists.hint("merge"), ["k1", "k2"]), of)  # lists grow with the texts: joined alike at every size
    ranges, done = [equal], [equal, mixed]
    large = mixed.where(F.col("kinds") > together).select("core").distinct()
    if large.isEmpty():
        ranges.append(saved(_resolved(around, of, keep_first)))
    else:
        around, large = saved(around), saved(large)
        parts = saved(_parts(around.join(large, "core", "left_semi").select("core", "k1", "k2", "place", "bytes"), of))
        sizes = saved(parts.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"))
        few = parts.join(sizes.where(F.col("n") <= together).select("core"), "core", "left_semi")
        many = parts.join(sizes.where(F.col("n") > together).select("core"), "core", "left_semi").select("core", "k1", "k2", "place", "bytes")
        ranges.append(saved(_resolved(around.join(large, "core", "left_anti").unionByName(few), of, keep_first)))
        windows = saved(_window_rows(many, of).distinct())
        again = saved(windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start")).alias("lead")).where("n > 1").drop("n"))
        hits = windows.join(again, ["w1", "w2"])  # both are tables, so that a hot window's rows can be split
        if keep_first:
            hits = hits.where(F.struct("k1", "k2", "start") != F.col("lead"))
        ranges.append(saved(hits.select("k1", "k2", "start", (F.col("start") + length).alias("stop"))))
        done += [around, large, parts, sizes, windows, again]
    release(spark)
    listed = functools.reduce(DataFrame.union, ranges).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("parts"))
    listed = saved(listed.mapInArrow(_merged, StructType([StructField("k1", LongType()), StructField("k2", LongType()), StructField("spans", SPANS)])))
    dropped(*done, *ranges[1:])
    release(spark)
    return listed


def with_repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 400, unit: str = "bytes", keep_first: bool = False, together: int = TOGETHER) -> DataFrame:
    """``docs`` with ``spans``: the maximal byte ranges covered by strings of ``length`` tokens that start anywhere else too.

    A token is a byte (of the UTF-8 text) or, with ``unit="words"``, a word ``[^\\x20\\x09-\\x0D]+``; white
    space between words makes no difference, and a range goes from its first word's first byte to its last
    word's last. Texts are taken whole; matches never cross texts; repetition within a text counts. With
    ``keep_first`` a string's first place (in the order of text hashes, then of places) stays out of the
    ranges, so that one copy of each is left; whole texts that are equal then count as one text.

    Null texts, empty ones and ones shorter than ``length`` have no spans. Rows pass through with all
    their columns (a column named ``spans`` is replaced); repeated rows are copies of one another, so
    that (without ``keep_first``) all bytes of a repeated text of enough length are covered. Texts are
    known by a 128-bit hash. Groups of any size are resolved exactly: up to ``together`` anchors with
    equal digits in a task, larger groups by a further pass over longer digits, and what is still larger
    then by counting windows across the cluster.
    """
    if length < 1 or unit not in ("bytes", "words"):
        raise ValueError("length must be positive and unit bytes or words")
    return _marked(docs, text_col, {"spans": (Tokens(length, unit == "words"), keep_first)}, together)


def _marked(docs: DataFrame, text_col: str, wanted: dict[str, tuple[Tokens, bool]], together: int) -> DataFrame:
    """``docs`` with a column of byte ranges for each of the wanted kinds of strings (and whether the first copy stays)."""
    clash = [c for c in docs.columns if c.lower() in (*wanted, "k1", "k2")]
    hidden = {c: f"__{i}_{c}" for i, c in enumerate(clash) if c.lower() not in wanted}
    docs = docs.drop(*(c for c in clash if c.lower() in wanted)).withColumnsRenamed(hidden)
    text_col = hidden.get(text_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(7), text)}
    found = docs.withColumns(keys)
    for name, (of, keep_first) in wanted.items():
        listed = _token_spans(docs, keys, text, of, keep_first, together).withColumnRenamed("spans", name)
        found = found.join(listed.hint("merge"), ["k1", "k2"], "left")
    back = [F.col(c).alias(next((k for k, v in hidden.items() if v == c), c)) for c in docs.columns]
    found = found.select(*back, *[F.coalesce(name, F.array().cast(SPANS)).alias(name) for name in wanted])
    place, of_words = docs.columns.index(text_col), [len(docs.columns) + i for i, (of, _) in enumerate(wanted.values()) if of.words]
    if not of_words:
        return found

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = batch.column(place), list(batch.columns)
            for n in of_words:
                spans = batch.column(n).to_pylist()
                for k in (k for k, x in enumerate(spans) if x):
                    begin, end = _bounds(*joined_bytes([texts[k].as_py().encode()]))
                    spans[k] = [{"start": int(begin[x["start"]]), "stop": int(end[x["stop"] - 1])} for x in spans[k]]
                columns[n] = pa.array(spans, _SPAN_LIST)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return found.mapInArrow(to_bytes, found.schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ranges of each row made maximal (touching ranges become one)."""
    for batch in batches:
        parts = batch.column(2)
        flat = parts.flatten()
        owner = np.repeat(np.arange(batch.num_rows), parts.value_lengths().to_numpy(zero_copy_only=False))
        start, stop = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
        shift = owner * (int(stop.max(initial=0)) + 1)
        reach = np.maximum.accumulate(stop + shift)
        begins = np.ones(len(start), dtype=bool)
        begins[1:] = start[1:] + shift[1:] > reach[:-1]
        begins[1:] |= owner[1:] != owner[:-1]
        ends = np.concatenate((np.flatnonzero(begins)[1:] - 1, [len(start) - 1])) if len(start) else np.zeros(0, int)
        values = pa.StructArray.from_arrays([pa.array(start[begins]), pa.array((reach - shift)[ends])], names=["start", "stop"])
        offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[begins], minlength=batch.num_rows)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), values).cast(_SPAN_LIST)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["k1", "k2", "spans"])


def _cut(text: bytes, spans: list[dict], letters: bool) -> bytes:
    """What the spans leave; with ``letters``, a character is removed only if all its bytes are."""
    kept, at = [], 0
    for x in spans:
        start, stop = x["start"], x["stop"]
        if letters:
            while start < len(text) and text[start] & 0xC0 == 0x80:
                start += 1
            while stop < len(text) and text[stop] & 0xC0 == 0x80:
                stop -= 1
        kept.append(text[at:start])
        at = max(at, stop)
    return b"".join([*kept, text[at:]])


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = 400, unit: str = "bytes", keep_first: bool = False) -> DataFrame:
    """``docs`` with the ranges of :func:`with_repeated_spans` cut from the text (whole characters only); a null text stays null."""
    marked = with_repeated_spans(docs, text_col, length, unit, keep_first)
    place = marked.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in sliced(batches, text_col):
            nulls = rows.column(place).is_valid().to_pylist()
            cut = [_cut(x, s, True).decode() if k else None for x, s, k in zip(raw, rows.column(rows.num_columns - 1).to_pylist(), nulls, strict=True)]
            columns = [pa.array(cut, pa.string()) if i == place else c for i, c in enumerate(rows.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names[:-1])

    return marked.mapInArrow(run, StructType(marked.schema.fields[:-1]))


#: Repeated passages of so many words are counted beside the repeated byte strings.
PASSAGE = 50


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 400 bytes; and how many of its bytes lie in repeated passages of 50 words.

    Null texts count as empty; repeated rows are copies of one another.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = _marked(docs, "text", {"spans": (Tokens(400), False), "passages": (Tokens(PASSAGE, True), False)}, TOGETHER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in sliced(batches, "text"):
            spans, passages = rows.column(2).to_pylist(), rows.column(3).to_pylist()
            size = lambda many: pa.array([sum(x["stop"] - x["start"] for x in s) for s in many], pa.int64())
            columns = [
                rows.column(0),
                pa.array([len(x) for x in raw], pa.int64()),
                size(spans),
                pa.array([len(s) for s in spans], pa.int64()),
                pa.array([hashlib.sha256(_cut(x, s, False)).hexdigest() for x, s in zip(raw, spans, strict=True)], pa.string()),
                size(passages),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"])

    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")
