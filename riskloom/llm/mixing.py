"""Language-model scores by online logistic context mixing over the bits of whole texts."""

from __future__ import annotations

import heapq
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import dropped, joined_bytes, release, saved, settings, sliced

#: A text is coded as its words with single blanks between, then one closing byte, which no word holds.
BLANK, CLOSE = b"\x20", b"\x0A"
END = b""  # the token after the last word of a text
#: The contexts of a bit: the last 4 bytes of the text, the word so far, and that with the word before.
ORDERS = (4,)
KINDS = len(ORDERS) + 2
#: Slots of each context's hashed table.
SLOTS = (1 << 20, 1 << 21, 1 << 22)
PART = 1 << 16  # slots that travel together
#: A gate is the longest context that has counts, how many (up to 1, 7, 63, or more), and which decision on the byte is next.
LEVELS = (1, 7, 63)
GATES, CENTRES = (KINDS + 1) * (len(LEVELS) + 1) * 8, np.arange(-8.0, 8.5, 0.5)
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
STEP = 1 << 15  # decisions that are predicted before the model moves
#: Training bytes of a shard, which is learned in one go; their number follows the corpus.
SHARD = 16 << 20
FIX = 1 << 24  # weights are added up as multiples of 1/FIX, so that the sum has no order
#: Only tokens of at most so many bytes, and of these the most frequent ones, are looked up in a broadcast table; all others by a join.
HEAD, SHORT = 1 << 16, 64
#: Different tokens that a task counts before it passes them on, however its rows come in batches.
COUNTED = 1 << 17


def words(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def coded(text: bytes) -> bytes:
    """What is coded of a text."""
    return BLANK.join(text.lower().split()) + CLOSE


class Code:
    """A prefix code of bytes, frequent ones short: the path of each byte as tree nodes and bits."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            for bit in (0, 1):
                parent[heap[0][2]] = (node - 256, bit)
                low = heapq.heappop(heap)
                total = low[0] if bit == 0 else total + low[0]
            heapq.heappush(heap, (total, node, node))
        paths = []
        for b in range(256):
            path, at = [], b
            while at in parent:
                path.append(parent[at])
                at = parent[at][0] + 256
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths])
        self.start = np.cumsum(self.length) - self.length  # where each byte's path begins in what follows
        self.node = np.array([n for p in paths for n, _ in p], dtype=np.uint32)
        self.bit = np.array([b for p in paths for _, b in p], dtype=np.uint8)
        self.depth = np.array([min(k, 7) for p in paths for k in range(len(p))])
        self.row = (self.node >> np.uint32(4)) * np.uint32(0x85EBCA6B)  # nodes of a row lie side by side in the tables
        self.inner = self.node & np.uint32(15)


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
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hash(x: np.ndarray) -> np.ndarray:
    return (_mixed(x * np.uint64(FACTOR)) >> np.uint64(32)).astype(np.uint32)


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(FACTOR))


def contexts(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each kind, a hash of the context of every byte of concatenated coded texts; contexts end at the text's begin."""
    size = len(data)
    place = np.arange(size) - np.repeat(starts[:-1], np.diff(starts))
    value = data.astype(np.uint64) + np.uint64(1)
    out, rolling, order = [], np.zeros(size, np.uint64), 0
    for wanted in ORDERS:
        while order < wanted:
            order += 1
            rolling *= np.uint64(0x100000001B3)
            reach = np.flatnonzero(place >= order)
            rolling[reach] += value[reach - order]
        out.append(_hash(rolling + np.uint64(order)))
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(size, FACTOR), out=sums[1:])
    part = (data == BLANK[0]) | (data == CLOSE[0])
    begins = np.concatenate(([0], np.flatnonzero(part) + 1))[: int(part.sum()) or 1]
    number = np.cumsum(part) - part  # the word of each byte; its closing byte belongs to it
    begin = begins[number]
    inverse = powers(size + 1, INVERSE)
    so_far = (sums[:-1] - sums[begin]) * inverse[begin]
    ends = np.flatnonzero(part)
    whole = (sums[ends] - sums[begins]) * inverse[begins]
    before = np.concatenate((np.zeros(1, np.uint64), whole[:-1])) if len(whole) else np.zeros(1, np.uint64)
    if len(ends):
        before[1:][data[ends[:-1]] == CLOSE[0]] = 0
    out.append(_hash(so_far + np.uint64(11)))
    out.append(_hash((so_far ^ _mixed(before * np.uint64(FACTOR) + np.uint64(1))[number]) + np.uint64(13)))
    return out


@dataclass
class Bits:
    """The binary decisions of some bytes along the code's paths."""

    low: int  # number of the first byte
    first: np.ndarray  # of each byte, its first decision
    bit: np.ndarray
    depth: np.ndarray  # how many decisions on the same byte came before, up to 7
    slots: list[np.ndarray]  # for each context kind


def decisions(data: np.ndarray, hashes: list[np.ndarray], code: Code, low: int, high: int) -> Bits:
    """The decisions of the bytes low..high."""
    some = data[low:high]
    length = code.length[some]
    first = np.cumsum(length) - length
    byte = np.repeat(np.arange(high - low), length)
    path = (code.start[some] - first)[byte] + np.arange(len(byte))
    row, inner, slots = code.row[path], code.inner[path], []
    for k, h in enumerate(hashes):
        mixed = h[low:high][byte]
        mixed += row
        mixed *= np.uint32(0x9E3779B1)
        mixed >>= np.uint32(33 - SLOTS[k].bit_length() + 4)
        mixed <<= np.uint32(4)
        mixed |= inner
        slots.append(mixed.astype(np.int64))
    return Bits(low, first, code.bit[path], code.depth[path], slots)


def chunks(texts: list[bytes], code: Code) -> Iterator[tuple[Bits, np.ndarray]]:
    """The decisions of coded texts in steps of about ``STEP``, and where each text begins."""
    data, starts = joined_bytes([coded(x) for x in texts])
    hashes = contexts(data, starts)
    step = max(1, STEP // 5)
    for low in range(0, len(data), step):
        yield decisions(data, hashes, code, low, min(low + step, len(data))), starts


@dataclass
class Mixer:
    """What predicts: the code, packed odds of each slot, mixing weights of each gate, and the refining map of each gate."""

    code: Code
    odds: list[np.ndarray]  # for each context kind, (log odds in 1/256) * 8 + level of every slot; level 0: never met
    weights: np.ndarray  # (gates, kinds + 1)
    seen: np.ndarray  # (gates, centres): weight of decisions near each centre
    ones: np.ndarray

    def inputs(self, bits: Bits) -> tuple[list[np.ndarray], np.ndarray]:
        packed = [table[slot] for slot, table in zip(bits.slots, self.odds, strict=True)]
        return gated([(x >> 3).astype(np.float32) * np.float32(1 / 256) for x in packed], [x & 7 for x in packed], bits.depth)

    def chance(self, bits: Bits) -> np.ndarray:
        stretched, gate = self.inputs(bits)
        return refined(mixed(self.weights, stretched, gate), gate, self.seen, self.ones)

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """The log10 probability of each whole text."""
        total = np.zeros(len(texts))
        for bits, starts in chunks(texts, self.code):
            chance = self.chance(bits)
            cost = np.log10(np.where(bits.bit == 1, chance, 1 - chance))
            begin = np.searchsorted(starts, bits.low, side="right") - 1  # the texts from here up to the last byte's
            end = np.searchsorted(starts, bits.low + len(bits.first))
            total[begin:end] += np.add.reduceat(cost, bits.first[np.maximum(starts[begin:end] - bits.low, 0)], dtype=np.float64)
        return total


def gated(stretched: list[np.ndarray], levels: list[np.ndarray], depth: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The inputs of each decision (a constant last), and its gate."""
    state = np.zeros(len(depth), np.int64)
    for k, level in enumerate(levels):
        found = (k + 1) * (len(LEVELS) + 1) - 1 + level.astype(np.int64)
        np.copyto(state, found, where=level > 0)
    return [*stretched, np.ones(len(depth), np.float32)], state * 8 + depth


def mixed(weights: np.ndarray, stretched: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
    """Log odds of a 1: the inputs weighed by the gate's weights."""
    total = np.zeros(len(gate), np.float32)
    for k, column in enumerate(np.ascontiguousarray(weights.T, np.float32)):
        total += column[gate] * stretched[k]
    return np.clip(total, -11, 11)


def _places(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = (np.clip(odds, np.float32(CENTRES[0]), np.float32(CENTRES[-1] - 1e-3)) - np.float32(CENTRES[0])) * np.float32(2)
    low = place.astype(np.int32)
    return low.astype(np.int64), place - low.astype(np.float32)


def refined(odds: np.ndarray, gate: np.ndarray, seen: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The chance of a 1: half the mixed one, half what came of decisions of the gate with like odds."""
    table = ((ones + 8 / (1 + np.exp(-CENTRES))) / (seen + 8)).ravel().astype(np.float32)
    low, share = _places(odds)
    at = gate * len(CENTRES) + low
    looked = table[at] * (1 - share) + table[at + 1] * share
    return np.clip(np.float32(0.5) * (looked + 1 / (1 + np.exp(-odds))), np.float32(1e-6), np.float32(1 - 1e-6))


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and level of slots' counts."""
    zeros, ones = zeros.astype(np.float32), ones.astype(np.float32)
    total = zeros + ones
    level = (total > 0).view(np.int8)
    for most in LEVELS:
        level += (total > most).view(np.int8)
    zeros += np.float32(0.2)
    ones += np.float32(0.2)
    ones /= zeros
    return np.log(ones, out=ones), level


def halves(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two counts in each of a shard's slots."""
    return packed.view(np.int32)[0::2], packed.view(np.int32)[1::2]


def first_weights() -> np.ndarray:
    """Where learning begins: trust in the longest context that has counts, the more the more it has."""
    out = np.zeros((KINDS + 1, len(LEVELS) + 1, 8, KINDS + 1))
    for longest in range(1, KINDS + 1):
        for level in range(len(LEVELS) + 1):
            trust = 0.4 + 0.5 * level / len(LEVELS)
            out[longest, level, :, longest - 1] = trust
            if longest > 1:
                out[longest, level, :, longest - 2] = 1 - trust
    return out.reshape(GATES, -1)


class Learner:
    """The state of one shard: counts, weights and refining map, moved after each step of decisions."""

    def __init__(self, code: Code, rate: float):
        self.code, self.rate = code, rate
        self.held: list[bytes] = []
        self.size = 0
        self.counts = [np.zeros(n, np.int64) for n in SLOTS]  # zeros in the low half, ones in the high half
        self.weights, self.squares = first_weights(), np.full((GATES, KINDS + 1), 1e-4)
        self.mass = np.zeros(GATES)
        self.seen, self.ones = np.zeros((GATES, len(CENTRES))), np.zeros((GATES, len(CENTRES)))

    def learn(self, text: bytes) -> None:
        """Takes in the shard's next text; what is learned together depends on the shard's texts alone."""
        self.held.append(text)
        self.size += len(text)
        if self.size >= STEP:
            self.flush()

    def flush(self) -> None:
        texts, self.held, self.size = self.held, [], 0
        for bits, _ in chunks(texts, self.code):
            self.step(bits)

    def step(self, bits: Bits) -> None:
        """Predicts some decisions with the state so far, then moves weights, refining map and counts by what they are."""
        found = [log_odds(*halves(table[slot])) for slot, table in zip(bits.slots, self.counts, strict=True)]
        stretched, gate = gated([x for x, _ in found], [x for _, x in found], bits.depth)
        odds = mixed(self.weights, stretched, gate)
        error = bits.bit - 1 / (1 + np.exp(-odds))
        mass = np.bincount(gate, minlength=GATES)
        for k in range(KINDS + 1):
            slope = np.bincount(gate, error * stretched[k], minlength=GATES) / np.maximum(mass, 1)
            self.squares[:, k] += slope**2
            self.weights[:, k] += self.rate * slope / np.sqrt(self.squares[:, k])
        self.mass += mass
        low, share = _places(odds)
        near = gate * len(CENTRES) + low + (share > 0.5)
        both = np.bincount(near * 2 + bits.bit, minlength=2 * self.seen.size).reshape(*self.seen.shape, 2)
        self.seen += both.sum(axis=2)
        self.ones += both[:, :, 1]
        one = np.int64(1) << (bits.bit.astype(np.int64) << 5)
        for slot, table in zip(bits.slots, self.counts, strict=True):
            np.add.at(table, slot, one)

    def parts(self) -> Iterator[tuple[int, tuple]]:
        """The state as numbered arrays of whole numbers, to be added to those of other shards."""
        self.flush()
        fixed = [(self.weights * self.mass[:, None]).ravel(), self.mass, self.seen.ravel(), self.ones.ravel()]
        yield -1, np.rint(np.concatenate(fixed) * FIX).astype(object)
        number = 0
        for table in self.counts:
            for at in range(0, len(table), PART):
                some = table[at : at + PART]
                used = np.flatnonzero(some)
                if len(used):
                    yield number, (used.astype(np.uint16), *halves(some[used]))
                number += 1


@dataclass
class Packed:
    """A learned model as it is broadcast: compressed tables, which each worker process unpacks once."""

    name: str
    code: Code
    parts: list[bytes]
    weights: np.ndarray
    seen: np.ndarray
    ones: np.ndarray

    def mixer(self) -> Mixer:
        if self.name not in _UNPACKED:
            _UNPACKED.clear()
            flat = np.concatenate([np.frombuffer(zlib.decompress(x), np.int16) if x else np.zeros(PART, np.int16) for x in self.parts])
            _UNPACKED[self.name] = Mixer(self.code, np.split(flat, np.cumsum(SLOTS)[:-1]), self.weights, self.seen, self.ones)
        return _UNPACKED[self.name]


_UNPACKED: dict[str, Mixer] = {}


def _code(vocabulary: DataFrame) -> tuple[Code, int]:
    """The code for the bytes of the training texts, and how many these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256, np.int64)
        for rows, tokens in sliced(batches, "token", 1 << 20):
            data, starts = joined_bytes(tokens)
            times = rows.column(1).to_numpy()
            counts += np.bincount(data, np.repeat(times, np.diff(starts)), minlength=256).astype(np.int64)
            counts[CLOSE[0]] += sum(int(n) for t, n in zip(tokens, times, strict=True) if not t)
            counts[BLANK[0]] += sum(int(n) for t, n in zip(tokens, times, strict=True) if t)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(counts)], names=["byte", "n"])

    rows = vocabulary.where("n > 0").mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(256, np.int64)
    for r in rows:
        counts[r["byte"]] = r["n"]
    return Code(counts), int(counts.sum())


def learn(rows: DataFrame, code: Code, size: int, rate: float = 0.02, shard: int = SHARD) -> Broadcast:
    """A model of all rows ``id, text`` (``size`` bytes together), broadcast.

    Rows are dealt by a hash of id and text into shards of about ``shard`` bytes, so many as the corpus
    asks for, and each shard is learned online, in the order of another hash: every step of decisions is
    predicted with the state so far (counts of hashed contexts, gated weights, refining map), which then
    moves. The shards' counts and maps are added up, their weights averaged by the decisions of each gate,
    all as whole numbers, so the model depends on the rows alone, not on how they lie in partitions. The
    tables have a fixed number of slots, which bounds what is broadcast; contexts that share one blur.
    """
    spark = rows.sparkSession
    count = max(1, -(-size // shard))
    texts = F.coalesce("text", F.lit(""))
    dealt = rows.select(F.pmod(F.xxhash64(F.lit(3), "id", texts), F.lit(count)).cast("int").alias("shard"), F.xxhash64(F.lit(5), texts).alias("order"), F.xxhash64(F.lit(6), texts).alias("order2"), texts.alias("text"))
    partitions = min(4 * count, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = sum(SLOTS) // PART
    wide = GATES * (KINDS + 2 + 2 * len(CENTRES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _UNPACKED.clear()  # a worker that scored before still holds that model
        state, current = None, None
        for some, texts in sliced(batches, "text", 1 << 16):
            shards = some.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(edges, edges[1:], strict=False):
                if shards[a] != current:
                    if state:
                        yield from emitted(state)
                    state, current = Learner(code, rate), shards[a]
                for text in texts[a:b]:
                    state.learn(text)
        if state:
            yield from emitted(state)

    def row(part: int, *sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(b"".join(x.tobytes() for x in sums), 1)], pa.binary())], names=["part", "sums"])

    def emitted(state: Learner) -> Iterator[pa.RecordBatch]:
        for part, sums in state.parts():
            if part >= 0:
                yield row(part, *sums)
            else:  # in two halves, so that sums of many shards stay within 64 bits
                high = np.array([int(x) >> 32 for x in sums], np.int64)
                yield row(-1, np.concatenate((high, np.array([int(x) & 0xFFFFFFFF for x in sums], np.int64))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = zlib.decompress(packed.as_py())
                if part < 0:
                    some = np.frombuffer(raw, np.int64)
                    held[part] = held[part] + some if part in held else some
                else:
                    size = len(raw) // 10
                    used = np.frombuffer(raw, np.uint16, size).astype(np.int64)
                    zeros, ones = np.frombuffer(raw, np.int32, size, 2 * size), np.frombuffer(raw, np.int32, size, 6 * size)
                    sums = held.setdefault(part, np.zeros(2 * PART, np.int64))
                    sums[used] += zeros
                    sums[used + PART] += ones
        for part, some in held.items():
            if part < 0:
                yield row(part, some)
            else:
                odds, level = log_odds(*np.split(some, 2))
                packed = (np.rint(np.clip(odds, -15, 15) * 256).astype(np.int16) << 3) + level.astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(packed.tobytes(), 1)], pa.binary())], names=["part", "sums"])

    schema = "part int, sums binary"
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}):
        shards = dealt.repartition(partitions, "shard").sortWithinPartitions("shard", "order", "order2").select("shard", "text")
        sums = saved(shards.mapInArrow(run, schema))
    del shards
    release(spark)  # the texts' shuffle, before the shards' sums are shuffled
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}):
        found = {r["part"]: bytes(r["sums"]) for r in sums.repartition("part").mapInArrow(add, schema).collect()}
    dropped(sums)
    release(spark)
    flat = np.zeros(wide)
    if -1 in found:
        high, low = np.split(np.frombuffer(zlib.decompress(found[-1]), np.int64), 2)
        flat = np.array([((int(h) << 32) + int(x)) / FIX for h, x in zip(high, low, strict=True)])
    weights, mass, seen, ones = np.split(flat, np.cumsum((GATES * (KINDS + 1), GATES, GATES * len(CENTRES))))
    mass, shape = mass[:, None], (GATES, len(CENTRES))
    weights = np.where(mass > 0, weights.reshape(GATES, -1) / np.maximum(mass, 1), first_weights())
    return spark.sparkContext.broadcast(Packed(uuid.uuid4().hex, code, [found.get(k, b"") for k in range(total)], weights, seen.reshape(shape), ones.reshape(shape)))


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, n`` of all texts: occurrences in rows whose ``learned`` is true (0 for tokens of other rows only)."""

    def emitted(counts: Counter, others: Counter) -> pa.RecordBatch:
        names = [*counts, *(x for x in others if x not in counts)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([counts.get(x, 0) for x in names], pa.int64())], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, others = Counter(), Counter()
        for rows, texts in sliced(batches, "text", 1 << 20):
            for text, flag in zip(texts, rows.column(1).to_pylist(), strict=True):
                (counts if flag else others).update(words(text))
            if len(counts) + len(others) >= COUNTED:
                yield emitted(counts, others)
                counts, others = Counter(), Counter()
        yield emitted(counts, others)

    return docs.select("text", "learned").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, rate: float = 0.02, shard: int = SHARD) -> DataFrame:
    """``id, learned, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row's whole text.

    A text is its words (ASCII lower-cased, white space parts them) and an end token. ``score`` is the
    log10 probability of the whole text, coded byte by byte with single blanks and a closing byte, under
    the model that :func:`learn` makes of the rows where ``learned`` is true; ``bits_per_byte`` is the same
    in bits. Every word is spelled out, known or not, in the context of what stands before it in the text.
    ``base_score``, of add-one word frequencies, knows the training tokens and one symbol for any other
    word. Texts look the ``head`` most frequent short tokens up in a broadcast table (at most ``head`` x
    ``SHORT`` bytes) and join the rest by token, so no hot token takes part in the join.

    Null text counts as empty (one token, the end). Null ids stay; repeated rows are scored one by one;
    where nothing is learned all counts are 0 and the untrained mixer scores. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learned, F.lit(False)).alias("learned"), F.col(text_col).cast("string").alias("text"))
    vocabulary = saved(token_counts(rows))
    release(spark)
    n, v = vocabulary.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    n = n or 0
    model = learn(rows.where("learned"), *_code(vocabulary), rate, shard)
    frequent = vocabulary.where(F.octet_length("token") <= SHORT).orderBy(F.desc("n"), "token").limit(head).collect()
    table = spark.sparkContext.broadcast({bytes(r["token"]): r["n"] for r in frequent})
    base_of = lambda c: math.log10((c + 1) / (n + v + 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mixer = table.value, model.value.mixer()
        for some, texts in sliced(batches, "text", 1 << 17):
            keys = some.column(0).to_pylist()
            whole, rare = [], []
            for k, text in enumerate(texts):
                tokens = words(text)
                base, sure = [], 0
                for token, times in Counter(tokens).items():
                    if token in known:
                        base.append(times * base_of(known[token]))
                        sure += times * (known[token] > 0)
                    else:
                        rare.append((keys[k], token, times))
                whole.append((len(tokens), sure, math.fsum(base), sum(map(len, tokens)) + max(1, len(tokens) - 1)))
            scores = pa.array(mixer.log10(texts))
            none = [None] * len(rare)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys + [r[0] for r in rare], pa.int64()),
                    pa.concat_arrays([some.column(1), pa.nulls(len(rare), some.column(1).type)]),
                    pa.concat_arrays([some.column(2), pa.nulls(len(rare), pa.bool_())]),
                    pa.array([None] * len(whole) + [r[1] for r in rare], pa.binary()),
                    pa.array([None] * len(whole) + [r[2] for r in rare], pa.int64()),
                    *(pa.array([w[j] for w in whole] + none, t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))),
                    pa.concat_arrays([scores, pa.nulls(len(rare), pa.float64())]),
                ],
                names=["key", "id", "learned", "token", "times", "n_tokens", "n_known", "base", "n_bytes", "score"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "id", "learned", "text")
    parts = saved(keyed.mapInArrow(read, f"key long, id {kind}, learned boolean, token binary, times long, n_tokens long, n_known long, base double, n_bytes long, score double"))
    rare = parts.where("token is not null").select("key", "token", "times").join(vocabulary, "token")
    rare = rare.groupBy("key").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("r_known"), F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(float(n + v + 1)))).alias("r_base"))
    whole = parts.where("token is null").drop("token", "times").join(rare, "key", "left")
    return whole.select(
        "id",
        "learned",
        "n_tokens",
        (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document's scores as :func:`scored` gives them, learned from those whose crc32(doc_id) mod 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scored(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    return found.select(F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
