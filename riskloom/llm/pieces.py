"""SentencePiece byte-pair encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from riskloom.llm.shared import sliced
from riskloom.llm.tokens import vocabulary_path

NEVER = np.int32(2**31 - 1)
#: Units of more characters go through the agenda one by one, shorter ones in a matrix.
WIDE = 48


class Pieces:
    """What a merge-type model says: the piece of each character, of each pair of pieces, and each piece's bytes."""

    def __init__(self, name: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
        self.size = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(self.size)]
        texts = [model.id_to_piece(i) for i in range(self.size)]
        normal = {t.replace("▁", " "): i for i, (t, s) in enumerate(zip(texts, special, strict=True)) if not s}
        self.byte = np.zeros(256, dtype=np.int32)
        for i in range(self.size):
            if model.is_byte(i):
                self.byte[int(texts[i][3:5], 16)] = i
        score = {i: model.get_score(i) for i in normal.values()}
        rank = {i: k for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i)))}
        levels = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(self.size + 1, NEVER, dtype=np.int32)
        for i in rank:
            self.rank[i] = levels[score[i]]
        self.other = self.size  # any character without a piece of its own
        self.of_char = np.full(0x110000, self.other, dtype=np.int32)
        for t, i in normal.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        pairs = {(normal[t[:k]], normal[t[k:]]): i for t, i in normal.items() for k in range(1, len(t)) if t[:k] in normal and t[k:] in normal}
        self.pairs = pairs
        keys = np.array([a * (self.size + 1) + b for a, b in pairs], dtype=np.int64)
        merged, self.tables = np.array(list(pairs.values()), dtype=np.int32), []
        while len(keys):  # hashed tables of pairs; what finds its slot taken goes to the next table
            shift = np.uint64(64 - max(8, (16 * len(keys)).bit_length()))
            table = np.full(1 << (64 - int(shift)), -1, dtype=np.int64), np.full(1 << (64 - int(shift)), -1, dtype=np.int32)
            slot = self._slot(keys, shift)
            _, first = np.unique(slot, return_index=True)
            table[0][slot[first]], table[1][slot[first]] = keys[first], merged[first]
            self.tables.append((shift, *table))
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, merged = keys[rest], merged[rest]
        raw = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else t.replace("▁", " ").encode() for i, t in enumerate(texts)]
        self.raw_starts = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        inner = {c for t in normal if len(t) > 1 for c in t}
        if any(" " in t.lstrip(" ") for t in normal):
            raise ValueError("pieces with a blank inside are not supported")
        self.units = re.compile(r" *[^ \n]+| +|\n" if "\n" not in inner else r" *[^ ]+| +")

    @staticmethod
    def _slot(key: np.ndarray, shift: np.uint64) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).view(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1."""
        key = left.astype(np.int64) * (self.size + 1) + right
        found = np.full(len(key), -1, dtype=np.int32)
        for shift, keys, merged in self.tables:
            slot = self._slot(key, shift)
            np.copyto(found, merged[slot], where=keys[slot] == key)
        return found


@functools.lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    return Pieces(name)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dropped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether candidate merges of [start, middle) and [middle, end) of the units with these keys are skipped."""
    place = (start << 42 ^ middle << 21 ^ end).view(np.uint64)
    place *= np.uint64(0x9E3779B97F4A7C15)
    place ^= key
    return _mix(place) < np.uint64(min(1.0, dropout) * ((1 << 64) - 1 - (1 << 11)))


def unit_keys(salt: int, offsets: np.ndarray) -> np.ndarray:
    """A key for each unit of a text: of the text's salt and the unit's place in the text."""
    return _mix(offsets.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def agenda(model: Pieces, points: np.ndarray, key: np.uint64, dropout: float) -> list[tuple[int, int]]:
    """(piece, first character) of one unit: the best candidate is taken off the agenda again and again.

    Candidates are ordered by their piece's rank, then from left to right; one that the keyed hash picks is
    skipped, for good; one whose sides have changed meanwhile is void.
    """
    ids, n = model.of_char[points].tolist(), len(points)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive, heap = [True] * n, []
    keys = np.array([key])

    def offer(a: int) -> None:
        if a >= 0 and end[a] < n:
            b = end[a]
            made = model.pairs.get((ids[a], ids[b]))
            if made is not None and not (dropout and dropped(keys, np.array([a]), np.array([b]), np.array([end[b]]), dropout)[0]):
                heapq.heappush(heap, (int(model.rank[made]), a, b, end[b], made))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, b, stop, made = heapq.heappop(heap)
        if alive[a] and b < n and alive[b] and end[a] == b and end[b] == stop:
            ids[a], end[a], alive[b] = made, stop, False
            if stop < n:
                before[stop] = a
            offer(before[a])
            offer(a)
    return [(ids[a], a) for a in range(n) if alive[a]]


def matrix(model: Pieces, points: np.ndarray, starts: np.ndarray, keys: np.ndarray, dropout: float) -> np.ndarray:
    """The agenda of many short units at once: for each character the piece that begins there, or -1.

    A row of each matrix is a unit, with a column more than the longest has characters, so that every unit is
    followed by a cell without a piece; the places of pieces are linked and never move.
    """
    sizes = np.diff(starts)
    rows, wide = len(sizes), int(sizes.max(initial=1)) + 1
    inside = np.arange(wide) < sizes[:, None]
    ids = np.full((rows, wide), -1, dtype=np.int32)
    ids[inside] = model.of_char[points]
    ids, cells = ids.ravel(), np.arange(rows * wide)
    before, after = cells - 1, cells + 1
    made = np.full(len(cells), -1, dtype=np.int32)
    rank = np.full(len(cells), NEVER, dtype=np.int32)

    def offer(left: np.ndarray, right: np.ndarray, end: np.ndarray, row: np.ndarray) -> None:
        found = model.joined(ids[left], ids[right])  # a cell without a piece merges with nothing
        if dropout:
            some = np.flatnonzero(found >= 0)
            r = row[some]
            base = r * wide
            found[some[dropped(keys[r], left[some] - base, right[some] - base, end[some] - base, dropout)]] = -1
        made[left] = found
        rank[left] = model.rank[found]  # the last rank, of -1, is NEVER

    first = cells[inside.ravel()]
    offer(first, first + 1, first + 2, np.repeat(np.arange(rows), sizes))
    live, ranks = np.arange(rows), rank.reshape(rows, wide)
    while len(live):
        some = ranks[live]
        best = some.argmin(axis=1)
        going = np.flatnonzero(some[np.arange(len(live)), best] < NEVER)
        live = live[going]
        a = live * wide + best[going]
        b = after[a]
        c = after[b]
        ids[a], ids[b], rank[b] = made[a], -1, NEVER
        after[a], before[c] = c, a
        left = before[a]
        offer(np.concatenate((left, a)), np.concatenate((a, c)), np.concatenate((c, after[c])), np.concatenate((live, live)))
    return ids.reshape(rows, wide)[inside]


def encode_units(model: Pieces, units: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of all units in one array, and where each unit's begin (the end last)."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begun = np.full(len(points), -1, dtype=np.int32)  # the piece that begins at each character
    edges = (0, 3, 6, 9, 13, 18, 26, WIDE)
    for low, high in zip(edges, edges[1:], strict=False):
        some = np.flatnonzero((sizes > low) & (sizes <= high))
        if len(some):
            offsets = np.concatenate(([0], np.cumsum(sizes[some])))
            chars = np.repeat(starts[some] - offsets[:-1], sizes[some]) + np.arange(offsets[-1])
            begun[chars] = matrix(model, points[chars], offsets, keys[some], dropout)
    for k in np.flatnonzero(sizes > WIDE):
        for piece, at in agenda(model, points[starts[k] : starts[k + 1]], keys[k], dropout):
            begun[starts[k] + at] = piece
    place = np.flatnonzero(begun >= 0)
    piece, edge = begun[place], np.searchsorted(place, starts)
    unknown = np.flatnonzero(piece == model.other)
    if len(unknown):  # characters without a piece become the pieces of their bytes
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[place[unknown]].tolist()]
        times = np.ones(len(piece), dtype=np.int64)
        times[unknown] = [len(x) for x in raw]
        slot = np.repeat(piece == model.other, times)
        piece, edge = np.repeat(piece, times), np.concatenate(([0], np.cumsum(times)))[edge]
        piece[slot] = model.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    return piece, edge


def gathered(values: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen runs of ``values`` one after another, and where each begins (the end last)."""
    sizes = starts[chosen + 1] - starts[chosen]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return values[np.repeat(starts[chosen] - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def encode_texts(model: Pieces, texts: list[str], salts: list[int], dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in one array, and where each text's begin.

    Each unit is encoded where it stands, by its own key; without dropout equal units are encoded once.
    """
    parts = [model.units.findall(f" {text}") if text else [] for text in texts]
    counts = [len(x) for x in parts]
    units = [u for x in parts for u in x]
    bounds = np.concatenate(([0], np.cumsum(counts)))
    if dropout:
        places = np.concatenate(([0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))))
        keys = [unit_keys(salt, places[a:b] - places[a]) for salt, a, b in zip(salts, bounds, bounds[1:], strict=False)]
        ids, starts = encode_units(model, units, np.concatenate(keys) if keys else np.zeros(0, np.uint64), dropout)
        return ids, starts[bounds]
    index: dict[str, int] = {}
    chosen = np.array([index.setdefault(u, len(index)) for u in units], dtype=np.int64)
    flat, starts = encode_units(model, list(index), np.zeros(len(index), np.uint64), 0.0)
    ids, ends = gathered(flat, starts, chosen)
    return ids, ends[bounds]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """``docs`` with ``pieces``: the piece ids of each whole text, as the model's merges give them with dropout.

    With dropout 0 these are the library's own pieces. Else each candidate merge is skipped with that
    chance, decided by a hash of the seed, the document's id, the unit's (a word with its blanks) place in
    the text and the candidate's place in the unit. So each occurrence of a word draws its own merges, in
    one document too; results do not depend on how rows are dealt, a document is encoded alike each time,
    and another seed gives other pieces. Every text decodes to itself, whatever was skipped.

    Null and empty texts have no pieces; null ids have a key of their own; rows with the same id and text
    are encoded alike. Rows pass through with all columns (one named ``pieces`` is replaced). One pass, no
    shuffle; a very long text is a task's work alone.
    """
    docs = docs.drop("pieces")
    keyed = docs.withColumn("__salt", F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(vocabulary)
        for rows, raw in sliced(batches, text_col, 1 << 20):
            ids, starts = encode_texts(model, [x.decode() for x in raw], [x & (1 << 64) - 1 for x in rows.column(rows.num_columns - 1).to_pylist()], dropout)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists], names=[*rows.schema.names[:-1], "pieces"])

    return keyed.mapInArrow(run, StructType(list(docs.schema.fields)).add("pieces", ArrayType(IntegerType())))


def decode_ids(model: Pieces, ids: np.ndarray, starts: np.ndarray) -> list[str]:
    """The texts of runs of piece ids; the blank that encoding puts before a text is taken off."""
    raw, ends = gathered(model.raw, model.raw_starts, ids)
    whole, at = raw.tobytes(), ends[starts].tolist()
    return [whole[a + (whole[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def decoded(docs: DataFrame, pieces_col: str = "pieces", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` with ``decoded``: the text of the piece ids (null: empty); control pieces stand for nothing, bytes that are no UTF-8 become U+FFFD."""
    docs = docs.drop("decoded")
    place = docs.columns.index(pieces_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                lists = rows.column(place).fill_null([]) if rows.column(place).null_count else rows.column(place)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(decode_ids(model, ids, starts), pa.string())], names=[*rows.schema.names, "decoded"])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("decoded", StringType()))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Each document's pieces, their number, and whether they decode to its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decoded(encoded(docs))
    return found.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"), "pieces")
