"""SimHash near-duplicate groups by multi-index hashing."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import components, dropped, release, saved, sliced

BITS = 64


def _line(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words (ASCII lower-cased) with single blanks between, and where each begins and ends."""
    words = text.lower().split()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.concatenate(([0], ends[:-1] + 1)), ends


def shingles(text: bytes, width: int = 4, seed: int = 42) -> np.ndarray:
    """The hashes of the ``width``-word shingles of one text, in order; a shorter text is one shingle, a word-less one has none."""
    line, starts, ends = _line(text)
    if not line:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(starts) <= width:
        return np.array([digest(line, seed)], np.uint64)
    some = zip(starts[: len(starts) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], seed) for a, b in some), np.uint64, len(starts) - width + 1)


#: Each 16-bit field of a sum counts one bit of at most so many hashes.
FIELD, MOST = np.uint64(0x0001000100010001), 65535


def majority(hashes: np.ndarray, sizes: np.ndarray, most: int = MOST) -> np.ndarray:
    """For each run of ``sizes`` hashes the bits that are set in over half of them; 0 for an empty run."""
    ends = np.cumsum(sizes)
    pieces = -(-sizes // most)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    begins = (ends - sizes)[owner] + most * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    out = np.zeros(len(sizes), np.uint64)
    if not len(owner):
        return out
    for shift in range(16):
        sums = np.add.reduceat(hashes >> np.uint64(shift) & FIELD, begins)
        for field in range(4):
            ones = np.bincount(owner, (sums >> np.uint64(16 * field) & np.uint64(0xFFFF)).astype(np.float64), minlength=len(sizes))
            out |= (2 * ones > sizes).astype(np.uint64) << np.uint64(16 * field + shift)
    return out


def fingerprint(text: bytes, width: int = 4, seed: int = 42, block: int = MOST) -> int:
    """The 64-bit SimHash of the ``width``-word shingles (repeats included) of one text, as unsigned."""
    hashes = shingles(text, width, seed)
    return int(majority(hashes, np.array([len(hashes)]), block)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``id, fp, text_hash`` of every row: a signed long holding the 64 bits (0 for null and word-less texts), and a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sliced(batches, "text", 1 << 20):
            every = [shingles(x, width) for x in texts]
            found = majority(np.concatenate(every), np.array([len(x) for x in every]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found.view(np.int64)), rows.column(2)], names=["id", "fp", "text_hash"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    return rows.mapInArrow(run, "id long, fp long, text_hash long")


def segments(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``count`` segments that cover 64 bits."""
    edges = [round(BITS * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _places(lanes: list[str], parts: int) -> list[tuple[Column, int, int]]:
    """(value, width, number) of each segment of a fingerprint that is held in these columns of 64 bits."""
    cut = [(lane, first, width) for lane in lanes for first, width in segments(parts)]
    mask = lambda width: F.lit((1 << width) - 1 if width < BITS else -1).cast("long")
    return [(F.shiftrightunsigned(lane, first).bitwiseAND(mask(width)), width, k) for k, (lane, first, width) in enumerate(cut)]


def _ball(value: Column, width: int, radius: int) -> list[Column]:
    """All values within ``radius`` differing bits of ``value``; 0, 1 or 2."""
    flips = [0] if radius >= 0 else []
    flips += [1 << i for i in range(width)] if radius >= 1 else []
    flips += [1 << i | 1 << j for i in range(width) for j in range(i)] if radius >= 2 else []
    return [value.bitwiseXOR(F.lit(x).cast("long")) for x in flips]


def _keys(prints: DataFrame, places: list[tuple[Column, int, int]], radii: list[int], kept: list[str]) -> DataFrame:
    """A row ``key, kept..`` for each value in the ball of each segment; the key holds the segment's number and the value."""
    balls = [x + F.lit(k << 48) if width <= 48 else F.xxhash64(F.lit(k), x) for value, width, k in places for x in _ball(value, width, radii[k])]
    return prints.select(*kept, F.explode(F.array(*balls)).alias("key")).select("key", *kept)


def _apart(lanes: list[str]) -> Column:
    """How many bits of two fingerprints differ."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_t"))) for x in lanes), start=F.lit(0))


def near_links(prints: DataFrame, distance: int = 4, parts: int = 3, label: str | None = None, node: str = "fp", lanes: tuple[str, ...] = ("fp",), radius: int | None = None, more: tuple[str, ...] = (), also: Column | None = None, kept: tuple[str, ...] = (), turns: int = 1) -> DataFrame:
    """Links ``u, v`` (u > v) between distinct nodes whose fingerprints are at most ``distance`` bits apart.

    A fingerprint is held in the columns ``lanes`` of 64 bits, each cut in ``parts`` segments. Multi-index
    hashing: with distance = a*segments + b, two such fingerprints are within a bits in one of the first b+1
    segments or within a-1 bits in one of the others, so probing the Hamming balls of these radii in the
    segments' tables meets every link; the complete distance is verified inside the join. A given
    ``radius`` is probed in all segments instead (it may then miss links that are spread evenly), and the
    segments of the ``more`` lanes are probed to radius 0. ``also`` is a further condition on the ``kept``
    columns (those of the table's side end in ``_t``). The segments are searched in so many ``turns``, each written before the
    next begins, so that only a share of the probes lies on disk at a time.

    With ``label``, links between nodes of one label are left out, each other pair is met once, by the
    probes of the smaller label, and the largest label sends none: a large group that has one label already
    costs no more than the probes of the others that meet it.
    """
    lanes = list(lanes)
    first, second = _places(lanes, parts), _places([*lanes, *more], parts)
    whole, extra = divmod(distance, len(first))
    radii = [radius if radius is not None else whole if k <= extra else whole - 1 for k in range(len(first))] + [0] * (len(second) - len(first))
    if max(radii) > 2:
        raise ValueError("distance is too large for this number of segments")
    carried = list(dict.fromkeys([node, *lanes, *kept]))
    asked, order = prints, F.col(node) > F.col(f"{node}_t")
    if label:
        sizes = saved(prints.groupBy(label).agg(F.count("*").alias("__size")))
        largest = sizes.agg(F.max(F.struct("__size", label)).alias("x")).select("x.*").first()
        prints = prints.join(sizes, label)
        if turns > 1:  # read twice a turn
            prints = saved(prints)
        asked = prints.where(F.col(label) != largest[1]) if largest[1] is not None else prints
        carried += ["__size", label]
        order = F.struct("__size", label) < F.struct(F.col("__size_t").alias("__size"), F.col(f"{label}_t").alias(label))
    found = []
    for turn in range(turns):
        some = second[turn::turns]
        entries = _keys(prints, some, [0] * len(second), carried).select("key", *(F.col(x).alias(f"{x}_t") for x in carried))
        met = _keys(asked, some, radii, carried).join(entries.hint("merge"), "key").where(order & (_apart(lanes) <= distance))
        if also is not None:
            met = met.where(also)
        found.append(met.select(F.greatest(node, f"{node}_t").alias("u"), F.least(node, f"{node}_t").alias("v")).distinct())
        if turns > 1:
            found[turn] = saved(found[turn])
            release(prints.sparkSession)
    return functools.reduce(DataFrame.union, found).distinct() if turns > 1 else found[0]


def _leaders(prints: DataFrame, distance: int, parts: int, node: str = "fp", lanes: tuple[str, ...] = ("fp",), more: tuple[str, ...] = (), also: Column | None = None, kept: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """For each node, links to one node (the seed decides which) of each of its segment buckets, where near enough: a few rows each."""
    places = _places([*lanes, *more], parts)
    carried = list(dict.fromkeys([node, *lanes, *kept]))
    spread = _keys(prints, places, [0] * len(places), carried)
    turn = F.xxhash64(F.lit(seed), node, "key") if seed else F.col(node)
    first = spread.groupBy("key").agg(F.min_by(F.struct(*carried), turn).alias("lead"), F.count("*").alias("n")).where("n > 1")
    first = first.select("key", *(F.col(f"lead.{x}").alias(f"{x}_t") for x in carried))
    near = spread.join(first, "key").where((F.col(node) != F.col(f"{node}_t")) & (_apart(list(lanes)) <= distance))
    if also is not None:
        near = near.where(also)
    return near.select(F.col(node).alias("u"), F.col(f"{node}_t").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, parts: int = 3) -> DataFrame:
    """Rows ``id, fp, text_hash, component``: each row's SimHash and the smallest id that links of at most ``distance`` bits reach.

    Exact copies of a fingerprint are one node from the start. Nodes are first joined to the leaders of
    their segment buckets (linear in the nodes), and the full search then returns only links between
    nodes that are not yet in one group, so that a large group of near copies never becomes all its
    pairs. ``parts`` trades probes for bucket size; every value gives the same groups (2 suits more than
    about 2^30 distinct fingerprints).

    Null text counts as empty: fingerprint 0, linked like any other. A null id keeps its row; its
    component is the smallest non-null id reached, null if there is none. Repeated ids and rows are
    kept; extra columns are ignored; an empty table gives an empty table.
    """
    marked = saved(fingerprints(docs, id_col, text_col, width))
    prints = marked.groupBy("fp").agg(F.min("id").alias("least"))
    prints = saved(prints)
    stars = components(_leaders(prints, distance, parts))
    named = prints.select("fp").join(stars, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("label"))
    named = saved(named)
    links = saved(near_links(named, distance, parts, label="label"))
    more = links.union(stars.select(F.col("node").alias("u"), F.col("root").alias("v")))
    whole = components(more)
    rooted = prints.join(whole, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_print = saved(rooted.join(ids, "root").select("fp", "component"))
    return marked.join(of_print, "fp").select("id", "fp", "text_hash", "component")


#: Fingerprints for whole-set similarity: lanes of 64 bits, each in three segments. The segments of the first two lanes are
#: probed to radius 1, those of the others to radius 0; the bits of the first two are compared. All pairs are met in so many turns.
LANES, COMPARED, SEGMENTS, TURNS = 10, 2, 3, 3
#: Longs that hold, for each of 64 hash classes a long, whether a set has an odd number of members in it.
PARITIES = 2
#: Rounds in which nodes are compared with one node of each of their buckets, before all pairs of different groups are met.
ROUNDS = 1
SALTS = np.random.default_rng(11).integers(0, 1 << 63, LANES, dtype=np.uint64)


def _laned(hashes: np.ndarray) -> list[np.ndarray]:
    """Independent hashes made of one, a lane each."""
    out = []
    for salt in SALTS:
        x = (hashes ^ salt) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return out


def allowance(similarity: float) -> int:
    """Differing bits of the compared 128 that two sets of this Jaccard similarity are all but sure (four deviations) not to exceed."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    bits = BITS * COMPARED
    return min(bits, math.ceil(bits * share + 4 * math.sqrt(bits * share * (1 - share))))


_LANES, _ODD = tuple(f"f{k}" for k in range(LANES)), tuple(f"p{k}" for k in range(PARITIES))


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set of hashes, the parities of its members in each hash class, as ``PARITIES`` longs.

    Each class in which two sets differ holds a member that only one of them has, so as many members at
    least differ: unlike a comparison of fingerprints this never rules a pair out by chance.
    """
    classes = BITS * PARITIES
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    place = owner * classes + (np.concatenate(sets) >> np.uint64(24)).astype(np.int64) % classes
    odd = np.bincount(place, minlength=len(sets) * classes) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64).reshape(-1, PARITIES)


def _few_odd(similarity: float) -> Column:
    """Whether the parities of two sets leave this Jaccard similarity possible."""
    return _apart(list(_ODD)) <= F.floor((F.col("n") + F.col("n_t")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-9)


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """``id, text_hash, node, n, f0.., p0..``: a row's set of shingles as a hash, its size, its fingerprint and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, texts in sliced(batches, "text", 1 << 19):
            sets = [np.unique(shingles(x, width)) for x in texts]
            sizes = np.array([len(x) for x in sets])
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64)
            columns = [node, *(majority(x, sizes) for x in _laned(np.concatenate(sets)))]
            arrays = [pa.array(x.view(np.int64)) for x in columns] + [pa.array(np.ascontiguousarray(x)) for x in parities(sets).T]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), arrays[0], pa.array(sizes), *arrays[1:]], names=["id", "text_hash", "node", "n", *_LANES, *_ODD])

    lanes = "".join(f", {x} long" for x in (*_LANES, *_ODD))
    return rows.select("id", "text_hash", "text").mapInArrow(run, f"id long, text_hash long, node long, n long{lanes}")


def _sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` of the wanted nodes ``node, text_hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, texts in sliced(batches, "text", 1 << 20):
            sets = [np.unique(shingles(x, width)).view(np.int64) for x in texts]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["node", "shingles"])

    once = rows.join(wanted, "text_hash").groupBy("node").agg(F.first("text").alias("text"))
    return once.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of the pairs ``u, v``, those whose whole shingle sets are alike enough."""
    pairs = saved(pairs)
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = saved(_sets(rows, nodes.join(ends, "node").select("node", "text_hash"), width))
    u, v = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in ("u", "v"))
    both = F.size(F.array_intersect("su", "sv"))
    found = saved(pairs.join(v, "v").join(u, "u").where(both / (F.size("su") + F.size("sv") - both) >= similarity).select("u", "v"))
    dropped(pairs, sets)
    return found


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows ``id, text_hash, component, root``: the smallest id that links of at least ``similarity`` reach, and the group's own number.

    Two texts are linked where the Jaccard similarity of their ``width``-word shingle sets (ASCII
    lower-cased words, 64-bit hashes) is ``similarity`` or more. Texts with equal sets are one node from
    the start. Candidates come from multi-index hashing of SimHash fingerprints of the sets: six segments of
    21 bits are probed to radius 1 and 24 more to radius 0, the distance of 128 bits is checked against
    :func:`allowance`, and whole sets decide. A pair of similarity 0.8 is met with a chance of about 0.83,
    one of 0.85 with 0.94, of 0.9 with 0.99 (and more often through a third text). Nodes are first compared
    with one node of each of their buckets; the full search then meets only nodes that are not yet in one
    group, and of these only pairs that the parities of 128 hash classes leave possible. Of a large group of
    near copies that are not linked that leaves few pairs, as long as sets have fewer than about 300
    members; of longer texts the compared bits alone decide what is verified.

    Null text counts as empty; word-less texts are one group. A null id keeps its row; its component is
    the smallest non-null id reached, null if there is none. Repeated ids and rows are kept; other columns
    are ignored; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), text.alias("text"))
    marked = saved(_sketches(rows, width))
    nodes = marked.groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("text_hash", "n", *_LANES, *_ODD)).alias("x")).select("node", "least", "x.*")
    nodes = saved(nodes)
    searched, bits = nodes.where("n > 0"), allowance(similarity)
    alike = F.least("n", "n_t") >= F.greatest("n", "n_t") * F.lit(similarity - 1e-9)
    how = {"node": "node", "lanes": _LANES[:COMPARED], "more": _LANES[COMPARED:]}
    met = functools.reduce(DataFrame.union, [_leaders(searched, bits, SEGMENTS, also=alike, kept=("n",), seed=k, **how) for k in range(ROUNDS)])
    stars = components(_verified(met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows, nodes, width, similarity))
    named = saved(searched.join(stars, "node", "left").select("node", "n", *_LANES, *_ODD, F.coalesce("root", "node").alias("label")))
    release(docs.sparkSession)
    links = _verified(near_links(named, bits, SEGMENTS, label="label", radius=1, also=alike & _few_odd(similarity), kept=("n", *_ODD), turns=TURNS, **how), rows, nodes, width, similarity)
    whole = components(links.union(stars.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    rooted = nodes.select("node", "least").join(whole, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_node = saved(rooted.join(ids, "root").select("node", "component", "root"))
    dropped(nodes, named, links)
    release(docs.sparkSession)
    return marked.join(of_node, "node").select("id", "text_hash", "component", "root")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and group, as :func:`near_duplicates` gives them; every row of the table, null texts as empty."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
