"""Exact n-gram Jaccard join in metric space: pivots, Voronoi regions, replicated boundaries, recursion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import components, dropped, release, saved, sliced

#: Mixed regions are measured against one of their documents so often before their pairs are.
OFTEN = 2
#: No longer read (there is no table of frequent shingles any more); a test still sets it.
SLOTS = 1 << 22
#: Regions of more documents are split by so many pivots, at most so often.
REGION, PIVOTS, DEPTH = 48, 4, 3
#: Of the first-level regions of a document so many are taken along, to see where a pair meets first.
HEAD = 16
#: Longs of the folded parities that travel with each row of a region.
FOLDED = 4
#: Words that a worker keeps the hashes of, and the most bits of the filter of wanted texts.
WORDS, FILTER_BITS = 1 << 18, 1 << 29
#: Sets with so many members together (8 MB) are sent to every task.
SENT = 1 << 20


class WordHashes(dict):
    """The 64-bit hash of each word, kept for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: bytes, width: int, words: WordHashes) -> np.ndarray:
    """The distinct ``width``-word shingles (ASCII lower-cased) of a text as sorted hashes, chained from those of the words.

    A shorter text is one shingle, a word-less one has none.
    """
    found = text.lower().split()
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(width, len(found))
    count = len(found) - width + 1 if width else 0
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = (out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def least_overlap(size: int, percent: int) -> int:
    """How many of ``size`` members a set must share with another of at least ``percent`` Jaccard similarity."""
    return -(-percent * size // 100)


def most_apart(size: int, other: int, percent: int) -> int:
    """The largest symmetric difference that two linked sets of these sizes can have."""
    return (100 - percent) * (size + other) // (100 + percent)


def class_count(level: int, percent: int) -> int:
    """How many hash classes sets of 2^level to 2^(level + 1) - 1 members are parted into: more than can differ, with a margin."""
    top = (2 << level) - 1
    most = most_apart(top, top * 100 // percent, percent)
    return most + 1 + max(6, most // 8)


def class_pivots(members: np.ndarray, level: int, percent: int, wanted: int) -> np.ndarray:
    """The ``wanted`` nearest of a set's class pivots (what it holds of each hash class), as hashes.

    The largest are nearest; of equal ones the smaller hash comes first, so the order is the same for all sets.
    """
    count = class_count(level, percent)
    classes = ((members >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)  # in order, as the members are
    ends = np.searchsorted(classes, np.arange(count + 1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(members)))
    sums = sums[ends[1:]] - sums[ends[:-1]]
    sums ^= sums >> np.uint64(29)
    found = sums * np.uint64(0xBF58476D1CE4E5B9) + (np.arange(count, dtype=np.uint64) + np.uint64(level << 40)) * np.uint64(0x9E3779B97F4A7C15)
    found ^= found >> np.uint64(32)
    return found[np.lexsort((found, ends[:-1] - ends[1:]))[:wanted]]


def first_pivots(members: np.ndarray, percent: int) -> np.ndarray:
    """The first-level regions of a set: any two linked sets share one.

    Sets of one level (sizes 2^k to 2^(k+1) - 1) are parted into the same classes, more of them than linked
    sets can differ in by members, so at most d = :func:`most_apart` of a set's class pivots are not the
    other's; among the d + 1 first of each, in a common order, one is in both. A set that can be linked to
    one of the level below takes its pivots there too. Empty classes come last and count as pivots.
    """
    size = len(members)
    if not size:
        return members
    level = size.bit_length() - 1
    out = class_pivots(members, level, percent, most_apart(size, size * 100 // percent, percent) + 1)
    low = (1 << level) - 1
    if least_overlap(size, percent) <= low:
        out = np.concatenate((out, class_pivots(members, level - 1, percent, most_apart(size, low, percent) + 1)))
    return out


def parities(members: np.ndarray) -> np.ndarray:
    """Whether the members in each of 2^k >= their number of hash classes are odd in number, packed in longs.

    Each class in which two sets differ holds a member of their symmetric difference. Half as many classes
    are the exclusive or of both halves.
    """
    count = max(64, 1 << (len(members) - 1).bit_length()) if len(members) else 64
    odd = np.bincount((members >> np.uint64(24)).astype(np.int64) & (count - 1), minlength=count) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _apart(a: str, b: str) -> F.Column:
    """A lower bound of the symmetric difference of two sets whose sizes differ by less than half, from their parities."""
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    fitted = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(F.col(x))
    return F.aggregate(F.zip_with(fitted(a, b), fitted(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0)))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def _marked(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``id, text_hash, node, n, keys, bits``: a row's set of shingles as a hash, its size, its first pivots, its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for some, texts in sliced(batches, "text", 1 << 19):
            nodes, sizes, keys, bits = [], [], [], []
            for text in texts:
                members = shingle_set(text, width, words)
                nodes.append(xxhash.xxh64_intdigest(members.tobytes()))
                sizes.append(len(members))
                keys.append(first_pivots(members, percent).view(np.int64))
                bits.append(parities(members))
            columns = [some.column(0), some.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), _lists(keys), _lists(bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "node", "n", "keys", "bits"])

    return rows.select("id", "text_hash", "text").mapInArrow(run, "id long, text_hash long, node long, n long, keys array<long>, bits array<long>")


def _folded() -> list[F.Column]:
    """The parities of at most ``FOLDED`` x 64 hash classes: longs of ``bits`` that lie so far apart, exclusive or."""
    place = lambda k: F.filter("bits", lambda x, i: i % FOLDED == k)
    return [F.aggregate(place(k), F.lit(0).cast("long"), lambda p, q: p.bitwiseXOR(q)).alias(f"b{k}") for k in range(FOLDED)]


def _seen(hashes: DataFrame) -> tuple[int, np.ndarray]:
    """A filter of the longs in column ``h``: as many bits as there is need for, up to a fixed most; it may pass others."""
    bits = 1 << 10
    while bits < min(FILTER_BITS, 8 * hashes.count()):
        bits *= 2
    place = F.pmod("h", F.lit(bits))
    words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) % 64 as int))")).alias("set")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return bits, out.view(np.uint64)


def _sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, members``: the whole sets of the wanted nodes ``node, id, text_hash``, from one text each.

    A filter of bounded size keeps most unwanted texts from being shuffled; the join decides.
    """
    bits, known = _seen(wanted.select(F.col("text_hash").alias("h")))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("text_hash").to_numpy() % bits
            yield batch.filter(pa.array((known[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for some, texts in sliced(batches, "text", 1 << 20):
            sets = [shingle_set(x, width, words).view(np.int64) for x in texts]
            yield pa.RecordBatch.from_arrays([some.column(0), _lists(sets)], names=["node", "members"])

    place = [F.coalesce("id", F.lit(-1)).alias("place"), "text_hash"]
    texts = rows.select(*place, "text").mapInArrow(passed, "place long, text_hash long, text string").join(wanted.select(*place, "node"), ["place", "text_hash"])
    return texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node long, members array<long>")


class Texts:
    """The texts ``id, text_hash, text`` and where each node's text is found, from which pairs are measured."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.rows, self.nodes, self.width, self.percent = rows, nodes, width, percent

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs of nodes that their parities leave possible: what differs must be few enough."""
        ends = [self.nodes.select(F.col("node").alias(x), F.col("n").alias(n), F.col("bits").alias(b)) for x, n, b in (("u", "n", "bits"), ("v", "n_t", "bits_t"))]
        both = pairs.select("u", "v").distinct().join(ends[1], "v").join(ends[0], "u")
        return both.where((F.least("n", "n_t") * 100 >= F.greatest("n", "n_t") * self.percent) & _alike_bits(self.percent)).select("u", "v")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are linked."""
        return _linked(self.distances(self.near(pairs)), self.percent)

    def distances(self, pairs: DataFrame) -> DataFrame:
        """``u, v, shared, joined``: the sizes of the intersection and the union of each distinct pair of nodes."""
        pairs = saved(pairs.select("u", "v").distinct())
        wanted = saved(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(self.nodes, "node").select("node", "id", "text_hash"))
        sets = saved(_sets(self.rows, wanted, self.width))
        ends = [sets.select(F.col("node").alias(x), F.col("members").alias(f"s{x}")) for x in ("u", "v")]
        right = ends[1].join(pairs.select("v").distinct(), "v", "left_semi")
        # A few sets that many are measured against, as pivots are, go to every task; more are joined by a shuffle.
        if (right.agg(F.sum(F.size("sv").cast("long"))).first()[0] or 0) <= SENT:
            right = F.broadcast(right)
        shared = F.size(F.array_intersect("su", "sv"))
        met = pairs.join(ends[0], "u").join(right, "v").select("u", "v", shared.alias("shared"), (F.size("su") + F.size("sv") - shared).alias("joined"))
        out = saved(met)
        dropped(pairs, wanted, sets)
        release(pairs.sparkSession)
        return out


def _linked(far: DataFrame, percent: int) -> DataFrame:
    return far.where(F.col("shared").cast("long") * 100 >= F.col("joined").cast("long") * percent).select("u", "v")


def _labelled(regions: DataFrame, stars: DataFrame) -> DataFrame:
    """Regions with each document's component so far, without those that lie in one component as a whole."""
    named = regions.join(stars.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("region").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("size")).where("a <> b")
    return named.join(mixed.select("region", "size"), "region")


def _possible(percent: int) -> F.Column:
    """Whether two members of a region may be linked, by their sizes and folded parities (a lower bound of what differs)."""
    sizes = F.least("n", "n_t") * 100 >= F.greatest("n", "n_t") * percent
    most = F.floor((F.col("n") + F.col("n_t")) * F.lit((100 - percent) / (100 + percent)) + 1e-9)
    apart = sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"b{k}_t"))) for k in range(FOLDED)), F.lit(0))
    return sizes & (apart <= most)


def _alike_bits(percent: int) -> F.Column:
    """Whether the parities of two sets leave few enough members in which they can differ."""
    return _apart("bits", "bits_t") <= F.floor((F.col("n") + F.col("n_t")) * F.lit((100 - percent) / (100 + percent)) + 1e-9)


_CARRIED = ["node", "n", *(f"b{k}" for k in range(FOLDED))]


def _led(regions: DataFrame, turn: int, percent: int) -> DataFrame:
    """The pairs ``u, v`` of a region's first document (in the order of a hash) and the others that may be linked to it."""
    lead = regions.groupBy("region").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), *_CARRIED)).alias("lead"))
    lead = lead.select("region", *(F.col(f"lead.{x}").alias(f"{x}_t") for x in _CARRIED))
    met = regions.join(lead, "region").where((F.col("node") != F.col("node_t")) & _possible(percent))
    return met.select(F.col("node").alias("u"), F.col("node_t").alias("v")).distinct()


def _pairs(regions: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` of different components that share a region, one of them at home in it, and may be linked.

    A pair that shares several first-level regions is taken in the first of them, as far as both heads tell.
    """
    right = regions.select("region", *(F.col(x).alias(f"{x}_t") for x in (*_CARRIED, "label", "home", "far", "head")))
    allowed = (F.col("node") > F.col("node_t")) & (F.col("label") != F.col("label_t")) & (F.col("home") | F.col("home_t")) & _possible(percent)
    # |d(x, q) - d(y, q)| <= d(x, y) for every pivot q of the region.
    pivots = F.forall(F.arrays_zip("far", "far_t"), lambda z: F.abs(z["far"] - z["far_t"]) <= 1 - percent / 100 + 1e-9)
    first = F.coalesce(F.get(F.array_intersect("head", "head_t"), F.lit(0)) >= F.col("key"), F.lit(True))
    met = regions.hint("merge").join(right, "region").where(allowed & pivots & first)
    return met.select(F.col("node").alias("u"), F.col("node_t").alias("v")).distinct()


def _split(regions: DataFrame, texts: Texts, depth: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The Voronoi regions of pivots inside each region, the regions that these do not divide, and the links to pivots.

    A document lies at home in the region of its nearest pivot and is a guest in every region whose
    pivot is within d(home) + 2t: if d(x, y) <= t, and q is the home pivot of x, then
    d(y, q) <= d(x, q) + t <= d(x, q') + t <= d(y, q') + 2t for the home pivot q' of y.
    A region that guests would more than double stays as it is; the distances to its pivots rule out pairs there.
    """
    # Pivots by hash order, a minimum each: pre-aggregated, however large a region is.
    draws = [F.min(F.struct(F.xxhash64(F.lit(depth), F.lit(k), "node").alias("h"), "node"))["node"] for k in range(PIVOTS)]
    pivots = regions.groupBy("region").agg(F.array_distinct(F.array(*draws)).alias("qs"))
    asked = saved(regions.drop("far").join(pivots, "region"))
    each = [asked.select(F.col("node").alias("u"), F.get("qs", F.lit(k)).alias("v")) for k in range(PIVOTS)]
    wanted = each[0]
    for more in each[1:]:
        wanted = wanted.union(more)
    far = texts.distances(wanted.where("u <> v"))
    # A row a document: its distances to the pivots of its regions, which share a few.
    known = far.groupBy(F.col("u").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("v", 1 - F.col("shared") / F.col("joined")))).alias("known"))
    to = F.transform("qs", lambda q: F.struct(F.when(q == F.col("node"), 0.0).otherwise(F.element_at("known", q)).alias("d"), q.alias("q")))
    seen = asked.join(known, "node", "left").withColumn("all", to).withColumn("own", F.array_min("all"))
    near = F.filter("all", lambda x: x["d"] <= F.col("own.d") + F.lit(2 * (1 - percent / 100) + 1e-9))
    placed = saved(seen.withColumn("near", near).withColumn("far", F.transform("all", lambda x: x["d"])).drop("qs", "known", "all"))
    parted = placed.groupBy("region").agg((F.sum(F.size("near")) <= 2 * F.count("*")).alias("parted"))
    marked = placed.join(parted, "region")
    spread = marked.where("parted").withColumn("at", F.explode("near"))
    parts = saved(spread.select(F.xxhash64("region", "at.q").alias("region"), "key", *_CARRIED, "head", F.col("size").alias("before"), (F.col("at.q") == F.col("own.q")).alias("home"), "far"))
    whole = saved(marked.where("not parted").select("region", "key", *_CARRIED, "head", "label", "home", "far"))
    links = saved(_linked(far, percent))
    dropped(asked, far, placed)
    return parts, whole, links


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """Rows ``id, n, component``: the size of each document's set of shingles, and the smallest id that links reach.

    Two documents are linked where 100 * |intersection| >= ``percent`` * |union| of their sets of distinct
    ``width``-word shingles (ASCII lower-cased, 64-bit hashes), that is, where their Jaccard distance, a
    metric, is at most t = 1 - percent/100. Equal sets are one node from the start.

    First pivots are small sets: what a document holds of each of some hash classes. Their number follows the
    document's size, so that linked documents differ in fewer classes than there are. A document of n
    shingles is at distance 1 - k/n from a pivot of k of its shingles; it is replicated to its nearest ones, so
    many that two documents within t share one (:func:`first_pivots`). In each region all documents are
    measured against one document, in two turns; what is linked is one component, and regions within
    one component are done. Larger regions are divided by four pivots of their own, with homes, guests within
    the triangle inequality's window, and recursion (:func:`_split`); in regions of 48 documents or less, in
    those that pivots do not divide, or after three levels, pairs of different components that sizes,
    distances to the pivots and the parities of their hash classes leave possible are measured. Every
    distance is taken on whole sets. All regions stay in written tables, pre-aggregated before they are
    shuffled; no region is gathered in a task.

    Null and word-less texts have no shingles and no links. A null id keeps its row; its component is the
    smallest non-null id reached, null if none. Repeated ids and rows are kept; other columns are ignored;
    an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    full = saved(_marked(rows, width, percent))
    one = full.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("id", "text_hash", "n", "keys", "bits")).alias("from"))
    nodes = saved(one.select("node", "least", "from.*"))
    marked = saved(full.select("id", "node", "n"))
    dropped(full)
    release(docs.sparkSession)
    # What is shuffled as a whole is narrow: first the regions alone, to find those that two nodes share.
    spread = nodes.select("node", F.explode("keys").alias("region"))
    shared = spread.groupBy("region").agg(F.count("*").alias("size")).where("size > 1").select("region")
    met = saved(spread.join(shared, "region").select("region", "node"))
    release(docs.sparkSession)
    regions = saved(met.join(nodes.select("node", "n", *_folded()), "node").select("region", *_CARRIED))
    dropped(met)
    texts = Texts(rows, nodes, width, percent)
    now = regions
    links = texts.links(_led(now, 0, percent))
    stars = components(links)
    for turn in range(1, OFTEN):
        now = _labelled(regions, stars)
        links = saved(links.union(texts.links(_led(now, turn, percent))))
        stars = components(links)
    now = saved(_labelled(regions, stars))
    heads = now.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("region")), 1, HEAD).alias("head"))
    started = now.join(heads, "node").withColumns({"key": F.col("region"), "home": F.lit(True), "far": F.array().cast("array<double>")})
    open_regions, depth = saved(started), 0
    dropped(regions, now)
    release(docs.sparkSession)
    while not open_regions.isEmpty():
        large = F.col("size") > REGION
        if depth:  # a region that its pivots did not divide is not divided again
            large = large & (F.col("size") < 0.8 * F.col("before"))
        few = open_regions if depth == DEPTH else open_regions.where(~large)
        links = links.union(texts.links(_pairs(few, percent)))
        rest = open_regions.where(large) if depth < DEPTH else open_regions.limit(0)
        if rest.isEmpty():
            break
        parts, whole, more = _split(rest.drop("before") if depth else rest, texts, depth, percent)
        links = saved(links.union(more).union(texts.links(_pairs(whole, percent))))
        stars = components(links)
        former, open_regions = open_regions, saved(_labelled(parts, stars))
        dropped(former, parts, whole)
        depth += 1
    whole = components(links)
    rooted = nodes.join(whole, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_node = saved(rooted.join(ids, "root").select("node", "component"))
    dropped(open_regions, nodes)
    found = marked.join(of_node, "node", "left")
    return found.select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def op13_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Each document's number of 4-word shingles and its component of links of 85 % or more, as :func:`jaccard_groups` gives them."""
    found = jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
