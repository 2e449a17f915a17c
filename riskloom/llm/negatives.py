"""Exact hard-negative mining: product quantisation with stored residual norms filters, whole numbers decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import dropped, saved, settings
from riskloom.llm.topk import _matrix, _packed, _weights

#: Subspaces, codes of each, the most rows that codebooks are fitted on, and the rounds of that.
SUBSPACES, CODES, SAMPLE, FIT_ROUNDS = 8, 64, 8192, 6
#: Rows of a stored chunk, anchors of a group, groups that one task meets with one chunk, pairs scored at once.
CHUNK, GROUP, SLOT, PAIRS = 8192, 256, 64, 1 << 16
#: Components are cut at this size, so that a hundred times a score of thousands of them fits a long.
LARGEST = 1 << 24
BLOB_SCHEMA = "block long, some array<int>, ids binary, labels binary, weights binary, codes binary, rests binary, windows binary"


def mined_rows(vectors: DataFrame, label: str, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, label, w``: rows with an id, a label (by the SQL expression ``label``) and only finite components, as floor(scale * x).

    Of rows that share an id the one with the smallest label, then components, counts.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.expr(label).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    limit = F.lit(float(LARGEST))
    ints = F.transform("x", lambda c: F.floor(F.greatest(-limit, F.least(limit, c * scale))).cast("int"))
    rows = given.where("id is not null and label is not null and x is not null").where(finite).select("id", F.struct("label", ints.alias("w")).alias("row"))
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")


class Codebooks:
    """Centres of each subspace: ``centres[j]`` holds the codes' vectors over the components ``edges[j]:edges[j + 1]``."""

    def __init__(self, sample: np.ndarray):
        self.width = sample.shape[1]
        self.edges = np.linspace(0, self.width, min(SUBSPACES, max(1, self.width)) + 1).astype(int)
        self.centres = []
        for part in self.parts(sample.astype(float)):
            centres = np.unique(part, axis=0)
            centres = centres[np.linspace(0, len(centres) - 1, min(CODES, len(centres))).astype(int)]
            for _ in range(FIT_ROUNDS):
                codes = self._nearest(part, centres)
                sizes = np.bincount(codes, minlength=len(centres))
                sums = np.stack([np.bincount(codes, x, minlength=len(centres)) for x in part.T], axis=1) if part.shape[1] else centres
                centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
            self.centres.append(centres)

    def parts(self, rows: np.ndarray) -> list[np.ndarray]:
        return [rows[:, a:b] for a, b in zip(self.edges, self.edges[1:], strict=False)]

    @staticmethod
    def _nearest(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres * centres).sum(axis=1) - 2 * part @ centres.T, axis=1)

    def fitted(self, weights: np.ndarray) -> np.ndarray:
        """Rows with as many components as the codebooks; the part beyond is left to the residual."""
        grown = np.pad(weights, ((0, 0), (0, max(0, self.width - weights.shape[1]))))
        return grown[:, : self.width].astype(float)

    def encoded(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes (rows x subspaces) and the norms of what they leave, a last one for components beyond the codebooks."""
        codes, rests = [], []
        for part, centres in zip(self.parts(self.fitted(weights)), self.centres, strict=True):
            codes.append(self._nearest(part, centres))
            rests.append(np.sqrt(((part - centres[codes[-1]]) ** 2).sum(axis=1)))
        beyond = weights[:, self.width :].astype(float)
        rests.append(np.sqrt((beyond**2).sum(axis=1)))
        return np.stack(codes, axis=1).astype(np.uint8), np.stack(rests, axis=1)

    def estimates(self, anchors: np.ndarray, codes: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sure lower and upper bounds of the scores (anchors x rows): lookup-table sums plus or minus the residual bound."""
        parts = self.parts(self.fitted(anchors))
        beyond = anchors[:, self.width :].astype(float)
        lengths = np.stack([np.sqrt((x**2).sum(axis=1)) for x in [*parts, beyond]], axis=1)
        sums = np.zeros((len(anchors), len(codes)))
        for j, (part, centres) in enumerate(zip(parts, self.centres, strict=True)):
            sums += np.take(part @ centres.T, codes[:, j], axis=1)
        most = lengths @ rests.T
        # Far more than floating point can be off by.
        most += 1e-9 * (most + lengths.sum(axis=1)[:, None] * max((float(np.abs(c).max(initial=0)) for c in self.centres), default=0.0) * self.width + 1)
        return sums - most, sums + most


def _blob(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["labels"], np.int32), _matrix(row["weights"], len(ids))


def _blobs(rows: DataFrame, size: int, books: Codebooks | None = None) -> DataFrame:
    """Rows ``id, label, w`` (and for anchors ``windows``) packed in blocks, alike labels together; with codes if codebooks are given."""
    windowed = "windows" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                weights, labels = _weights(some.column("w")), some.column("label").to_numpy()
                codes, rests = books.encoded(weights) if books else (None, None)
                found = [number, np.unique(labels).tolist(), some.column("id").to_numpy().tobytes(), labels.tobytes(), _packed(weights), codes.tobytes() if books else None, rests.tobytes() if books else None]
                found.append(np.array(some.column("windows").to_pylist(), np.int64).tobytes() if windowed else None)
                kinds = [pa.int64(), pa.list_(pa.int32())] + [pa.binary()] * 6
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(found, kinds, strict=True)], names=["block", "some", "ids", "labels", "weights", "codes", "rests", "windows"])
                number += 1

    ordered = rows.repartitionByRange("label", "id").sortWithinPartitions("label", "id")
    return saved(ordered.mapInArrow(run, BLOB_SCHEMA))


def _met(groups: DataFrame, chunks: DataFrame, pairs: DataFrame, found: Callable, schema: str) -> DataFrame:
    """What ``found(anchors, chunk)`` gives for the pairs ``q, chunk`` of a group of anchors and a chunk of rows.

    A chunk is sent once for every 64 groups that it meets and stays in the task while these stream past;
    a task holds one chunk and a few groups, however many there are.
    """
    pairs = saved(pairs.withColumn("slot", F.pmod(F.xxhash64("q"), F.lit(1 << 20)) % F.greatest(F.lit(1), (F.count("*").over(Window.partitionBy("chunk")) / SLOT).cast("int"))))
    sent = chunks.withColumnRenamed("block", "chunk").join(pairs.select("chunk", "slot").distinct(), "chunk").withColumn("q", F.lit(-1).cast("long"))
    asking = pairs.join(groups.withColumnRenamed("block", "q"), "q")
    names = ["chunk", "slot", "q", *(c for c in groups.columns if c != "block")]
    stream = sent.select(*names).union(asking.select(*names)).repartition("chunk", "slot").sortWithinPartitions("chunk", "slot", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for row in (r for b in batches for r in b.to_pylist()):
            if row["q"] == -1:
                ids, labels, weights = _blob(row)
                held = ids, labels, weights, np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["rests"]).reshape(len(ids), -1)
            else:
                yield from found(row, held)

    with settings(groups.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}):  # a row holds matrices
        out = saved(stream.mapInArrow(run, schema))
    dropped(pairs)
    return out


def exact_scores(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the pairs (a, b), in whole numbers."""
    width = max(anchors.shape[1], rows.shape[1])
    anchors, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (anchors, rows))
    out = [np.einsum("ij,ij->i", anchors[a[i : i + PAIRS]], rows[b[i : i + PAIRS]]) for i in range(0, len(a), PAIRS)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def survivors(low: np.ndarray, high: np.ndarray, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
    """Which (anchor, row) pairs can be among the k highest scores of [least, most]: all that the bounds do not rule out.

    A row is out if its bounds miss the window, or lie below the k-th best sure lower bound of the rows
    that are surely inside.
    """
    possible = allowed & (high >= least[:, None]) & (low <= most[:, None])
    inside = possible & (low >= least[:, None]) & (high <= most[:, None])
    return possible & (high >= _kth(np.where(inside, low, -np.inf), k)[:, None])


def firsts(a: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first pairs of each anchor: higher scores, then smaller ids."""
    order = np.lexsort((ids, -scores, a))
    ordered = a[order]
    begins = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(a) else np.zeros(0, bool)
    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(begins, np.arange(len(a)), 0)) if len(a) else np.zeros(0, int)
    return order[rank < k]


def hard_negatives(rows: DataFrame, anchors: str = "id % 100 = 0", positives: int = 5, k: int = 5, margin: tuple[int, int] = (80, 100)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows ``id, label, w`` (from :func:`mined_rows`).

    An anchor (a row where the SQL condition holds) has as positives its first ``positives`` other rows of
    its label; each pair takes its first ``k`` rows of other labels with margin[0] * positive_score <= 100 *
    negative_score <= margin[1] * positive_score. Scores are inner products in whole numbers, higher first,
    ties by smaller id.

    Rows are stored in chunks with their product codes (eight subspaces, codebooks fitted on the at most
    8192 rows that come first by a hash of the id) and the norm of what the code leaves in each subspace.
    Blocks of anchors meet chunks: those of their own label for positives, all for negatives. Lookup
    tables give each score up to the residual bound (Cauchy-Schwarz a subspace), which rules rows out
    rigorously (:func:`survivors`); only the others are scored exactly, in the same task, and each chunk
    answers with at most ``k`` rows a window. Nothing else is shuffled but chunks and blocks of anchors,
    and no task holds more than one chunk and a few blocks, so a hot label only means more chunks.

    Rows without an id, label or vector, or with a component that is null or not finite, are no part of the
    input (see :func:`mined_rows`, which also makes one of repeated ids); shorter vectors count as filled
    with zeros. An anchor without positives, and a positive without a row in its window (always where its
    score is negative), give nothing; an empty table gives an empty table.
    """
    spark = rows.sparkSession
    rows = saved(rows)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()  # bounded by SAMPLE
    books = Codebooks(_weights(sample.column("w").combine_chunks()) if sample.num_rows else np.zeros((1, 1), np.int64))
    chunks = _blobs(rows, CHUNK, books)
    asked = rows.where(F.expr(anchors))
    groups = _blobs(asked, GROUP)

    def positive(group: dict, chunk: tuple) -> Iterator[pa.RecordBatch]:
        a_ids, a_labels, a_weights = _blob(group)
        ids, labels, weights, codes, rests = chunk
        allowed = (a_labels[:, None] == labels) & (a_ids[:, None] != ids)
        low, high = books.estimates(a_weights, codes, rests)
        ends = np.full(len(a_ids), np.inf)
        a, b = np.nonzero(survivors(low, high, allowed, -ends, ends, positives))
        scores = exact_scores(a_weights, weights, a, b)
        some = firsts(a, scores, ids[b], positives)
        yield pa.RecordBatch.from_arrays([pa.array(a_ids[a[some]]), pa.array(ids[b[some]]), pa.array(scores[some])], names=["anchor_id", "positive_id", "positive_score"])

    labelled = [x.select(F.col("block").alias(name), F.explode("some").alias("label")) for x, name in ((groups, "q"), (chunks, "chunk"))]
    pairs = labelled[0].join(labelled[1], "label").select("q", "chunk").distinct()
    close = _met(groups, chunks, pairs, positive, "anchor_id long, positive_id long, positive_score long")
    place = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = close.withColumn("place", F.row_number().over(place)).where(F.col("place") <= positives)
    # A window a positive: place, id, score; missing ones have place 0.
    listed = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.array(F.col("place").cast("long"), "positive_id", "positive_score"))).alias("windows"))
    filled = F.slice(F.concat("windows", F.array_repeat(F.array(*[F.lit(0).cast("long")] * 3), positives)), 1, positives)
    windowed = asked.join(listed.select(F.col("anchor_id").alias("id"), filled.alias("windows")), "id")
    asking = _blobs(windowed, GROUP)

    def negative(group: dict, chunk: tuple) -> Iterator[pa.RecordBatch]:
        a_ids, a_labels, a_weights = _blob(group)
        ids, labels, weights, codes, rests = chunk
        windows = np.frombuffer(group["windows"], np.int64).reshape(len(a_ids), positives, 3)
        allowed = a_labels[:, None] != labels
        low, high = books.estimates(a_weights, codes, rests)
        least, most = -(-margin[0] * windows[:, :, 2] // 100), margin[1] * windows[:, :, 2] // 100
        real = (windows[:, :, 0] > 0) & (least <= most)
        alive = np.zeros(low.shape, bool)
        for p in range(positives):
            rows_of = np.flatnonzero(real[:, p])
            alive[rows_of] |= survivors(low[rows_of], high[rows_of], allowed[rows_of], least[rows_of, p], most[rows_of, p], k)
        a, b = np.nonzero(alive)
        scores = exact_scores(a_weights, weights, a, b)
        for p in range(positives):
            inside = np.flatnonzero(real[a, p] & (scores >= least[a, p]) & (scores <= most[a, p]))
            some = inside[firsts(a[inside], scores[inside], ids[b[inside]], k)]
            pair = windows[a[some], p]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a_ids[a[some]], pair[:, 1], ids[b[some]], pair[:, 2], scores[some])], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    # A stated query set (blocks of anchors) meets all rows (chunks); only their numbers are paired here.
    pairs = asking.select(F.col("block").alias("q")).crossJoin(chunks.select(F.col("block").alias("chunk")))
    found = _met(asking, chunks, pairs, negative, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    dropped(rows, chunks, groups, close, asking)
    place = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, as :func:`hard_negatives` gives them; labels of ids divisible by 7 move by one first."""
    label = "if(vec_id % 7 = 0, (label + 1) % 10, label)"
    return hard_negatives(mined_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label))
