"""Exact top-k search by inner product, with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import saved, settings

BLOCK, CHUNK, GROUP = 64, 1024, 512  # vectors of a block; of a stored chunk of blocks; queries of a group
#: So many chunks, those that promise most to a group of queries, are scored before the others are bounded again.
FIRST = 4
GROUP_SCHEMA = "q_group long, q_ids binary, q_weights binary, q_chunks binary, b_ids binary, b_scores binary"
CHUNK_SCHEMA = "chunk long, ids binary, weights binary, asked binary"


def _weights(rows: pa.Array) -> np.ndarray:
    """A matrix of integer components; shorter vectors are filled with zeros."""
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), int(sizes.max(initial=1))), dtype=np.int64)
    out[np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.arange(s) for s in sizes])] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = np.full(queries, np.iinfo(np.int64).min) if floor is None else floor

    def kth(self) -> np.ndarray:
        """The score that a candidate must reach."""
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """Scores (rows x ids) of new candidates; those not ok don't count."""
        lowest, none = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        scores = np.where(ok & (scores >= self.kth()[rows, None]), scores, lowest)
        some = (scores > lowest).any(axis=1)
        rows, scores, ids = rows[some], scores[some], np.broadcast_to(ids, scores.shape)[some]
        all_scores = np.concatenate((self.score[rows], scores), axis=1)
        all_ids = np.concatenate((self.id[rows], np.where(scores > lowest, ids, none)), axis=1)
        # An id takes one place, with its best score: by id and score, all but the first of each id are void.
        order = np.lexsort((-np.maximum(all_scores, -none), all_ids), axis=1)
        all_scores, all_ids = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
        again = np.zeros(all_ids.shape, dtype=bool)
        again[:, 1:] = all_ids[:, 1:] == all_ids[:, :-1]
        all_scores, all_ids = np.where(again, lowest, all_scores), np.where(again, none, all_ids)
        order = np.lexsort((all_ids, -np.maximum(all_scores, -none)), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


def maxima(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest weight of each term in each block."""
    edges = np.arange(0, len(weights), BLOCK)
    return np.minimum.reduceat(weights, edges), np.maximum.reduceat(weights, edges)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and block, the sum over the query's terms of the most that the block's weights can give."""
    width = max(queries.shape[1], low.shape[1])
    queries, low, high = _padded(queries, width), _padded(low, width), _padded(high, width)
    return _products(np.maximum(queries, 0), high) + _products(np.minimum(queries, 0), low)


def search(best: Best, queries: np.ndarray, query_ids: np.ndarray, weights: np.ndarray, ids: np.ndarray, asked: np.ndarray | None = None) -> int:
    """Scores a chunk's blocks for the queries, in the order of their bounds, until these fall below the kth score.

    A block is read (through its rows, the forward index) for the queries whose bound is not below their
    kth score; ``asked`` names the queries to serve, all if not given. Returns how many (query, block)
    pairs were scored.
    """
    bound = bounds(queries, *maxima(weights))
    width = max(queries.shape[1], weights.shape[1])
    queries, weights = _padded(queries, width), _padded(weights, width)
    order = np.argsort(-bound, axis=1, kind="stable")
    served = np.ones(len(queries), dtype=bool) if asked is None else asked
    scored = 0
    for turn in range(bound.shape[1]):
        block_of = order[:, turn]
        alive = served & (bound[np.arange(len(queries)), block_of] >= best.kth())
        if not alive.any():
            break
        for block in np.unique(block_of[alive]):
            rows = np.flatnonzero(alive & (block_of == block))
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            best.add(rows, _products(queries[rows], weights[part]), ids[None, part], ids[None, part] != query_ids[rows, None])
            scored += len(rows)
    return scored


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    """A packed matrix: a marking byte tells the size of its numbers."""
    return np.frombuffer(raw, np.int32 if raw[0] == 4 else np.int64, offset=8).reshape(rows, -1).astype(np.int64)


def _read(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    return ids, _matrix(row[f"{prefix}weights"], len(ids))


def _kept(row: dict, queries: int, k: int) -> Best:
    """The places of a group's queries so far."""
    best = Best(queries, k)
    best.id, best.score = (np.frombuffer(row[x], np.int64).reshape(queries, k).copy() for x in ("b_ids", "b_scores"))
    return best


def _packed(x: np.ndarray) -> bytes:
    kind = np.int32 if np.abs(x).max(initial=0) < 2**31 else np.int64
    return bytes([np.dtype(kind).itemsize] * 8) + x.astype(kind).tobytes()


def _hits(best: Best) -> list[bytes]:
    """The places of all queries so far, as bytes."""
    return [best.id.tobytes(), best.score.tobytes()]


def top_k(vectors: DataFrame, asked: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``asked`` (an SQL condition on ``id``) holds, its k best others.

    Components become floor(scale * x). Rows are ordered by their strongest components, so that a block
    holds like vectors, and stored in chunks of blocks, with each block's term maxima in a small table.
    First each chunk serves the queries it holds, which gives each a kth score to beat. Then groups of
    queries meet the maxima of all blocks: a (group, chunk) goes on only if some query's bound for some of
    its blocks reaches that query's kth score. The chunks that promise most to each group are scored first
    and give new kth scores; those that still can matter follow. Within a chunk blocks are scored in the
    order of their bounds until these fall below the kth score. What travels is a group and a chunk at a time.

    Vectors that are null, or hold null or non-finite components, and rows with a null id take no part.
    Shorter vectors count as filled with zeros. Components beyond +-2^62 are cut there (their scores would
    not fit a long). Equal scores go to the smaller id. Of rows that share an id the best one counts as
    candidate, never for a query of that id; queries that share an id are answered as one. Other columns
    are ignored; an empty table has no answers.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where("id is not null and x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    limit = float(1 << 62)
    ints = F.transform("x", lambda c: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), c * scale))).cast("long"))
    rows = given.where(finite).select("id", ints.alias("w"), F.expr(asked).alias("asked"))
    strongest = F.slice(F.array_sort(F.transform("w", lambda v, i: F.struct((-F.abs(v)).alias("s"), F.when(v < 0, -i - 1).otherwise(i).alias("d")))), 1, 3)
    keyed = rows.withColumn("like", F.transform(strongest, lambda s: s["d"]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                weights = _weights(some.column(1))
                mask = some.column(2).fill_null(False).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([some.column(0).to_numpy().tobytes()]), pa.array([_packed(weights)]), pa.array([np.flatnonzero(mask).astype(np.int32).tobytes()])], names=["chunk", "ids", "weights", "asked"])
                number += 1

    ordered = keyed.repartitionByRange("like", "id").sortWithinPartitions("like", "id").select("id", "w", "asked")
    chunks = saved(ordered.mapInArrow(pack, CHUNK_SCHEMA))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            ids, weights = _read(row)
            own = np.frombuffer(row["asked"], np.int32)
            if len(own):
                best = Best(len(own), k)
                search(best, weights[own], ids[own], weights, ids)
                columns = [[row["chunk"]] * len(own), ids[own].tolist(), [_packed(weights[i : i + 1]) for i in own], best.id.tolist(), best.score.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["chunk", "id", "w", "ids", "scores"])

    seeds = chunks.mapInArrow(seed, "chunk long, id long, w binary, ids array<long>, scores array<long>")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def emit() -> pa.RecordBatch:
            rows = [_matrix(x["w"], 1) for x in held]
            width = max(x.shape[1] for x in rows)
            weights = np.concatenate([_padded(x, width) for x in rows])
            columns = [[number], [np.array([x["id"] for x in held]).tobytes()], [_packed(weights)], [np.array([x["chunk"] for x in held]).tobytes()], [np.array([x["ids"] for x in held]).tobytes()], [np.array([x["scores"] for x in held]).tobytes()]]
            kinds = [pa.int64()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["q_group", "q_ids", "q_weights", "q_chunks", "b_ids", "b_scores"])

        for row in (r for b in batches for r in b.to_pylist()):
            held.append(row)
            if len(held) >= GROUP:
                yield emit()
                number, held = number + 1, []
        if held:
            yield emit()

    groups = saved(seeds.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(gather, GROUP_SCHEMA))

    def pack_maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            low, high = maxima(_read(row)[1])
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), pa.array([_packed(low)]), pa.array([_packed(high)]), pa.array([len(low)], pa.int32())], names=["chunk", "low", "high", "blocks"])

    tops = saved(chunks.mapInArrow(pack_maxima, "chunk long, low binary, high binary, blocks int"))

    def promise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How far a chunk's bounds reach above the kth scores of a group, at best; below 0 nothing of it can matter."""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                query_ids, queries = _read(row, "q_")
                low, high = (_matrix(row[x], row["blocks"]) for x in ("low", "high"))
                gap = bounds(queries, low, high).max(axis=1).astype(float) - _kept(row, len(query_ids), k).kth()
                out.append(float(gap[np.frombuffer(row["q_chunks"], np.int64) != row["chunk"]].max(initial=-1.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["q_group", "chunk", "promise"])

    def promised(groups: DataFrame, of: DataFrame) -> DataFrame:
        met = groups.join(of).select("q_group", "chunk", "q_ids", "q_weights", "q_chunks", "b_ids", "b_scores", "low", "high", "blocks")
        return saved(met.mapInArrow(promise, "q_group long, chunk long, promise double").where("promise >= 0"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            ids, weights = _read(row)
            query_ids, queries = _read(row, "q_")
            best = Best(len(query_ids), k, _kept(row, len(query_ids), k).kth())
            pairs = search(best, queries, query_ids, weights, ids, np.frombuffer(row["q_chunks"], np.int64) != row["chunk"])
            yield pa.RecordBatch.from_arrays([pa.array([row["q_group"]]), *(pa.array([x]) for x in _hits(best)), pa.array([pairs], pa.int64())], names=["q_group", "b_ids", "b_scores", "pairs"])

    def scored(groups: DataFrame, pairs: DataFrame) -> DataFrame:
        met = pairs.select("q_group", "chunk").repartition("chunk", "q_group").join(chunks.drop("asked"), "chunk").join(groups, "q_group")
        return saved(met.mapInArrow(meet, "q_group long, b_ids binary, b_scores binary, pairs long"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of each group's queries, from rows sorted by group."""
        current, best = None, None
        for row in (r for b in batches for r in b.to_pylist()):
            ids, scores = (np.frombuffer(row[x], np.int64).reshape(-1, k) for x in ("b_ids", "b_scores"))
            if row["q_group"] != current:
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array([current]), *(pa.array([x]) for x in _hits(best))], names=["q_group", "b_ids", "b_scores"])
                current, best = row["q_group"], Best(len(ids), k)
            best.add(np.arange(len(ids)), scores, ids, ids != np.iinfo(np.int64).max)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([current]), *(pa.array([x]) for x in _hits(best))], names=["q_group", "b_ids", "b_scores"])

    def merged(groups: DataFrame, found: DataFrame) -> DataFrame:
        rows = groups.select("q_group", "b_ids", "b_scores").union(found.select("q_group", "b_ids", "b_scores"))
        best = rows.repartition("q_group").sortWithinPartitions("q_group").mapInArrow(merge, "q_group long, b_ids binary, b_scores binary")
        return saved(groups.drop("b_ids", "b_scores").join(best, "q_group").select(*groups.columns))

    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "32"}):  # a row holds two matrices
        # Every group of queries is to meet every block's maxima: blocks of a stated query set against all rows.
        open_pairs = promised(groups, tops)
        place = Window.partitionBy("q_group").orderBy(F.desc("promise"), "chunk")
        first = saved(open_pairs.withColumn("place", F.row_number().over(place)).where(F.col("place") <= FIRST).drop("place"))
        groups = merged(groups, scored(groups, first))
        rest = open_pairs.join(first.select("q_group", "chunk"), ["q_group", "chunk"], "left_anti")
        again = promised(groups.join(rest.select("q_group").distinct(), "q_group", "left_semi"), tops).join(rest.select("q_group", "chunk"), ["q_group", "chunk"], "left_semi")
        groups = merged(groups, scored(groups, again))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            query_ids = np.frombuffer(row["q_ids"], np.int64)
            best = _kept(row, len(query_ids), k)
            real = best.id != np.iinfo(np.int64).max
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, k)[real.ravel()]), pa.array(best.id[real]), pa.array(best.score[real])], names=["query_id", "vec_id", "score"])

    hits = groups.mapInArrow(listed, "query_id long, vec_id long, score long")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The five nearest others of every vector whose id is divisible by 50, as :func:`top_k` gives them."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0")
