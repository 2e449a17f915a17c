"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax on top."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from riskloom.llm.langid import code_points, grams
from riskloom.llm.shared import sliced

ORDERS, BUCKETS, REPEATS, SPACE = (1, 2, 3, 4), 1 << 14, 8, np.array([32, 9, 10, 11, 12, 13], dtype=np.uint32)
#: At most so many labelled documents are learned from, the first in the order of a hash of their ids.
MOST_LABELLED = 4000


def word_hashes(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (white space parts words) and the number of the text that it is in."""
    inside = ~np.isin(points, SPACE)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[starts[:-1][starts[:-1] < len(points)]] |= inside[starts[:-1][starts[:-1] < len(points)]]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    number = np.cumsum(first) - 1
    offset = (np.arange(len(points)) - at[np.maximum(number, 0)]).astype(np.uint32)
    value = (points + np.uint32(0x51ED27)) * np.uint32(0x2C1B3C6D)
    value = (value ^ value >> np.uint32(12)) * (np.uint32(2) * offset * np.uint32(0x297A2D39) + np.uint32(1))
    total = np.add.reduceat(np.where(inside, value, np.uint32(0)), at, dtype=np.uint32)
    total = (total ^ total >> np.uint32(15)) * np.uint32(0x846CA68B)
    return total, np.searchsorted(starts, at, side="right") - 1


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of all character n-grams, words and repeats of a word, family by family."""
    points, starts = code_points(texts, lower=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    for bucket, inside in grams(points, starts, ORDERS, BUCKETS):
        yield bucket[inside], owner[inside]
    words, owner = word_hashes(points, starts)
    shift = np.uint32(33 - BUCKETS.bit_length())
    yield (words >> shift).astype(np.int32), owner
    back = np.zeros(len(words), dtype=np.uint32)  # how many words ago the same word stood, 0: not among the last ones
    for k in range(min(REPEATS, len(words) - 1), 0, -1):
        back[k:][(words[k:] == words[:-k]) & (owner[k:] == owner[:-k])] = k
    yield ((back + np.uint32(1)) * np.uint32(0x9E3779B1) >> shift).astype(np.int32), owner


@dataclass
class QualityModel:
    """``vectors[bucket]``: learned embeddings; ``output``: softmax weights; ``bias``."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The chance of label 1 of each text."""
        lift = (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, owner in features(texts):
            total += np.bincount(owner, lift[bucket], minlength=len(texts))
            count += np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias[1] - self.bias[0])))


def histograms(docs: DataFrame) -> DataFrame:
    """``label, buckets, weights``: the share of each bucket among the features of each labelled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sliced(batches, "text", 1 << 20):
            for k, text in enumerate(texts):
                counts = sum(np.bincount(bucket, minlength=BUCKETS) for bucket, _ in features([text]))
                at = np.flatnonzero(counts).astype(np.int16)
                weights = (counts[at] / max(1, counts.sum())).astype(np.float32)
                yield pa.RecordBatch.from_arrays([rows.column(1).slice(k, 1), pa.array([at.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary())], names=["label", "buckets", "weights"])

    return docs.select(F.col("text").cast("string").alias("text"), "label").mapInArrow(run, "label int, buckets binary, weights binary")


def train(rows: list[tuple[int, bytes, bytes]], size: int = 8, epochs: int = 10, rate: float = 100.0, output_rate: float = 0.5, batch: int = 32, seed: int = 1) -> QualityModel:
    """Stochastic gradient descent over small batches of documents, with a linearly falling rate."""
    rng = np.random.default_rng(seed)
    labels = np.array([r[0] for r in rows], dtype=np.int64)
    parts = [(np.frombuffer(r[1], np.int16), np.frombuffer(r[2], np.float32)) for r in rows]
    vectors = rng.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
    output, ones = rng.uniform(-0.5, 0.5, (size, 2)).astype(np.float32), labels.sum()
    bias = np.log(np.array([len(labels) - ones + 1, ones + 1], dtype=np.float32))
    if 0 < ones < len(labels):
        steps, step = epochs * -(-len(rows) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                some = order[at : at + batch]
                dense = np.zeros((len(some), BUCKETS), np.float32)
                for k, i in enumerate(some):
                    dense[k, parts[i][0]] = parts[i][1]
                hidden = dense @ vectors
                logits = hidden @ output + bias
                chance = np.exp(logits - logits.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                chance[np.arange(len(some)), labels[some]] -= 1
                pace = np.float32((1 - step / steps) / len(some))
                toward = chance @ output.T
                output -= output_rate * pace * (hidden.T @ chance)
                bias -= output_rate * pace * chance.sum(axis=0)
                vectors -= rate * pace * (dense.T @ toward)
                step += 1
    else:
        vectors[:] = 0
    return QualityModel(vectors, output, bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> QualityModel:
    """A model of at most ``most`` labelled rows (documented bound; chosen by a hash of the id, so the same ones each time).

    Labels other than 0 and 1 and null ids or labels are left out; a document with several label rows
    counts once for each distinct label, and of documents that share an id one counts. With no labels, or of one kind only, every text gets the same score.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    sample = known.orderBy(F.xxhash64("id"), "id", "label").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # The sample has `most` rows at most, and of documents that share an id one is taken, so as many rows reach the driver.
    one = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = histograms(one).collect()
    return train(sorted((r["label"], bytes(r["buckets"]), bytes(r["weights"])) for r in rows))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, of the whole text; null counts as empty; a column of that name is replaced).

    Only the text enters the score; other columns pass through. The model is broadcast; its size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sliced(batches, text_col, 1 << 20):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shared.value.scores(texts))], names=[*rows.schema.names, "score"])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("score", DoubleType()))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the labels of those whose crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    model = fit(docs.where(~held), labels.where(~held))
    found = score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
