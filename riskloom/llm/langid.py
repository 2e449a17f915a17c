"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import dropped, saved, sliced

ORDERS, BUCKETS, UNKNOWN = (1, 2, 3), 1 << 15, "und"
#: Languages of one broadcast matrix; more languages take more passes over the texts.
TOGETHER = 256
WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; signs such as ½ or ① are word characters, but no letters."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


@dataclass
class LanguageModel:
    """``weights[bucket, language]``: log probabilities; ``prior[language]``; names in order. One of the passes' matrices."""

    names: list[str]
    weights: np.ndarray
    prior: np.ndarray


def code_points(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The (lower-cased) code points of all texts in one array, and where each text begins (the end last)."""
    lowered = [x.decode().lower() if lower else x.decode() for x in texts]
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lowered], out=starts[1:])
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def grams(points: np.ndarray, starts: np.ndarray, orders=ORDERS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at every place, and which places have one inside their text."""
    rolling = np.zeros(len(points), dtype=np.uint32)
    for order in range(1, max(orders) + 1):
        rolling *= np.uint32(0x01000193)
        rolling[: len(points) - order + 1] += points[order - 1 :] if order <= len(points) else np.uint32(0)
        if order in orders:
            mixed = (rolling + np.uint32(order)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA77)
            inside = np.ones(len(points), dtype=bool)
            for back in range(1, order):
                at = starts[1:] - back
                inside[at[at >= starts[:-1]]] = False
            yield (mixed >> np.uint32(33 - buckets.bit_length())).astype(np.int32), inside


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, bucket, n``: n-grams of all rows that have a language; bucket -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, texts in sliced(batches, "text", 1 << 20):
            names = rows.column(1).to_pylist()
            order = sorted(range(len(names)), key=names.__getitem__)
            points, starts = code_points([texts[k] for k in order])
            named = [names[k] for k in order]
            edges = [0] + [k for k in range(1, len(named)) if named[k] != named[k - 1]] + [len(named)]
            for bucket, inside in grams(points, starts):
                for a, b in zip(edges, edges[1:], strict=False):
                    part = slice(starts[a], starts[b])
                    into = sums.setdefault(named[a], np.zeros(BUCKETS + 1, dtype=np.int64))
                    into[:BUCKETS] += np.bincount(bucket[part][inside[part]], minlength=BUCKETS)
            for a, b in zip(edges, edges[1:], strict=False):
                sums[named[a]][BUCKETS] += b - a
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5, together: int = TOGETHER) -> list[LanguageModel]:
    """A model of all rows with text and language, in matrices of at most ``together`` languages.

    Counting is distributed over all rows; the driver gets the counts of ``together`` languages x buckets at a time.
    """
    counted = saved(gram_counts(docs, text_col, lang_col))
    per_name = {r["lang"]: r["n"] for r in counted.where("bucket = -1").collect()}
    names, models = sorted(per_name), []
    seen = float(sum(per_name.values()))
    for at in range(0, len(names), together):
        some = names[at : at + together]
        counts = np.zeros((BUCKETS, len(some)))
        table = counted.where((F.col("bucket") >= 0) & F.col("lang").between(some[0], some[-1])).toPandas()
        counts[table["bucket"].to_numpy(), np.searchsorted(some, table["lang"].to_numpy(dtype=str))] = table["n"].to_numpy()
        weights = np.log((counts + smoothing) / (counts + smoothing).sum(axis=0))
        models.append(LanguageModel(some, weights.astype(np.float32), np.log(np.array([per_name[x] for x in some]) / seen)))
    dropped(counted)
    return models


def text_scores(model: LanguageModel, texts: list[bytes]) -> np.ndarray:
    """A row a text: the log probability of each language and the text's n-grams, which are counted first and only then multiplied."""
    points, starts = code_points(texts)
    total = np.tile(model.prior, (len(texts), 1))
    kinds = [(bucket, inside) for bucket, inside in grams(points, starts)]
    for k in np.flatnonzero(starts[1:] > starts[:-1]).tolist():
        part = slice(starts[k], starts[k + 1])
        found = np.concatenate([bucket[part][inside[part]] for bucket, inside in kinds])
        if len(found) < 2048:
            used, times = np.unique(found, return_counts=True)
        else:
            times = np.bincount(found, minlength=BUCKETS)
            used = np.flatnonzero(times)
            times = times[used]
        total[k] += times.astype(np.float64) @ model.weights[used].astype(np.float64)
    return total


def predict(docs: DataFrame, models: list[LanguageModel], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (they replace columns of these names).

    Null texts and texts without a letter get ``und`` and score 0, as do all where nothing was learned;
    of equal probabilities the first name in order wins. What is broadcast at a time is bounded by
    ``TOGETHER`` languages x ``BUCKETS``; each matrix takes a pass over the texts, in one stage. A text's
    n-grams are counted sparsely, so memory follows its different n-grams, not its length times the
    languages. Whole texts are read; other columns pass through untouched.
    """
    from pyspark.sql.types import DoubleType, StringType, StructType

    docs = docs.drop("lang_pred", "score", "__all")
    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("__all", DoubleType())
    out = docs.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(float("-inf")), "__all": F.lit(float("-inf"))})
    for model in models:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for rows, texts in sliced(batches, text_col, 1 << 20):
                total = text_scores(shared.value, texts)
                place, best = total.argmax(axis=1), total.max(axis=1)
                names, before = rows.column(rows.num_columns - 3).to_pylist(), rows.column(rows.num_columns - 2).to_numpy()
                whole = np.logaddexp(rows.column(rows.num_columns - 1).to_numpy(), best + np.log(np.exp(total - best[:, None]).sum(axis=1)))
                known = [has_letter(x.decode()) for x in texts]
                names = [shared.value.names[p] if k and b > a else n for p, k, b, a, n in zip(place, known, best, before, names, strict=True)]
                score = np.where(known, np.maximum(best, before), float("-inf"))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-3], pa.array(names, pa.string()), pa.array(score), pa.array(whole)], names=rows.schema.names)

        out = out.mapInArrow(run, schema)
    chance = F.when(F.col("lang_pred").isNull(), F.lit(0.0)).otherwise(F.exp(F.col("score") - F.col("__all")))
    return out.withColumns({"score": chance, "lang_pred": F.coalesce("lang_pred", F.lit(UNKNOWN))}).drop("__all")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language as :func:`predict` gives it, learned from those whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = fit(docs.where(~held))
    found = predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
