"""A corpus-cleaning pipeline over ``documents``: five stages, each written as Parquet and read again.

1. ``language_id`` learns the languages from the rows' own text and ``lang`` and lets go of documents
   without a letter, and of those whose language stays in doubt (less than half the probability).
2. ``near_dedup`` keeps one document of each group of near copies (Jaccard similarity of the 5-word
   shingles at least 0.8): the one with the smallest id.
3. ``suffix_dedup`` cuts every string of 50 words that stands in more than one place, but for its first
   place; documents that nothing is left of go.
4. ``decontamination`` lets go of documents that hold a passage of the benchmark.
5. ``sentencepiece`` adds the pieces of each text, encoded with merge-dropout, and their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import langid, leaks, pieces, simhash, suffixes
from riskloom.llm.shared import saved

#: Below this share of probability a document's language is in doubt.
SURE = 0.5
#: Documents are near copies if their shingles of so many words have at least this Jaccard similarity.
SHINGLE, SIMILAR = 5, 0.8
#: Passages of so many words are cut where they stand again.
PASSAGE = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough. Null and letterless texts go; of ties the first language counts; an empty table stays empty."""
    found = langid.predict(docs, langid.fit(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of the smallest id (rows without one come last), then of the smallest text hash and fields.

    Null and wordless texts are one group; repeated rows are copies of one another; an empty table stays empty.
    """
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 3)
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), late), "__hash": F.xxhash64(F.col("text").cast("string"))})
    groups = simhash.near_copies(keyed, "__id", width=SHINGLE, similarity=SIMILAR)
    winners = groups.groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("first")).select("first.*")
    kept = keyed.join(winners, (F.col("__id") == F.col("id")) & (F.col("__hash") == F.col("text_hash")), "left_semi")
    first = Window.partitionBy("__id", "__hash").orderBy("lang", "source", "n_chars")
    return kept.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave one copy each; texts that were empty before stay, ones that are cut whole go; null texts stay."""
    whole = docs.withColumn("__empty", F.coalesce(F.col("text"), F.lit("")) == "")
    cut = suffixes.without_repeats(whole, length=PASSAGE, unit="words", keep_first=True)
    kept = cut.where((F.col("text") != "") | F.col("__empty")).drop("__empty")
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null texts hold none and stay; repeated rows fare alike; an empty benchmark lets all stay."""
    marked = leaks.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("leaks") == 0).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its pieces. Null and empty texts have none; repeated rows are encoded alike; an empty table stays empty."""
    return pieces.encoded(docs).withColumn("n_pieces", F.size("pieces")).select("doc_id", "lang", "source", "text", "n_pieces", "pieces")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the stages (near copies, alignment, merges); tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = saved(docs)
    return docs
