"""Exact token counts of whole texts, huge ones by overlapping chunks that are spliced."""

from __future__ import annotations

import bisect
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import sliced


def vocabulary_path(name: str) -> str:
    """A file's place: an absolute path as it is, else the name of a public tokenizer of this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


def _starts(encoding, at: int) -> tuple[list[int], list[int]]:
    """Where the words (pre-tokens) of an encoding of text[at:] begin: in the whole text, and as token numbers."""
    places, tokens, last = [], [], -1
    for k, (word, (first, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:
            places.append(at + first)
            tokens.append(k)
        last = word
    return places, tokens


def spliced_count(coder, text: str, chunk: int = 1 << 15, overlap: int = 256, margin: int = 16) -> int:
    """Tokens of ``text``, encoded in chunks of ``chunk`` characters that overlap by ``overlap``.

    A pre-tokenizer that reads left to right goes on alike from any place where it begins a word, so a
    place where both encodings begin a word, ``margin`` characters inside both chunks (longer than a
    special token, so that none is cut there), is a boundary of the whole text's encoding: tokens before
    it come from the left chunk, tokens from it on from the right one. Where the overlap has no such
    place it is doubled, until there is one or the left chunk reaches the end.
    """
    margin = max([margin, *(len(t.content) + 1 for t in coder.get_added_tokens_decoder().values())])
    chunk = max(chunk, 4 * margin)
    encode = functools.partial(coder.encode, add_special_tokens=False)
    begin, end = 0, min(chunk, len(text))
    left = encode(text[begin:end])
    total, counted = 0, 0  # tokens before the proven boundary; the first token of `left` that counts
    while end < len(text):
        width, places = max(overlap, 3 * margin), None
        while end < len(text):
            start = max(begin + 1, end - width)
            right_end = min(len(text), start + max(chunk, 2 * width))
            right = encode(text[start:right_end])
            places, tokens = _starts(left, begin)
            right_places, right_tokens = _starts(right, start)
            known = set(right_places)
            low, high = bisect.bisect_left(places, start + margin), bisect.bisect_right(places, end - margin)
            meet = next((k for k in range(high - 1, low - 1, -1) if places[k] in known and tokens[k] >= counted), None)
            if meet is not None:
                total += tokens[meet] - counted
                counted = right_tokens[bisect.bisect_left(right_places, places[meet])]
                left, begin, end = right, start, right_end
                break
            end = min(len(text), end + width)
            width *= 2
            left = encode(text[begin:end])
    return total + len(left.ids) - counted


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", chunk: int = 1 << 15, overlap: int = 256) -> DataFrame:
    """``id, n_bytes, n_tokens`` of every row, as the tokenizers library encodes the whole text.

    No begin, end or other special tokens are added; special strings inside a text count as the library
    counts them. ``vocabulary`` is the file (a path, or the name of a public tokenizer) of a tokenizer
    whose pre-tokenizer reads left to right without looking back, as byte-level ones do. Texts of more
    than ``chunk`` characters go through :func:`spliced_count`. Null counts as empty (0 bytes, 0 tokens);
    ids may be null or repeat; extra columns are ignored. One pass over the rows, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        for rows, raw in sliced(batches, "text", 1 << 19):
            texts = [x.decode() for x in raw]
            short = [k for k, x in enumerate(texts) if len(x) <= chunk]
            counts = [0] * len(texts)
            for k, found in zip(short, coder.encode_batch_fast([texts[k] for k in short], add_special_tokens=False), strict=True):
                counts[k] = len(found)
            for k, x in enumerate(texts):
                if len(x) > chunk:
                    counts[k] = spliced_count(coder, x, chunk, overlap)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    found = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
