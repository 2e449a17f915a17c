import random

import pytest

from riskloom.llm.tokens import op2_token_counts, spliced_count, token_counts, tokenizer

SPECIAL = "<|endoftext|>"


def whole(text):
    return len(tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (100, 60), (257, 30), (1000, 256)])
def test_splicing_equals_the_whole(chunk, overlap):
    rng = random.Random(chunk)
    bits = ["word", " the", "  ", "\n\n", "\t", "123", "é", "日本語", "!!!", "'s", "'", " ", "x" * 90, " " * 130, SPECIAL, "<|endo", "ftext|>", "😀", "a'll", "?" * 70]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(400)))
        assert spliced_count(tokenizer("byte_bpe_50k.json"), text, chunk, overlap) == whole(text)


def test_one_unbroken_run():
    for text in ("a" * 5000, " " * 3000 + "a", "\n " * 2000, SPECIAL * 300):
        assert spliced_count(tokenizer("byte_bpe_50k.json"), text, 128, 16) == whole(text)


def test_rows(spark, tmp_path):
    rows = [(1, "Hello world", "a"), (1, "Hello world", "a"), (2, None, None), (None, "", "c"), (5, "é " * 40000, "d"), (6, f"a{SPECIAL}b", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in token_counts(docs).collect()), key=str)
    assert got == sorted(((k, len((t or "").encode()), whole(t or "")) for k, t, _ in rows), key=str)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert op2_token_counts(spark, str(tmp_path)).dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert op2_token_counts(spark, str(tmp_path)).count() == 0
