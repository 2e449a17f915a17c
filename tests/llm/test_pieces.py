import random

import numpy as np
import sentencepiece

from riskloom.llm.pieces import agenda, decode_ids, decoded, encode_texts, encoded, matrix, op4_sentencepiece, pieces, unit_keys
from riskloom.llm.tokens import vocabulary_path

NAME = "piece_bpe_32k.model"
BITS = ["word", " the", "  ", "\n", "\t", "123", "é", "日本語", "!!!", "▁", "▁▁x", " ", "internationalization", "    ", "<s>", "<0x0A>", "😀", "\x00", "Straße", "aaaa", " "]


def texts(n, seed):
    rng = random.Random(seed)
    return ["", " ", "  a", "x" * 300, " " * 70 + "end", "ab" * 90, "日本語" * 40] + ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def split(ids, starts):
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]


def test_without_dropout_as_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(NAME))
    some = [t for t in texts(400, 1) if "▁" not in t and "\x00" not in t]
    got = split(*encode_texts(pieces(NAME), some, [0] * len(some), 0.0))
    assert got == [library.encode(t) for t in some]


def test_matrix_as_agenda_and_lossless():
    model = pieces(NAME)
    for dropout in (0.0, 0.1, 0.5, 1.0):
        for text in texts(80, 2):
            ids, starts = encode_texts(model, [text], [5], dropout)
            assert decode_ids(model, ids, starts) == [text]
            plain, place = [], 0
            for unit in model.units.findall(f" {text}") if text else []:
                points = np.array([ord(c) for c in unit], dtype=np.uint32)
                key = unit_keys(5, np.array([place]))[0]
                place += len(unit)
                for piece, at in agenda(model, points, key, dropout):
                    plain += [piece] if piece != model.other else model.byte[list(unit[at].encode())].tolist()
            assert ids.tolist() == plain


def test_pieces_of_a_matrix_stay_where_they_begin():
    """One array over all characters: what a piece takes over is -1, and rows of all widths, first and last, keep apart."""
    model, units = pieces(NAME), [" internationalization", "a", " the", "aaaaaaaa", "é", " 日本", "x"]
    keys = unit_keys(7, np.arange(len(units)))
    points = np.array([ord(c) for u in units for c in u], dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(u) for u in units])))
    for dropout in (0.0, 0.3, 1.0):
        found = matrix(model, points, starts, keys, dropout)
        assert len(found) == len(points)
        for k, (a, b) in enumerate(zip(starts, starts[1:])):
            assert [(int(i), p) for p, i in enumerate(found[a:b]) if i >= 0] == agenda(model, points[a:b], keys[k], dropout)


def test_dropout_varies_with_seed_and_rows_do_not_matter(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts(40, 3))] + [(None, None, None), (3, "again", "y"), (None, "some words here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    one, again, other = ([tuple(r["pieces"]) for r in encoded(x, seed=s).orderBy("doc_id", "text").collect()] for x, s in ((docs, 1), (docs.repartition(3), 1), (docs, 2)))
    assert one == again != other
    back = decoded(encoded(docs, dropout=0.3)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back) and len(back) == len(rows)


def test_each_occurrence_draws_its_own_merges():
    model = pieces(NAME)
    ids, starts = encode_texts(model, ["internationalization " * 200] * 2, [1, 2], 0.2)
    one, two = split(ids, starts)
    assert one != two and decode_ids(model, ids, starts) == ["internationalization " * 200] * 2
    words, at = set(), []
    for i in one:
        if model.raw[model.raw_starts[i] : model.raw_starts[i] + 1].tobytes() == b" " and at:
            words.add(tuple(at))
            at = []
        at.append(i)
    assert len(words) > 20


def test_a_very_long_text():
    model = pieces(NAME)
    long = "the quick été 日本 " * 60_000 + "x" * 5000
    ids, starts = encode_texts(model, [long, ""], [9, 9], 0.1)
    assert decode_ids(model, ids, starts) == [long, ""]


def test_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert [r["lossless"] for r in op4_sentencepiece(spark, str(tmp_path / "a")).collect()] == [True] * 3
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert op4_sentencepiece(spark, str(tmp_path / "b")).count() == 0
