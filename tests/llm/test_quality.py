import random

import numpy as np

from riskloom.llm.quality import features, fit, op8_quality_classifier, score, word_hashes
from riskloom.llm.langid import code_points


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = ["w" + rng.choice("abcdefgh") + rng.choice("aeiou") for _ in range(rng.randrange(5, 60))]
        kind = rng.randrange(4)
        text = " ".join(words) if kind < 2 else " ".join(w.upper() + "!!" for w in words) if kind == 2 else " ".join([words[0]] * 30)
        out.append((k, text, int(kind < 2), "en"))
    return out


def test_words_and_repeats():
    points, starts = code_points([b"", b" ab cd ab", b"ab", b""], lower=False)
    words, owner = word_hashes(points, starts)
    assert owner.tolist() == [1, 1, 1, 2] and words[0] == words[2] == words[3] != words[1]
    assert sum(len(b) for b, _ in features([b"", b" \n"])) == sum((2, 1))
    assert all((b < 1 << 14).all() and (b >= 0).all() for b, _ in features(["héllo wörld".encode()]))


def test_held_out_accuracy_and_edge_rows(spark, tmp_path):
    rows = corpus(400, 1)
    docs = spark.createDataFrame([(k, t, s, 0.5) for k, t, _, s in rows] + [(None, None, None, None), (7, "", "x", 0.0), (7, "", "x", 0.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q, _ in rows] + [(None, 1, 0), (3, None, 0), (5, 9, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = op8_quality_classifier(spark, str(tmp_path)).collect()
    truth = {k: q for k, _, q, _ in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None]
    assert len(got) == docs.count() and len(held) > 90
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert fit(docs, labels).scores([b"x"]).tolist() == fit(docs, labels).scores([b"x"]).tolist()


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in score(docs, fit(docs, labels)).collect()} == {0.5}
    assert score(docs.limit(0), fit(docs, labels)).count() == 0


def test_long_texts_and_shared_ids(spark):
    long = "good words here " * 150_000
    docs = spark.createDataFrame([(1, long), (1, "bad"), (2, "bad " * 50), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = fit(docs, labels)
    found = score(docs, model).collect()
    assert len(found) == 4 and all(0 <= r["score"] <= 1 for r in found)
    assert model.scores([long.encode()]).tolist() == fit(docs.repartition(3), labels).scores([long.encode()]).tolist()
