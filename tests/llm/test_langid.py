import math
import random
from collections import Counter

import numpy as np

from riskloom.llm.langid import BUCKETS, ORDERS, code_points, fit, gram_counts, grams, op9_language_id, predict


def buckets_of(text):
    points, starts = code_points([text.encode()])
    return [b for bucket, inside in grams(points, starts) for b in bucket[inside].tolist()]


def corpus(n, seed):
    rng = random.Random(seed)
    words = {"en": ["the", "and", "thing", "house"], "fr": ["le", "été", "maison", "où"], "de": ["über", "straße", "und", "haus"]}
    return [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 30))), lang, 1.5) for k in range(n) for lang in [rng.choice(list(words))]]


def test_counts_and_posterior_match_plain_python(spark):
    rows = corpus(60, 1) + [(None, None, "en", 0.0), (7, "", "fr", 0.0), (8, "123 !", "de", None), (9, "abc", None, None), (9, "İstanbul", "de", 1.0), (10, "½ ² ①", "fr", 1.0), (11, "the " * 5000, "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    plain = Counter((lang, b) for _, t, lang, _ in rows if t is not None and lang for b in buckets_of(t))
    plain += Counter((lang, -1) for _, t, lang, _ in rows if t is not None and lang)
    assert {(r["lang"], r["bucket"]): r["n"] for r in gram_counts(docs).collect()} == dict(plain)
    (model,) = fit(docs)
    assert model.names == ["de", "en", "fr"]
    got = predict(docs, [model]).collect()
    parts = fit(docs, together=1)
    assert [x.names for x in parts] == [["de"], ["en"], ["fr"]]
    key = lambda r: (str(r["doc_id"]), str(r["text"]), str(r["lang"]))
    assert [(r["lang_pred"], round(r["score"], 5)) for r in sorted(predict(docs, parts).collect(), key=key)] == [(r["lang_pred"], round(r["score"], 5)) for r in sorted(got, key=key)]
    assert len(got) == len(rows)
    totals = {x: sum(n for (lang, b), n in plain.items() if lang == x and b >= 0) for x in model.names}
    n_docs = sum(plain[x, -1] for x in model.names)
    for r in got:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = [math.log(plain[x, -1] / n_docs) + sum(math.log((plain[x, b] + 0.5) / (totals[x] + 0.5 * BUCKETS)) for b in buckets_of(r["text"])) for x in model.names]
        assert r["lang_pred"] == model.names[int(np.argmax(logs))]
        assert abs(r["score"] - 1 / sum(math.exp(x - max(logs)) for x in logs)) < 1e-3


def test_held_out_accuracy_and_empty(spark, tmp_path):
    docs = spark.createDataFrame(corpus(400, 2), "doc_id long, text string, lang string, score double")
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = op9_language_id(spark, str(tmp_path / "a")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * len(got)
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert op9_language_id(spark, str(tmp_path / "b")).count() == 0
    assert ORDERS == (1, 2, 3)
