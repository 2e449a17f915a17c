import random

import corpus_pipeline
from riskloom.llm.langid import fit, predict
from riskloom.llm.leaks import LEAST, budget
from riskloom.llm.pieces import decoded
from tests.llm.test_leaks import plain, within
from tests.llm.test_near_copies import groups_of
from tests.llm.test_suffixes import word_spans_first

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(seed):
    rng = random.Random(seed)
    en, fr = ["the", "and", "thing", "house", "walks", "over"], ["le", "été", "maison", "où", "dans", "près"]
    words = lambda some, n: " ".join(rng.choice(some) + rng.choice("abcdefghij") * rng.randrange(3) for _ in range(n))
    bench = [words(en, 25), words(fr, 30), "tiny"]
    passage = words(en, 90)
    texts = [(words(en if k % 2 else fr, rng.randrange(30, 200)), "en" if k % 2 else "fr") for k in range(30)]
    texts += [(texts[1][0], "en")] * 3 + [(texts[2][0] + " fin", "fr"), (None, "en"), ("", None), ("12 34 !", "en"), ("...", "fr")]
    texts += [(f"{words(en, 60)} {passage} {words(en, 50)}", "en") for _ in range(4)]
    texts += [(f"{words(en, 40)} {bench[0].upper()} {words(en, 30)}", "en"), (f"{words(fr, 20)} {bench[1][:-4]} {words(fr, 30)}", "fr")]
    out = [(k, t, lang, f"s{k % 3}", len(t) if t is not None else None) for k, (t, lang) in enumerate(texts)]
    out[5] = (None, *out[5][1:])
    return out + [out[7], out[7], (None, *out[1][1:]), (8, *out[9][1:])], list(enumerate(bench))


def as_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_stages_match_brute_force(spark, tmp_path):
    data, bench = rows(1)
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    named = [name for name, _ in corpus_pipeline.STAGES]
    assert named == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "sentencepiece"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    one = stage["language_id"](spark, docs, str(tmp_path))
    kept = as_rows(one)
    scores = [r["text"] for r in predict(docs, fit(docs)).where("lang_pred <> 'und' and score >= 0.5").collect()]
    assert one.columns == COLUMNS and sorted(r[1] for r in kept) == sorted(scores) and "12 34 !" not in scores and None not in scores

    two = stage["near_dedup"](spark, one, str(tmp_path))
    single = as_rows(two)
    late = [(k if k is not None else 10**9 + n, t) for n, (k, t, *_) in enumerate(kept)]
    first = {}
    for g, (k, t) in zip(groups_of(late), late):
        first[g] = min(k, first.get(g, k))
    assert two.columns == COLUMNS and len(single) == len(first) < len(kept)
    assert sorted(r[0] for r in single if r[0] is not None) == sorted(k for k in first.values() if k < 10**9)

    three = stage["suffix_dedup"](spark, two, str(tmp_path))
    texts = spark.createDataFrame([(r[1],) for r in single], "text string").selectExpr("text", "xxhash64(text) a", "xxhash64(7, text) b").collect()
    keys = {r["text"].encode(): (r["a"], r["b"]) for r in texts}
    spans = word_spans_first([r[1] for r in single], 50, keys.__getitem__)
    want = {}
    for r, cut in zip(single, spans):
        raw = bytearray(r[1].encode())
        for a, b in reversed(cut):
            del raw[a:b]
        if raw:
            want[r[0]] = bytes(raw).decode()
    got = {r[0]: r for r in as_rows(three)}
    assert any(spans) and three.columns == COLUMNS and {k: r[1] for k, r in got.items()} == want
    assert all(r[4] == len(r[1]) for r in got.values())

    four = stage["decontamination"](spark, three, str(tmp_path))
    items = [plain(t) for _, t in bench if len(plain(t)) >= LEAST]
    clean = [r for r in as_rows(three) if all(within(i, plain(r[1])) > budget(len(i)) for i in items)]
    assert as_rows(four) == clean and len(clean) < len(got)

    five = stage["sentencepiece"](spark, four, str(tmp_path))
    assert sorted(r["decoded"] for r in decoded(five).collect()) == sorted(r[1] for r in clean)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), list(r["pieces"])) for r in whole) == sorted((str(r["doc_id"]), list(r["pieces"])) for r in five.collect())
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
