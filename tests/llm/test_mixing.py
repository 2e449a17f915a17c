import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing
from riskloom.llm.mixing import KINDS, ORDERS, Code, Learner, Mixer, coded, contexts, decisions, halves, log_odds, op3_lm_scoring, scored, token_counts, words
from riskloom.llm.shared import joined_bytes


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "é", "ing", "st"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rare = lambda: "".join(rng.choice(parts) for _ in range(4))
    phrases = [" ".join(rng.choices(vocabulary, weights, k=3)) for _ in range(200)]  # texts have an order to learn
    return [(k, " ".join(rng.choices(phrases, k=rng.randrange(1, 27)) + [rare()] * (k % 3 > 0)).title(), "x") for k in range(n)]


CODE = Code(np.bincount(np.frombuffer(b"the cat and the hat \n", np.uint8), minlength=256))
MASK = (1 << 64) - 1


def learner(texts):
    out = Learner(CODE, 0.02)
    for x in texts:
        out.learn(x)
    out.flush()
    return out


def mixer(state):
    odds = []
    for table in state.counts:
        value, level = log_odds(*halves(table))
        odds.append((np.rint(np.clip(value, -15, 15) * 256).astype(np.int16) << 3) + level.astype(np.int16))
    return Mixer(CODE, odds, state.weights, state.seen, state.ones)


def plain_contexts(text, i):
    """The contexts of byte i of a coded text, as plain values."""
    begin = max(text.rfind(b" ", 0, i), -1) + 1
    before = text[:begin].split()[-1] if begin else b""
    return [*(text[max(0, i - o) : i] for o in ORDERS), text[begin:i], (before, text[begin:i])]


def test_contexts_are_those_of_the_plain_model():
    texts = [coded(x) for x in (b"The cat  and the cat", b"", b"and the cat and", b"a \xc3\xa9\x00 a")]
    data, starts = joined_bytes(texts)
    found = contexts(data, starts)
    want = [plain_contexts(x, i) for x in texts for i in range(len(x))]
    for k in range(KINDS):
        names = {}
        for h, w in zip(found[k].tolist(), (x[k] for x in want)):
            assert names.setdefault(h, w) == w
        assert len(names) == len({x[k] for x in want})


def test_log10_is_the_plain_sum_over_bits():
    state = learner([b"the cat sat on the mat and the hat", b"and the cat sat"] * 4)
    model = mixer(state)
    for text in (b"the cat sat", b"", b"zebra \xff", b"cat the sat"):
        data, starts = joined_bytes([coded(text)])
        bits = decisions(data, contexts(data, starts), CODE, 0, len(data))
        total, at = 0.0, 0
        for byte in coded(text):
            for depth in range(CODE.length[byte]):
                xs, gate = [], 0
                for k in range(KINDS):
                    packed = int(model.odds[k][bits.slots[k][at]])
                    xs.append((packed >> 3) / 256)
                    if packed & 7:
                        gate = (k + 1) * 4 + (packed & 7) - 1
                gate = gate * 8 + min(depth, 7)
                odds = max(-11.0, min(11.0, sum(w * x for w, x in zip(model.weights[gate], [*xs, 1.0]))))
                place = (max(-8.0, min(8 - 1e-3, odds)) + 8) * 2
                low, share = int(place), place - int(place)
                cell = lambda j: (model.ones[gate, j] + 8 / (1 + math.exp(8 - j / 2))) / (model.seen[gate, j] + 8)  # noqa: B023, E731
                chance = 0.5 * (cell(low) * (1 - share) + cell(low + 1) * share) + 0.5 / (1 + math.exp(-odds))
                total += math.log10(chance if CODE.bit[CODE.start[byte] + depth] else 1 - chance)
                at += 1
        assert model.log10([text])[0] == pytest.approx(total, rel=1e-4)
    assert model.log10([b"the cat sat on the mat"])[0] > model.log10([b"mat the on sat cat the"])[0]
    both = model.log10([b"the cat", b"and"])
    assert both[0] == pytest.approx(model.log10([b"the cat"])[0]) and both[1] == pytest.approx(model.log10([b"and"])[0])


def test_learning_is_online():
    """Each step is predicted with the counts of the steps before: plain counts of one context agree."""
    texts = [b"aa bb aa", b"aa bb cc"]
    state = learner(texts)
    data, starts = joined_bytes([coded(b"aa bb")])
    bits = decisions(data, contexts(data, starts), CODE, 0, 1)
    zeros, ones = halves(state.counts[KINDS - 2][bits.slots[KINDS - 2]])
    # the word-so-far context at a word's begin was met six times, four of these before an "a"
    assert (zeros + ones)[0] == 6 and (zeros + ones)[-1] >= 3
    again = learner(texts)
    assert all(np.array_equal(a, b) for a, b in zip(state.counts, again.counts)) and np.array_equal(state.weights, again.weights)


def test_code_is_a_prefix_code():
    paths = ["".join(map(str, CODE.bit[CODE.start[b] : CODE.start[b] + CODE.length[b]])) for b in range(256)]
    assert len(set(paths)) == 256 and sum(2.0 ** -len(p) for p in paths) == 1
    assert len(paths[ord(" ")]) < len(paths[0]) and CODE.node.max() == 254
    assert not any(b.startswith(a) for a in paths for b in paths if a != b)


def test_probabilities_of_the_next_byte_add_up():
    model = mixer(learner([b"the cat sat on the mat and the hat"] * 3))
    total = 0.0
    for byte in range(256):
        data, starts = joined_bytes([b"the ca" + bytes([byte]) + b"\n"])
        bits = decisions(data, contexts(data, starts), CODE, 6, 7)
        chance = model.chance(bits)
        total += np.prod(np.where(bits.bit == 1, chance, 1 - chance))
    assert total == pytest.approx(1, abs=1e-4)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(corpus(2000, 2), "doc_id long, text string, token string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (2, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append({r["id"]: r["score"] for r in scored(docs.repartition(n), F.col("doc_id") % 3 > 0, shard=1 << 16).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == pytest.approx(found[1], rel=1e-12)


def test_matches_plain_counts_and_beats_them(spark, tmp_path):
    rows = corpus(500, 1) + [(None, "The end", None), (501, None, "a"), (502, "", "b"), (3, "again again", "b"), (505, "unbroken" * 3000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string")
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = op3_lm_scoring(spark, str(tmp_path / "a")).collect()
    held = lambda k: k is None or zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(itertools.chain.from_iterable(words((t or "").encode()) for k, t, _ in rows if not held(k)))
    n, v = sum(counts.values()), len(counts)
    want = {}
    for k, t, _ in rows:
        tokens = words((t or "").encode())
        want.setdefault(k, []).append((len(tokens), sum(counts[x] > 0 for x in tokens), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), 6)))
    have = {}
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n and r["score"] < 0 and math.isfinite(r["score"])
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["n_known"], round(r["base_score"], 6)))
    assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}
    new = [r for r in got if r["held_out"] and r["n_known"] == r["n_tokens"]]  # the base has one event for all unknown words
    assert len(new) > 5 and sum(r["score"] for r in new) > sum(r["base_score"] for r in new)


def test_head_size_changes_nothing(spark):
    docs = spark.createDataFrame(corpus(60, 3), "doc_id long, text string, token string")
    a, b = ({r["id"]: (r["n_known"], round(r["base_score"], 8), round(r["score"], 8)) for r in scored(docs, F.col("doc_id") % 3 > 0, head=h).collect()} for h in (1, 1000))
    assert a == b


def test_nothing_learned_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = scored(docs, F.lit(False)).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(3, 0, 0), (1, 0, 0)} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert op3_lm_scoring(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("counted", [1 << 17, 3])
def test_tokens_are_counted_across_batches(spark, monkeypatch, counted):
    """Batches of four rows: the sums are those of all rows, whether a task passes them on once or often."""
    monkeypatch.setattr(mixing, "COUNTED", counted)
    docs = spark.createDataFrame([(("b a", "a a C", None, "d")[k % 4], k % 4 != 3) for k in range(40)], "text string, learned boolean").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        found = {bytes(r["token"]): r["n"] for r in token_counts(docs).collect()}
    finally:
        spark.conf.set(name, before)
    assert found == {b"a": 30, b"b": 10, b"c": 10, b"d": 0, b"": 30}


def test_shuffles_are_let_go_before_the_next_large_one(spark, monkeypatch):
    """After tokens are counted, after the shards are learned, and after these are added up."""
    calls = []
    for name in ("saved", "release"):
        before = getattr(mixing, name)
        monkeypatch.setattr(mixing, name, lambda x, name=name, before=before: (calls.append(name), before(x))[1])
    scored(spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), F.lit(True))
    assert calls == ["saved", "release", "saved", "release", "release", "saved"]
