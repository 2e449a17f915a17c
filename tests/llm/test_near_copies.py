import random

import numpy as np

import corpus_pipeline
from riskloom.llm import simhash
from riskloom.llm.simhash import near_copies


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_of(rows):
    found = [sets(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        before = list(group)
        for i in range(len(rows)):
            for j in range(i):
                if not (found[i] | found[j]) or len(found[i] & found[j]) / max(1, len(found[i] | found[j])) >= 0.8:
                    group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    return group


def brute(rows):
    group = groups_of(rows)
    least = {}
    for (k, _), g in zip(rows, group):
        if k is not None:
            least[g] = min(k, least.get(g, k))
    return [least.get(g) for g in group]


def corpus(seed):
    rng = random.Random(seed)
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two three four five"), (906, "one two three four five six")]
    for base in range(12):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice((40, 120, 400)))]
        for _ in range(5):
            copy = list(text)
            for _ in range(rng.randrange(1 + len(text) // 25)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    edge = [f"e{k}" for k in range(14)]  # ten shingles; the second text shares eight of ten in the union
    return rows + [(800, " ".join(edge)), (801, " ".join(edge[:12])), (802, " ".join(edge[:11])), (None, " ".join(edge))]


def test_groups_match_brute_force_jaccard(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for (k, t), g in zip(rows, brute(rows)):
        want.setdefault(k, []).append(g)
    found = near_copies(docs).collect()
    wrong = [r for r in found if r["component"] not in want[r["id"]]]
    assert len(found) == len(rows) and len(wrong) <= 2  # a pair of exactly 0.8 is met with a chance of 0.83
    assert all(r["component"] > min(want[r["id"]]) for r in wrong)  # what is missed is never a false link
    assert near_copies(docs.limit(0)).collect() == []


def test_stage_keeps_one_of_each_group(spark):
    rows = [(k, t) for k, t in corpus(4) if k is not None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    want = set(brute(rows))  # a pair at the threshold is met with a chance of 0.83; no other document is taken for a copy
    assert kept >= want and len(kept - want) <= 2 and len(kept) < len(rows) - 20
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").collect() == []


def test_unlinked_near_copies_are_ruled_out_before_whole_sets(spark, monkeypatch):
    """70 copies of one text whose similarities stay near 0.66: few pairs of them are worth whole sets."""
    rng = random.Random(7)
    base, rows = [f"w{k}" for k in range(150)], []
    for k in range(70):
        copy = list(base)
        for place in rng.sample(range(5, 145), 3):
            copy[place] = f"own{k}x{place}"
        rows.append((k, " ".join(copy)))
    asked, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    found = {r["id"]: r["component"] for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k] for k, _ in rows] == brute(rows)
    assert len(asked) == 2 and asked[1] < 400  # of 2,415 pairs; fingerprints alone leave 1,280


def test_parities_never_exceed_what_differs():
    rng = np.random.default_rng(2)
    for size in (1, 5, 60, 400, 3000):
        both = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        sets = [np.unique(np.concatenate((both, rng.integers(0, 1 << 63, k, dtype=np.uint64)))) for k in (0, 1, size // 9, size)]
        odd = simhash.parities([*sets, np.zeros(0, np.uint64)]).view(np.uint64)
        for i, a in enumerate(sets):
            assert not odd[-1].any() and np.bitwise_count(odd[i]).sum() <= len(a)
            for j, b in enumerate(sets):
                assert np.bitwise_count(odd[i] ^ odd[j]).sum() <= len(np.setxor1d(a, b))
