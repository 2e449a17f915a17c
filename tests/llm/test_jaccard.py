import random
import re

import numpy as np
import pytest

from riskloom.llm import jaccard
from riskloom.llm.jaccard import first_pivots, jaccard_groups, op13_ngram_jaccard


def members(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, percent=85):
    sets = [members(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, groups=12, copies=9, edits=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    out = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([5, 40, 150, 400]))
        if rng.random() < 0.6:
            at = rng.randrange(len(base))
            base[at:at] = passage
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = rng.choices(words, k=rng.randrange(2))
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, region string, node int, n int")


def test_matches_brute_force_with_odd_rows(spark, tmp_path):
    rows = corpus(1) + [(500, None), (501, ""), (502, " \t\n"), (503, "one two"), (504, "ONE  two"), (505, "one two three"), (506, "a b c d"), (507, "A B c d")]
    rows += [rows[0], rows[1], (rows[2][0], rows[3][1]), (None, rows[4][1]), (None, "alone in the world today"), (508, "Ä b c d e"), (509, "ä b c d e")]
    rows += [(510, "the very long one " * 30000), (511, "the very long one " * 40000 + "."), (512, " ".join(str(i) for i in range(30000))), (513, " ".join(str(i) for i in range(300, 31000)))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in op13_ngram_jaccard(spark, str(tmp_path)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed,percent", [(2, 85), (3, 60)])
def test_regions_are_divided_and_joined_exactly(spark, monkeypatch, seed, percent):
    """Tiny regions and few pivots, so that every level of the recursion is taken; one large group of near copies."""
    monkeypatch.setattr(jaccard, "REGION", 3)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rows = corpus(seed, groups=6) + [(1000 + i, t) for i, t in corpus(seed + 10, groups=1, copies=70, edits=60)]
    got = sorted((tuple(r) for r in jaccard_groups(frame(spark, rows).repartition(3), percent=percent).collect()), key=str)
    assert got == brute(rows, percent)


def test_order_of_shingles_does_not_matter(spark, monkeypatch):
    rows = corpus(5)
    want = brute(rows)
    monkeypatch.setattr(jaccard, "OFTEN", 1)
    monkeypatch.setattr(jaccard, "SLOTS", 97)
    assert sorted((tuple(r) for r in jaccard_groups(frame(spark, rows)).collect()), key=str) == want


def test_linked_sets_share_a_first_region():
    rng = random.Random(7)
    for _ in range(3000):
        size = rng.choice([1, 2, 5, 6, 7, 8, 12, 31, 32, 37, 64, 75, 127, 128, 140, 255, 256, 300])
        a = {rng.getrandbits(64) for _ in range(size)}
        b = set(a)
        for x in rng.sample(sorted(a), rng.randrange(size * 15 // 100 + 1)):
            b.discard(x)
        while rng.random() < 0.9:
            more = b | {rng.getrandbits(64)}
            if 100 * len(a & more) < 85 * len(a | more):
                break
            b = more
        assert 100 * len(a & b) >= 85 * len(a | b)
        one, two = (first_pivots(np.array(sorted(x), np.uint64), 85) for x in (a, b))
        assert set(one.tolist()) & set(two.tolist())
        assert len(one) <= 0.36 * len(a) + 4 and len(two) <= 0.36 * len(b) + 4


def test_unlinked_near_copies_are_not_joined_pair_by_pair(spark, monkeypatch):
    """200 near copies of one text, about half of each its own: few of the 19,900 pairs leave the join of regions."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=160)
    texts = []
    for _ in range(200):
        text = list(base)
        for at in rng.sample(range(160), 18):
            text[at] = rng.choice(words)
        texts.append(" ".join(text))
    rows, joined, before = list(enumerate(texts)), [], jaccard._pairs

    def counted(*args):
        found = before(*args)
        joined.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_pairs", counted)
    assert sorted((tuple(r) for r in jaccard_groups(frame(spark, rows)).collect()), key=str) == brute(rows)
    assert sum(joined) < 400


def test_no_rows(spark):
    assert jaccard_groups(frame(spark, [])).collect() == []
    assert [tuple(r) for r in jaccard_groups(frame(spark, [(1, None)])).collect()] == [(1, 0, 1)]
