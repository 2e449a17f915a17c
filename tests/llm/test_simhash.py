import random

import numpy as np
import xxhash

from riskloom.llm.simhash import fingerprint, near_duplicates, op1_simhash_near_dedup


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(prints[i] ^ prints[j]).count("1") <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for (k, _), g in zip(rows, group):
        if k is not None:
            least[g] = min(k, least.get(g, k))
    return sorted(((k, p, least.get(g)) for (k, _), p, g in zip(rows, prints, group)), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "déjà", "x", "lorem", "ipsum"]
    rows = [(None, None), (3, None), (4, ""), (5, " \t\n"), (9, "one"), (9, "one"), (2, "ONE"), (None, "one two")]
    for base in range(8):
        text = [rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.choice((3, 40, 300)))]
        for _ in range(4):
            copy = list(text)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((rng.randrange(1000), " ".join(copy)))
    docs = spark.createDataFrame([(k, t, "n", 1) for k, t in rows], "doc_id long, text string, node string, fp int")
    for parts in (2, 3, 4):
        got = sorted(((r.id, r.fp & (1 << 64) - 1, r.component) for r in near_duplicates(docs, parts=parts).collect()), key=str)
        assert got == brute(rows)


def test_long_chain_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op1_simhash_near_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 0


def test_components_of_a_chain(spark):
    from riskloom.llm.shared import components

    rng = np.random.default_rng(1)
    order = rng.permutation(60).tolist()
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(59)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(60)} | {100: 100, 101: 100}


def test_fingerprint_blocks():
    text = b" ".join(b"w%d" % (i % 977) for i in range(5000))
    assert fingerprint(text, block=64) == fingerprint(text) == plain(text.decode())
