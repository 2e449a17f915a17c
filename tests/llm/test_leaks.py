import random
import re
import time

import numpy as np

from riskloom.llm.leaks import HELD, LEAST, Items, aligned, budget, found, normalised, op5_benchmark_decontamination, with_leaks


def plain(text):
    return " ".join(text.lower().split())


def within(item, text):
    """The least edit distance of the item to any passage of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def material(seed):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "é", "ing", "st", "ß"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize()

    def edited(text, times):
        chars = list(text)
        for _ in range(times):
            at = rng.randrange(len(chars))
            rng.choice([lambda: chars.pop(at), lambda: chars.insert(at, "#"), lambda: chars.__setitem__(at, "~")])()
        return "".join(chars)

    items = [prose(rng.randrange(8, 30)) for _ in range(12)] + ["short", None, "aaaa " * 12, "x" * 60]
    texts = [None, "", "short", prose(50), "x" * 500, "aaaa " * 100, items[0]]
    for item in items[:12]:
        for times in (0, 1, 3, 6, 12, 25):
            texts.append(prose(20) + " " + edited(item, times).replace(" ", "\n  ") + " " + prose(20).upper())
        texts += [item[: len(item) // 2] + prose(10), edited(item, 4) + ".", prose(5) + item.upper()]
    return texts, items


def test_same_pairs_as_brute_force(spark, tmp_path):
    texts, items = material(1)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, items[1], 2)], "doc_id long, text string, leaks int")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for k, t in [*enumerate(texts), (None, items[1])]:
        for n, item in enumerate(items):
            if item and len(plain(item)) < LEAST:
                if re.search(rf"(?<![^\W_]){re.escape(plain(item))}(?![^\W_])", plain(t or "")):
                    want.add((k, n, 0))
            elif item:
                d = within(plain(item), plain(t or ""))
                if d <= budget(len(plain(item))):
                    want.add((k, n, d))
    for size in (4 << 20, 300):
        rows = with_leaks(docs, benchmark, pass_chars=size).collect()
        assert len(rows) == len(texts) + 1
        assert {(r["doc_id"], x["item_id"], x["distance"]) for r in rows for x in r["leaks"]} == want
    for r in rows:
        for x in r["leaks"]:
            passage, item = plain(r["text"][x["start"] : x["stop"]]), plain(items[x["item_id"]])
            assert within(item, passage) == x["distance"] and abs(len(passage) - len(item)) <= x["distance"] + 1
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = op5_benchmark_decontamination(spark, str(tmp_path))
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["leaks"] for r in with_leaks(docs, none).collect()] == [[]]
    assert with_leaks(docs.limit(0), none).collect() == []


def test_alignment():
    item = normalised("abcdefgh")[0]
    regions = np.stack([np.pad(normalised(t)[0], (0, 20))[:14] for t in ("xxabcdefghxx", "xabcefghxx", "abcdzefgh")])
    distance, start, stop = aligned(item, regions)
    assert distance.tolist() == [0, 1, 1] and (start[0], stop[0]) == (2, 10)
    assert found(Items([], [], 0.1), ["some text here"]) == [[]]


def test_normalised():
    points, at = normalised("  A\t\nİb ")
    assert "".join(map(chr, points)) == "a İb" and at.tolist() == [2, 3, 5, 6]


def test_common_grams_and_long_texts():
    """Items of one template share most q-grams; a long text is full of them."""
    rng = random.Random(3)
    template = "which of the following answers is the right one for question {} of the list that was given above"
    items = [template.format("".join(rng.choice("abcdefghij") for _ in range(30))) for _ in range(150)]
    index = Items(list(range(len(items))), [normalised(x)[0] for x in items], 0.1)
    assert max(len(x) for x, _, _ in index.hits(*[np.concatenate([normalised(template * 300)[0]]), np.array([0, len(normalised(template * 300)[0])])])) < HELD + 200
    long = (template.format("nothing") + " ") * 400 + items[7] + " " + items[9].replace("given", "givn") + " word" * 100_000
    got = found(index, [long, "", items[3]])
    assert [(n, d) for n, d, _, _ in got[0]] == [(7, 0), (9, 1)] and got[1] == [] and [(n, d) for n, d, _, _ in got[2]] == [(3, 0)]


def short_by_find(item, text):
    at = text.find(item)
    while at >= 0 and (text[max(0, at - 1) : at].isalnum() and item[0].isalnum() or text[at + len(item) : at + len(item) + 1].isalnum() and item[-1].isalnum()):
        at = text.find(item, at + 1)
    return at


def test_short_items_by_one_automaton():
    rng = random.Random(8)
    letters = "ab -é\x00\ud800"
    items = [plain("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))) for _ in range(300)] + ["a", "ab", "a"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 200))) for _ in range(60)] + ["", "ab", "a" * 3000]
    got = found(Items(list(range(len(items))), [normalised(x)[0] for x in items], 0.1), texts)
    for text, leaks in zip(texts, got):
        low = plain(text)
        want = {n: at for n, item in enumerate(items) if item and (at := short_by_find(item, low)) >= 0}
        assert [n for n, *_ in leaks] == sorted(want) and all(d == 0 for _, d, _, _ in leaks)
        places = normalised(text)[1]
        assert all(start == places[want[n]] for n, _, start, _ in leaks)


def test_many_short_items_cost_little():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(2000)) for _ in range(20)]
    longs = [normalised(" ".join(word() for _ in range(20)))[0] for _ in range(50)]
    none, many = (Items(list(range(50 + n)), longs + [normalised(f"{word()} {word()} {k % 97}")[0][: LEAST - 1] for k in range(n)], 0.1) for n in (0, 20_000))

    def seconds(items):
        took = []
        for _ in range(4):
            began = time.perf_counter()
            found(items, texts)
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(many) < 4 * seconds(none)  # searching item by item took some eighty times as long


def test_repeated_benchmark_rows_count_once(spark):
    docs = spark.createDataFrame([(1, "the short one is here"), (1, "the short one is here")], "doc_id long, text string")
    rows = [(7, "short one")] * 50 + [(8, "short one"), (None, "short one"), (None, "short one")]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    for size in (4 << 20, 9):
        got = with_leaks(docs, benchmark, pass_chars=size).collect()
        assert [sorted(x["item_id"] or 0 for x in r["leaks"]) for r in got] == [[0, 7, 8]] * 2
