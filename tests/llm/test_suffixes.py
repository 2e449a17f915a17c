import hashlib
import re
import random
from collections import Counter

from riskloom.llm.suffixes import op10_suffix_array_dedup, with_repeated_spans, without_repeats


def brute(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    found = []
    for x in raw:
        covered = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans, at = [], 0
        while at < len(x):
            if covered[at]:
                end = at
                while end < len(x) and covered[end]:
                    end += 1
                spans.append((at, end))
                at = end
            else:
                at += 1
        found.append(spans)
    return found


def corpus(seed):
    rng = random.Random(seed)

    def fresh(n):
        return "".join(rng.choice("abcdefg é\n") for _ in range(n))

    base, passage, line = fresh(3000), fresh(700), fresh(90)
    texts = [None, "", "short", "a" * 399, "a" * 400, "a" * 1000, base, base, base[:1500] + "X" + base[1501:], fresh(800) + base[1000:1399], base[100:499], base[100:501]]
    texts += [fresh(rng.randrange(900)) + passage + fresh(rng.randrange(900)) for _ in range(12)]
    texts += [fresh(300) + passage[:398] + fresh(300), fresh(10) + passage[20:430], line * 30, line * 7, "😀" * 500, ("é" * 150 + "x") * 4]
    for _ in range(8):
        near = list(base)
        for _ in range(rng.randrange(1, 6)):
            near[rng.randrange(len(near))] = "#"
        texts.append("".join(near))
    return texts


def check(spark, texts, together):
    docs = spark.createDataFrame([(k, t, "s", 3) for k, t in enumerate(texts)], "doc_id long, text string, spans string, k1 int")
    got = {r["doc_id"]: [(x["start"], x["stop"]) for x in r["spans"]] for r in with_repeated_spans(docs, together=together).collect()}
    want = brute(texts)
    assert [got[k] for k in range(len(texts))] == want


def test_spans_match_brute_force(spark):
    check(spark, corpus(1), 1 << 15)


def test_large_groups_take_the_distributed_way(spark):
    check(spark, corpus(2), 3)
    check(spark, corpus(4), 8)


def test_query_and_cut_texts(spark, tmp_path):
    texts = corpus(3)
    docs = spark.createDataFrame([(k if k % 7 else None, t, "x") for k, t in enumerate(texts)] , "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = sorted((tuple(r) for r in op10_suffix_array_dedup(spark, str(tmp_path / "a")).collect()), key=str)
    want = []
    for k, (t, spans, passages) in enumerate(zip(texts, brute(texts), word_brute(texts, 50))):
        raw = bytearray((t or "").encode())
        for a, b in reversed(spans):
            del raw[a:b]
        want.append((k if k % 7 else None, len((t or "").encode()), sum(b - a for a, b in spans), len(spans), hashlib.sha256(raw).hexdigest(), sum(b - a for a, b in passages)))
    assert got == sorted(want, key=str)
    cut = without_repeats(docs)
    assert cut.columns == docs.columns
    kept = sorted(r["text"] for r in cut.collect() if r["text"])
    assert "short" in kept and all("�" not in x for x in kept)
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert op10_suffix_array_dedup(spark, str(tmp_path / "b")).count() == 0


def brute_first(texts, length, order):
    """Spans without each string's first place, in the given order of the texts (equal texts count once)."""
    raw = [(t or "").encode() for t in texts]
    seen, found = set(), {}
    for x in sorted(set(raw), key=order):
        covered = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if x[i : i + length] in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(x[i : i + length])
        found[x] = covered
    return [[(m.start(), m.end()) for m in re.finditer(b"\1+", found[x])] for x in raw]


def test_first_copy_stays(spark):
    for together in (1 << 15, 3):
        texts = corpus(6)
        keys = {r["text"] or "": (r["a"], r["b"]) for r in spark.createDataFrame([(t or "",) for t in texts], "text string").selectExpr("text", "xxhash64(text) a", "xxhash64(7, text) b").collect()}
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: [(x["start"], x["stop"]) for x in r["spans"]] for r in with_repeated_spans(docs, keep_first=True, together=together).collect()}
        assert [got[k] for k in range(len(texts))] == brute_first(texts, 400, lambda x: keys[x.decode()])


def word_corpus(seed):
    rng = random.Random(seed)

    def fresh(n):
        return "".join(rng.choice("abcdé") * rng.randrange(1, 4) + rng.choice((" ", "  ", "\n", " x ")) for _ in range(n))

    passage, base = fresh(60), fresh(300)
    texts = [None, "", " \n", "a b c", "x " * 49, "x " * 50, "y " * 200, base, base + "tail", fresh(20) + passage + fresh(20)]
    texts += [fresh(rng.randrange(90)) + " " + passage.replace("  ", "\n") + " " + fresh(rng.randrange(90)) for _ in range(9)]
    return texts + [" ".join(passage.split()[5:]), " ".join(passage.split()[3:52]), "z" * 5000]


def word_brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)] for x in raw]
    words = [tuple(x[a:b] for a, b in p) for x, p in zip(raw, places)]
    seen = Counter(w[i : i + length] for w in words for i in range(len(w) - length + 1))
    out = []
    for w, p in zip(words, places):
        covered = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if seen[w[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        out.append([(p[m.start()][0], p[m.end() - 1][1]) for m in re.finditer(b"\1+", covered)])
    return out


def word_spans_first(texts, length, order):
    """Spans without each passage's first place, in the given order of the texts (equal texts count once)."""
    seen, found = set(), {}
    for x in sorted({(t or "").encode() for t in texts}, key=order):
        places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)]
        words = tuple(x[a:b] for a, b in places)
        covered = bytearray(len(words))
        for i in range(len(words) - length + 1):
            if words[i : i + length] in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(words[i : i + length])
        found[x] = [(places[m.start()][0], places[m.end() - 1][1]) for m in re.finditer(b"\1+", covered)]
    return [found[(t or "").encode()] for t in texts]


def test_words_match_brute_force(spark):
    texts = word_corpus(2)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for length, together in ((50, 1 << 12), (50, 2), (3, 1 << 12), (1, 1 << 12)):
        got = {r["doc_id"]: [(x["start"], x["stop"]) for x in r["spans"]] for r in with_repeated_spans(docs, length=length, unit="words", together=together).collect()}
        assert [got[k] for k in range(len(texts))] == word_brute(texts, length), length
