import hashlib
import random
import re
import zlib

from hoptrail.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=24, times=3):
    """Every period tried at every place."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            part = w[start : i + q]
            if len(part) >= max(least, times * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, len(part), q))
    return sorted(out)


def collapsed(w, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_and_repeated_words():
    rng = random.Random(1)
    for _ in range(1_200):
        letters = rng.choice([1, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            base = [rng.randrange(letters + 1) for _ in range(rng.randint(1, 12))]
            at = rng.randint(0, len(w))
            w[at:at] = (base * 9)[: rng.randint(len(base), 9 * len(base))]
        for least, times in ((24, 3), (2, 2), (6, 2), (8, 4)):
            assert runs.runs_of(w, least, times) == brute(w, least, times), (w, least, times)


def test_equal_hashes_do_not_make_equal_words(monkeypatch):
    """With a prime of 7 most stretches have equal hashes; the words decide."""
    monkeypatch.setattr(runs, "_PRIME", 7)
    monkeypatch.setattr(runs, "_powers", runs.array("Q", [1]))
    rng = random.Random(2)
    for _ in range(300):
        base = [rng.randrange(3) for _ in range(rng.randint(14, 20))]
        w = [rng.randrange(3) for _ in range(rng.randint(0, 30))] + base * 4 + [rng.randrange(3) for _ in range(rng.randint(0, 30))]
        w[rng.randrange(len(w))] = 3
        assert runs.runs_of(w) == brute(w)


def test_long_texts():
    assert runs.runs_of([0] * 30_000) == [(0, 30_000, 1)]
    assert runs.runs_of([0, 1, 2, 3, 4] * 60_000) == [(0, 300_000, 5)]
    assert runs.runs_of(list(range(1_000)) * 300) == [(0, 300_000, 1_000)]


def test_rows(spark):
    texts = [None, "", " \n", "a " * 30, "x " + "a b\tc\n" * 9 + "é", "a" * 50, "A b " * 12 + "q " + "b a " * 13]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "z " * 24)], "doc_id long, text string").selectExpr("*", "1 as runs", "doc_id as row", "'k' as collapsed")
    out = runs.find_runs(df).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        w = WORD.findall(r.text or "")
        found = brute(w)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.row) == (len(w), found, collapsed(w, found), r.doc_id)
    assert runs.find_runs(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(out) == len(docs)
    seen = 0
    for doc_id, text in docs:
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if n > 1_500:
            continue
        found, r = brute(w), out[doc_id]
        seen += bool(found)
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
    assert seen > 5
