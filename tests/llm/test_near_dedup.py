import random

from hoptrail.llm import near_dedup


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, percent):
    sets = [(d, shingles(t, n)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if a is not None and b is not None and x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(d, len(s), find(d) if d is not None else None, d is None or find(d) == d) for d, s in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for family in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 4, 8, 20, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return [(i * 3, t) for i, t in enumerate(docs)]


def check(spark, docs, shingle, percent):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as component_id", "'x' as salt")
    out = near_dedup.near_duplicates(df, shingle=shingle, percent=percent).collect()
    assert len(out) == len(docs)
    want = brute(docs, shingle, percent)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out} == want


def test_against_brute_force(spark):
    docs = corpus(1) + [(1001, None), (1002, ""), (1003, " \n\t"), (1004, "One two"), (1005, "one TWO"), (None, "one two"), (1006, "Ünï x y"), (1007, "ünï x y")]
    check(spark, docs, 3, 85)


def test_five_word_shingles_and_repeats(spark):
    docs = corpus(2)
    check(spark, docs + docs[:5], 5, 80)


def test_empty_table_and_deduplicate(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(4, "a b c d e f"), (2, "a b c d e f"), (9, "other"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id for r in near_dedup.deduplicate(df).collect()), key=str) == [2, 9, None]
