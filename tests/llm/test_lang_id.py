from hoptrail.llm import lang_id, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op6_language_id(spark, sf).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert 0.15 < len(held) / len(out) < 0.35
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_against_plain_profiles(spark):
    from collections import Counter

    train = [("x", "Aba cab"), ("x", "aba"), ("y", "zzq qz"), (None, "ignored"), ("y", None)]

    def grams(text):
        c = Counter()
        for w in text.lower().split():
            w = f"_{w}_"
            c.update(g for n in (1, 2, 3) for i in range(len(w) - n + 1) if (g := w[i : i + n]) != "_")
        return c

    number = lambda g: sum(ord(ch) << 21 * (len(g) - 1 - i) for i, ch in enumerate(g))
    df = spark.createDataFrame(train, "lang string, text string")
    for lang in "xy":
        c = sum((grams(t) for a, t in train if a == lang and t), Counter())
        want = [number(g) for g, _ in sorted(c.items(), key=lambda x: (-x[1], number(x[0])))]
        got = [r.gram for r in lang_id.profiles(df).filter(f"lang = '{lang}'").orderBy("place").collect()]
        assert got == want
    ask = spark.createDataFrame([(1, "cab aba"), (2, "qzz"), (3, None), (4, "12 !"), (5, ""), (6, "a" * 30_000), (6, "_")], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred) for r in lang_id.predict(ask, lang_id.profiles(df)).collect())
    assert got == [(1, "x"), (2, "y"), (3, "und"), (4, "und"), (5, "und"), (6, "und"), (6, "x")]
    none = lang_id.predict(ask, lang_id.profiles(df.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert lang_id.predict(ask.limit(0), lang_id.profiles(df)).count() == 0


def test_distance_against_brute_force_and_clashing_names(spark):
    """Out-of-place distances of whole documents, summed n-gram by n-gram."""
    import random
    from collections import Counter

    rng = random.Random(4)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))
    train = spark.createDataFrame([(lang, say(letters, 60)) for lang, letters in (("p", "abcdé"), ("q", "cdefg"), ("r", "efgab"))], "lang string, text string")
    size = 40
    rows = lang_id.profiles(train, profile_size=size).collect()
    places = {(r.lang, r.gram): r.place for r in rows}
    langs = sorted({r.lang for r in rows})
    assert all(sorted(r.place for r in rows if r.lang == lang) == list(range(size)) for lang in langs)

    def nearest(text):
        c = Counter(lang_id.packed_grams("_" + "_".join(text.split()) + "_").tolist())
        top = [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]]
        far = {lang: sum(abs(places[lang, g] - i) if (lang, g) in places else size for i, g in enumerate(top)) for lang in langs}
        best = min(langs, key=lambda lang: (far[lang], lang))
        return best, max(0.0, 1 - far[best] / (size * len(top)))

    docs = [(i, say(rng.choice(["abcdé", "cdefg", "efgab", "abg"]), rng.randint(1, 80))) for i in range(60)]
    ask = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as _letters", "2 as row", "3 as letters")
    out = lang_id.predict(ask, lang_id.profiles(train, profile_size=size), profile_size=size).collect()
    assert len(out) == len(docs)
    for r in out:
        lang, score = nearest(r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-12 and (r._letters, r.row, r.letters) == (1, 2, 3)
