import random
import re
from collections import Counter

from hoptrail.llm import quality_rules as q
from hoptrail.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Least share of held-back bad documents that the learned rules find.
BAD_FOUND = 0.5


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    hit = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def got(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_stats_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\x0b ", "a", "a b c d e a b c d e", "é🙂 x\x1cy", "a a a a a a a", "x y z"]
    for _ in range(200):
        texts.append("".join(rng.choice(["a", "b", "cé", "#|", "\n"]) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randint(0, 80))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as n_words", "1 as kept")
    out = q.text_stats(df).collect()
    assert len(out) == len(texts)
    for r in out:
        assert got(r) == brute(texts[r.doc_id]), texts[r.doc_id]
    assert q.text_stats(df.limit(0)).count() == 0


def test_cover_finds_planted_rules_and_keeps_good_rows():
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        r = {f: rng.random() for f in q.FEATURES}
        r["bad"] = int((r["symbol_ratio"] > 0.8 and r["mean_word"] < 0.5) or r["dup_line_ratio"] > 0.9)
        rows.append(r)
    rules = q.cover(rows)
    caught = [any(x.covers(r) for x in rules.rules) for r in rows]
    bad = [r["bad"] for r in rows]
    assert sum(c and b for c, b in zip(caught, bad)) > 0.9 * sum(bad)
    assert sum(c and not b for c, b in zip(caught, bad)) < 0.02 * len(bad)
    assert q.cover([]).rules == [] and q.cover([dict(r, bad=0) for r in rows]).rules == []


def test_without_labels_all_passing_documents_stay(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "short"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.doc_id for r in q.keep_good(docs, none).collect()] == [1]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op4_quality_rules(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        assert got(r) == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    good = [r.kept for r in out if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) > 0.97 * len(good)


def test_clashing_names_and_contradicting_labels(spark):
    names = ["_words", "_lines", "_hashes", "_windows", "_n_lines", "_n_short", "_some", "_sorted", "_same", "_starts", "_row"]
    docs = spark.createDataFrame([(i, f"some words {i} " * (1 + i % 7)) for i in range(40)], "doc_id long, text string")
    given = docs.select("*", *[q.F.lit(k).alias(n) for k, n in enumerate(names)])
    for r in q.judge(given, q.DecisionList()).collect():
        assert [r[n] for n in names] == list(range(len(names))) and r.n_words == len(r.text.split())
    labels = spark.createDataFrame([(i, q) for i in range(40) for q in ([0, 1] if i % 5 == 0 else [1])], "doc_id long, quality int")
    assert q.keep_good(given, labels).columns == given.columns
    first, again = (str([str(x) for x in q.learn(docs, d).rules]) for d in (labels, labels.orderBy("quality", "doc_id").repartition(3)))
    assert first == again


def test_rules_reject_bad_documents_that_were_held_back(spark):
    """Learned from the labels of three quarters of the documents, judged on the other quarter."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = q.F.crc32(q.F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    rules = q.learn(docs, labels.filter(~held))
    out = q.judge(docs.join(labels.filter(held), "doc_id"), rules).select("quality", "base_failed", "kept").collect()
    open_ = [r for r in out if not r.base_failed]
    bad, good = [r for r in open_ if not r.quality], [r for r in open_ if r.quality]
    assert rules.rules and sum(r.kept for r in good) > 0.97 * len(good)
    assert bad and sum(not r.kept for r in bad) > BAD_FOUND * len(bad), (len(bad), sum(not r.kept for r in bad), len(good))


def test_ids_of_texts_and_a_long_text(spark):
    docs = spark.createDataFrame([(f"d{i}", ("some plain words " if i % 2 else "## $$ ** ## %% ") * (3 + i % 9)) for i in range(400)] + [("long", "word and more " * 130_000)], "doc_id string, text string")
    labels = docs.filter("doc_id != 'long'").selectExpr("doc_id", "int(substr(doc_id, 2)) % 2 as quality")
    rules = q.learn(docs, labels)
    out = {r.doc_id: r for r in q.judge(docs, rules).select("doc_id", "n_words", "n_repeat_words", "kept").collect()}
    assert out["long"].n_words == out["long"].n_repeat_words == 390_000 and len(out) == 401
