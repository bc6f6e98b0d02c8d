import hashlib
import random
import re

from hoptrail.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for key, item in items:
        v = words(item)
        for win in [v] if 0 < len(v) < n else [v[j : j + n] for j in range(len(v) - n + 1)]:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(key)
    return len(w), len(hit), found


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["ab", "Éa", "c1", "dd", "e"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 9, 10, 14, 30])))) for i in range(40)] + [(7, "ab, c1!"), (50, None), (51, ""), (None, "zz yy xx")]
    docs = []
    for i in range(150):
        t = " ".join(rng.choice(vocab + ["q"] * 3) for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            t += ".\n" + rng.choice(items[:40])[1].upper() + " tail"
        docs.append((i, t))
    docs += [(200, None), (201, ""), (None, "ab"), (3, docs[3][1]), (202, "a zz-yy xx")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "n_hit")
    b = spark.createDataFrame(items, "item_id long, text string")
    for how in ({}, {"block_chars": 300, "shard_bytes": 200}):
        out = decontaminate.find_overlaps(d, b, **how).collect()
        assert len(out) == len(docs)
        for r in out:
            n, hit, found = brute(r.text, items)
            assert (r.n_words, r.n_hit, {m.item_id for m in r.matches}) == (n, hit, found), r.text
            for m in r.matches:
                if m.item_id is not None and m.item_id != 7:
                    v = words(dict(items)[m.item_id])
                    assert words(r.text)[m.doc_word : m.doc_word + m.words] == v[m.item_word : m.item_word + m.words]
    kept = decontaminate.remove_contaminated(d, b).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in out if not r.n_hit}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate.find_overlaps(d, b).first()
    assert (r.n_words, r.n_hit, r.matches) == (2, 0, [])
    assert decontaminate.find_overlaps(d.limit(0), b).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op9_decontaminate(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        if r.contaminated or r.doc_id % 20 == 0:
            n, hit, found = brute(docs[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_suffix_array_is_in_order_of_all_words():
    rng = random.Random(2)
    docs = ["", "a", "a b a b a b", "a b a b a b", "c " * 40, *(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 50))) for _ in range(30))]
    raw, offsets = decontaminate.string_buffers(decontaminate.pa.array(docs))
    hashes, first = decontaminate.hashed_words(raw, offsets, decontaminate.ALNUM)
    array = decontaminate.SuffixArray(hashes, first)
    suffixes = [tuple(array.words[i : array.ends[i]].tolist()) for i in array.order]
    assert suffixes == sorted(suffixes) and sorted(array.order.tolist()) == list(range(len(hashes)))


def test_clashing_names_and_many_blocks(spark):
    """A benchmark of fifty blocks; columns named like the operator's own stay."""
    items = [(i, f"w{i} x y z u v w s t r q{i}") for i in range(50)]
    docs = [(i, f"before w{i} x y z u v w s t r q{i} after") for i in range(0, 60, 2)] + [(99, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as spans", "'r' as row", "1 as n_words", "7 as digest")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_overlaps(d, b, block_chars=40).collect()
    assert len(out) == len(docs)
    for r in out:
        n, hit, found = brute(r.text, items)
        assert (r.n_words, r.n_hit, {m.item_id for m in r.matches}, r.spans, r.row, r.digest) == (n, hit, found, r.doc_id, "r", 7)
    kept = decontaminate.remove_contaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {50, 52, 54, 56, 58, 99}


def test_shards_without_words(spark):
    """One-row tables, and a partition of its own beside others with words."""
    b = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    for text in (None, "", "--- !!"):
        d = spark.createDataFrame([(1, text)], "doc_id long, text string")
        r = decontaminate.find_overlaps(d, b).first()
        assert (r.n_words, r.n_hit, r.matches) == (0, 0, [])
        assert decontaminate.remove_contaminated(d, b).count() == 1
    d = spark.createDataFrame([(1, "x a b c d e f g h i j k"), (2, "--- !!"), (3, None)], "doc_id long, text string").repartition(3, "doc_id")
    assert {r.doc_id: r.n_hit for r in decontaminate.find_overlaps(d, b, shard_bytes=1).collect()} == {1: 11, 2: 0, 3: 0}
    assert {r.doc_id for r in decontaminate.remove_contaminated(d, b.limit(0)).collect()} == {1, 2, 3}
