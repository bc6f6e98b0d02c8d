import random
import re

from hoptrail.llm import line_dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, least=20):
    """For documents in order of doc_id: the kept lines of each."""
    seen, out = [], {}
    for d, t in docs:
        kept = []
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                same = line in seen
                near = len(line) >= least and any(abs(len(s) - len(line)) <= 1 and len(s) >= least and edits(s, line) <= 1 for s in seen)
                seen.append(line)
                if same or near:
                    continue
            kept.append(line)
        out[d] = "\n".join(kept)
    return out


def corpus():
    rng = random.Random(9)
    base = ["".join(rng.choice("abé ") for _ in range(rng.choice([3, 19, 20, 21, 22, 40]))) + "x" for _ in range(25)] + ["a" * 25, "a" * 24, "ab" * 15]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                p, kind = rng.randrange(len(line)), rng.randrange(3)
                if kind == 0:
                    line[p] = rng.choice("abz")
                elif kind == 1:
                    line.insert(p, rng.choice("abz"))
                elif len(line) > 1:
                    del line[p]
            lines.append("".join(line))
        docs.append((d, "\n".join(lines + [""] * rng.randint(0, 2))))
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "5 as n_lines", "'k' as gone", "1 as line")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "gone", "line", "n_lines", "n_dropped"]
    want = brute(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        assert got[d].text == want[d], (t, got[d].text, want[d])
        assert got[d].n_lines == len(t.split("\n")) and got[d].n_lines - got[d].n_dropped == (len(want[d].split("\n")) if want[d] or got[d].n_dropped < got[d].n_lines else 0)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "first"), (1, "first"), (2, None), (3, ""), (4, "same\nsame"), (5, "two rows"), (5, "two rows"), (6, "x" * 5000 + "\n" + "x" * 4999 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == sorted([(None, "first"), (1, ""), (2, None), (3, ""), (4, "same"), (5, "two rows"), (5, "two rows"), (6, "x" * 5000)], key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    assert 1 not in {r.doc_id for r in line_dedup.cut_repeated_lines(df).collect()}


def test_edit_bound_at_every_length(spark):
    """One edit from ``near_chars`` characters on, none below; every kind of edit at every length."""
    rng = random.Random(3)
    docs = []
    for n in range(1, 46):
        line = "".join(rng.choice("abcé") for _ in range(n))
        p = rng.randrange(n)
        docs += [line, line[:p] + "z" + line[p + 1 :], line[:p] + line[p + 1 :], line[:p] + "y" + line[p:], line + "w"]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for least in (1, 20):
        assert dict(line_dedup.dedup_lines(df, near_chars=least).select("doc_id", "text").collect()) == brute(docs, least)


def test_halves_shared_by_many_lines(spark):
    docs = [(i, f"a common beginning of many lines, number {i % 60:05d} {'same end' * 3}") for i in range(120)]
    got = dict(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text").collect())
    assert got == brute(docs)


def test_larger_tables_are_joined_with_salts(spark, monkeypatch):
    monkeypatch.setattr("hoptrail.llm.scratch.LOOKUP_ROWS", 0)
    docs = corpus()
    assert dict(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text").collect()) == brute(docs)
