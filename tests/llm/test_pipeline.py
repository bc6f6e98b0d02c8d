"""The pipeline's stages against brute force on a small data folder."""

import base64
import hashlib
import os
import random
import sys
import tempfile

import public_tokenizers as P
import tiktoken

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
import test_decontaminate  # noqa: E402
import test_line_dedup  # noqa: E402
import test_near_dedup  # noqa: E402
import test_quality_rules  # noqa: E402


def folder(spark):
    rng = random.Random(12)
    vocab = [f"wo{i}" for i in range(300)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(14))) for i in range(5)]
    license_line = " ".join(words(60))
    docs = []
    for i in range(60):
        lines = [" ".join(words(rng.randint(12, 40))) for _ in range(rng.randint(1, 4))]
        if i % 4 == 0:
            lines.append(license_line)
        if i % 9 == 0:
            lines[0] += " " + items[i % 5][1]
        docs.append((i, "\n".join(lines)))
    docs += [(100, docs[3][1]), (101, docs[5][1] + "x"), (102, "too short"), (103, ""), (104, None)]
    near = docs[7][1].split()
    near[3:3] = ["new"]
    docs.append((105, " ".join(near)))
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_pipeline(spark):
    path, docs, items = folder(spark)
    kept = [(d, t) for d, t in docs if not test_quality_rules.brute(t)[-1]]
    lines = test_line_dedup.brute(kept)
    kept = [(d, lines[d]) for d, _ in kept if lines[d].strip()]
    near = test_near_dedup.brute(kept, 5, 80)
    alone = {d for d, _, _, k in near if k}
    kept = [(d, t) for d, t in kept if d in alone]
    kept = [(d, t) for d, t in kept if not test_decontaminate.brute(t, items)[1]]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.RANKS, "rb"))}
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for d, t in kept:
        ids = library.encode_ordinary(t)
        want.add((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    docs_df = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:1]:
        assert stage(spark, docs_df, path).columns == docs_df.columns
    got = corpus_pipeline.run(spark, path).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert 20 < len(want) < len(docs)

def test_edge_tables(spark):
    """Repeated rows, columns named like the stages' own, and tables without rows go through every stage."""
    path, docs, _ = folder(spark)
    table = spark.read.parquet(f"{path}/documents.parquet")
    again = table.unionByName(table.filter("doc_id = 11")).selectExpr("*", "7 as kept", "'r' as row", "doc_id as n_words", "text as digest", "1 as spans")
    for given in (again, again.limit(0)):
        now = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, path)
            assert now.columns == given.columns
        out = corpus_pipeline.STAGES[-1][1](spark, now, path).collect()
        assert len(out) == len({r.doc_id for r in out}) + (sum(r.doc_id == 11 for r in out) > 1) and bool(out) == (given is again)
