import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from hoptrail.llm import queries, token_counts

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def texts():
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "don't", "'s", "\x1c", "\x85", "12", "é", "漢字", "!?", "  \n ", "word", "🙂", "'", "ll", "<|endoftext|>", "Ouwhea", "thnthest", "<|", "queciónesuemente"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(120)] + ["", " ", "<|endoftext|>", "x" * 300, " " * 80 + "a", "\n\n\n  \n"]


def test_every_prefix(library):
    count = token_counts.counter(PATH, P.PATTERN)
    for t in texts():
        assert count.every(t) == [library(t[:i]) for i in range(len(t) + 1)], repr(t)
        chars, tokens = count.changes(t)
        assert chars[-1] == len(t) and tokens[-1] == library(t), repr(t)


def test_table_and_budget(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None), (1, "same"), (1, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("prefix_chars", token_counts.F.lit("x"))
    out = token_counts.prefix_table(df, PATH, P.PATTERN, every_character=True)
    got = out.select("text", token_counts.total_tokens().alias("n"), token_counts.longest_prefix(5).alias("p"), token_counts.tokens_within(7).alias("w")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        assert r.n == library(t)
        assert r.p == max(i for i in range(len(t) + 1) if library(t[:i]) <= 5)
        assert r.w == library(t[:7])
    assert token_counts.prefix_table(df.limit(0), PATH, P.PATTERN).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op3_token_counts(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        t = docs[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), library(t), library(t) > 512)
        assert library(t[: r.chars_within_limit]) <= 512 and (r.chars_within_limit == len(t)) == (library(t) <= 512)
        if r.over_limit:
            assert library(t[: r.chars_within_limit + 1]) > 512


def test_pairs_stay_apart_as_their_merges_say():
    count, rng = token_counts.PrefixCounter(PATH, P.PATTERN), random.Random(3)
    whole = [t for t in range(len(count.tokens)) if count._made_by(t) is not None]
    runs = [count.vocabulary[b"a" * n] for n in range(1, 5) if b"a" * n in count.vocabulary]
    pairs = [(a, b) for a in runs for b in runs] + [(rng.choice(whole), rng.choice(whole)) for _ in range(3000)]
    for t in rng.sample(whole, 3000):  # both parts of a token, and other cuts of it
        k = rng.randint(1, max(1, len(count.tokens[t]) - 1))
        parts = [count.vocabulary.get(x) for x in (count.tokens[t][:k], count.tokens[t][k:])]
        pairs += [tuple(parts)] if all(p is not None and count._made_by(p) is not None for p in parts) else []
    for a, b in pairs:
        assert count._fits(a, b) == (count.merge([count._byte[x] for t in (a, b) for x in count.tokens[t]]) == [a, b]), (count.tokens[a], count.tokens[b])


def test_full_memory_keeps_what_is_asked_for_again(library, monkeypatch):
    for name in ("CACHE_ENTRIES", "CACHE_PIECES", "CACHE_HEADS"):
        monkeypatch.setattr(token_counts, name, 40)
    count, made = token_counts.PrefixCounter(PATH, P.PATTERN), []
    number = count._number
    count._number = lambda stretch: made.append(stretch) or number(stretch)
    for i in range(60):
        t = f"often asked words again one{'qz' * i} more{'kv' * i}, and{i}"
        chars, tokens = count.changes(t)
        assert [int(tokens[chars.searchsorted(j, side="right") - 1]) for j in range(len(t) + 1)] == [library(t[:j]) for j in range(len(t) + 1)]
    assert made.count(" asked") == 1
