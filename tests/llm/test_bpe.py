import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from hoptrail.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "don't", "'s", " ", "\x1c", "\x85", "12", "é", "漢字", "!?", "  \n ", "word", " ", "🙂", "'", "ll"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return made + ["", " ", "   ", "x" * 5000, " " * 3000 + "a", "<|endoftext|> a", "a " * 3000, "ab1 \n" * 2000]


def test_round_trip_and_library_ids(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b"), (9000, None), (1, "same"), (1, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, overlap in ((65536, 1024), (64, 16), (7, 3)):
        out = bpe.decode(bpe.encode(df, PATH, P.PATTERN, chunk_chars=size, overlap_chars=overlap), PATH).collect()
        assert len(out) == len(rows)
        for r in out:
            assert r.ids == library.encode_ordinary(r.text or ""), (size, r.text)
            assert bytes(r.decoded) == (r.text or "").encode()


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "ids string, text string, _row int")
    assert bpe.encode(df, PATH, P.PATTERN).columns == ["text", "_row", "ids"]
    assert bpe.encode(df, PATH, P.PATTERN).count() == 0


def test_ids_stay_with_their_rows(spark, library):
    """After a round-robin shuffle and after a join, with repeated long texts and with every name that the operator uses itself."""
    rng = random.Random(5)
    words = ["word", " other", "'s", "\n\n", "  ", "é", "12"]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randint(20, 80)))) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, "y" * 1500 + " end"), (2001, "a b" + " " * 900 + "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id * 3 as _row", "'r' as row", "doc_id as digest", "doc_id as at", "doc_id as rest")
    for given in (df.repartition(8), df.join(df.select("doc_id"), "doc_id").select(*df.columns)):
        out = bpe.decode(bpe.encode(given, PATH, P.PATTERN, chunk_chars=100, overlap_chars=20), PATH).collect()
        assert sorted((r.doc_id, r.text) for r in out) == sorted(rows)
        for r in out:
            assert r.ids == library.encode_ordinary(r.text) and bytes(r.decoded) == r.text.encode()
            assert (r._row, r.row, r.digest, r.at, r.rest) == (3 * r.doc_id, "r", r.doc_id, r.doc_id, r.doc_id)


def test_query_against_library(spark, library):
    from hashlib import sha256

    from hoptrail.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op2_byte_bpe(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(docs[r.doc_id].encode()).hexdigest())


def test_long_pre_token_is_gone_through_a_few_times(library):
    enc = bpe.encoder(PATH, P.PATTERN)
    text = "z" * 20_000 + " a b c"
    chunks = [bpe.Chunk.of(a, text[a : a + 120], enc) for a in range(0, len(text), 100)]
    assert bpe.stitch(chunks, enc) == bpe.np.array(library.encode_ordinary(text), "<i4").tobytes()


def test_many_copies_of_long_texts(spark, monkeypatch):
    """Rows of a long text that many rows have, and of one that few have."""
    monkeypatch.setattr(bpe, "HOT_COPIES", 3)
    rows = [(i, "the hot text " * 9) for i in range(20)] + [(20, "a rare text " * 9), (21, "short"), (22, None)] + [(0, "the hot text " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as salt", "2 as hot", "'d' as digest")
    out = bpe.encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, chunk_chars=40, overlap_chars=10)
    got = bpe.decode(out, P.path("byte_bpe_multi_50k.tiktoken")).collect()
    assert len(got) == len(rows) and all((r.decoded.decode(), r.salt, r.hot, r.digest) == (r.text or "", 1, 2, "d") for r in got)
    assert len({tuple(r.ids) for r in got}) == 4
