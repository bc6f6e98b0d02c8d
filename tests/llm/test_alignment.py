import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from hoptrail.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "\r", "\x1c", "　", "\xa0", "a", "the", " The", "'s", "'ll", "12", "!!", "é", "é,", "🙂", "東京", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "▁x", "ﬁ", "\x00", " ", "x\ny", ".", " .", "x.", "%", "&&", " b", "1."]


class Libraries:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.a_bytes = alignment.byte_level_tokens(A)

    def b_bytes(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, text):
        """Ids of both sides by groups, from offsets alone; None without tokens."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        xs, ys = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if not b"".join(xs) == b"".join(ys) == (" " + text).encode():
            return None
        ends = [[sum(map(len, s[: k + 1])) for k in range(len(s))] for s in (xs, ys)]
        out, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(e) + 1, ends[1].index(e) + 1
            out.append((a[i:x], b[j:y]))
            i, j = x, y
        return out

    def links(self, groups):
        for a, b in groups or []:
            for s, t in ((s, t) for s in self.spans(a, self.a_bytes.__getitem__) for t in self.spans(b, self.b_bytes)):
                if max(s[1], t[1]) < min(s[2], t[2]):
                    yield s[0], t[0]

    def spans(self, ids, of):
        at = 0
        for i in ids:
            yield i, at, at + len(of(i))
            at += len(of(i))


def text_of(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])


def expected(rows):
    """For each (doc_id, text): the counts and the groups, by all pairs of tokens."""
    lib = Libraries()
    grouped = [(d, lib.groups(t)) for d, t in rows]
    links = [list(lib.links(g)) for _, g in grouped]
    count = Counter(p for ls in links for p in ls)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(d, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), text_of(g)) for (d, g), ls in zip(grouped, links, strict=True)]


def test_segments_give_the_libraries_tokens():
    lib, work = Libraries(), alignment.Aligner(A, B, public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(6_000)] + [None, "", " ", "\n", "x" * 5_000, "the " * 20_000]
    for text, (n_a, n_b, n, groups, _) in zip(texts, work.texts(texts), strict=True):
        if text and len(text) > 1_000:
            ids = lib.a.encode(" " + text, add_special_tokens=False).ids, lib.b.encode(text)
            assert (n_a, n_b) == tuple(map(len, ids))
            continue
        want = lib.groups(text)
        assert groups == text_of(want), repr(text)
        assert (n_a, n_b, n) == (sum(len(a) for a, _ in want or []), sum(len(b) for _, b in want or []), len(want or []))


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(alignment, "KEEP_SEGMENTS", 20)
    monkeypatch.setattr(alignment, "KEEP_STEPS", 10)
    lib, work = Libraries(), alignment.Aligner(A, B, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(40):
        texts = ["".join(rng.choice(PARTS) for _ in range(12)) for _ in range(5)]
        assert [x[3] for x in work.texts(texts)] == [text_of(lib.groups(t)) for t in texts]


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 15)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a ▁ b"), (None, "the the"), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as pairs", "'g' as block", "doc_id as row", "'x' as codes").repartition(3)
    aligned = alignment.align(df, A, B, public_tokenizers.PATTERN)
    assert aligned.select(alignment.n_links().alias("n")).agg({"n": "sum"}).first()[0] == sum(r[4] for r in expected(rows))
    scored = alignment.score_links(aligned)
    assert scored.columns[:6] == ["doc_id", "text", "block", "row", "codes", "n_a"]
    out = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in scored.collect()]
    assert Counter(out) == Counter(expected(rows))
    assert alignment.score_links(aligned.limit(0)).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    r = alignment.score_links(alignment.align(one, A, B, public_tokenizers.PATTERN)).first()
    assert (r.n_a, r.n_b, r.n_groups, r.groups, r.n_links, r.n_best, r.count_sum) == (0, 0, 0, "", 0, 0, 0)


def test_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500").limit(40)
    docs.unionByName(docs.limit(1).selectExpr("doc_id + 100000 as doc_id", "cast(null as string) as text", "lang", "source", "n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    out = {r.doc_id: r for r in queries.op11_alignment(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for d, *numbers, groups in expected(rows):
        r = out[d]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
