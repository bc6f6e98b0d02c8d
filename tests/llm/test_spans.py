"""Personal data and secrets against plain regular expressions in Python."""

import hashlib
import math
import random
import re
from collections import Counter

from hoptrail.llm import pii, queries, secrets


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def n_digits(s):
    return sum(c in "0123456789" for c in s)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= n_digits(m[0]) <= 19 and luhn(re.sub("[ -]", "", m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= n_digits(m[0]) <= 15),
}
SECRETS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def brute(text, kinds):
    found = {k: [m.span() for m in re.finditer(rx, text or "", re.A) if ok(m)] for k, (rx, ok) in kinds.items()}
    order = {k: i for i, k in enumerate(kinds)}
    rows = sorted((a, order[k], f"{k}:{a}:{b}") for k, v in found.items() for a, b in v)
    return [len(v) for v in found.values()], hashlib.sha256(",".join(r[2] for r in rows).encode()).hexdigest()


def texts():
    rng = random.Random(6)
    parts = ["a@b.c", "_d@e.f", "@", "x.y", " ", "\n", "1.2.3.4", ".5.6", "999.1.1.1", "000255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4", "+49 (30) 123.456-78", "+1", " - ", "é🙂", "GB82 WEST 1234 5698 7654 32", "Password=", "api_key: '", "token", ":", "=", "abcdef0123456789", "AKIA", "AKIAIOSFODNN7EXAMPL", "Z9", "secret=secret=abcdefghij", "078-05-1120", "SSN: ", "deadbeef", "q7Fz0Lk2Xp9Vb4Tn8Wm1Rc6Y"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(250)]
    return [None, "", *made, "a" * 1_500 + "@" + "b." * 500, "1" * 1_500, "1.2.3.4 " * 600, "token" + " " * 1_500 + "x"]


def check(spark, find, kinds, digest, names):
    rows = list(enumerate(texts())) + [(1, "a@b.c"), (1, "a@b.c"), (None, "+49 30 1234567")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", f"'x' as {names[0]}")
    found = find(df)
    out = digest(found).collect()
    assert len(out) == len(rows)
    want = Counter((d, *brute(t, kinds)[0], brute(t, kinds)[1]) for d, t in rows)
    assert Counter((r[0], *r[1 : 1 + len(kinds)], r.base_sha256) for r in out) == want
    assert find(df.limit(0)).count() == 0
    return found


def test_pii(spark):
    found = check(spark, pii.find_pii, PII, lambda f: queries._span_digests(f, pii, pii.KINDS[:4]), pii.KINDS)
    for r in found.collect():
        for k in pii.KINDS:
            for s in r[k]:
                assert r.text[s.start : s.stop] == s.text
    extra = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32 ok, ssn: 078-05-1120"), (2, "GB82 WEST 1234 5698 7654 33, 078-05-1120")], "doc_id long, text string")
    got = {r.doc_id: ([s.text for s in r.iban], [s.text for s in r.ssn]) for r in pii.find_pii(extra).collect()}
    assert got == {1: (["GB82 WEST 1234 5698 7654 32"], ["078-05-1120"]), 2: ([], [])}
    several = spark.createDataFrame([(1, "SSN 123-45-6789, 234-56-7890 and 345-67-8901.")], "doc_id long, text string").selectExpr("*", "7 as _text", "8 as _seen", "'r' as _row")
    r = pii.find_pii(several).first()
    assert [(s.start, s.score) for s in r.ssn] == [(4, 0.7), (17, 0.7), (33, 0.7)] and (r._text, r._seen, r._row) == (7, 8, "r")
    assert pii.find_pii(several).select(pii.all_scores().alias("s")).first().s == "ssn:4:0.7,ssn:17:0.7,ssn:33:0.7"
    assert [r.text for r in pii.redact(pii.find_pii(extra)).orderBy("doc_id").collect()][0].startswith("IBAN [iban] ok")


def test_account_numbers_end_where_their_check_holds(spark):
    rows = [(1, "iban DE89370400440532013000 BIC COBADEFF"), (2, "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 NOW"), (3, "DE89370400440532013001 BIC"), (4, "DE89370400440532013000X")]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: [s.text for s in r.iban] for r in found}
    assert got == {1: ["DE89370400440532013000"], 2: ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"], 3: [], 4: []}
    assert all(r.text[s.start : s.stop] == s.text for r in found for s in r.iban)


def test_secrets(spark):
    check(spark, secrets.find_secrets, SECRETS, lambda f: queries._span_digests(f, secrets, secrets.KINDS[:3]), secrets.KINDS)
    t = "k q7Fz0Lk2Xp9Vb4Tn8Wm1Rc6Y and AAAAAAAAAAAAAAAAAAAAAAAAAAAa1 and example7Fz0Lk2Xp9Vb4Tn8Wm1Rc"
    r = secrets.find_secrets(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    clash = secrets.find_secrets(spark.createDataFrame([(1, t, 5)], "doc_id long, text string, _text int").selectExpr("*", "6 as _seen", "7 as _base64", "8 as _upper")).first()
    assert (clash._text, clash._seen, clash._base64, clash._upper, clash.entropy) == (5, 6, 7, 8, r.entropy)
    assert [s.text for s in r.entropy] == ["q7Fz0Lk2Xp9Vb4Tn8Wm1Rc6Y"]


def test_window_entropy(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcXY12") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "w string")

    def entropy(s):
        return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())

    for r in df.select("w", secrets.window_entropy(secrets.F.col("w"), 8).alias("e")).collect():
        want = max((entropy(r.w[i : i + 8]) for i in range(len(r.w) - 7)), default=0.0)
        assert abs(r.e - want) < 1e-9
