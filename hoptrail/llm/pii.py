"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

All of it is built-in expressions. Patterns are written so that a scan is
linear: a run of characters is entered at its start, or where the match before
ended (``\\G``), and possessive quantifiers never give characters back.

Every span has a score: 0.5 by its form, plus 0.4 when a checksum confirms it
(Luhn, mod 97), plus 0.2 when a context word of its kind stands within
``CONTEXT`` characters, at most as far as the fourth match of the kind. Base kinds are kept at any score; an added kind is kept
from ``least_score`` on.

Defined cases: a null text is empty; a text without spans gets the empty list;
extra columns pass through and result columns replace columns of the same name;
repeated rows get repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoptrail.functions.spans import spans_text, with_spans

CONTEXT = 48
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)([0-9]++)(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: No blank in it stands before the beginning of another one.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20(?![A-Z]{2}[0-9]{2})[A-Z0-9]|[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Kinds in the order in which they are listed; those after the first four are added by the method.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
#: Words that make a kind likelier.
WORDS = {
    "email": r"(?i)\b(?:e-?mail|contact|mail|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|telefon|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security|tax id)\b",
}


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda x: x != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number with its country letters leaves 1 by 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    # Letters count as 10 to 35, digits as themselves.
    values = F.transform(F.filter(F.split(turned, ""), lambda x: x != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda s, v: F.when(v > 9, s * 100 + v).otherwise(s * 10 + v) % 97) == 1


def small_part(part: Column) -> Column:
    """Whether a dotted part of an address is at most 255."""
    plain = F.regexp_replace(part, r"^\.?0*", "")
    return (F.char_length(plain) < 3) | ((F.char_length(plain) == 3) & (plain <= "255"))


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        return small_part(s["g1"]) & small_part(s["g2"]) & small_part(s["g3"]) & small_part(s["g4"])
    if kind == "card":
        n = F.char_length(digits(s["text"]))
        return F.when((n >= 14) & (n <= 19), luhn(digits(s["text"]))).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(s["text"])).between(10, 15)
    if kind == "iban":
        return s["text"].isNotNull()
    if kind == "ssn":
        return ~s["text"].rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _shortened(s: Column) -> Column:
    """A span of an account number up to the last blank or end where its check holds: capitals after it aren't part of it."""
    words = F.split(s["text"], " ")
    heads = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    text = F.get(F.filter(heads, lambda h: (F.char_length(F.replace(h, F.lit(" "), F.lit(""))) >= 15) & mod97(h)), F.lit(0))
    return F.struct(s["start"].alias("start"), (s["start"] + F.char_length(text)).cast("bigint").alias("stop"), text.alias("text"), s["before"].alias("before"), F.concat(F.substr(s["text"], F.char_length(text) + 1), s["after"]).alias("after"))


def _scored(kind: str) -> Column:
    """The confirmed spans of a kind with their scores."""

    def score(s: Column) -> Column:
        near = s["before"].rlike(WORDS[kind]) | s["after"].rlike(WORDS[kind])
        return F.round(F.lit(0.9 if kind in ("card", "iban") else 0.5) + F.when(near, 0.2).otherwise(0.0), 2)

    found = F.transform(kind, _shortened) if kind == "iban" else F.col(kind)
    good = F.filter(found, lambda s: _confirmed(kind, s))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["text"].alias("text"), score(s).alias("score")))


def find_pii(docs: DataFrame, text_col: str = "text", least_score: float = 0.6) -> DataFrame:
    """``docs`` with one column of spans (start, stop, text, score) for each of ``KINDS``."""
    own = [c for c in docs.columns if c not in KINDS]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))  # no name of the input can clash
    # A kind's scan is skipped where a sign that all its matches have is missing.
    signs = {"email": F.col("_text").contains("@"), "phone": F.col("_text").contains("+"), "ssn": F.col("_text").contains("-"), "ip": F.col("_text").contains(".")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
    for kind in KINDS:
        seen = df.withColumn("_seen", F.when(signs[kind], F.col("_text")).otherwise(F.lit(""))) if kind in signs else df.withColumn("_seen", F.col("_text"))
        df = with_spans(seen, "_seen", patterns[kind], kind, CONTEXT, groups=(1, 2, 3, 4) if kind == "ip" else ()).drop("_seen")
        scored = _scored(kind)
        df = df.withColumn(kind, scored if kind in KINDS[:4] else F.filter(scored, lambda s: s["score"] >= least_score))
    return df.select(*[F.col("_row")[c].alias(c) for c in own], *KINDS)


def all_spans(kinds: list[str]) -> Column:
    return spans_text([(k, F.col(k)) for k in kinds])


def all_scores() -> Column:
    """``kind:start:score`` of all spans, in the order of their text."""
    return spans_text([(k, F.col(k)) for k in KINDS], "score")


def redact(found: DataFrame, text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """The result of ``find_pii`` with each span of its text replaced by its kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def marks(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(mark.format(kind)).alias("mark")))

    rows = F.concat(*[marks(k) for k in KINDS])
    done = F.aggregate(
        F.sort_array(rows),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda s, r: F.when(r["start"] < s["at"], s).otherwise(F.struct(F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), (r["start"] - s["at"]).cast("int")), r["mark"]).alias("out"), r["stop"].alias("at"))),
        lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))),
    )
    return found.withColumn(text_col, done)
