"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoptrail.functions.fence import fenced
from hoptrail.llm import alignment, bpe, decontaminate, lang_id, line_dedup, mixing, near_dedup, pii, quality_rules, runs, secrets, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM d),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT line, length(line) AS n, min((doc_id, p)) AS first FROM w GROUP BY line),
g AS (SELECT * FROM c WHERE n >= 20),
near AS (
  SELECT DISTINCT b.line FROM g a JOIN g b ON left(a.line, 9) = left(b.line, 9) AND abs(a.n - b.n) <= 1 AND a.first < b.first AND levenshtein(a.line, b.line) <= 1
  UNION
  SELECT DISTINCT b.line FROM g a JOIN g b ON right(a.line, 9) = right(b.line, 9) AND abs(a.n - b.n) <= 1 AND a.first < b.first AND levenshtein(a.line, b.line) <= 1
), gone AS (
  SELECT doc_id, p FROM w JOIN c USING (line) WHERE (doc_id, p) <> c.first OR line IN (SELECT line FROM near)
), kept AS (SELECT l.* FROM l ANTI JOIN gone USING (doc_id, p)),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM kept GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.text, '') AS text, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(k.n, 0) AS n_dropped
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), ranks))


def token_digests(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    table = token_counts.prefix_table(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    n = token_counts.total_tokens()
    fits = F.when(n > 512, token_counts.longest_prefix(512)).otherwise(F.element_at("prefix_chars", -1))
    return table.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > 512).alias("over_limit"), fits.cast("long").alias("chars_within_limit"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def _span_digests(found: DataFrame, module, base: list[str], *more) -> DataFrame:
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(module.all_spans(base), 256).alias("base_sha256"),
        module.all_spans(module.KINDS).alias("spans"),
        *more,
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")), pii, pii.KINDS[:4], pii.all_scores().alias("scores"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")), secrets, secrets.KINDS[:3])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    learned = lang_id.profiles(docs.filter(part != 2))
    held = docs.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "text")
    return lang_id.predict(held, learned).select("doc_id", "held_out", "lang_pred", "score")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, shingle=3, percent=85)


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_sets FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_sets >= 85 * (x.n + y.n - both_sets)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reached),
m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
"""


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win),
dwin AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
), hits AS (SELECT doc_id, i, dwin.size AS size, item_id FROM dwin JOIN win USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, _table(spark, sf_dir, "benchmark"))
    items = F.array_distinct(F.transform(F.filter("matches", lambda m: m.item_id.isNotNull()), lambda m: m.item_id.cast("string")))
    return found.withColumn("_items", items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("_items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), k AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS keeper FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN keeper IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
FROM k
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    scored = alignment.score_links(aligned.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs", "times"))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(docs, [5, 2, 1]).select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || left(md5('0:' || CAST(doc_id AS VARCHAR)), 15) AS BIGINT) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST(2 * source_size AS DOUBLE) AS cap, CAST(CASE r % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM s
), c AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, coalesce(sum(weight) OVER before, 0) AS weights, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS total, sum(weight) OVER () AS every
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT (total - caps) / (every - weights) AS level FROM c WHERE cap >= weight * ((total - caps) / (every - weights)) ORDER BY weights LIMIT 1
), t AS (SELECT source, source_size, least(cap, weight * level) AS target, CAST(round(least(cap, weight * level)) AS BIGINT) AS budget FROM w, l),
p AS (
  SELECT d.*, source_size, target, budget, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(least(budget - epochs * source_size - before, size), 0) AS BIGINT) AS taken FROM p
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_with_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.col("best")
    return found.withColumn("best", fenced(runs.strongest(F.col("runs")))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Where the crc32 h of the decimal doc_id ends in 0, the words from a = g % n on become repeats of the p words there; g = h // 10."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), fenced(F.when(chosen, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))).alias("words"))
    n = F.size("words")
    placed = split.withColumn("a", F.when(n > 0, F.pmod("g", n))).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    piece = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    again = F.flatten(F.array_repeat(piece, F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    repeated = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(again, F.lit(1), (n - F.col("a")).cast("int")))
    return placed.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_byte_bpe, op3_token_counts, op4_quality_rules, op5_pii, op6_language_id, op7_near_dedup, op8_secrets, op9_decontaminate, op10_warc, op11_alignment, op12_mixing, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op7_near_dedup": OP7_SQL, "op9_decontaminate": OP9_SQL, "op10_warc": OP10_SQL, "op12_mixing": OP12_SQL}
