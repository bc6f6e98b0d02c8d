"""Registered queries: each operator over the data folder's tables, with the SQL that checks it.

``events`` stands for an event stream: user_id parts it, (ts, event_id) orders
it, errors are gaps, sign-ups break it, value is a probability or a count and
props holds a number that serves as an address.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hoptrail.functions import control, literals, text
from hoptrail.operators import biases, dataset, graph, joins, likeness, model, packets, report, resolver, segmenter, vocab, windows
from hoptrail.streaming import alarms

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
BY, ORDER = ["user_id"], ["ts", "event_id"]
LOW, SIZE, LEAST = 20.0, 8, 3


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a row number in their stream and the number in props."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.withColumn("row", F.row_number().over(windows.ordered(BY, ORDER)).cast("bigint"))


EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row FROM events)"
#: Errors are unscored, sign-ups break the run.
RUNS = f"""{EV}, sc AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS score FROM ev),
rs AS (SELECT *, CASE WHEN row = 1 OR event_type = 'signup' OR score IS NULL OR lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS r FROM sc),
ru AS (SELECT *, sum(r) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM rs),
lc AS (SELECT *, score < {LOW} AS is_low, sum(CASE WHEN score < {LOW} THEN 1 ELSE 0 END) OVER w AS low_count, count(*) OVER w AS observed, first_value(row) OVER w AS start_row
       FROM ru WHERE score IS NOT NULL WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("score", F.when(F.col("event_type") != "error", F.col("value")))
    runs = windows.scored_runs(e, "score", "row", BY, ORDER, F.col("event_type") == "signup")
    return windows.low_counts(runs, "score", LOW, SIZE, BY, ORDER, "row")


@query(f"WITH {RUNS} SELECT user_id, event_id, CAST(low_count AS BIGINT) AS low_count FROM lc WHERE observed >= {SIZE} AND low_count >= {LEAST}")
def q_sliding_low_alarm(spark, sf_dir):
    return windows.alarms(scored(spark, sf_dir), SIZE, LEAST).select("user_id", "event_id", "low_count")


@query(f"WITH {RUNS} SELECT user_id, event_id, start_row, row AS end_row, observed FROM lc WHERE low_count >= {LEAST}")
def q_alarm_window_bounds(spark, sf_dir):
    return windows.alarms(scored(spark, sf_dir), SIZE, LEAST, partial=True).select("user_id", "event_id", "start_row", F.col("row").alias("end_row"), "observed")


@query(f"WITH {RUNS} SELECT count(*) AS n_scored, CAST(sum(CASE WHEN is_low THEN 1 ELSE 0 END) AS BIGINT) AS n_low, CAST(max(low_count) AS BIGINT) AS max_window_low_count, round(sum(CASE WHEN is_low THEN 1 ELSE 0 END) / count(*), 6) AS low_ratio FROM lc")
def q_report_summary(spark, sf_dir):
    low = F.sum(F.col("is_low").cast("bigint"))
    return scored(spark, sf_dir).agg(F.count("*").alias("n_scored"), low.alias("n_low"), F.max("low_count").alias("max_window_low_count"), F.round(low / F.count("*"), 6).alias("low_ratio"))


@query(f"""WITH {RUNS} SELECT user_id, row, 'low_token' AS event, CAST(low_count AS BIGINT) AS low_count FROM lc WHERE is_low
UNION ALL SELECT user_id, row, 'window_alarm', CAST(low_count AS BIGINT) FROM lc WHERE observed >= {SIZE} AND low_count >= {LEAST}
UNION ALL SELECT user_id, row, 'unscored', 0 FROM sc WHERE score IS NULL""")
def q_unscored_union(spark, sf_dir):
    s = scored(spark, sf_dir)
    rows = lambda df, name, n: df.select("user_id", "row", F.lit(name).alias("event"), n.cast("bigint").alias("low_count"))
    low = rows(s.filter("is_low"), "low_token", F.col("low_count"))
    unscored = rows(events(spark, sf_dir).filter("event_type = 'error'"), "unscored", F.lit(0))
    return low.unionByName(rows(windows.alarms(s, SIZE, LEAST), "window_alarm", F.col("low_count"))).unionByName(unscored)


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS context FROM events")
def q_context_ffill(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return windows.forward_fill(e, {"context": F.when(F.col("event_type") == "signup", F.col("event_id"))}, BY, ORDER).select("event_id", "context")


@query("""WITH c AS (SELECT event_id, user_id, ts, CASE WHEN row_number() OVER w > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS generation FROM c""")
def q_generation_counter(spark, sf_dir):
    return windows.changes(table(spark, sf_dir, "events"), ["event_type"], BY, ORDER).select("event_id", "generation")


SEGMENTS = "s AS (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM events)"


@query(f"WITH {SEGMENTS} SELECT user_id, segment, count(*) AS length FROM s GROUP BY ALL HAVING count(*) >= 3")
def q_segments(spark, sf_dir):
    s = windows.segments(table(spark, sf_dir, "events"), F.col("event_type") == "signup", BY, ORDER)
    return windows.segment_stats(s, ["user_id", "segment"], 3)


@query(f"WITH {SEGMENTS}, n AS (SELECT user_id, segment, count(*) AS l FROM s GROUP BY ALL) SELECT count(*) AS n_segments, min(l) AS min_length, max(l) AS max_length, round(avg(l), 6) AS mean_length, CAST(sum(l) AS BIGINT) AS total, CAST(sum(l - 1) AS BIGINT) AS examples FROM n")
def q_segment_length_stats(spark, sf_dir):
    s = windows.segments(table(spark, sf_dir, "events"), F.col("event_type") == "signup", BY, ORDER)
    n = windows.segment_stats(s, ["user_id", "segment"], 1)
    return n.agg(F.count("*").alias("n_segments"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.round(F.avg("length"), 6).alias("mean_length"), F.sum("length").alias("total"), F.sum(F.col("length") - 1).alias("examples"))


@query(f"""WITH {EV}, g AS (SELECT *, event_type IN ('error', 'view') AS gap FROM ev),
n AS (SELECT *, CASE WHEN gap AND NOT coalesce(lag(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) THEN 1 ELSE 0 END AS f FROM g),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, CAST(island AS BIGINT) AS gap, min(row) AS first_row, max(row) AS last_row, count(*) AS n_rows, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS reasons FROM i WHERE i.gap GROUP BY user_id, island""")
def q_gap_coalesce(spark, sf_dir):
    return windows.coalesce_gaps(events(spark, sf_dir), F.col("event_type").isin("error", "view"), "event_type", BY, ["ts", "event_id", "row"])


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'gap' WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'error' THEN 'after_gap' ELSE 'continuous' END AS continuity FROM events")
def q_continuity(spark, sf_dir):
    return windows.continuity(table(spark, sf_dir, "events"), F.col("event_type") == "error", BY, ORDER).select("event_id", "continuity")


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM p")
def q_dedupe_consecutive(spark, sf_dir):
    return windows.drop_repeats(table(spark, sf_dir, "events"), "event_type", BY, ORDER).select("event_id", "event_type")


@query(f"""WITH {EV} SELECT p.event_id, (SELECT max_by(b.event_id, b.event_id) FROM ev b WHERE b.event_type = 'view' AND b.k = p.k AND b.user_id = p.user_id AND b.event_id < p.event_id) AS last_view FROM ev p WHERE p.event_type = 'purchase'""")
def q_asof_address(spark, sf_dir):
    e = events(spark, sf_dir)
    views = e.filter("event_type = 'view'").select("user_id", "k", "event_id", F.col("event_id").alias("view_id"))
    return joins.asof_join(e.filter("event_type = 'purchase'").select("user_id", "k", "event_id"), views, ["user_id", "k"], "event_id", "view_id", "last_view").select("event_id", "last_view")


@query(f"WITH {EV} SELECT event_id, lead(k) OVER w AS next_start, coalesce(k = lead(k) OVER w, false) AS hint_matches FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q_next_hint(spark, sf_dir):
    return joins.next_hint(events(spark, sf_dir), "k", "k", BY, ORDER).select("event_id", "next_start", "hint_matches")


MAPS = "m AS (SELECT p_partkey AS map_id, p_partkey * 40 AS lo, p_partkey * 40 + p_size AS hi, p_size FROM part)"


def maps(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("map_id"), (F.col("p_partkey") * 40).alias("lo"), (F.col("p_partkey") * 40 + F.col("p_size")).alias("hi"), "p_size")


@query(f"WITH {MAPS} SELECT o_orderkey, map_id FROM orders LEFT JOIN m ON o_orderkey >= lo AND o_orderkey < hi")
def q_interval_lookup(spark, sf_dir):
    return joins.interval_join(table(spark, sf_dir, "orders").select("o_orderkey"), maps(spark, sf_dir), "o_orderkey", "lo", "hi").select("o_orderkey", "map_id")


@query(f"WITH {MAPS} SELECT o_orderkey, map_id FROM orders JOIN m ON o_orderkey >= lo AND o_orderkey < hi + 200 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY p_size, map_id) = 1")
def q_interval_priority(spark, sf_dir):
    wide = maps(spark, sf_dir).withColumn("hi", F.col("hi") + 200)
    found = joins.interval_join(table(spark, sf_dir, "orders").select("o_orderkey"), wide, "o_orderkey", "lo", "hi", "inner", bin_width=256)
    return joins.best_interval(found, ["o_orderkey"], [F.col("p_size"), F.col("map_id")]).select("o_orderkey", "map_id")


@query("""SELECT s_suppkey, n_nationkey, score FROM (SELECT s_suppkey, n_nationkey, 100 + CASE WHEN s_nationkey = n_nationkey THEN 50 ELSE 0 END + CASE WHEN s_suppkey % 5 = n_regionkey THEN 30 ELSE 0 END AS score
FROM supplier JOIN nation ON s_suppkey % 3 <> n_nationkey % 3) QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, n_nationkey) = 1""")
def q_candidate_score(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    score = F.lit(100) + F.when(F.col("s_nationkey") == F.col("n_nationkey"), 50).otherwise(0) + F.when(F.col("s_suppkey") % 5 == F.col("n_regionkey"), 30).otherwise(0)
    best = joins.best_candidate(s, table(spark, sf_dir, "nation"), F.col("s_suppkey") % 3 != F.col("n_nationkey") % 3, score, ["s_suppkey"], "n_nationkey")
    return best.select("s_suppkey", "n_nationkey", "score")


@query("""WITH b AS (SELECT DISTINCT p_partkey * 8 - s_suppkey * 4 AS bias FROM part JOIN supplier ON p_size = s_nationkey),
c AS (SELECT bias, count(*) AS coverage FROM b JOIN part ON true JOIN supplier ON p_size = s_nationkey AND p_partkey * 8 - s_suppkey * 4 = bias GROUP BY bias)
SELECT bias, coverage FROM c ORDER BY coverage DESC, abs(bias), bias LIMIT 1""")
def q_bias_coverage(spark, sf_dir):
    """Biases are 4 times the distance of twice the part and the supplier."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("place"), (F.col("p_partkey") * 2).alias("a"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("place"), F.col("s_suppkey").alias("b"))
    return biases.most_covered(p, s, "place", "a", "b").select((F.col("bias") * 4).alias("bias"), "coverage")


@query("""SELECT o_orderkey, '0x' || lower(printf('%x', o_orderkey)) AS short_hex, '0x' || lower(printf('%016x', o_orderkey)) AS long_hex,
CASE WHEN o_orderkey % 7 - 3 < 0 THEN '-0x' || lower(printf('%x', 3 - o_orderkey % 7)) ELSE '0x' || lower(printf('%x', o_orderkey % 7 - 3)) END AS signed, o_orderkey - o_orderkey % 16 AS down, (o_orderkey + 15) // 16 * 16 AS up,
CASE WHEN o_orderkey % 256 >= 128 THEN o_orderkey % 256 - 256 ELSE o_orderkey % 256 END AS extended FROM orders""")
def q_hex_format(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, literals.hex_text(k).alias("short_hex"), literals.hex_text(k, 16).alias("long_hex"), literals.signed_hex(k % 7 - 3).alias("signed"), literals.align_down(k, 16).alias("down"), literals.align_up(k, 16).alias("up"), literals.sign_extend(k, 8).alias("extended"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey & 1 <> 0 THEN 'r' ELSE '-' END || CASE WHEN o_orderkey & 2 <> 0 THEN 'w' ELSE '-' END || CASE WHEN o_orderkey & 4 <> 0 THEN 'x' ELSE '-' END AS perms,
CASE o_orderkey % 12 WHEN 0 THEN 'direct_call' WHEN 1 THEN 'direct_branch' WHEN 2 THEN 'conditional_branch' WHEN 3 THEN 'return' WHEN 5 THEN 'exception_return' WHEN 6 THEN 'normal' WHEN 7 THEN 'indirect_branch' WHEN 8 THEN 'indirect_call' WHEN 9 THEN 'return' WHEN 10 THEN 'exception_instruction' ELSE 'normal' END AS kind FROM orders""")
def q_bitmask_classify(spark, sf_dir):
    k = F.col("o_orderkey")
    flags = k.bitwiseAND(1) * 4 + k.bitwiseAND(2) + F.shiftright(k.bitwiseAND(4), 2)
    words = F.element_at(F.array(*[F.lit(x) for x in (0x94000000, 0x14000000, 0x54000000, 0xD65F03C0, 0xD503201F, 0xD6BF03E0, 0xD4A00001, 0xD71F0822, 0xD73F0C22, 0xD65F0FFF, 0xD4000001, 0xD4000000)]), (k % 12 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k, literals.permission_text(flags).alias("perms"), control.instruction_kind(words).alias("kind"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN CASE o_orderstatus WHEN 'O' THEN 'cond:T' WHEN 'F' THEN 'cond:N' ELSE 'cond:?' END WHEN '2-HIGH' THEN 'ret' WHEN '3-MEDIUM' THEN 'icall' WHEN '4-LOW' THEN 'call' ELSE 'other' END AS label,
CASE WHEN CAST(floor(o_totalprice / 1000) AS BIGINT) - 50 < 0 THEN 1 ELSE least(CAST(floor(o_totalprice / 1000) AS BIGINT) - 50, 255) + 2 END AS bucket FROM orders""")
def q_control_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "conditional_branch").when(F.col("o_orderpriority") == "2-HIGH", "return").when(F.col("o_orderpriority") == "3-MEDIUM", "indirect_call").when(F.col("o_orderpriority") == "4-LOW", "direct_call").otherwise("other")
    flag = F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False)
    return o.select("o_orderkey", control.edge_control(kind, flag).alias("label"), control.count_bucket(F.floor(F.col("o_totalprice") / 1000) - 50).alias("bucket"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/]+)', 1) AS host, string_split(string_split(url, '#')[1], '/')[-1] AS last_part FROM pages""")
def q_regex_parse(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, "://([^/]+)", 1).alias("host"), text.base_name(F.split_part(u, F.lit("#"), F.lit(1))).alias("last_part"))


@query("""SELECT p_partkey, p_type || '+0x' || lower(printf('%x', p_size)) AS symbol, p_type AS name, CAST(p_size AS BIGINT) AS off, '+' AS relation FROM part""")
def q_symbol_split(spark, sf_dir):
    symbol = text.symbol_text(F.col("p_type"), F.col("p_size").cast("bigint"), F.lit(True))
    p = table(spark, sf_dir, "part").withColumn("symbol", symbol)
    found = text.split_symbol(F.col("symbol"))
    return p.select("p_partkey", "symbol", found["name"].alias("name"), found["offset"].alias("off"), found["relation"].alias("relation"))


@query("""SELECT p_partkey, 'mov FUN_<ADDR>, off_<ADDR>, s_' || lower(printf('%x', p_partkey)) || ', ' || p_brand AS clean FROM part""")
def q_autosym_normalize(spark, sf_dir):
    hexed = F.lower(F.hex("p_partkey"))
    raw = F.concat(F.lit("mov  FUN_00"), hexed, F.lit(", off_"), hexed, F.lit(", s_"), hexed, F.lit(",\t "), F.col("p_brand"), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalise_instruction(raw).alias("clean"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS p0_key, event_type AS stream FROM events")
def q_kv_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("P0 Key=0x"), F.hex(F.get_json_object("props", "$.k").cast("bigint")), F.lit(", stream="), F.col("event_type"))
    found = text.key_values(line, ("p0_key", "stream"))
    return e.select("event_id", literals.parse_int(found["p0_key"]).alias("p0_key"), found["stream"].alias("stream"))


@query("SELECT o_orderkey, i - 1 AS place, substr(repeat('EN', 1 + CAST(o_orderkey % 3 AS INTEGER)), CAST(i AS INTEGER), 1) AS atom FROM (SELECT o_orderkey, unnest(range(1, 3 + 2 * (o_orderkey % 3))) AS i FROM orders)")
def q_atom_explode(spark, sf_dir):
    atoms = F.repeat(F.lit("EN"), (1 + F.col("o_orderkey") % 3).cast("int"))
    line = F.concat(F.lit("ATOM - "), atoms)
    exploded = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.filter(F.split(text.packet_fields(line)["atoms"], ""), lambda c: c != "")).alias("place", "atom"))
    return exploded.withColumn("place", F.col("place").cast("bigint"))


TOP = "t AS (SELECT k, count(*) AS n, min(event_id) AS f FROM ev WHERE k IS NOT NULL GROUP BY k), top AS (SELECT k, 1 + row_number() OVER (ORDER BY n DESC, f, k) AS id FROM t QUALIFY row_number() OVER (ORDER BY n DESC, f, k) <= 50)"


def top_tokens(spark, sf_dir):
    counts = vocab.token_counts(events(spark, sf_dir), ["k"], "event_id")
    return vocab.build(counts, "k", 50)


@query(f"WITH {EV}, {TOP} SELECT k, id FROM top")
def q_vocab_topk(spark, sf_dir):
    return top_tokens(spark, sf_dir)


@query(f"WITH {EV}, {TOP} SELECT event_id, coalesce(id, 1) AS token_id FROM ev LEFT JOIN top USING (k)")
def q_dict_encode(spark, sf_dir):
    return vocab.encode(events(spark, sf_dir), top_tokens(spark, sf_dir), {"k": "token_id"}, "k").select("event_id", "token_id")


@query(f"WITH {EV} SELECT event_id, CASE WHEN event_type = 'error' THEN '<GAP>@0x0' WHEN event_type = 'signup' THEN NULL ELSE 'u' || user_id || '::' || event_type || '@' || k END AS node FROM ev")
def q_joint_node(spark, sf_dir):
    kind = F.col("event_type")
    name = F.when(kind == "error", literals.GAP).when(kind != "signup", kind)
    off = F.when(kind == "error", "0x0").otherwise(F.col("k").cast("string"))
    return events(spark, sf_dir).select("event_id", control.node_id(F.concat(F.lit("u"), F.col("user_id")), name, off).alias("node"))


@query("WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), n AS (SELECT user_id, coalesce(sum(count(*) + 1) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM events GROUP BY user_id) SELECT event_id, CAST(start + pos AS BIGINT) AS row_id FROM r JOIN n USING (user_id)")
def q_row_ids(spark, sf_dir):
    return windows.row_ids(table(spark, sf_dir, "events"), BY, ORDER).select("event_id", "row_id")


@query(f"WITH {EV} SELECT event_id, array_to_string(list_concat(list_transform(range(8 - len(h)), lambda x: 0), h), ',') AS history FROM (SELECT event_id, coalesce(list(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS h FROM ev)")
def q_history_window(spark, sf_dir):
    h = windows.history(events(spark, sf_dir), "k", 8, BY, ORDER, pad=0)
    return h.select("event_id", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


@query("WITH n AS (SELECT coalesce(sum(count(*) + 1) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(count(*) + 1) OVER () AS total FROM events GROUP BY user_id) SELECT CAST(b AS BIGINT) AS split_row FROM n ORDER BY abs(b - floor(total * 0.8)), b DESC LIMIT 1")
def q_boundary_split(spark, sf_dir):
    rows = windows.row_ids(table(spark, sf_dir, "events"), BY, ORDER)
    starts = rows.groupBy("user_id").agg((F.min("row_id") - 1).alias("split_row"), F.count("*").alias("n"))
    total = starts.agg(F.sum(F.col("n") + 1).alias("total"))
    return windows.boundary_split(starts.crossJoin(F.broadcast(total)), "split_row", F.floor(F.col("total") * 0.8))


@query("""SELECT l_returnflag, CAST(sum(CASE WHEN l_linenumber > 1 AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS ctrl_rows, CAST(sum(CASE WHEN l_linenumber > 1 AND l_linestatus = 'O' AND l_quantity > 10 THEN 1 ELSE 0 END) AS BIGINT) AS dst_rows,
round(sum(CASE WHEN l_linenumber > 1 AND l_linestatus = 'O' AND l_quantity > 10 THEN -ln(greatest(l_discount, 1e-7)) ELSE 0 END) / sum(CASE WHEN l_linenumber > 1 AND l_linestatus = 'O' AND l_quantity > 10 THEN 1 ELSE 0 END), 6) AS loss FROM lineitem GROUP BY l_returnflag""")
def q_loss_masks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns(model.loss_weights(F.col("l_linenumber") > 1, F.col("l_linestatus") == "O", F.col("l_quantity") > 10))
    floor = F.greatest(F.col("l_discount"), F.lit(1e-7))
    return li.groupBy("l_returnflag").agg(F.sum("ctrl_weight").alias("ctrl_rows"), F.sum("dst_weight").alias("dst_rows"), F.round(F.sum(-F.log(floor) * F.col("dst_weight")) / F.sum("dst_weight"), 6).alias("loss"))


BIGRAM = "p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), c AS (SELECT prev, event_type, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY ALL), md AS (SELECT prev, event_type, n, n / sum(n) OVER (PARTITION BY prev) AS prob FROM c)"


def bigrams(spark, sf_dir):
    pairs = model.transitions(table(spark, sf_dir, "events"), "event_type", BY, ORDER)
    return pairs, model.fit_bigram(pairs, "event_type")


@query(f"WITH {BIGRAM} SELECT prev, event_type, n, round(prob, 6) AS prob FROM md")
def q_ngram_next(spark, sf_dir):
    return bigrams(spark, sf_dir)[1].select("prev", "event_type", "n", F.round("prob", 6).alias("prob"))


@query(f"""WITH {BIGRAM}, sc AS (SELECT p.user_id, p.ts, p.event_id, prob FROM p LEFT JOIN md USING (prev, event_type) WHERE prev IS NOT NULL),
w AS (SELECT *, sum(CASE WHEN prob < 0.1998 THEN 1 ELSE 0 END) OVER x AS low, count(*) OVER x AS n FROM sc WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT event_id, CAST(low AS BIGINT) AS low_count FROM w WHERE n >= 8 AND low >= 4""")
def q_ngram_score_alarm(spark, sf_dir):
    pairs, fitted = bigrams(spark, sf_dir)
    s = model.score_bigram(pairs, fitted, "event_type").filter("dst_prob IS NOT NULL").withColumn("row", F.row_number().over(windows.ordered(BY, ORDER)))
    runs = windows.scored_runs(s, "dst_prob", "row", BY, ORDER)
    return windows.alarms(windows.low_counts(runs, "dst_prob", 0.1998, 8, BY, ORDER, "row"), 8, 4).select("event_id", "low_count")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best, CASE WHEN list_position(embedding, list_max(embedding)) - 1 < 25 THEN (SELECT n_name FROM nation WHERE n_nationkey = list_position(embedding, list_max(embedding)) - 1) ELSE '<id:' || (list_position(embedding, list_max(embedding)) - 1) || '>' END AS token FROM embeddings")
def q_argmax_token(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", model.argmax(F.col("embedding")).cast("bigint").alias("best"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("best"), "n_name")
    return e.join(names, "best", "left").select("vec_id", "best", model.token_name(F.col("n_name"), F.col("best")).alias("token"))


@query("SELECT vec_id, round(coalesce(embedding[CAST(vec_id % 100 AS INTEGER) + 1], 0.0), 5) AS prob FROM embeddings")
def q_prob_at(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(model.probability_at(F.col("embedding"), F.col("vec_id") % 100).cast("double"), 5).alias("prob"))


@query("WITH v AS (SELECT abs(unnest(embedding)) AS m FROM embeddings), r AS (SELECT m, row_number() OVER (ORDER BY m) AS i, count(*) OVER () AS n FROM v) SELECT CAST(floor(n * 0.2) AS BIGINT) AS k, round(CAST(m AS DOUBLE), 7) AS threshold, (SELECT count(*) FROM v WHERE v.m > r.m) AS kept FROM r WHERE i = floor(n * 0.2)")
def q_prune_threshold(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("w"))
    cut = model.kth_magnitude(v, "w", 0.2)
    kept = v.crossJoin(F.broadcast(cut)).groupBy("k", "threshold").agg(F.count_if(F.abs("w") > F.col("threshold")).alias("kept"))
    return kept.select("k", F.round(F.col("threshold").cast("double"), 7).alias("threshold"), "kept")


@query("SELECT n_nationkey, round(0.7 + (0.2 - 0.7) * pow(1 - greatest(0.0, least(1.0, (n_nationkey - 2) / 20)), 3), 9) AS sparsity FROM nation")
def q_sparsity_schedule(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(model.scheduled_sparsity(0.2, 0.7, (F.col("n_nationkey") - 2) / 20), 9).alias("sparsity"))


@query("SELECT l_orderkey, l_linenumber, confidence FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'medium' ELSE 'high' END AS confidence, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS rank FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY rank DESC, l_linenumber, l_partkey) = 1")
def q_keep_best(spark, sf_dir):
    named = F.when(F.col("l_returnflag") == "A", "low").when(F.col("l_returnflag") == "N", "medium").otherwise("high")
    li = table(spark, sf_dir, "lineitem").withColumn("confidence", named)
    return graph.keep_best(li, ["l_orderkey"], control.confidence_rank(F.col("confidence")), ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "confidence")


@query("SELECT l_orderkey, count(DISTINCT t) AS n_targets, coalesce(string_agg(DISTINCT t, ';' ORDER BY t), '') AS targets, CASE WHEN count(t) = 0 THEN 'unresolved' WHEN max(c) = 1 THEN 'resolved' ELSE 'partial' END AS status FROM (SELECT l_orderkey, CASE WHEN l_quantity > 25 THEN CAST(l_suppkey AS VARCHAR) END AS t, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS c FROM lineitem) GROUP BY l_orderkey")
def q_indirect_sites(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("target", F.when(F.col("l_quantity") > 25, F.col("l_suppkey").cast("string")))
    return graph.indirect_sites(li, ["l_orderkey"], "target", F.col("l_returnflag") == "R")


@query("WITH e AS (SELECT l_partkey % 50 AS a, l_suppkey AS b FROM lineitem), n AS (SELECT a AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT b, 1, 0 FROM e) SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM n GROUP BY node")
def q_degrees(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("a"), F.col("l_suppkey").alias("b"))
    return graph.degrees(e, "a", "b")


@query("SELECT l_orderkey, sha256(string_agg('B:' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || ':' || l_partkey, chr(10) ORDER BY 'B:' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || ':' || l_partkey)) AS layout_hash, FROM lineitem GROUP BY l_orderkey")
def q_layout_hash(spark, sf_dir):
    part = F.concat(F.lit("B:"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit(":"), F.col("l_partkey"))
    return graph.ordered_hash(table(spark, sf_dir, "lineitem"), ["l_orderkey"], part, "layout_hash")


#: The unit separator between the parts of a hash.
SEP = "chr(31)"
WL_STEP = f"""i{{t}} AS (SELECT e.g, e.dst AS node, string_agg(e.type || ':' || c.colour, {SEP} ORDER BY e.type || ':' || c.colour) AS s FROM e JOIN c{{p}} c ON c.g = e.g AND c.node = e.src GROUP BY ALL),
o{{t}} AS (SELECT e.g, e.src AS node, string_agg(e.type || ':' || c.colour, {SEP} ORDER BY e.type || ':' || c.colour) AS s FROM e JOIN c{{p}} c ON c.g = e.g AND c.node = e.dst GROUP BY ALL),
c{{t}} AS (SELECT c.g, c.node, CASE WHEN rounds >= {{t}} THEN sha256(c.colour || {SEP} || 'IN' || coalesce({SEP} || i.s, '') || {SEP} || 'OUT' || coalesce({SEP} || o.s, '')) ELSE c.colour END AS colour, rounds FROM c{{p}} c LEFT JOIN i{{t}} i USING (g, node) LEFT JOIN o{{t}} o USING (g, node))"""


@query(
    f"""WITH e AS (SELECT DISTINCT l_orderkey % 40 AS g, l_partkey % 12 AS src, l_suppkey % 12 AS dst, l_returnflag AS type FROM lineitem),
n AS (SELECT g, src AS node FROM e UNION SELECT g, dst FROM e),
di AS (SELECT g, dst AS node, count(*) AS i FROM e GROUP BY ALL), dout AS (SELECT g, src AS node, count(*) AS o FROM e GROUP BY ALL),
c0 AS (SELECT g, node, sha256(CASE WHEN node = 0 THEN 'ENTRY' ELSE 'NODE' END || {SEP} || 'flow' || {SEP} || coalesce(i, 0) || {SEP} || coalesce(o, 0)) AS colour, least(count(*) OVER (PARTITION BY g), 8) AS rounds FROM n LEFT JOIN di USING (g, node) LEFT JOIN dout USING (g, node)),
{", ".join(WL_STEP.format(t=t, p=t - 1) for t in range(1, 9))},
a AS (SELECT g, count(*) AS n, string_agg(colour, {SEP} ORDER BY colour) AS s FROM c8 GROUP BY g),
t AS (SELECT e.g, x.colour || ':' || e.type || ':' || y.colour AS line FROM e JOIN c8 x ON x.g = e.g AND x.node = e.src JOIN c8 y ON y.g = e.g AND y.node = e.dst),
b AS (SELECT g, count(*) AS n, string_agg(line, {SEP} ORDER BY line) AS s FROM t GROUP BY g)
SELECT g, sha256('NODES' || {SEP} || a.n || {SEP} || a.s || {SEP} || 'EDGES' || {SEP} || b.n || {SEP} || b.s) AS fingerprint FROM a JOIN b USING (g)"""
)
def q_wl_fingerprint(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    e = li.select((F.col("l_orderkey") % 40).alias("g"), (F.col("l_partkey") % 12).alias("src"), (F.col("l_suppkey") % 12).alias("dst"), F.col("l_returnflag").alias("type")).distinct()
    n = e.select("g", F.col("src").alias("node")).union(e.select("g", "dst")).distinct()
    return graph.fingerprint(n, e, "g", [F.when(F.col("node") == 0, "ENTRY").otherwise("NODE"), F.lit("flow")])


@query(f"""WITH {EV}, r AS (SELECT user_id, ts, event_id, event_type = 'error' AS cut, k % 4 AS here, k // 4 % 4 AS there FROM ev),
p AS (SELECT *, lag(cut) OVER w AS pc, lag(there) OVER w AS pt, row_number() OVER w AS rn FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN cut OR pc IS NULL OR pc OR pt IS DISTINCT FROM here THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS run FROM p),
x AS (SELECT user_id, run, count(*) AS length, max(rn) AS last FROM s WHERE NOT cut GROUP BY ALL)
SELECT x.user_id, row_number() OVER (PARTITION BY x.user_id ORDER BY x.run) - 1 AS segment_id, CAST(length AS INTEGER) AS length, CASE WHEN n.rn IS NULL THEN 'file_end' WHEN n.cut THEN 'discontinuity:error' ELSE 'pc_mismatch' END AS break_reason,
CAST(length AS INTEGER) AS n_valid FROM x LEFT JOIN s n ON n.user_id = x.user_id AND n.rn = x.last + 1""")
def q_segmenter(spark, sf_dir):
    """The machine under the strict policy, on ranges that begin and go on at one of four places each."""
    place = lambda n: (n * 64 + 0x1000).cast("string")
    k, cut = F.col("k"), F.col("event_type") == "error"
    e = events(spark, sf_dir).select("user_id", F.col("row").alias("n"), F.when(cut, "discontinuity").otherwise("instruction_range").alias("event"), F.when(cut, F.lit("error")).alias("reason"), F.lit("m").alias("module"), *[place(k % 4).alias(c) for c in ("runtime_start", "runtime_end", "elf_start", "elf_end")], place(F.floor(k / 4) % 4).alias("next_pc"), F.struct(F.lit("direct_branch").alias("kind")).alias("waypoint"))
    found = segmenter.segment_events(e, by="user_id", order="n", policy="strict")
    return found.select("user_id", "segment_id", "length", "break_reason", F.size(F.filter("tokens", lambda t: t["target_valid"])).alias("n_valid"))


@query(f"""WITH {EV}, r AS (SELECT user_id, row AS n, k, event_type, k % 4 AS here, CASE WHEN k % 19 <> 0 THEN k // 4 % 4 END AS there,
CASE WHEN event_type = 'signup' THEN 'exception' WHEN event_type = 'error' THEN NULL WHEN k % 29 = 0 THEN 'range:address-not-in-maps' WHEN k % 31 = 0 THEN 'range_status:weird' WHEN event_type <> 'purchase' AND k % 23 = 0 THEN 'range:outside_target_module' END AS cut FROM ev),
q AS (SELECT *, CASE WHEN cut IS NOT NULL THEN 'C' WHEN event_type = 'error' THEN 'G' WHEN event_type = 'purchase' THEN 'P' ELSE 'N' END AS kind, count(cut) OVER (PARTITION BY user_id ORDER BY n) AS seg FROM r),
x AS (SELECT *, lead(kind) OVER w AS nk, lead(here) OVER w AS nh, lead(cut) OVER w AS nc FROM q WINDOW w AS (PARTITION BY user_id ORDER BY n)),
f AS (SELECT *, CASE WHEN nk = 'N' AND nh <> there THEN 'pc_mismatch' WHEN nk = 'P' AND nh IS DISTINCT FROM there THEN 'range_before_partial_mismatch' END AS forced, coalesce(nk IN ('N', 'P') AND nh = there, false) AS hint FROM x WHERE kind = 'N'),
t AS (SELECT user_id, seg, n + 1 AS em, 0 AS ord, CASE WHEN event_type = 'view' THEN 'return' ELSE 'direct_branch' END AS kind, CASE WHEN forced IS NOT NULL THEN 'conflict' WHEN hint THEN 'confirmed' WHEN event_type = 'view' THEN 'speculative' ELSE 'exact' END AS confidence,
forced IS NULL AND there IS NOT NULL AND (hint OR event_type <> 'view') AS valid, forced AS reason, CASE WHEN there IS NULL THEN '<UNKNOWN_TARGET>@0x0' WHEN hint THEN 'f' || there || '@0x10' ELSE '<elf>@' || format('0x{{:x}}', there * 64) END AS dst FROM f WHERE NOT coalesce(nc = 'range:outside_target_module' AND nh = there, false)
UNION ALL SELECT user_id, seg, n + 1, 1, 'flow_gap', 'observed', false, coalesce(forced, 'missing_prev_next_pc'), '<GAP>@0x0' FROM f WHERE forced IS NOT NULL OR nk = 'N' AND there IS NULL
UNION ALL SELECT user_id, seg, n, 2, 'return', 'unresolved', false, NULL, '<UNKNOWN_TARGET>@0x0' FROM x WHERE kind = 'P'
UNION ALL SELECT user_id, seg, n, 3, 'flow_gap', 'observed', false, 'range_status:target_unresolved', '<GAP>@0x0' FROM x WHERE kind = 'P'
UNION ALL SELECT user_id, seg, n, 1, 'flow_gap', 'observed', false, CASE WHEN k % 2 = 0 THEN 'lost' ELSE 'overflowed' END, '<GAP>@0x0' FROM x WHERE kind = 'G'),
l AS (SELECT *, row_number() OVER w AS i, lag(kind) OVER w AS before FROM t WINDOW w AS (PARTITION BY user_id, seg ORDER BY em, ord)),
m AS (SELECT *, sum(CASE WHEN kind = 'flow_gap' AND before = 'flow_gap' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, seg ORDER BY i) AS g FROM l),
why AS (SELECT user_id, seg, g, string_agg(reason, ';' ORDER BY i) AS reasons FROM (SELECT user_id, seg, g, reason, min(i) AS i FROM m WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY ALL),
k AS (SELECT m.*, coalesce(reasons, '') AS reasons FROM m LEFT JOIN why USING (user_id, seg, g) WHERE NOT (m.kind = 'flow_gap' AND coalesce(before, '') = 'flow_gap')),
s AS (SELECT user_id, seg, CAST(count(*) AS INTEGER) AS length, string_agg(kind || ' ' || confidence || ' ' || valid || ' ' || CASE WHEN kind <> 'flow_gap' AND before = 'flow_gap' THEN 'after_gap' ELSE 'continuous' END || ' ' || dst || ' ' || reasons, ', ' ORDER BY i) AS tokens FROM k GROUP BY ALL)
SELECT s.user_id, row_number() OVER (PARTITION BY s.user_id ORDER BY s.seg) - 1 AS segment_id, length, coalesce(q.cut, 'file_end') AS break_reason, tokens FROM s LEFT JOIN q ON q.user_id = s.user_id AND q.cut IS NOT NULL AND q.seg = s.seg + 1""")
def q_segmenter_evidence(spark, sf_dir):
    """The evidence policy with every kind of range: whole segments, token by token."""
    k, kind = F.col("k"), F.col("event_type")
    here, there, range_ = k % 4, F.when(k % 19 != 0, F.floor(k / 4) % 4), ~kind.isin("signup", "error")
    place = lambda n, at=0x1000: (n * 64 + at).cast("string")
    cols = {
        "event": F.when(kind == "signup", "exception").when(kind == "error", "flow_gap").otherwise("instruction_range"),
        "reason": F.when(kind == "error", F.when(k % 2 == 0, "lost").otherwise("overflowed")).when(range_ & (k % 29 == 0), "address-not-in-maps"),
        "status": F.when(k % 31 == 0, "weird").when(kind == "purchase", "target_unresolved"),
        "module": F.when(k % 23 == 0, "other").otherwise("m"),
        "start_symbol": F.concat(F.lit("f"), here.cast("string"), F.lit("+0x10")),
        "next_pc": F.when(kind != "purchase", place(there)),
        "target_source": F.when(kind == "view", "software_return_stack"),
        "waypoint": F.struct(F.when(kind.isin("view", "purchase"), "return").otherwise("direct_branch").alias("kind")),
    }
    cols |= {c: place(here) for c in ("runtime_start", "runtime_end")} | {c: place(here, 0) for c in ("elf_start", "elf_end")}
    e = events(spark, sf_dir).select("user_id", F.col("row").alias("n"), *[v.alias(c) for c, v in cols.items()])
    found = segmenter.segment_events(e, by="user_id", order="n", target_modules=("m",))
    words = F.transform("tokens", lambda t: F.concat_ws(" ", t["kind"], t["confidence"], t["target_valid"].cast("string"), t["continuity"], F.concat(t["dst_function"], F.lit("@"), t["dst_offset"]), F.coalesce(t["reason"], F.lit(""))))
    return found.select("user_id", "segment_id", "length", "break_reason", F.array_join(words, ", ").alias("tokens"))


SHARED_SQL = {"module": (["src_module", "dst_module"], 10, []), "function": (["src_ctrl_func", "dst_func"], 5, []), "offset": (["src_ctrl_off", "dst_off"], 60, []), "node": (["dst_node"], 80, ["<UNKNOWN_TARGET>@0x0", "<GAP>@0x0"]), "ctrl_type": (["ctrl_type"], 0, [])}


def _vocabulary_sql(name: str) -> str:
    fields, size, reserved = SHARED_SQL[name]
    each = " UNION ALL ".join(f"SELECT {f} AS t, row_id * {len(fields)} + {i} AS seen FROM e WHERE {f} IS NOT NULL" for i, f in enumerate(fields))
    top = f"QUALIFY row_number() OVER (ORDER BY n DESC, f, t) <= {size - 2 - len(reserved)}" if size else ""
    kept = " WHERE t NOT IN (" + ", ".join(f"'{r}'" for r in reserved) + ")" if reserved else ""
    fixed = "".join(f" UNION ALL SELECT '{r}', {2 + i}" for i, r in enumerate(reserved))
    return f"c_{name} AS (SELECT t, count(*) AS n, min(seen) AS f FROM ({each}) GROUP BY t), k_{name} AS (SELECT * FROM c_{name} {top}), v_{name} AS (SELECT t, {1 + len(reserved)} + row_number() OVER (ORDER BY n DESC, f, t) AS id FROM k_{name}{kept}{fixed})"


def _id_sql(field: str) -> str:
    name = next(n for n, (fields, *_) in SHARED_SQL.items() if field in fields)
    return f"CAST(coalesce((SELECT id FROM v_{name} WHERE t = {field}), 1) AS INTEGER) AS {field}"


#: Edges of user streams, as segments: a control transfer each, some to gaps, some doubtful.
EDGES_SQL = f"""{EV}, n AS (SELECT user_id, coalesce(sum(count(*) + 1) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM events GROUP BY user_id HAVING count(*) >= 3),
e0 AS (SELECT user_id, CAST(start + row AS BIGINT) AS row_id, row - 1 AS pos, k, 'm' || user_id % 7 AS src_module, event_type AS src_ctrl_func, CASE WHEN k % 11 <> 0 THEN CAST(k AS VARCHAR) END AS src_ctrl_off,
event_type || CASE WHEN k % 2 = 0 THEN ':taken' WHEN k % 3 = 0 THEN ':not_taken' ELSE ':unknown' END || CASE WHEN k % 5 = 0 THEN '|speculative' ELSE '' END AS ctrl_type,
CASE WHEN k % 23 = 0 THEN '<UNKNOWN_MODULE>' ELSE 'm' || k % 3 END AS dst_module, CASE WHEN k % 13 = 0 THEN '<GAP>' WHEN k % 7 <> 0 THEN event_type END AS dst_func, CASE WHEN k % 13 = 0 THEN '0x0' ELSE CAST(k % 50 AS VARCHAR) END AS dst_off FROM ev JOIN n USING (user_id)),
e AS (SELECT *, CASE WHEN dst_func = '<GAP>' THEN dst_func || '@' || dst_off WHEN dst_func IS NOT NULL THEN dst_module || '::' || dst_func || '@' || dst_off END AS dst_node FROM e0)"""


def edge_segments(spark, sf_dir):
    """Segments as they are written, one for each user."""
    k, text_of = F.col("k"), lambda c: c.cast("string")
    place = lambda module, function, offset: F.struct(module.alias("module"), function.alias("function"), offset.alias("function_offset"))
    dst = place(F.when(k % 23 != 0, F.concat(F.lit("m"), k % 3)), F.when(k % 13 == 0, literals.GAP).when(k % 7 == 0, "<unknown>").otherwise(F.col("event_type")), F.when(k % 13 == 0, "0x0").otherwise(text_of(k % 50)))
    src = place(F.concat(F.lit("m"), F.col("user_id") % 7), F.col("event_type"), F.when(k % 11 != 0, text_of(k)))
    ctrl = F.struct(F.col("event_type").alias("kind"), F.when(k % 2 == 0, "E").when(k % 3 == 0, "N").alias("atom"))
    quality = F.create_map(*[x for name, c in {"target_valid": text_of(k % 4 != 0), "confidence": F.when(k % 5 == 0, "speculative").otherwise("exact"), "path_confidence": F.when(k % 5 == 0, "speculative"), "continuity": F.when(k % 17 == 0, "after_gap"), "status": F.when(k % 13 == 0, "gap")}.items() for x in (F.lit(name), c)])
    token = F.struct(src.alias("src_ctrl"), ctrl.alias("ctrl"), dst.alias("dst"), F.when(k % 19 == 0, "<unknown>").otherwise(text_of(k % 300)).alias("instruction_count"), quality.alias("quality"))
    listed = events(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("row", F.to_json(token).alias("t")))).alias("x"))
    kind = "struct<src_ctrl:struct<module:string,function:string,function_offset:string>,ctrl:struct<kind:string,atom:string>,dst:struct<module:string,function:string,function_offset:string>,instruction_count:string,quality:map<string,string>>"
    return listed.select("user_id", F.transform("x", lambda r: F.from_json(r["t"], kind)).alias("tokens"))


LIMITS = dataset.Limits(**{name: size for name, (_, size, _) in SHARED_SQL.items()}, min_length=3)


@query(f"""WITH {EDGES_SQL}, {", ".join(map(_vocabulary_sql, SHARED_SQL))}
SELECT row_id, {", ".join(_id_sql(f) for fields, *_ in SHARED_SQL.values() for f in fields)}, CAST(CASE WHEN k % 19 = 0 THEN 1 ELSE least(k % 300, 255) + 2 END AS INTEGER) AS icount,
CAST(k % 4 <> 0 AND dst_func IS NOT NULL AS INTEGER) AS target_valid, CAST(k % 5 <> 0 AS INTEGER) AS control_valid, CAST(k % 17 <> 0 AS INTEGER) AS transition_valid, CAST(k % 13 = 0 AS INTEGER) AS is_gap FROM e
UNION ALL SELECT CAST(start AS BIGINT), {", ".join(["0"] * 13)} FROM n""")
def q_dataset_rows(spark, sf_dir):
    return dataset.build(edge_segments(spark, sf_dir), ["user_id"], LIMITS).rows


@query(f"""WITH {EDGES_SQL}, {", ".join(map(_vocabulary_sql, SHARED_SQL))} {" UNION ALL ".join(f"SELECT '{name}' AS name, t AS token, id FROM v_{name}" for name in SHARED_SQL)}""")
def q_dataset_vocabulary(spark, sf_dir):
    found = dataset.build(edge_segments(spark, sf_dir), ["user_id"], LIMITS).vocabs
    parts = [v.select(F.lit(name).alias("name"), "token", "id") for name, v in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@query(f"""WITH {EDGES_SQL}, s AS (SELECT count(*) AS seen, count_if(c >= 3) AS kept FROM (SELECT count(*) AS c FROM events GROUP BY user_id))
SELECT seen AS segments_seen, CAST(kept AS BIGINT) AS segments_kept, CAST(seen - kept AS BIGINT) AS segments_dropped_short, count(*) AS edges, CAST(count_if(pos > 0) AS BIGINT) AS examples, CAST(count_if(NOT (k % 4 <> 0 AND dst_func IS NOT NULL)) AS BIGINT) AS invalid_target_edges,
CAST(count_if(k % 5 = 0) AS BIGINT) AS invalid_control_edges, CAST(count_if(k % 13 = 0) AS BIGINT) AS gap_edges, CAST(count_if(pos > 0 AND k % 17 = 0) AS BIGINT) AS invalid_transition_examples FROM e, s GROUP BY ALL""")
def q_dataset_stats(spark, sf_dir):
    return dataset.build(edge_segments(spark, sf_dir), ["user_id"], LIMITS).stats


#: A process's maps, the rules of 25 modules and the segments of five files.
PLACES_SQL = """mp AS (SELECT s_suppkey AS map_idx, s_suppkey * 200 AS start, s_suppkey * 200 + 150 + s_suppkey % 3 * 40 AS stop, CASE WHEN s_suppkey % 4 = 0 THEN 'rw-p' ELSE 'r-xp' END AS perms, s_suppkey % 2 * 100 AS pgoff, '/lib/n' || s_nationkey || '.so' AS path FROM supplier),
ru AS (SELECT n_nationkey AS module_idx, 'n' || n_nationkey AS name, 'e' || n_nationkey % 5 AS elf, n_nationkey * 300 AS load_bias, n_nationkey % 2 = 0 AS some_contexts, n_nationkey % 3 = 0 AS some_els, n_nationkey % 4 = 0 AS ranged, n_nationkey % 5 = 1 AS anchored FROM nation),
sg AS (SELECT 'e' || r_regionkey AS elf, 0 AS seg_idx, 50 AS p_offset, 100 AS p_vaddr, 3000 AS p_filesz, 4000 + r_regionkey * 100 AS p_memsz, 5 AS flags FROM region UNION ALL SELECT 'e' || r_regionkey, 1, 3050, 4100 + r_regionkey * 100, 300, 400, 6 FROM region)"""


def places(spark, sf_dir):
    """Maps, rules and segments as ``resolver`` takes them."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    maps_ = table(spark, sf_dir, "supplier").select(k.alias("map_idx"), (k * 200).alias("start"), (k * 200 + 150 + k % 3 * 40).alias("stop"), F.when(k % 4 == 0, "rw-p").otherwise("r-xp").alias("perms"), (k % 2 * 100).alias("pgoff"), F.concat(F.lit("/lib/n"), "s_nationkey", F.lit(".so")).alias("path"))
    span = F.array(F.struct((n * 300).alias("start"), (n * 300 + 2000).alias("stop")))
    rules = table(spark, sf_dir, "nation").select(n.alias("module_idx"), F.concat(F.lit("n"), n).alias("name"), F.concat(F.lit("e"), n % 5).alias("elf"), (n * 300).alias("load_bias"), F.when(n % 5 == 1, F.array(F.concat(F.lit("n"), n, F.lit("[.]so$")))).otherwise(F.array().cast("array<string>")).alias("anchors"), F.when(n % 2 == 0, F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("context_ids"), F.lit(None).cast("array<bigint>").alias("vmids"), F.when(n % 3 == 0, F.array(F.lit("EL1"))).alias("els"), F.when(n % 4 == 0, span).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("ranges"))
    r = F.col("r_regionkey")
    elf = F.concat(F.lit("e"), r)
    code = table(spark, sf_dir, "region").select(elf.alias("elf"), F.lit(0).alias("seg_idx"), F.lit(50).alias("p_offset"), F.lit(100).alias("p_vaddr"), F.lit(3000).alias("p_filesz"), (r * 100 + 4000).alias("p_memsz"), F.lit(5).alias("flags"))
    data = table(spark, sf_dir, "region").select(elf.alias("elf"), F.lit(1).alias("seg_idx"), F.lit(3050).alias("p_offset"), (r * 100 + 4100).alias("p_vaddr"), F.lit(300).alias("p_filesz"), F.lit(400).cast("long").alias("p_memsz"), F.lit(6).alias("flags"))
    return maps_, rules, code.unionByName(data)


@query(f"""WITH {PLACES_SQL}, pt AS (SELECT o_orderkey AS row_id, o_orderkey % 20011 AS address, o_custkey % 4 AS context_id, 'EL' || o_orderkey % 2 AS el FROM orders),
md AS (SELECT pt.*, map_idx, perms, path FROM pt LEFT JOIN mp ON address >= start AND address < stop QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY start DESC, map_idx) = 1),
cd AS (SELECT md.row_id, name AS module, ru.elf, address - load_bias AS elf_va, CASE WHEN address - load_bias < p_vaddr + p_filesz THEN p_offset + address - load_bias - p_vaddr END AS file_offset, seg_idx,
100 + CASE WHEN path IS NOT NULL THEN 80 + CASE WHEN anchored AND regexp_matches(path, name || '[.]so$') THEN 100 ELSE 0 END ELSE 0 END + CASE WHEN ranged THEN 100 ELSE 0 END + CASE WHEN some_contexts THEN 50 ELSE 0 END + CASE WHEN some_els THEN 30 ELSE 0 END AS score
FROM md JOIN ru ON (NOT some_contexts OR context_id < 2) AND (NOT some_els OR el = 'EL1') AND (NOT ranged OR (address >= load_bias AND address < load_bias + 2000)) JOIN sg ON sg.elf = ru.elf AND flags = 5 AND address - load_bias >= p_vaddr AND address - load_bias < p_vaddr + p_memsz
WHERE perms IS NULL OR perms = 'r-xp' QUALIFY row_number() OVER (PARTITION BY md.row_id ORDER BY score DESC, module_idx, seg_idx) = 1)
SELECT md.row_id, path, module, elf, elf_va, file_offset, seg_idx, score, CASE WHEN perms = 'rw-p' THEN 'address-in-non-executable-map' WHEN module IS NOT NULL THEN NULL WHEN path IS NULL THEN 'address-not-in-maps' ELSE 'no-configured-elf' END AS reason FROM md LEFT JOIN cd USING (row_id)""")
def q_resolve(spark, sf_dir):
    maps_, rules, segments = places(spark, sf_dir)
    k = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select(k.alias("row_id"), (k % 20011).alias("address"), (F.col("o_custkey") % 4).alias("context_id"), F.lit(None).cast("long").alias("vmid"), F.concat(F.lit("EL"), k % 2).alias("el"))
    return resolver.resolve(points, maps_, rules, segments).drop("address", "context_id", "vmid", "el")


@query(f"""WITH {PLACES_SQL}, pr AS (SELECT module_idx, ru.elf, map_idx, seg_idx, start - p_vaddr // 100 * 100 AS bias, CASE WHEN anchored THEN 1000 ELSE 0 END + CASE WHEN contains(path, '/' || name) THEN 300 ELSE 0 END + CASE WHEN pgoff = p_offset // 100 * 100 THEN 200 WHEN pgoff <> 0 THEN -200 ELSE 0 END
+ CASE WHEN stop - start = runs THEN 400 WHEN stop - start <= runs THEN 80 ELSE -least(300, (stop - start - runs) // 100) END + CASE WHEN (perms = 'r-xp') = (flags = 5) THEN 150 ELSE 0 END AS own
FROM ru JOIN (SELECT *, (p_vaddr - p_vaddr // 100 * 100 + p_memsz + 99) // 100 * 100 AS runs FROM sg) sg USING (elf) JOIN mp ON (NOT anchored OR regexp_matches(path, name || '[.]so$')) AND NOT (perms = 'r-xp' AND flags = 6)),
bs AS (SELECT DISTINCT module_idx, elf, bias FROM pr), ht AS (SELECT module_idx, bias, map_idx, perms, min_by(flags, seg_idx) AS flags FROM bs JOIN sg USING (elf) JOIN mp ON start - bias >= p_vaddr AND start - bias < p_vaddr + p_memsz GROUP BY ALL),
cv AS (SELECT module_idx, bias, count(*) * 10 + count_if(perms = 'r-xp' AND flags = 5) * 30 AS c FROM ht GROUP BY ALL)
SELECT module_idx, bias AS load_bias, CAST(own + coalesce(c, 0) AS BIGINT) AS score FROM pr LEFT JOIN cv USING (module_idx, bias) QUALIFY row_number() OVER (PARTITION BY module_idx ORDER BY score DESC, abs(bias), map_idx, seg_idx) = 1""")
def q_infer_bias(spark, sf_dir):
    maps_, rules, segments = places(spark, sf_dir)
    return resolver.infer_bias(rules, maps_, segments, page=100)


VERSIONS = """o AS (SELECT p_partkey AS oid, p_brand || (p_partkey % 40) AS name, p_type AS sig FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey AS nid, p_brand || (p_partkey % 40 - 1) AS name, p_type AS sig FROM part WHERE p_partkey % 2 = 1)"""


def versions(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    old = p.filter(k % 2 == 0).select(k.alias("oid"), F.concat("p_brand", (k % 40).cast("string")).alias("name"), F.col("p_type").alias("sig"))
    new = p.filter(k % 2 == 1).select(k.alias("nid"), F.concat("p_brand", (k % 40 - 1).cast("string")).alias("name"), F.col("p_type").alias("sig"))
    return old, new


@query(f"""WITH {VERSIONS}, m1 AS (SELECT oid, nid FROM (SELECT name, min(oid) AS oid FROM o GROUP BY name HAVING count(*) = 1) JOIN (SELECT name, min(nid) AS nid FROM n GROUP BY name HAVING count(*) = 1) USING (name)),
o1 AS (SELECT * FROM o ANTI JOIN m1 USING (oid)), n1 AS (SELECT * FROM n ANTI JOIN m1 USING (nid)),
m2 AS (SELECT oid, nid FROM (SELECT name, sig, min(oid) AS oid FROM o1 GROUP BY ALL HAVING count(*) = 1) JOIN (SELECT name, sig, min(nid) AS nid FROM n1 GROUP BY ALL HAVING count(*) = 1) USING (name, sig)),
o2 AS (SELECT * FROM o1 ANTI JOIN m2 USING (oid)), n2 AS (SELECT * FROM n1 ANTI JOIN m2 USING (nid)),
m3 AS (SELECT oid, nid FROM (SELECT name, min(oid) AS oid FROM o2 GROUP BY name HAVING count(*) = 1) JOIN (SELECT name, min(nid) AS nid FROM n2 GROUP BY name HAVING count(*) = 1) USING (name))
SELECT *, 'name' AS method, 'high' AS confidence FROM m1 UNION ALL SELECT *, 'signature', 'high' FROM m2 UNION ALL SELECT *, 'residual', 'medium' FROM m3""")
def q_function_match(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return joins.match_versions(old, new, "name", "sig", "oid", "nid")


@query(f"WITH {VERSIONS} SELECT oid, nid FROM (SELECT name, sig, min(oid) AS oid FROM o GROUP BY ALL HAVING count(*) = 1) JOIN (SELECT name, sig, min(nid) AS nid FROM n GROUP BY ALL HAVING count(*) = 1) USING (name, sig)")
def q_unique_block_map(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return joins.unique_pairs(old, new, ["name", "sig"], "oid", "nid").select("oid", "nid")


PROP_STEP = """a{t} AS (SELECT m.o, m.n, e.type, min(e.dst) AS o2 FROM (SELECT * FROM eo WHERE dst NOT IN (SELECT o FROM m{p})) e JOIN m{p} m ON e.src = m.o GROUP BY ALL HAVING count(*) = 1),
b{t} AS (SELECT m.o, m.n, e.type, min(e.dst) AS n2 FROM (SELECT * FROM en WHERE dst NOT IN (SELECT n FROM m{p})) e JOIN m{p} m ON e.src = m.n GROUP BY ALL HAVING count(*) = 1),
d{t} AS (SELECT DISTINCT o2, n2 FROM a{t} JOIN b{t} USING (o, n, type)),
m{t} AS (SELECT o, n FROM m{p} UNION ALL SELECT o2, n2 FROM (SELECT *, count(*) OVER (PARTITION BY o2) AS x, count(*) OVER (PARTITION BY n2) AS y FROM d{t}) WHERE x = 1 AND y = 1)"""


@query(f"""WITH c AS (SELECT max(l_orderkey) + 1 AS c FROM lineitem), eo AS (SELECT DISTINCT l_orderkey AS src, l_orderkey * 3 % c AS dst, l_returnflag AS type FROM lineitem, c), en AS (SELECT DISTINCT l_orderkey + 10000 AS src, l_orderkey * 3 % c + 10000 AS dst, l_returnflag AS type FROM lineitem, c WHERE l_orderkey % 11 <> 0),
m0 AS (SELECT DISTINCT l_orderkey AS o, l_orderkey + 10000 AS n FROM lineitem WHERE l_orderkey % 25 = 0), {PROP_STEP.format(t=1, p=0)}, {PROP_STEP.format(t=2, p=1)} SELECT o, n FROM m2""")
def q_neighbor_propagate(spark, sf_dir):
    k = F.col("l_orderkey")
    li = table(spark, sf_dir, "lineitem")
    nodes = F.lit(li.agg(F.coalesce(F.max(k), F.lit(0))).first()[0] + 1)
    eo = li.select(k.alias("src"), (k * 3 % nodes).alias("dst"), F.col("l_returnflag").alias("type")).distinct()
    en = li.filter(k % 11 != 0).select((k + 10000).alias("src"), (k * 3 % nodes + 10000).alias("dst"), F.col("l_returnflag").alias("type")).distinct()
    return joins.propagate(li.filter(k % 25 == 0).select(k.alias("o"), (k + 10000).alias("n")).distinct(), eo, en, 2)


SIMILAR = """pr AS (SELECT a.p_partkey AS o, b.p_partkey AS n, 0.30 * (a.p_brand = b.p_brand)::INT + 0.25 * (a.p_name = b.p_name)::INT + 0.15 * (a.p_type = b.p_type)::INT + 0.15 / (1 + abs(a.p_size - b.p_size)) + 0.10 * least(a.p_size, b.p_size) / greatest(a.p_size, b.p_size) + 0.05 * (a.p_size = b.p_size)::INT AS s
FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1)"""


@query(f"""WITH {SIMILAR}, x AS (SELECT o, n, s FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY round(s, 9) DESC, n) AS k, coalesce(lead(round(s, 9)) OVER (PARTITION BY o ORDER BY round(s, 9) DESC, n), 0) AS nx FROM pr) WHERE k = 1 AND round(s, 9) >= 0.4 AND round(s, 9) - nx >= 0.02),
y AS (SELECT o, n FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY round(s, 9) DESC, o) AS k, coalesce(lead(round(s, 9)) OVER (PARTITION BY n ORDER BY round(s, 9) DESC, o), 0) AS nx FROM pr) WHERE k = 1 AND round(s, 9) >= 0.4 AND round(s, 9) - nx >= 0.02)
SELECT o, n, round(s, 9) AS similarity FROM x JOIN y USING (o, n)""")
def q_mutual_best(spark, sf_dir):
    p = table(spark, sf_dir, "part")

    def score(same, a, b):
        return graph.block_similarity(same["p_brand"], same["p_name"], F.lit(True), F.abs(a - b), F.least(a, b) / F.greatest(a, b), a == b)

    return likeness.mutual_best(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1"), "p_partkey", ["p_type"], ["p_brand", "p_name"], "p_size", score, 0.4, 0.02)


EDGES = "a AS (SELECT l_partkey AS src, l_suppkey AS dst, min(l_returnflag) AS t FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY ALL), b AS (SELECT l_partkey AS src, l_suppkey AS dst, min(l_returnflag) AS t FROM lineitem WHERE l_orderkey % 3 <> 1 GROUP BY ALL), df AS (SELECT src, dst, a.t AS old_type, b.t AS new_type, CASE WHEN a.t IS NULL THEN 'ADDED' WHEN b.t IS NULL THEN 'REMOVED' WHEN a.t = b.t THEN 'UNCHANGED' ELSE 'TYPE_CHANGED' END AS status FROM a FULL JOIN b USING (src, dst))"


def edge_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda skip: li.filter(F.col("l_orderkey") % 3 != skip).groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.min("l_returnflag").alias("t"))
    return joins.edge_diff(side(0), side(1), ["src", "dst"], "t")


@query(f"WITH {EDGES} SELECT * FROM df")
def q_edge_diff(spark, sf_dir):
    return edge_rows(spark, sf_dir)


@query(f"""WITH {EDGES}, g AS (SELECT src, count(*) FILTER (status = 'ADDED') AS added, count(*) FILTER (status = 'REMOVED') AS removed, count(*) FILTER (status = 'TYPE_CHANGED') AS changed FROM df GROUP BY src)
SELECT src, added, removed, changed, CASE WHEN src % 97 = 0 THEN 'ANALYSIS_FAILED' WHEN src % 89 = 0 THEN 'ANALYSIS_PARTIAL' WHEN added + removed > 0 THEN 'CFG_CHANGED' WHEN changed > 0 THEN 'CONTENT_ONLY' ELSE 'UNCHANGED' END AS status FROM g""")
def q_pair_status(spark, sf_dir):
    n = lambda s: F.count_if(F.col("status") == s)
    g = edge_rows(spark, sf_dir).groupBy("src").agg(n("ADDED").alias("added"), n("REMOVED").alias("removed"), n("TYPE_CHANGED").alias("changed"))
    no = F.lit(False)
    return g.withColumn("status", graph.function_status(F.col("src") % 97 == 0, F.col("src") % 89 == 0, no, F.col("added") + F.col("removed") > 0, F.col("changed") > 0, no))


@query("SELECT k, in_old, in_new FROM (SELECT DISTINCT l_partkey AS k, true AS in_old FROM lineitem WHERE l_returnflag = 'R') FULL JOIN (SELECT DISTINCT l_partkey AS k, true AS in_new FROM lineitem WHERE l_returnflag = 'A') USING (k)")
def q_set_ops(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    old, new = (li.filter(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("k")) for x in "RA")
    both = old.intersect(new).select("k", F.lit(True).alias("in_old"), F.lit(True).alias("in_new"))
    none = F.lit(None).cast("boolean")
    return both.unionByName(old.exceptAll(new).distinct().join(both, "k", "left_anti").select("k", F.lit(True).alias("in_old"), none.alias("in_new"))).unionByName(new.subtract(old).select("k", none.alias("in_old"), F.lit(True).alias("in_new")))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 8")
def q_counters_topn(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(8)


@query("""WITH f AS (SELECT *, CASE WHEN role = 'user' OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS packet FROM f)
SELECT conv_id, packet, count(*) AS n_lines, sha256(string_agg(text, chr(10) ORDER BY turn)) AS joined FROM g GROUP BY ALL""")
def q_packet_text_sessions(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = windows.segments(table(spark, sf_dir, "conversations"), (F.col("role") == "user") | (F.row_number().over(w) == 1), ["conv_id"], ["turn"], "packet")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return c.groupBy("conv_id", "packet").agg(F.count("*").alias("n_lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("joined"))


@query(f"WITH {EV}, d AS (SELECT event_id, user_id, ts, k, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS step FROM ev) SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN NULL ELSE lag(k) OVER w END AS before_k, CAST(sum(step) OVER w AS BIGINT) AS balance FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def q_call_balance(spark, sf_dir):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    e = events(spark, sf_dir)
    return e.select("event_id", F.lag("k").over(windows.ordered(BY, ORDER)).alias("before_k"), F.sum(step).over(windows.up_to_now(BY, ORDER)).alias("balance"))


#: Lines of a trace for each user: what an event's number and kind make of it.
LINES_SQL = """ln AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS k, event_id % 7 AS m FROM events)"""


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets: errors discard or flush, sign-ups switch tracing on, views are atoms, purchases commits, clicks addresses."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    k, m = F.get_json_object("props", "$.k").cast("bigint") % 3, F.col("event_id") % 7
    line = (
        F.when(F.col("event_type") == "error", F.when(k == 0, "Conditional flush").otherwise("Discard"))
        .when((F.col("event_type") == "signup") & (k == 0), "TraceOn")
        .when((F.col("event_type") == "signup"), F.concat(F.lit("TraceInfo - cc_threshold = "), k))
        .when(F.col("event_type") == "view", F.concat(F.lit("ATOM - "), F.repeat(F.lit("E"), (k + 1).cast("int"))))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Commit - "), m))
        .otherwise(F.concat(F.lit("Address - Instruction address 0x"), F.lower(F.hex(F.col("event_id"))), F.lit(", Instruction set AArch64")))
    )
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), n.alias("line_no"), line.alias("line"))


@query(f"""WITH {LINES_SQL}, st AS (SELECT *, CASE WHEN event_type = 'error' AND k <> 0 THEN 'discard' WHEN event_type = 'error' THEN 'conditional-flush' WHEN event_type = 'signup' AND k = 0 THEN 'trace-on' END AS word,
CASE WHEN event_type = 'error' AND k <> 0 THEN 1 WHEN event_type IN ('error', 'signup') AND NOT (event_type = 'signup' AND k = 0) THEN NULL ELSE 0 END AS state FROM ln),
bf AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS was FROM st),
isl AS (SELECT *, sum(CASE WHEN word IN ('discard', 'trace-on') AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY n) AS island FROM bf),
mem AS (SELECT stream, island, word, min(n) AS pos FROM isl WHERE word IN ('discard', 'trace-on') OR (word = 'conditional-flush' AND was) GROUP BY ALL)
SELECT stream, min(pos) AS first_line, string_agg(word, ',' ORDER BY pos) AS reasons, island AS generation FROM mem GROUP BY stream, island""")
def q_packet_resync(spark, sf_dir):
    """Runs of discards, flushes and restarts as one record each."""
    done = packets.dispatch(trace_lines(spark, sf_dir)).filter("action = 'resync'")
    return done.select("stream", F.col("count").alias("first_line"), F.col("detail").alias("reasons"), "generation")


@query(f"""WITH {LINES_SQL}, st AS (SELECT *, event_type = 'error' AND k <> 0 AS dis, event_type = 'signup' AND k = 0 AS restart, CASE WHEN event_type = 'error' AND k <> 0 THEN 1 WHEN event_type = 'error' OR event_type = 'signup' AND k <> 0 THEN NULL ELSE 0 END AS state FROM ln),
bf AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS was FROM st),
ep AS (SELECT *, sum(CASE WHEN (dis OR restart) AND NOT was OR event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY n) AS epoch FROM bf),
q AS (SELECT *, CASE WHEN event_type = 'view' THEN k + 1 ELSE 0 END AS a, CASE WHEN event_type = 'purchase' THEN m ELSE 0 END AS c FROM ep WHERE event_type IN ('view', 'purchase')),
s AS (SELECT *, sum(a) OVER w AS arrived, sum(c) OVER w AS asked FROM q WINDOW w AS (PARTITION BY stream, epoch ORDER BY n)),
g AS (SELECT *, asked + least(0, min(arrived - asked) OVER (PARTITION BY stream, epoch ORDER BY n)) AS given FROM s)
SELECT stream, CAST(sum(given_here) AS BIGINT) AS atoms_taken, CAST(sum(c) - sum(given_here) AS BIGINT) AS atoms_missing, CAST(sum(a) - sum(given_here) AS BIGINT) AS atoms_discarded
FROM (SELECT *, given - coalesce(lag(given) OVER (PARTITION BY stream, epoch ORDER BY n), 0) AS given_here FROM g) GROUP BY stream""")
def q_packet_commit(spark, sf_dir):
    """Atoms that commits take, that they miss, and that are discarded, for each stream."""
    done = packets.dispatch(trace_lines(spark, sf_dir), mode="commit").filter(F.col("action").isin("atom", "commit", "atoms_discarded"))
    total = lambda action, of: F.coalesce(F.sum(F.when(F.col("action") == action, of)), F.lit(0)).cast("bigint")
    return done.groupBy("stream").agg(total("atom", F.lit(1)).alias("atoms_taken"), total("commit", F.col("missing")).alias("atoms_missing"), total("atoms_discarded", F.col("count")).alias("atoms_discarded"))


@query("""WITH sy AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY addr, size DESC, name) AS i FROM (SELECT p_size % 5 AS module, 's' || p_partkey AS name, p_partkey // 3 * 40 AS addr, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size * 3 END AS size, p_size % 3 AS kind FROM part)),
lk AS (SELECT module, addr, max(i) AS i FROM sy GROUP BY ALL),
pt AS (SELECT l_orderkey, l_linenumber, l_suppkey % 6 AS module, l_partkey * 14 + CAST(l_quantity AS BIGINT) AS va FROM lineitem),
ix AS (SELECT pt.*, lk.i AS last, lk.addr AS near FROM pt ASOF LEFT JOIN lk ON pt.module = lk.module AND pt.va >= lk.addr),
cd AS (SELECT ix.*, name, addr, sy.i AS i, size, kind, CASE WHEN size > 0 THEN va < addr + size ELSE va = addr END AS holds FROM ix JOIN sy ON ix.module = sy.module AND sy.i BETWEEN last - 8 AND last),
b AS (SELECT * FROM cd WHERE holds OR addr = near QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, va, module ORDER BY NOT holds, CASE WHEN holds THEN (kind <> 2)::INT END, CASE WHEN holds THEN CASE WHEN size > 0 THEN size ELSE 4611686018427387904 END END, CASE WHEN holds THEN -addr END, CASE WHEN holds THEN name END, i) = 1)
SELECT ix.l_orderkey, ix.l_linenumber, ix.va, b.name AS symbol, ix.va - b.addr AS symbol_offset, coalesce(b.holds, false) AS symbol_contains FROM ix LEFT JOIN b USING (l_orderkey, l_linenumber, module, va)""")
def q_symbol_lookup(spark, sf_dir):
    size = F.col("p_size").cast("bigint")
    symbols = table(spark, sf_dir, "part").select((size % 5).alias("module"), F.concat(F.lit("s"), "p_partkey").alias("name"), (F.floor(F.col("p_partkey") / 3) * 40).alias("addr"), F.when(size % 7 == 0, 0).otherwise(size * 3).alias("size"), (size % 3).alias("kind"))
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 6).alias("module"), (F.col("l_partkey") * 14 + F.col("l_quantity").cast("bigint")).alias("va"))
    return joins.symbol_lookup(points, symbols, at="va").drop("module")


#: Steps of each user: the event's value is the target's probability, its number the rest.
STEPS_SQL = f"""{EV}, sp AS (SELECT user_id, row, value / 100 AS dst, (k % 10) / 10 AS ctrl, event_type <> 'signup' AS tv, k % 13 <> 0 AS cv, event_type <> 'purchase' AS gv FROM ev),
sc AS (SELECT *, CASE WHEN tv AND cv THEN CASE WHEN gv THEN dst * pow(ctrl, 0.2) ELSE ctrl END END AS p, CASE WHEN NOT tv THEN 'unscored_discontinuous_transition' WHEN NOT cv THEN 'unscored_speculative_path' END AS why FROM sp),
bg AS (SELECT *, CASE WHEN row = 1 OR p IS NULL OR NOT tv OR lag(p) OVER w IS NULL THEN row END AS b FROM sc WINDOW w AS (PARTITION BY user_id ORDER BY row)),
rn AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY row) AS run FROM bg),
lc AS (SELECT *, coalesce(p < 0.2, false) AS low, count_if(p < 0.2) OVER w AS lows, greatest(run, row - {SIZE - 1}) AS start_row FROM rn WINDOW w AS (PARTITION BY user_id, run ORDER BY row ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW))"""


def windowed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    e = events(spark, sf_dir).select("user_id", "row", (F.col("value") / 100).alias("dst_prob"), (k % 10 / 10).alias("ctrl_prob"), (F.col("event_type") != "signup").alias("transition_valid"), (k % 13 != 0).alias("control_valid"), (F.col("event_type") != "purchase").alias("target_valid"))
    return report.windows_of(e, BY, "row", 0.2, SIZE)


@query(f"""WITH {STEPS_SQL} SELECT user_id, row, 0 AS seq, CASE WHEN p IS NULL THEN why ELSE 'low_token' END AS event, round(p, 6) AS score_prob, CASE WHEN p IS NULL THEN 0 ELSE lows END AS low_count, NULL AS start_row FROM lc WHERE p IS NULL OR low
UNION ALL SELECT user_id, row, 1, 'window_alarm', round(p, 6), lows, start_row FROM lc WHERE p IS NOT NULL AND row - start_row + 1 >= {SIZE} AND lows >= {LEAST}""")
def q_prediction_report(spark, sf_dir):
    """Records of unscored and low steps, and alarms after the record that raised them."""
    done = report.report(windowed_steps(spark, sf_dir), BY, "row", SIZE, LEAST)
    return done.select("user_id", "row", "seq", "event", F.round("score_prob", 6).alias("score_prob"), "low_count", "start_row")


@query(f"""WITH {STEPS_SQL} SELECT count(*) AS total_samples, count(p) AS scored_samples, count(*) - count(p) AS unscored_samples, CAST(count_if(NOT gv) AS BIGINT) AS invalid_target_samples, CAST(count_if(NOT cv) AS BIGINT) AS invalid_control_samples, CAST(count_if(low) AS BIGINT) AS low_samples,
CAST(count_if(p IS NOT NULL AND row - start_row + 1 >= {SIZE} AND lows >= {LEAST}) AS BIGINT) AS alarm_windows, CAST(max(CASE WHEN p IS NULL THEN 0 ELSE lows END) AS BIGINT) AS max_window_low_count, count_if(low) / count(p) AS low_ratio FROM lc""")
def q_prediction_summary(spark, sf_dir):
    return report.summary(windowed_steps(spark, sf_dir), SIZE, LEAST)


@query("""WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS n, count(*) OVER () AS total FROM events), p AS (SELECT *, n // 96 AS b, n % 96 AS i FROM n)
SELECT event_id, b * 3 + i // 32 AS piece_no, i % 32 AS place FROM p WHERE (i // 32 + 1) * 32 <= least(96, total - b * 96) AND b * 3 + i // 32 < 20""")
def q_calibration_batches(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return model.full_batches(e, ORDER, 96, 32, 640).select("event_id", "piece_no", "place")


#: Three steps of pruning; between them weights shrink by a share that their tensor gives.
PRUNE_SQL = """w0 AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS w FROM embeddings, range(1, 9) t(i)),
c0 AS (SELECT max(m) AS c FROM (SELECT abs(w) AS m, row_number() OVER (ORDER BY abs(w)) AS r, count(*) OVER () AS n FROM w0) WHERE r = CAST(floor(n * 0.2) AS BIGINT)),
p0 AS (SELECT vec_id, i, w, abs(w) > c AS keep FROM w0, c0),
w1 AS (SELECT vec_id, i, CASE WHEN keep THEN w * (1 - vec_id % 5 * 0.1) ELSE 0 END AS w FROM p0),
c1 AS (SELECT max(m) AS c FROM (SELECT abs(w) AS m, row_number() OVER (ORDER BY abs(w)) AS r, count(*) OVER () AS n FROM w1) WHERE r = CAST(floor(n * 0.5) AS BIGINT)),
p1 AS (SELECT vec_id, i, w, abs(w) > c AS keep FROM w1, c1),
w2 AS (SELECT vec_id, i, CASE WHEN keep THEN w * (1 - vec_id % 5 * 0.1) ELSE 0 END AS w FROM p1),
c2 AS (SELECT max(m) AS c FROM (SELECT abs(w) AS m, row_number() OVER (ORDER BY abs(w)) AS r, count(*) OVER () AS n FROM w2) WHERE r = CAST(floor(n * 0.7) AS BIGINT)),
p2 AS (SELECT vec_id, i, w, abs(w) > c AS keep FROM w2, c2)"""


@query(f"""WITH {PRUNE_SQL} {" UNION ALL ".join(f"SELECT {i} AS step, CAST({t} AS DOUBLE) AS target, round(min(c), 7) AS threshold, count(*) AS parameters, CAST(count_if(NOT keep) AS BIGINT) AS zeros FROM p{i}, c{i}" for i, t in enumerate((0.2, 0.5, 0.7)))}""")
def q_prune_steps(spark, sf_dir):
    """Steps of pruning with masks that stay while weights move."""
    w = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("i", "w")).withColumn("w", F.col("w").cast("double"))
    shrink = lambda df, step: df.withColumn("w", F.col("w") * (1 - F.col("vec_id") % 5 * F.lit(0.1)))
    return model.prune(w, "w", [0.2, 0.5, 0.7], shrink)[1].withColumn("threshold", F.round("threshold", 7))


@query("""WITH bd AS (SELECT p_size % 4 AS module, p_partkey % 40 AS func, p_partkey * 37 % 9000 AS a, p_partkey * 37 % 9000 + p_size * 2 AS b FROM part),
pt AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 5 AS module, (l_partkey * 11 + l_orderkey) % 9500 AS pos FROM lineitem)
SELECT pt.l_orderkey, pt.l_linenumber, pt.l_partkey, pt.module, pt.pos, min(func) AS func FROM pt LEFT JOIN bd ON pt.module = bd.module AND pos >= a AND pos < b GROUP BY ALL""")
def q_containment(spark, sf_dir):
    """The function whose body, several ranges, holds each address."""
    size = F.col("p_size").cast("bigint")
    bodies = table(spark, sf_dir, "part").select((size % 4).alias("module"), (F.col("p_partkey") % 40).alias("func"), (F.col("p_partkey") * 37 % 9000).alias("a"), (F.col("p_partkey") * 37 % 9000 + size * 2).alias("b"))
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    points = table(spark, sf_dir, "lineitem").select(*key, (F.col("l_suppkey") % 5).alias("module"), ((F.col("l_partkey") * 11 + F.col("l_orderkey")) % 9500).alias("pos"))
    return joins.containing(points.distinct(), bodies, [*key, "module", "pos"], "pos", "func", "a", "b", by=["module"]).select(*key, "module", "pos", "func")


@query(f"WITH {RUNS} SELECT user_id AS stream, row, CAST(low_count AS BIGINT) AS low_count, start_row FROM lc WHERE observed >= {SIZE} AND low_count >= {LEAST}")
def q_stream_alarm(spark, sf_dir):
    """The alarms of a live stream: events, numbered, go through the state operator and a sink."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("stream"), "row", F.when(F.col("event_type") != "error", F.col("value")).alias("score"), (F.col("event_type") == "signup").alias("breaks"))
    return alarms.run_once(e, LOW, SIZE, LEAST)
