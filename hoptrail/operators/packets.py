"""From lines of decoded traces to what they do: contexts, generations, resyncs, atoms and commits.

``dispatch`` reads a stream's lines in order, but no line waits for another one's
turn: every rule of the state machine that a decoder would run is a running value
over the stream (``scans``): whether an information block or a resync is open is
the last line that opens or closes it, a context is the last value of each field,
a generation is a sum, and the atoms that a commit takes follow from a running
minimum, since a queue that gets a atoms and is asked for n has given
n + min(0, least a - n so far).

A line leads to up to four steps in order of ``seq``: an information block ends,
a resync ends, a context is completed by the first line after it, the line's own
action. Steps carry the context after them; ``reset`` says why the flow must
start anew, ``gap`` that a synchronised flow then records a gap. The reader of the
steps knows whether it is synchronised, so ``resync`` steps are records of a gap
only where it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoptrail.functions import text
from hoptrail.functions.literals import parse_int
from hoptrail.operators.scans import scan
from hoptrail.written import materialize

#: Forms of lines that ``functions.text`` doesn't have.
STREAM = r"^Decode trace stream of ID\s+(0x[0-9a-fA-F]+|\d+)"
INFO, INFO_END = r"^TraceInfo\s*-\s*(.*)$", r"(?i)\bcc_threshold\s*="
STARTS = ["Decode trace stream", "TraceInfo", "Address ", "Timestamp", "ATOM", "Commit", "Cancel", "Exception", "TraceOn", "Discard", "Conditional flush"]
FIELDS = ["Context ID", "VMID", "Exception level", "Security", "64-bit instruction", "32-bit instruction"]
RESYNC = ["Discard", "Conditional flush", "TraceInfo", "TraceOn"]
RETURNS = ["Exception return", "Exception Return", "exception return", "EXCEPTION RETURN"]
MISPREDICTS = ["mispredict", "Mispredict", "MISPREDICT"]
INFO_KEYS = ("p0_key", "curr_spec_depth", "cc_threshold")
#: Why each kind of line discards atoms, and why it resets the flow.
DISCARDS = {"trace_stream": "trace-stream-change", "context": "context-change", "exception": "exception-boundary", "exception_return": "exception-return", "cancel": "cancel-or-mispredict", "address": "new-address-packet", "trace_on": "trace-resync", "discard": "trace-resync", "end": "end-of-trace"}
RESETS = {k: DISCARDS[k] for k in ("trace_stream", "exception_return", "cancel")}

CONTEXT = ["context_id", "vmid", "el", "security", "isa"]
STEP = ["stream", "line_no", "seq", "idx", "action", "generation", "trace_id", *CONTEXT, "timestamp", "in_exception", "reset", "gap", "detail", "address", "atom", "count", "missing"]


def _any(line: Column, words: list[str], how: str) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | getattr(line, how)(w)
    return found


def _case(kind: Column, of: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in of.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def parse(lines: DataFrame) -> DataFrame:
    """Lines (stream, line_no, line) with the kind that they have outside of information blocks, and their fields."""
    line = F.col("line")
    group = lambda pattern, i=1: F.when(line.rlike(pattern), F.regexp_extract(line, pattern, i))
    width = F.when(line.contains(FIELDS[4]), "AArch64").when(line.contains(FIELDS[5]), "AArch32")
    values = {"c_context_id": parse_int(group(text.CONTEXT_ID)), "c_vmid": parse_int(group(text.VMID)), "c_el": group(text.EXCEPTION_LEVEL), "c_security": group(text.SECURITY)}
    field = width.isNotNull()
    for v in values.values():
        field = field | v.isNotNull()
    named = group(text.ADDRESS, 2)
    isa = F.when(F.lower(named).contains("aarch64"), "AArch64").when(F.lower(named).contains("aarch32"), "AArch32").otherwise(named)
    kind = (
        F.when(line.isNull(), "end")
        .when(line.rlike(STREAM), "trace_stream")
        .when(line.rlike(INFO), "trace_info")
        .when(field, "context")
        .when(line.startswith("Timestamp") & line.rlike(text.TIMESTAMP), "timestamp")
        .when(line.startswith(text.TRACE_ON), "trace_on")
        .when(line.startswith(text.DISCARD), "discard")
        .when(line.startswith(text.FLUSH), "flush")
        .when((line == "Exception") | line.startswith("Exception -"), "exception")
        .when(_any(line, RETURNS, "startswith"), "exception_return")
        .when(line.rlike(text.CANCEL) | _any(line, MISPREDICTS, "contains"), "cancel")
        .when(line.startswith("Address") & line.rlike(text.ADDRESS), "address")
        .when(line.rlike(text.ATOM), "atom")
        .when(line.rlike(text.COMMIT), "commit")
        .otherwise("raw")
    )
    exception = text.exception_fields(line)
    parsed = lines.select(
        "stream",
        "line_no",
        "line",
        kind.alias("kind"),
        (line.isNull() | _any(line, STARTS, "startswith") | _any(line, FIELDS, "contains")).alias("starts"),
        F.coalesce(line.rlike(INFO_END), F.lit(False)).alias("ends"),
        F.coalesce(_any(line, RESYNC, "startswith"), F.lit(False)).alias("in_resync"),
        *[v.alias(k) for k, v in values.items()],
        width.isNotNull().alias("width"),
        F.coalesce(width, isa).alias("c_isa"),
        parse_int(group(STREAM)).alias("c_trace_id"),
        parse_int(group(text.TIMESTAMP)).alias("c_timestamp"),
        parse_int(group(text.ADDRESS)).alias("c_address"),
        exception["type"].alias("c_type"),
        exception["address"].alias("c_target"),
        group(text.ATOM).alias("atoms"),
        parse_int(F.coalesce(group(text.COMMIT), group(text.CANCEL))).alias("c_count"),
    )
    fields = {"c_isa": ["context", "address"], "c_timestamp": ["timestamp"], "c_address": ["address"], "c_type": ["exception"], "c_target": ["exception"], "atoms": ["atom"], "c_count": ["commit", "cancel"]} | {k: ["context"] for k in values}
    return parsed.withColumns({k: F.when(F.col("kind").isin(of), F.col(k)) for k, of in fields.items()})


def dispatch(lines: DataFrame, mode: str = "immediate", context_ids: list[int] | None = None, els: list[str] | None = None, block: int | None = None) -> DataFrame:
    """The steps of lines (stream, line_no, line), stripped and not blank, in columns ``STEP``.

    In ``immediate`` mode each atom is a step at its line; in ``commit`` mode atoms wait until a
    commit takes them, and commits report how many were ``missing``. Addresses whose context is not
    among ``context_ids`` and ``els`` become ``filtered_address``: they stay as marks where the flow
    is reset. Every stream ends with a step ``end``.
    """
    by, at = ["stream"], "line_no"
    k = F.col("kind")
    every = lines.select("stream", "line_no", "line")
    ended = every.groupBy("stream").agg((F.max("line_no") + 1).alias("line_no")).withColumn("line", F.lit(None).cast("string"))
    rows = parse(every.unionByName(ended))

    # Information blocks: the last line that opens or closes one says whether one is open.
    opens = (k == "trace_info") & ~F.col("ends")
    rows = scan(rows, by, at, fills={"open": F.when(opens, 1).when(F.col("ends") | F.col("starts"), 0)}, sums={"info": (k == "trace_info").cast("bigint")}, block=block)
    inside = F.coalesce(F.col("open") == 1, F.lit(False))
    taken = inside & (F.col("ends") | ~F.col("starts"))
    rows = rows.withColumns({"taken": taken, "closes": inside & ~taken, "kind": F.when(taken, F.when(F.col("ends"), "info_end").otherwise("info_more")).otherwise(k)})
    rows = rows.withColumn("info", F.when(k == "trace_info", F.col("info") + 1).otherwise(F.col("info"))).withColumn("of_info", F.when(F.col("closes") & (k == "trace_info"), F.col("info") - 1).otherwise(F.col("info")))

    # Whether a resync is open, and the context before each line. A field is a struct, so that a new stream can set it to null.
    sets = {c: F.when(k == "trace_stream", F.struct(F.lit(None).cast(t).alias("v"))).when(F.col(f"c_{c}").isNotNull() & ~F.col("taken"), F.struct(F.col(f"c_{c}").alias("v"))) for c, t in zip(CONTEXT, ("bigint", "bigint", "string", "string", "string"), strict=True)}
    plain = {"trace_id": F.when(k == "trace_stream", F.col("c_trace_id")), "timestamp": F.when(k == "timestamp", F.col("c_timestamp")), "in_exception": F.when(k == "exception", True).when(k.isin("exception_return", "trace_stream"), False)}
    state = F.when(k == "discard", 1).when((k == "trace_on") | ~F.col("in_resync"), 0)
    own = rows.filter(k != "info_more")
    own = scan(own, by, at, fills={f"b_{c}": v for c, v in (sets | plain).items()} | {"resync": F.when(k != "info_end", state)}, block=block)
    changed = F.lit(False)
    for c in CONTEXT:
        changed = changed | (F.col(f"c_{c}").isNotNull() & ~F.col(f"c_{c}").eqNullSafe(F.col(f"b_{c}.v")))
    own = own.withColumns({"changed": (k == "context") & changed, "resyncing": F.coalesce(F.col("resync") == 1, F.lit(False))})

    # A changed context waits for the line that ends its packet, or for the first other line.
    clears = (k == "context") & F.col("width") | ~k.isin("context", "trace_info", "info_end")
    own = scan(own, by, at, fills={"last_change": F.when(F.col("changed"), F.col(at)), "last_clear": F.when(clears, F.col(at))}, block=block)
    waiting = F.coalesce(F.col("last_change") > F.coalesce(F.col("last_clear"), F.lit(-1)), F.lit(False))
    own = own.withColumns(
        {
            "completes": (k == "context") & F.col("width") & (waiting | F.col("changed")),
            "implied": waiting & ~k.isin("context", "trace_info", "info_end", "trace_stream", "end"),
            "begins": k.isin("discard", "trace_on") & ~F.col("resyncing"),
            "finishes": F.col("resyncing") & ((k == "trace_on") | ~F.col("in_resync")) & (k != "info_end"),
        }
    )
    bump = F.col("completes") | F.col("begins") | k.isin("trace_stream", "exception", "exception_return")
    empties = F.col("completes") | F.col("begins") | k.isin("trace_stream", "exception", "exception_return", "cancel", "address", "end")
    number = lambda c: c.cast("bigint")
    own = scan(own.withColumns({"bump": number(bump), "empties": number(empties), "implied_n": number(F.col("implied"))}), by, at, sums={"generations": F.col("bump") + F.col("implied_n"), "epoch": F.col("empties") + F.col("implied_n"), "island": number(F.col("begins"))}, block=block)
    own = own.withColumn("epoch_here", F.col("epoch") + F.col("implied_n"))
    own = materialize(own, "packets")
    return _steps(own, rows, mode, context_ids, els, block)


def _steps(own: DataFrame, rows: DataFrame, mode: str, context_ids: list[int] | None, els: list[str] | None, block: int | None) -> DataFrame:
    k = F.col("kind")
    before = {c: F.col(f"b_{c}.v") for c in CONTEXT} | {"trace_id": F.col("b_trace_id"), "timestamp": F.col("b_timestamp"), "in_exception": F.coalesce(F.col("b_in_exception"), F.lit(False))}
    fresh = k == "trace_stream"
    after = {c: F.when(fresh, None).otherwise(F.coalesce(F.col(f"c_{c}"), before[c])) for c in CONTEXT}
    after |= {"trace_id": F.when(fresh, F.col("c_trace_id")).otherwise(before["trace_id"]), "timestamp": F.coalesce(F.col("c_timestamp"), before["timestamp"])}
    after["in_exception"] = F.when(k == "exception", True).when(k.isin("exception_return", "trace_stream"), False).otherwise(before["in_exception"])
    pre, mid = F.col("generations"), F.col("generations") + F.col("implied_n")
    kinds = {"stream": "string", "line_no": "bigint", "seq": "int", "idx": "bigint", "action": "string", "generation": "bigint", "trace_id": "bigint", "context_id": "bigint", "vmid": "bigint", "el": "string", "security": "string", "isa": "string", "timestamp": "bigint", "in_exception": "boolean", "reset": "string", "gap": "boolean", "detail": "string", "address": "bigint", "atom": "string", "count": "bigint", "missing": "bigint"}

    def steps(df: DataFrame, seq: int, action, generation, context: dict[str, Column], **more) -> DataFrame:
        cols = {"stream": F.col("stream"), "line_no": F.col("line_no"), "seq": F.lit(seq), "idx": F.lit(0), "action": action if isinstance(action, Column) else F.lit(action), "generation": generation, "gap": F.lit(False)} | context | more
        return df.select(*[cols.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in STEP])

    # Information blocks, found again by their number; more of a block than its lines is never gathered.
    parts = rows.filter((k == "trace_info") | F.col("taken")).select("stream", F.col("info").alias("of_info"), F.struct("line_no", F.when(k == "trace_info", F.regexp_extract("line", INFO, 1)).otherwise(F.col("line")).alias("part")).alias("p"))
    infos = parts.groupBy("stream", "of_info").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["part"]), " ").alias("info_text"))
    shown = own.filter(F.col("closes") | (k == "info_end") | ((k == "trace_info") & F.col("ends"))).join(infos, ["stream", "of_info"])
    depth = F.coalesce(text.key_values(F.col("info_text"), INFO_KEYS)["curr_spec_depth"].try_cast("bigint"), F.lit(0))
    shown = shown.withColumn("depth", depth)
    out = [
        steps(shown.filter("depth != 0"), 0, "flow_gap", pre, before, reset=F.lit(None), detail=F.concat(F.lit("nonzero-initial-spec-depth,curr_spec_depth="), "depth"), count=F.col("depth")),
        steps(shown, 1, "trace_info", pre, before, detail=F.col("info_text"), count=F.col("depth")),
    ]

    # A resync's lines share the number of its first; reasons stand in the order of their first line.
    reason = F.when(k == "discard", "discard").when(k == "trace_on", "trace-on").when((k == "flush") & F.col("resyncing"), "conditional-flush")
    member = F.col("island") + F.when(F.col("begins"), 1).otherwise(0)
    reasons = own.filter(reason.isNotNull()).select("stream", member.alias("island_no"), "line_no", reason.alias("reason")).groupBy("stream", "island_no", "reason").agg(F.min("line_no").alias("at"))
    reasons = reasons.groupBy("stream", "island_no").agg(F.min("at").alias("first_line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "reason"))), lambda r: r["reason"]), ",").alias("reasons"))  # three at most
    closed = own.filter(F.col("finishes") | (F.col("begins") & (k == "trace_on"))).withColumn("island_no", member).join(reasons, ["stream", "island_no"])
    late = k == "trace_on"  # after its own record
    out.append(steps(closed.filter(~late), 2, "resync", pre, before, detail=F.col("reasons"), count=F.col("first_line")))
    out.append(steps(closed.filter(late), 7, "resync", mid + F.col("bump"), after, detail=F.col("reasons"), count=F.col("first_line")))

    out.append(steps(own.filter("implied"), 4, "context", mid, before, reset=F.lit("context-change"), detail=F.lit("implicit")))
    allowed = F.lit(True)
    if context_ids is not None:
        allowed = allowed & F.coalesce(after["context_id"].isin(context_ids), F.lit(False))
    if els is not None:
        allowed = allowed & F.coalesce(after["el"].isin(els), F.lit(False))
    other_isa = after["isa"] != "AArch64"
    action = F.when(k == "address", F.when(~allowed, "filtered_address").otherwise("address")).when(k.isin("trace_on", "discard"), "discontinuity").when((k == "flush") & ~F.col("resyncing"), "trace_control").when(k == "exception_return", "exception_return").otherwise(k)
    reset = F.when((k == "context") & F.col("completes"), "context-change").when(F.col("begins"), "trace-resync").when(k == "address", F.when(~allowed, "filtered-address").when(other_isa, "unsupported-isa")).otherwise(_case(k, RESETS))
    silent = k.isin("trace_info", "info_end", "atom", "commit") | ((k == "flush") & F.col("resyncing")) | ((k == "context") & ~F.col("width"))
    out.append(steps(own.filter(~silent), 5, action, mid + F.col("bump"), after, reset=reset, gap=(k == "cancel"), detail=F.when(k == "exception", F.col("c_type")).when(k.isin("context", "raw", "discard", "trace_on", "flush", "cancel", "exception_return", "trace_stream"), F.col("line")), address=F.coalesce("c_address", "c_target"), count=F.col("c_count")))
    out.append(steps(own.filter((k == "address") & allowed & other_isa), 6, "flow_gap", mid, after, detail=F.concat(F.lit("unsupported-isa,"), after["isa"]), address=F.col("c_address")))

    atoms = own.filter(k == "atom").select("*", F.posexplode(F.split("atoms", "")).alias("nth", "one")).filter("one != ''")
    commits = own.filter(k == "commit")
    if mode == "immediate":
        out.append(steps(atoms, 5, "atom", mid, after, atom=F.col("one"), idx=F.col("nth")))
        out.append(steps(commits, 6, "commit", mid, after, count=F.col("c_count"), missing=F.lit(0)))
    else:
        # Atoms that arrived and were asked for in the time between two discards.
        queue = own.filter(k.isin("atom", "commit")).select("stream", F.col("epoch_here").alias("since"), "line_no", F.length("atoms").cast("bigint").alias("more"), F.coalesce(F.when(k == "commit", F.col("c_count")), F.lit(0)).alias("ask"))
        key = ["stream", "since"]
        queue = scan(queue, key, "line_no", sums={"arrived": F.coalesce("more", F.lit(0)), "asked": F.col("ask")}, block=block)
        queue = scan(queue, key, "line_no", mins={"least": F.when(F.col("ask") > 0, F.col("arrived") - F.col("asked") - F.col("ask"))}, block=block)
        given = lambda asked, least: asked + F.least(F.lit(0), F.coalesce(least, F.lit(0)))
        now = F.col("asked") + F.col("ask")
        queue = materialize(queue.withColumns({"from": given(F.col("asked"), F.col("least")), "to": given(now, F.when(F.col("ask") > 0, F.least(F.col("least"), F.col("arrived") - now)).otherwise(F.col("least")))}), "queue")
        asks = queue.filter("more IS NULL").select("stream", "line_no", F.col("from").alias("from_n"), F.col("to").alias("to_n"))
        commits = commits.join(asks, ["stream", "line_no"])
        missing = F.col("c_count") - (F.col("to_n") - F.col("from_n"))
        out.append(steps(commits, 6, "commit", mid, after, count=F.col("c_count"), missing=missing, reset=F.when(missing > 0, "commit-without-pending-atom")))
        placed = atoms.join(queue.filter("more IS NOT NULL").select("stream", "line_no", "arrived"), ["stream", "line_no"]).select("stream", F.col("epoch_here").alias("since"), (F.col("arrived") + F.col("nth") + 1).alias("place"), "one")
        pops = commits.filter("to_n > from_n").withColumn("since", F.col("epoch_here")).withColumn("place", F.explode(F.sequence(F.col("from_n") + 1, F.col("to_n"))))
        out.append(steps(pops.join(placed, ["stream", "since", "place"]), 5, "atom", mid, after, atom=F.col("one"), idx=F.col("place") - F.col("from_n") - 1))
        left = queue.groupBy("stream", "since").agg((F.sum(F.coalesce("more", F.lit(0))) - F.max("to")).alias("left")).filter("left > 0").withColumnRenamed("since", "epoch")
        drops = own.filter("implied OR empties > 0").join(left, ["stream", "epoch"])
        why = F.when(F.col("implied"), "context-change").otherwise(_case(k, DISCARDS))
        out.append(steps(drops, 3, "atoms_discarded", F.when(F.col("implied"), mid).otherwise(mid + F.col("bump")), before, count=F.col("left"), detail=why))
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return done
