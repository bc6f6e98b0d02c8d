"""Events to segments as layers of running values; no event waits for the one before it.

What a reader of the stream would remember is found for all events at once: the
context, trace and module are last values; the addresses that name a place are
looked up as of the event; a range's edge is emitted by the first event after it
that ends its wait, a value from behind; segments are a running sum of closes.
Streams of no more events than a block are windows over their one partition, from
events to segments; longer ones are cut into blocks (``scans``), and so are hot
addresses, which are looked up only where events name any.

Edges and gaps are tokens in the order (event, place in the event): the waiting
range's edge, the gap of its mismatch, a close, the event's own edge, its own gap.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoptrail.functions.control import EVIDENCE, target_quality
from hoptrail.functions.fence import fenced
from hoptrail.functions.literals import ELF, GAP, OPAQUE, UNKNOWN, UNKNOWN_TARGET, parse_int, signed_hex
from hoptrail.operators.scans import BLOCK, running, scan
from hoptrail.written import materialize

#: Reasons of addresses outside of code, and statuses of ranges that are evidence only in part.
CUT = ("address-not-in-maps", "address-in-non-executable-map")
PARTIAL = ("conflict", "target_unknown", "target_unresolved")
CONTEXT = ("context_id", "vmid", "el", "security", "isa")
TEXTS = ["event", "module", "atom", "status", "reason", "runtime_start", "runtime_end", "elf_start", "elf_end", "start_symbol", "end_symbol", "next_pc", "target_source", "confidence", "path_confidence", "address", "runtime_addr", "elf_addr", "elf_va", "symbol", "map", "map_file_offset", "pc", "trace_id", "kind", *CONTEXT]
TOKEN = (
    "struct<kind:string,atom:string,module:string,function:string,function_offset:string,dst_module:string,dst_function:string,dst_offset:string,"
    "dst_address:string,instruction_count:bigint,status:string,reason:string,target_source:string,confidence:string,target_valid:boolean,"
    "control_valid:boolean,continuity:string,path_confidence:string,return_stack_match:boolean,expected_pc:string,observed_pc:string>"
)
PLACES = 8
#: Lines of an event: its edge, the gap and the close after its edge, its own gap, its own close.
EDGE, HELD_GAP, HELD_CLOSE, OWN_GAP, OWN_CLOSE = range(5)
Scan = Callable[..., DataFrame]


def _base(path: Column) -> Column:
    return F.when((path != "") & ~path.startswith("["), F.element_at(F.split(path, "/"), -1))


def _number(symbol: Column) -> Column:
    """The number after the last plus of ``name+0x10``."""
    return F.when(symbol.contains("+"), parse_int(F.substring_index(symbol, "+", -1)))


def _split(symbol: Column, number: Column) -> tuple[Column, Column]:
    """Function and offset of ``name+0x10`` with the number that ``_number`` gives."""
    name = F.left(symbol, F.length(symbol) - F.length(F.substring_index(symbol, "+", -1)) - 1)
    none, good = symbol.isNull(), number.isNotNull() & (name != "")
    clean = F.when(name.contains("~"), F.regexp_replace(name, "~$", "")).otherwise(name)
    return F.when(none, UNKNOWN).when(good, clean).otherwise(symbol), F.when(none, None).when(good, signed_hex(number)).otherwise("0x0")


def _halves(df: DataFrame, symbols: dict[str, Column]) -> DataFrame:
    """``df`` with each symbol's number (``_n``), function (``_f``) and offset (``_o``)."""
    df = df.withColumns({f"{k}_n": _number(v) for k, v in symbols.items()})
    parts = {k: _split(v, F.col(f"{k}_n")) for k, v in symbols.items()}
    df = df.withColumns({f"{k}_{x}": c for k, pair in parts.items() for x, c in zip("fo", pair, strict=True)})
    return df


def _flat(events: DataFrame, by: str, order: str, targets: tuple[str, ...]) -> DataFrame:
    """Events, written, with one plain column for each field that the layers read and their numbers; absent fields are null literals, empty texts are null."""
    have = set(events.columns)
    cols = {c: F.nullif(F.col(c).cast("string"), F.lit("")) for c in TEXTS if c in have}
    absent = {c: F.lit(None).cast("string") for c in TEXTS if c not in have}
    fields = lambda c: {f.name for f in events.schema[c].dataType.fields} if c in have else set()
    inner = {f: F.col("context")[f].cast("string") if f in fields("context") else F.lit(None).cast("string") for f in CONTEXT}
    some = F.lit(False)
    for f in inner.values():
        some = some | f.isNotNull()
    nested = F.when(some, F.struct(*[v.alias(f) for f, v in inner.items()]))
    names = F.filter("modules", lambda m: m != "") if "modules" in have else None
    special = {
        "nested": nested if fields("context") & set(CONTEXT) else None,
        "instruction_count": F.col("instruction_count").cast("bigint") if "instruction_count" in have else None,
        "way": F.col("waypoint")["kind"].cast("string") if "kind" in fields("waypoint") else None,
        "sole": F.when(F.size(names) == 1, F.get(names, F.lit(0))) if names is not None else None,
    }
    kinds = {"nested": "struct<" + ",".join(f"{c}:string" for c in CONTEXT) + ">", "instruction_count": "bigint", "way": "string", "sole": "string"}
    absent |= {k: F.lit(None).cast(kinds[k]) for k, v in special.items() if v is None}
    cols |= {k: v for k, v in special.items() if v is not None}
    e = events.select(F.col(by).alias("s"), F.col(order).cast("bigint").alias("i"), *[v.alias(k) for k, v in cols.items()]).filter("s IS NOT NULL")
    kept = e.columns
    e = e.withColumns(absent)
    ev, reason = F.col("event"), F.col("reason")
    is_address = ev == "address"
    own = F.coalesce(F.col("module"), _base(F.col("map")))
    opaque = is_address & F.coalesce(reason == "no-configured-elf", F.lit(False))
    outside = F.coalesce(~own.isin(*targets), F.lit(True)) if targets else F.lit(False)
    bad = F.coalesce(reason.isin(*CUT), F.lit(False))
    texts = {
        "start": ("runtime_start",),
        "end": ("runtime_end",),
        "to": ("next_pc",),
        "e_start": ("elf_start", "elf_va"),
        "e_end": ("elf_end",),
        "a_at": ("runtime_addr", "address"),
        "a_elf": ("elf_addr", "elf_va"),
    }
    said = [k for k, names in texts.items() if have & set(names)]
    # One lambda for all texts: a parse for each in one generated method is too long for the JVM to compile.
    if said:
        of = lambda k: F.when(is_address, F.coalesce(*texts[k])) if k.startswith("a_") else F.coalesce(*texts[k])
        e = e.withColumn("parsed", F.transform(F.array(*[of(k) for k in said]), parse_int))
    numbers = {k: F.col("parsed")[said.index(k)] if k in said else F.lit(None).cast("bigint") for k in texts} | {
        "elf_from": F.coalesce("elf_start", "elf_va"),
        "opaque": opaque,
        "named": is_address & ~opaque & ~bad & ~outside,
        "name": own,
    }
    e = e.withColumns(numbers).select(*kept, *numbers)
    return materialize(e, "events").withColumns(absent)


def _lookup(events: DataFrame, probes: DataFrame, block: int | None) -> DataFrame:
    """Probes (s, i, tag, r, e: addresses) with what the last address event before i said: by ``r``, else by ``e``."""
    told = events.filter("named").select("s", "i", F.struct(F.lit(True).alias("there"), "name", "symbol", F.coalesce("elf_addr", "elf_va").alias("elf")).alias("info"), F.col("a_at").alias("r"), F.col("a_elf").alias("e"))
    none = F.lit(None).cast(told.schema["info"].dataType)
    keyed = lambda df, info, tag: df.select("s", F.col("i").alias("at"), F.explode(F.filter(F.array(F.struct(F.lit("r").alias("k"), F.col("r").alias("v")), F.struct(F.lit("e").alias("k"), F.col("e").alias("v"))), lambda x: x["v"].isNotNull())).alias("x"), info.alias("info"), tag.alias("tag")).select("s", "at", "x.k", "x.v", "info", "tag")
    both = keyed(told, F.col("info"), F.lit(None).cast("string")).unionByName(keyed(probes, none, F.col("tag")))
    seen = scan(both, ["s", "k", "v"], "at", fills={"found": F.col("info")}, block=block).filter("tag IS NOT NULL AND found IS NOT NULL")
    return seen.groupBy("s", F.col("at").alias("i"), "tag").agg(F.coalesce(F.first(F.when(F.col("k") == "r", F.col("found")), True), F.first(F.col("found"), True)).alias("found"))


def _typed(e: DataFrame, strict: bool, targets: tuple[str, ...], go: Scan, asked: bool, block: int | None) -> DataFrame:
    """Events with their module, symbols, and what they do: a type, a reason, and whether a context change cuts before it."""
    ev, reason = F.col("event"), F.col("reason")
    is_range, is_address = ev == "instruction_range", ev == "address"
    bad = F.coalesce(reason.isin(*CUT), F.lit(False))
    stated, start_name, end_name = F.col("name"), F.col("start_symbol"), F.col("end_symbol")
    if asked:
        ends = [("first", "start", "e_start"), ("last", "end", "e_end")]
        probes = None
        for tag, r, x in ends:
            one = e.filter(is_range).select("s", "i", F.lit(tag).alias("tag"), F.col(r).alias("r"), F.col(x).alias("e"))
            probes = one if probes is None else probes.unionByName(one)
        found = _lookup(e, probes, block).groupBy("s", "i").agg(*[F.first(F.when(F.col("tag") == t, F.col("found")), True).alias(t) for t, *_ in ends])
        e = e.join(found, ["s", "i"], "left")
        stated = F.coalesce(F.col("name"), F.col("first.name"), F.col("last.name"))
        start_name, end_name = F.coalesce("start_symbol", "first.symbol"), F.coalesce("end_symbol", "last.symbol")
    key = F.struct(*[F.col(c) for c in CONTEXT])
    text = lambda c: F.struct(c.alias("v"))
    e = e.withColumns({"stated": F.when(is_range, stated), "said_context": F.when(ev == "context", key).when(is_range, F.col("nested")), "start_name": start_name, "end_name": end_name})
    sets = F.when((ev == "header") & F.col("sole").isNotNull(), F.col("sole")).when(is_range, F.col("stated")).when(is_address & F.col("named"), F.col("name"))
    sets = F.when(F.col("opaque"), F.struct(_base(F.col("map")).alias("v"), F.col("i").alias("i"))).when(sets.isNotNull(), F.struct(sets.alias("v"), F.col("i").alias("i")))
    trace = F.when((ev == "trace_stream") & F.col("trace_id").isNotNull(), text(F.col("trace_id"))).when(ev == "context", text(F.lit(None).cast("string")))
    e = e.withColumn("sets", sets)
    e = go(e, ["s"], "i", fills={"b_context": F.col("said_context"), "b_trace": trace, "b_module": F.col("sets"), "default": F.when((ev == "header") & F.col("sole").isNotNull(), F.col("sole")), "b_silent": F.when(is_range & F.col("stated").isNull(), F.col("i"))})
    # A range that says nothing takes the default where the module isn't known, and then it is known.
    before = F.coalesce("b_module.v", F.when(F.col("b_silent") > F.coalesce("b_module.i", F.lit(-1)), F.col("default")))
    empty = F.struct(*[F.lit(None).cast("string").alias(c) for c in CONTEXT])
    changed = F.col("said_context").isNotNull() & ~F.col("said_context").eqNullSafe(F.coalesce("b_context", empty))
    e = e.withColumns({"module_before": before, "changed": changed})
    e = e.withColumn("of", F.when(is_range, F.coalesce("stated", "module_before", "default")))
    e = e.withColumn("module_now", F.when(F.col("opaque"), F.col("sets.v")).otherwise(F.coalesce("sets.v", "of", "module_before")))
    e = e.withColumn("status", F.coalesce("status", F.lit("resolved")))
    status = F.col("status")
    partial_, flow = status.isin(*PARTIAL), ev.isin("flow_gap", "overflow")
    beyond = F.coalesce(~F.col("of").isin(*targets), F.lit(True)) if targets else F.lit(False)
    label = lambda mark, *rest: F.concat(F.lit(mark), F.coalesce(*rest))
    control = F.coalesce("kind", "reason", "event")
    cut = (
        F.when((ev == "trace_stream") & ~F.col("trace_id").eqNullSafe(F.col("b_trace.v")), F.lit("trace_stream_change"))
        .when((ev == "context") & F.col("changed"), F.lit("context_change"))
        .when(F.lit(strict) & (ev == "flow_gap"), label("flow_gap:", reason, ev))
        .when(F.lit(strict) & (ev == "overflow"), F.lit("overflow"))
        .when(F.lit(strict) & F.col("opaque"), F.lit("unconfigured_executable_module"))
        .when(ev == "discontinuity", label("discontinuity:", reason, ev))
        .when((ev == "trace_control") & (control != "conditional_flush"), F.concat(F.lit("trace_control:"), control))
        .when(ev.isin("exception", "exception_return"), ev)
        .when(is_address & ~F.col("opaque") & ~F.col("named"), label("address:", reason, F.lit("outside-target")))
        .when(is_range & bad, F.concat(F.lit("range:"), reason))
        .when(is_range & (~status.isin(*EVIDENCE) | (F.lit(strict) & partial_)), F.concat(F.lit("range_status:"), status))
        .when(is_range & ~partial_ & (F.col("start").isNull() | F.col("e_start").isNull()), F.lit("range_missing_start"))
        .when(is_range & ~partial_ & (F.col("end").isNull() | F.col("e_end").isNull()), F.lit("range_missing_end"))
        .when(is_range & ~partial_ & beyond, F.lit("range:outside_target_module"))
    )
    kind = F.when(F.col("cut").isNotNull(), "cut").when(flow | F.col("opaque"), "soft").when(is_range, F.when(partial_, "partial").otherwise("range")).when(is_address, "address")
    e = e.withColumn("cut", cut).withColumn("type", kind)
    drops = F.col("cut").startswith("address:") | (F.col("cut") == "range:outside_target_module")
    why = F.when(F.col("opaque"), "unconfigured_executable_module").when(ev == "flow_gap", F.coalesce(reason, ev)).when(ev == "overflow", ev)
    doubtful = F.coalesce(F.col("path_confidence") == "speculative", F.lit(False)) | F.coalesce(F.col("target_source") == "software_return_stack", F.lit(False))
    e = e.withColumns({"precut": F.coalesce(is_range & F.col("changed"), F.lit(False)), "drops": F.coalesce(drops, F.lit(False)), "why": why, "doubtful": doubtful})
    return _halves(e, {"start": F.col("start_name"), "end": F.col("end_name")})


def _emitted(e: DataFrame, strict: bool, go: Scan) -> DataFrame:
    """Events; each range with when and how its edge is emitted: ``em``, ``hint`` (the range it leads to), ``forced``, ``gap``, ``close``, ``shown``."""
    kind = F.col("type")
    ends = kind.isin("cut", "soft", "partial", "range") | F.col("precut")
    place = F.coalesce("pc", "address", "runtime_addr")
    after = F.struct("i", "type", "precut", "drops", F.coalesce("start", "a_at").alias("at"), "start", "start_f", "start_o", "of", F.col("elf_from").isNotNull().alias("elf"), F.col("e_start").alias("elf_at"), F.coalesce(F.col("path_confidence") == "speculative", F.lit(False)).alias("speculative"), place.alias("place"), F.col("module_now").alias("now"))
    waits = F.when(kind == "range", F.struct("i", "to", "doubtful")).when(ends, F.struct(F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("bigint").alias("to"), F.lit(False).alias("doubtful")))
    e = go(e, ["s"], "i", fills={"waiting": waits})
    # Addresses that speak of a doubtful range are met before the next one ends its wait: the first of them is the last from behind.
    met = (kind == "address") & F.col("waiting.doubtful") & F.col("a_at").isNotNull() & F.col("waiting.to").isNotNull()
    same = F.col("a_at") == F.col("waiting.to")
    miss = F.when(met & ~same, F.struct(F.col("waiting.i").alias("whose"), "i", "a_at", "module_before", place.alias("place")))
    e = e.withColumns({"back": -F.col("i"), "a_miss": miss, "a_hit": F.when(met & same, F.struct(F.col("waiting.i").alias("whose"), "i"))})
    e = go(e, ["s"], "back", fills={"then": F.when(ends, after), "miss": F.col("a_miss"), "hit": F.col("a_hit")}, mins={"back_last": F.col("back")})
    e = e.withColumns({"miss": F.when(F.col("miss.whose") == F.col("i"), F.col("miss")), "hit": F.when(F.col("hit.whose") == F.col("i"), F.col("hit.i")), "last_i": F.coalesce(-F.col("back_last"), F.col("i"))})
    n, is_range = F.col("then.type"), F.coalesce(kind == "range", F.lit(False))
    e = e.withColumns({"missed": is_range & F.col("miss").isNotNull() & F.lit(not strict), "plain": F.col("then").isNull() | F.col("then.precut") | n.isin("cut", "soft"), "leads": F.col("to").eqNullSafe(F.col("then.start"))})
    missed, plain, leads = F.col("missed"), F.col("plain"), F.col("leads")
    hint = is_range & ~missed & ~plain & leads & (F.col("to").isNotNull() | (n == "partial"))
    e = e.withColumns({"hint": F.coalesce(hint, F.lit(False)), "lost": F.coalesce(is_range & ~missed & ~plain & (n == "range") & F.col("to").isNull(), F.lit(False))})
    lost = F.col("lost")
    forced = F.when(~is_range, None).when(missed, "address_anchor_mismatch").when(plain | F.col("hint") | F.lit(strict), None).when(n == "partial", "range_before_partial_mismatch").when(F.col("to").isNotNull(), "pc_mismatch")
    dropped = ~missed & F.coalesce(~F.col("then.precut") & F.col("then.drops") & F.col("to").eqNullSafe(F.col("then.at")), F.lit(False)) | (lost & F.lit(strict))
    confirmed = is_range & F.col("hit").isNotNull() & (F.lit(strict) | F.col("miss").isNull() | (F.col("hit") < F.col("miss.i")))
    e = e.withColumn("forced", forced)
    return e.withColumns(
        {
            "em": F.when(is_range, F.coalesce(F.when(missed, F.col("miss.i")).otherwise(F.col("then.i")), F.col("last_i") + 1)).otherwise(F.col("i")),
            "invalid": lost | F.coalesce(kind == "partial", F.lit(False)),
            "gap": F.coalesce("forced", F.when(lost & F.lit(not strict), "missing_prev_next_pc")),
            "close": F.when(is_range & F.lit(strict) & ~plain & (n == "range"), F.when(lost, "missing_prev_next_pc").when(~leads, "pc_mismatch")),
            "edge": (is_range & ~F.coalesce(dropped, F.lit(False))) | F.coalesce(kind == "partial", F.lit(False)),
            "confidence": F.when(confirmed, "confirmed").otherwise(F.col("confidence")),
        }
    )


def rating(edge: dict[str, Column], forced: Column, next_pc: Column, next_start: Column, next_speculative: Column) -> dict[str, Column]:
    """The quality of an edge's target; its own target_valid says whether it may be valid at all."""
    q = target_quality(edge["status"], edge["kind"], edge["target_source"], edge["confidence"], next_pc, next_start, next_speculative)
    confidence = F.coalesce(forced, q["confidence"])
    match = F.when(q["target_source"] == "software_return_stack", F.when(confidence == "confirmed", True).when(confidence == "conflict", False))
    return {"target_source": q["target_source"], "confidence": confidence, "target_valid": edge["target_valid"] & q["target_valid"] & edge["control_valid"], "return_stack_match": match}


def _lines(e: DataFrame, named: DataFrame | None, block: int | None) -> DataFrame:
    """(s, pos, first, token, close): edges, gaps and closes of each event, in the order ``pos``."""
    # Where an edge goes: to the range that follows, to what an address said of it, or on from its own file's place.
    derived = F.when(F.col("start").isNotNull() & F.col("e_start").isNotNull(), F.col("e_start") + F.col("to") - F.col("start"))
    e = e.withColumn("derived", F.when(F.col("edge"), derived))
    there = F.lit(False)
    if named is not None:
        e = materialize(e, "emitted")
        asks = e.filter("edge AND NOT hint AND to IS NOT NULL").select("s", F.col("em").alias("i"), F.col("i").cast("string").alias("tag"), F.col("to").alias("r"), F.col("derived").alias("e"))
        told = _lookup(named, asks, block).select("s", F.col("tag").cast("bigint").alias("i"), "found")
        e = e.join(told, ["s", "i"], "left").withColumn("told_elf", parse_int(F.col("found.elf")))
        e, there = _halves(e, {"told": F.col("found.symbol")}), F.col("found").isNotNull()
    told_ = lambda c: F.col(c) if named is not None else F.lit(None).cast("string")
    goes_on = F.coalesce((F.col("to") == F.col("end") + 4) & F.col("end_name").isNotNull(), F.lit(False))
    # Ranges that end without a symbol have the one they start with.
    hint, some_end = F.col("hint"), F.col("end_name").isNotNull()
    e = e.withColumns(
        {
            "t_function": F.when(hint, F.col("then.start_f")).when(there, told_("told_f")).when(goes_on, F.col("end_f")).otherwise(UNKNOWN),
            "t_offset": F.when(hint, F.col("then.start_o")).when(there, told_("told_o")).when(goes_on, signed_hex(F.coalesce(F.when(F.col("end_o") != "0x0", F.col("end_n")), F.lit(0)) + 4)),
            "t_elf": F.when(hint, F.col("then.elf")).when(there, told_("found.elf").isNotNull()).otherwise(F.col("derived").isNotNull()),
            "t_elf_at": F.when(hint, F.col("then.elf_at")).when(there, told_("told_elf").cast("bigint")).otherwise(F.col("derived")),
            "t_module": F.when(hint, F.col("then.of")).when(there, told_("found.name")).otherwise(F.col("of")),
            "own_f": F.when(some_end, F.col("end_f")).otherwise(F.col("start_f")),
            "own_o": F.when(some_end, F.col("end_o")).otherwise(F.col("start_o")),
            "control_valid": ~F.coalesce(F.col("path_confidence") == "speculative", F.lit(False)),
            "way": F.coalesce("way", F.lit("unknown")),
            "place": F.coalesce("pc", "address", "runtime_addr"),
        }
    )
    next_start, next_speculative = F.when(hint, F.col("then.start")), F.coalesce(hint & F.col("then.speculative"), F.lit(False))
    may = ~F.col("invalid") & F.col("forced").isNull()
    rates = rating({"status": F.col("status"), "kind": F.col("way"), "target_source": F.col("target_source"), "confidence": F.col("confidence"), "target_valid": may, "control_valid": F.col("control_valid")}, F.when(F.col("forced").isNotNull(), "conflict"), F.col("to"), next_start, next_speculative)
    e = e.withColumns({f"q_{k}": v for k, v in rates.items()})
    is_partial, is_soft = F.col("type") == "partial", F.col("type") == "soft"
    says = {EDGE: F.col("edge"), HELD_GAP: F.col("edge") & F.col("gap").isNotNull(), HELD_CLOSE: F.col("close").isNotNull(), OWN_GAP: is_partial | is_soft, OWN_CLOSE: F.col("cut").isNotNull() | F.col("precut")}
    e = e.withColumn("said", fenced(F.array_compact(F.array(*[F.when(v, k) for k, v in says.items()]))))
    e = e.withColumn("line", F.explode("said"))
    line = F.col("line")
    edge, held, own = line == EDGE, line == HELD_GAP, line == OWN_GAP
    by_elf = (F.col("t_function") == UNKNOWN) & F.col("t_elf")
    away = F.col("to").isNull()
    own_elf = (F.col("own_f") == UNKNOWN) & F.col("elf_end").isNotNull()
    known = F.col("gap").isin("address_anchor_mismatch", "pc_mismatch")
    at_opaque = own & F.col("opaque")
    gap_module = F.when(own, F.col("module_now")).when(F.col("missed"), F.col("miss.module_before")).otherwise(F.col("then.now"))
    gap_f, gap_o = F.when(at_opaque, OPAQUE).otherwise(GAP), F.coalesce(F.when(at_opaque, F.col("map_file_offset")), F.lit("0x0"))
    gap_place = F.when(own, F.col("place")).when(F.col("missed"), F.col("miss.place")).when(F.col("gap") != "range_before_partial_mismatch", F.col("then.place"))
    observed = F.when(F.col("missed"), signed_hex(F.col("miss.a_at"))).when(known, signed_hex(F.col("then.start")))
    either = lambda a, b: F.when(edge, a).otherwise(b)
    fields = {
        "kind": either(F.col("way"), F.lit("flow_gap")),
        "atom": F.when(edge, F.col("atom")),
        "module": either(F.col("of"), gap_module),
        "function": either(F.when(own_elf, ELF).otherwise(F.col("own_f")), gap_f),
        "function_offset": either(F.when(own_elf, F.col("elf_end")).otherwise(F.col("own_o")), gap_o),
        "dst_module": either(F.when(~away, F.col("t_module")), gap_module),
        "dst_function": either(F.when(away, UNKNOWN_TARGET).when(by_elf, ELF).otherwise(F.col("t_function")), gap_f),
        "dst_offset": either(F.when(away, "0x0").when(by_elf, signed_hex(F.coalesce("t_elf_at", F.lit(0)))).otherwise(F.col("t_offset")), gap_o),
        "dst_address": either(signed_hex(F.col("to")), gap_place),
        "instruction_count": F.when(edge, F.col("instruction_count")),
        "status": either(F.col("status"), F.lit("gap")),
        "reason": F.when(edge, F.coalesce("forced", "reason")).when(held, F.col("gap")).when(is_partial, F.concat(F.lit("range_status:"), "status")).otherwise(F.col("why")),
        "target_source": either(F.col("q_target_source"), F.lit("none")),
        "confidence": either(F.col("q_confidence"), F.lit("observed")),
        "target_valid": either(F.col("q_target_valid"), F.lit(False)),
        "control_valid": F.when(edge, F.col("control_valid")),
        "continuity": F.lit("continuous"),
        "path_confidence": F.when(edge, F.col("path_confidence")),
        "return_stack_match": F.when(edge, F.col("q_return_stack_match")),
        "expected_pc": F.when(own, F.col("pc")).when(held & known, signed_hex(F.col("to"))),
        "observed_pc": F.when(held, observed),
    }
    token = F.struct(*[v.alias(k) for k, v in fields.items()]).cast(TOKEN)
    # A context change before a cut of the same range leaves the cut nothing to close, unless a partial edge stands between: a partial range is never a cut.
    close = F.when(line == HELD_CLOSE, F.col("close")).when(line == OWN_CLOSE, F.when(F.col("precut"), "context_change").otherwise(F.col("cut")))
    em = F.when(line < OWN_GAP, F.col("em")).otherwise(F.col("i"))
    ord_ = F.when(edge, F.when(is_partial, 3).otherwise(0)).when(held, 1).when(own, 4).otherwise(2)
    return e.select("s", (em * PLACES + ord_).alias("pos"), F.least(em, F.col("last_i")).alias("first"), F.when(edge | held | own, token).alias("token"), close.alias("close"))


def _merged(lines: DataFrame, said: dict[str, Column], go: Scan) -> DataFrame:
    """Lines of segments; gaps that follow each other are one token with the reasons of all."""
    is_gap = F.coalesce(F.col("token.kind") == "flow_gap", F.lit(False))
    lines = go(lines, ["s"], "pos", fills={"prior": F.coalesce("token.kind", F.lit("close"))}, sums=said)
    after_gap = F.coalesce(F.col("prior") == "flow_gap", F.lit(False))
    lines = lines.withColumns({"begins": F.col("close").isNull() & ~(is_gap & after_gap), "continuity": F.when(~is_gap & after_gap, "after_gap").otherwise("continuous")})
    lines = go(lines, ["s"], "pos", sums={"number": F.col("begins").cast("bigint")})
    lines = lines.withColumn("number", F.col("number") + F.col("begins").cast("bigint"))
    begun = lambda c: F.when(F.col("begins"), c)
    merged = lines.groupBy("s", "run", "number").agg(
        F.min(begun(F.col("pos"))).alias("pos"),
        F.min(begun(F.col("first"))).alias("first"),
        F.first(begun(F.struct("token", "continuity")), True).alias("x"),
        F.max("close").alias("close"),
        F.collect_list(F.when(is_gap, F.struct("pos", "token.reason"))).alias("reasons"),
    )
    reasons = F.array_join(F.array_distinct(F.sort_array("reasons")["reason"]), ";")
    token = F.col("x.token").withField("continuity", F.col("x.continuity")).withField("reason", F.when(F.size("reasons") > 0, reasons).otherwise(F.col("x.token.reason")))
    return merged.select("s", "run", "first", "close", F.when(F.col("x").isNotNull(), F.struct("pos", token.alias("token"))).alias("x"))


def _segments(e: DataFrame, strict: bool, targets: tuple[str, ...], go: Scan, named: DataFrame | None, block: int | None) -> DataFrame:
    """All segments of streams, however short, with null reasons where their stream ends."""
    lines = _lines(_emitted(_typed(e, strict, targets, go, named is not None, block), strict, go), named, block)
    said = {"run": F.col("close").isNotNull().cast("bigint")}
    if strict:  # breaks where the other policy has gaps, so there are none
        lines = go(lines, ["s"], "pos", sums=said)
        begun = lambda c: F.when(F.col("close").isNull(), c)
        merged = lines.select("s", "run", begun(F.col("first")).alias("first"), "close", begun(F.struct("pos", "token")).alias("x"))
    else:
        merged = _merged(lines, said, go)
    segments = merged.groupBy("s", "run").agg(F.min("first").alias("first_event"), F.count("x").cast("int").alias("length"), F.max("close").alias("break_reason"), F.sort_array(F.collect_list("x")).alias("x"))
    return go(segments.filter("length > 0"), ["s"], "run", sums={"segment_id": F.lit(1).cast("bigint")})


def layered(events: DataFrame, by: str, order: str, strict: bool, targets: tuple[str, ...], least: int, block: int | None = None) -> DataFrame:
    """(s, segment_id, first_event, length, break_reason, tokens): the segments of each stream."""
    e = _flat(events, by, order, targets)
    sizes = e.groupBy("s").agg(F.count("*").alias("n"), F.max("named").alias("named"))
    most, names = sizes.agg(F.max("n"), F.max("named")).first()
    named = e if names else None
    if (most or 0) <= (block or BLOCK):
        out = _segments(e, strict, targets, running, named, block)
    else:
        long = materialize(sizes.filter(F.col("n") > (block or BLOCK)).select("s"), "long")
        parts = [_segments(e.join(long, "s", how), strict, targets, go, named, block) for how, go in (("left_anti", running), ("left_semi", partial(scan, block=block)))]
        out = parts[0].unionByName(parts[1])
    return out.filter(F.col("length") >= least).select("s", "segment_id", "first_event", "length", F.coalesce("break_reason", F.lit("file_end")).alias("break_reason"), F.col("x")["token"].alias("tokens"))
