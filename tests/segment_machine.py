"""The segmenter as a machine for each file, fed in event order: what the layers are tested against.

A range waits until it is known where control went; it then becomes an edge of
the open segment. Breaks close the segment. Under the evidence policy, doubtful
steps become edges with invalid targets and gap tokens; under the strict policy
they break. The machine says only what it has seen around an edge; what a
target is worth follows from ``control.target_quality``, in columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoptrail.functions.control import EVIDENCE
from hoptrail.functions.literals import ELF, GAP, OPAQUE, UNKNOWN, UNKNOWN_TARGET
from hoptrail.operators.segmenter import rated
from hoptrail.operators.sequential import Machine

TOKEN = (
    "struct<kind:string,atom:string,module:string,function:string,function_offset:string,dst_module:string,dst_function:string,dst_offset:string,"
    "dst_address:string,instruction_count:long,status:string,reason:string,target_source:string,confidence:string,target_valid:boolean,"
    "control_valid:boolean,continuity:string,path_confidence:string,return_stack_match:boolean,expected_pc:string,observed_pc:string>"
)
#: What the machine says of an edge, from which its target's quality follows.
SEEN = "struct<forced:string,next_pc:long,next_start:long,next_speculative:boolean>"
SCHEMA = f"segment_id long, first_event long, length int, break_reason string, tokens array<struct<token:{TOKEN},seen:{SEEN}>>"
CUT = {"address-not-in-maps", "address-in-non-executable-map"}
PARTIAL = {"conflict", "target_unknown", "target_unresolved"}


def number(text) -> int | None:
    """0x-prefixed or decimal text as an integer; None for anything else."""
    if text is None or isinstance(text, bool):
        return None
    try:
        return int(str(text).strip(), 0)
    except ValueError:
        return None


def split(symbol: str | None) -> tuple[str, str | None]:
    """Function and offset of ``name+0x10``."""
    if not symbol:
        return UNKNOWN, None
    name, plus, offset = symbol.rpartition("+")
    value = number(offset) if plus else None
    return (name.removesuffix("~"), hex(value)) if value is not None and name else (symbol, "0x0")


def base(path: str | None) -> str | None:
    return path.rsplit("/", 1)[-1] if path and not path.startswith("[") else None


def context_of(row: dict) -> tuple:
    return tuple(row.get(c) for c in ("context_id", "vmid", "el", "security", "isa"))


@dataclass
class Range:
    row: dict
    module: str | None
    start: int | None
    end: int | None
    elf_start: int | None
    elf_end: int | None
    next_pc: int | None
    confidence: str | None
    context: tuple | None = None

    @property
    def waypoint(self) -> dict:
        return self.row.get("waypoint") or {}

    @property
    def speculative(self) -> bool:
        return self.row.get("path_confidence") == "speculative"

    @property
    def doubtful(self) -> bool:
        """Whether its target was foretold, not seen."""
        return self.speculative or self.row.get("target_source") == "software_return_stack"


@dataclass
class Segmenter(Machine):
    """The machine; ``targets`` limits the modules whose code may stand in segments."""

    strict: bool = False
    targets: frozenset = frozenset()
    least: int = 1
    context: tuple = (None,) * 5
    trace_id: str | None = None
    module: str | None = None
    default_module: str | None = None
    pending: Range | None = None
    tokens: list = field(default_factory=list)
    after_gap: bool = False
    segment_id: int = 0
    first_event: int = 0
    event: int = 0
    seen: dict = field(default_factory=dict)
    out: list = field(default_factory=list)

    def feed(self, row: dict) -> list[dict]:
        self.out, self.event = [], row["event_index"]
        kind = row.get("event")
        if kind == "instruction_range":
            self.on_range(row)
        elif kind == "address":
            self.on_address(row)
        elif kind == "header":
            names = [n for n in row.get("modules") or [] if n]
            if len(names) == 1:
                self.default_module = self.module = names[0]
        elif kind == "trace_stream":
            if row.get("trace_id") != self.trace_id:
                self.cut("trace_stream_change")
            self.trace_id = row.get("trace_id") or self.trace_id
        elif kind == "context":
            self.on_context(context_of(row))
            self.trace_id = None
        elif kind == "flow_gap":
            why = row.get("reason") or kind
            if self.strict:
                self.cut(f"flow_gap:{why}")
            else:
                self.soft(why, row)
        elif kind == "overflow":
            self.soft(kind, row)
        elif kind == "discontinuity":
            self.cut(f"discontinuity:{row.get('reason') or kind}")
        elif kind == "trace_control":
            why = row.get("kind") or row.get("reason") or kind
            if why != "conditional_flush":
                self.cut(f"trace_control:{why}")
        elif kind in ("exception", "exception_return"):
            self.cut(kind)
        return self.out

    def end(self) -> list[dict]:
        self.out = []
        self.cut("file_end")
        return self.out

    # Segments

    def close(self, reason: str) -> None:
        if self.tokens:
            if len(self.tokens) >= self.least:
                self.out.append({"segment_id": self.segment_id, "first_event": self.first_event, "length": len(self.tokens), "break_reason": reason, "tokens": self.tokens})
            self.segment_id += 1  # short segments use their number too
        self.tokens, self.after_gap = [], False

    def cut(self, reason: str, keep: bool = True) -> None:
        """End the segment; a pending range is emitted unless it isn't to be kept."""
        pending, self.pending = self.pending, None
        if pending and keep:
            self.edge(pending)
        self.close(reason)

    def add(self, token: dict, seen: dict | None = None) -> None:
        if not self.tokens:
            self.first_event = self.event
        self.tokens.append({"token": token, "seen": seen})

    def gap(self, reason: str, row: dict, module: str | None = None, function: str = GAP, expected: int | None = None, observed: int | None = None, offset: str | None = None) -> None:
        """A gap token; it grows if one stands there already."""
        if self.tokens and self.tokens[-1]["token"]["kind"] == "flow_gap":
            last = self.tokens[-1]["token"]
            if reason not in last["reason"].split(";"):
                last["reason"] += f";{reason}"
            return
        place = row.get("pc") or row.get("address") or row.get("runtime_addr")
        wanted = hex(expected) if expected is not None else row.get("pc")
        self.add({"kind": "flow_gap", "module": module or self.module, "function": function, "function_offset": offset or "0x0", "dst_module": module or self.module, "dst_function": function, "dst_offset": offset or "0x0", "dst_address": place, "status": "gap", "reason": reason, "target_source": "none", "confidence": "observed", "target_valid": False, "continuity": "continuous", "expected_pc": wanted, "observed_pc": hex(observed) if observed is not None else None})
        self.after_gap = True

    def soft(self, reason: str, row: dict, **more) -> None:
        """A doubtful place: a gap token, or a break under the strict policy."""
        if self.strict:
            self.cut(reason)
            return
        self.flush()
        self.gap(reason, row, **more)

    def flush(self) -> None:
        pending, self.pending = self.pending, None
        if pending:
            self.edge(pending)

    # Events

    def on_context(self, key: tuple) -> None:
        if key != self.context:
            self.cut("context_change")
        self.context = key

    def on_address(self, row: dict) -> None:
        at, reason = number(row.get("runtime_addr") or row.get("address")), row.get("reason")
        elf = row.get("elf_addr") or row.get("elf_va")
        module = row.get("module") or base(row.get("map"))
        if reason == "no-configured-elf":
            self.module = base(row.get("map"))
            self.soft("unconfigured_executable_module", row, module=self.module, function=OPAQUE, offset=row.get("map_file_offset"))
            return
        if reason in CUT or (self.targets and module not in self.targets):
            self.cut(f"address:{reason or 'outside-target'}", keep=not (self.pending and self.pending.next_pc == at))
            return
        waiting = self.pending
        if waiting and waiting.doubtful and at is not None and waiting.next_pc is not None:
            if waiting.next_pc == at:
                waiting.confidence = "confirmed"
            elif not self.strict:
                self.pending = None
                self.edge(waiting, bad="conflict", why="address_anchor_mismatch")
                self.gap("address_anchor_mismatch", row, expected=waiting.next_pc, observed=at)
        if module:
            self.module = module
        known = {"module": module, "symbol": row.get("symbol"), "elf": elf}
        for key in (("r", at), ("e", number(elf))):
            if key[1] is not None:
                self.seen[key] = known

    def read(self, row: dict) -> Range:
        """A range with what earlier addresses say of its module and symbols."""
        nested = row.get("context")
        if nested and any(v is not None for v in nested.values()):
            self.on_context(context_of(nested))
        row = row | {"elf_start": row.get("elf_start") or row.get("elf_va")}
        start, end, elf_start, elf_end = (number(row.get(c)) for c in ("runtime_start", "runtime_end", "elf_start", "elf_end"))
        first, last = (self.seen.get(("r", r)) or self.seen.get(("e", e)) or {} for r, e in ((start, elf_start), (end, elf_end)))
        module = row.get("module") or base(row.get("map")) or first.get("module") or last.get("module") or self.module or self.default_module
        self.module = module or self.module
        row = row | {"start_symbol": row.get("start_symbol") or first.get("symbol"), "end_symbol": row.get("end_symbol") or last.get("symbol")}
        return Range(row, module, start, end, elf_start, elf_end, number(row.get("next_pc")), row.get("confidence"), self.context)

    def on_range(self, row: dict) -> None:
        item = self.read(row)
        status = row.get("status") or "resolved"
        if row.get("reason") in CUT:
            self.cut(f"range:{row['reason']}")
            return
        if status not in EVIDENCE or (self.strict and status in PARTIAL):
            self.cut(f"range_status:{status}")
            return
        if status in PARTIAL:
            waiting, self.pending = self.pending, None
            if waiting:
                if waiting.next_pc == item.start:
                    self.edge(waiting, hint=item)
                else:
                    self.edge(waiting, bad="conflict", why="range_before_partial_mismatch")
                    self.gap("range_before_partial_mismatch", {})
            self.edge(item, invalid=True)
            self.gap(f"range_status:{status}", row)
            return
        if item.start is None or item.elf_start is None:
            self.cut("range_missing_start")
            return
        if item.end is None or item.elf_end is None:
            self.cut("range_missing_end")
            return
        if self.targets and item.module not in self.targets:
            self.cut("range:outside_target_module", keep=not (self.pending and self.pending.next_pc == item.start))
            return
        if self.pending and self.pending.context != item.context:
            self.cut("context_change")
        waiting, self.pending = self.pending, item
        if waiting is None:
            return
        if waiting.next_pc is None:
            if self.strict:
                self.close("missing_prev_next_pc")
            else:
                self.edge(waiting, invalid=True)
                self.gap("missing_prev_next_pc", row)
        elif waiting.next_pc != item.start:
            if self.strict:
                self.edge(waiting)
                self.close("pc_mismatch")
            else:
                self.edge(waiting, bad="conflict", why="pc_mismatch")
                self.gap("pc_mismatch", row, expected=waiting.next_pc, observed=item.start)
        else:
            self.edge(waiting, hint=item)

    # Edges

    def target(self, item: Range, hint: Range | None) -> tuple[str | None, str, str | None]:
        """Module, function and offset of where an edge goes."""
        at = item.next_pc
        if at is None:
            return None, UNKNOWN_TARGET, "0x0"
        if hint:
            function, offset = split(hint.row.get("start_symbol"))
            module, elf = hint.module, hint.row.get("elf_start")
        else:
            start, elf_start = item.start, number(item.row.get("elf_start"))
            derived = hex(elf_start + at - start) if start is not None and elf_start is not None else None
            known = self.seen.get(("r", at)) or self.seen.get(("e", number(derived)))
            if known:
                function, offset = split(known["symbol"])
                module, elf = known["module"], known["elf"]
            else:
                function, offset = UNKNOWN, None
                module, elf = item.module, derived
                if item.end is not None and at == item.end + 4 and item.row.get("end_symbol"):
                    name, inner = split(item.row["end_symbol"])
                    function, offset = name, hex((number(inner) or 0) + 4)
        if function == UNKNOWN and elf:
            function, offset = ELF, hex(number(elf) or 0)
        return module, function, offset

    def edge(self, item: Range, hint: Range | None = None, bad: str | None = None, invalid: bool = False, why: str | None = None) -> None:
        row = item.row
        module, function, offset = self.target(item, hint)
        own_function, own_offset = split(row.get("end_symbol") or row.get("start_symbol"))
        if own_function == UNKNOWN and row.get("elf_end"):
            own_function, own_offset = ELF, row["elf_end"]
        self.add(
            {
                "kind": item.waypoint.get("kind") or "unknown",
                "atom": row.get("atom"),
                "module": item.module,
                "function": own_function,
                "function_offset": own_offset,
                "dst_module": module,
                "dst_function": function,
                "dst_offset": offset,
                "dst_address": hex(item.next_pc) if item.next_pc is not None else None,
                "instruction_count": row.get("instruction_count"),
                "status": row.get("status") or "resolved",
                "reason": why or row.get("reason"),
                "target_source": row.get("target_source"),
                "confidence": item.confidence,
                "target_valid": not (invalid or bad),
                "control_valid": not item.speculative,
                "continuity": "after_gap" if self.after_gap else "continuous",
                "path_confidence": row.get("path_confidence"),
            },
            {"forced": bad, "next_pc": item.next_pc, "next_start": hint.start if hint else None, "next_speculative": bool(hint and hint.speculative)},
        )
        self.after_gap = False


def machine_segments(events: DataFrame, by: str = "file", order: str = "event_index", policy: str = "evidence", target_modules: tuple[str, ...] = (), min_edges: int = 1) -> DataFrame:
    """Segments of event streams, one stream after the other, in this process."""
    streams: dict = {}
    for r in events.orderBy(by, order).collect():
        row = r.asDict(recursive=True)
        streams.setdefault(row[by], []).append(row | {"event_index": row[order]})
    out = []
    for name, rows in streams.items():
        machine = Segmenter(strict=policy == "strict", targets=frozenset(target_modules), least=min_edges)
        for found in [x for row in rows for x in machine.feed(row)] + machine.end():
            out.append({by: name} | found)
    kind = events.schema[by].dataType.simpleString()
    made = events.sparkSession.createDataFrame(out, f"{by} {kind}, {SCHEMA}")
    return made.withColumn("tokens", F.transform("tokens", lambda x: F.when(x["seen"].isNull(), x["token"]).otherwise(rated(x["token"], x["seen"]))))
