"""Atoms to instruction ranges: follows control flow along a table of waypoints.

``waypoints`` has, for each address of a module, the next instruction that isn't
normal (made once by a window over the instruction table). The machine holds a
PC, the stack of return addresses and a target that waits for an address packet.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoptrail.functions.control import branch_target, instruction_kind
from hoptrail.operators.sequential import Machine, run_machines

#: Instructions looked at for one atom, and return addresses kept.
REACH, DEPTH = 65_536, 4_096
SCHEMA = "row_id long, event string, start long, stop long, kind string, atom string, next_pc long, status string, reason string, target_source string, confidence string, path_confidence string, instruction_count long"


def waypoints(instructions: DataFrame, reach: int = REACH) -> DataFrame:
    """module, va and the next waypoint from there: its address, kind and target; ``hole`` where code ends before it.

    Distance is in bytes: a waypoint counts only if an instruction stands at every fourth byte up to it.
    """
    known = instructions.withColumn("kind", instruction_kind(F.col("word"))).withColumn("target", branch_target(F.col("va"), F.col("word")))
    inside = Window.partitionBy("module").orderBy("va")
    known = known.withColumn("_n", F.row_number().over(inside))
    ahead = inside.rangeBetween(0, 4 * (reach - 1))
    way = F.first(F.when(F.col("kind") != "normal", F.struct("va", "kind", "target", "_n")), ignorenulls=True).over(ahead)
    last = F.struct(F.last("va").over(ahead).alias("va"), F.last("_n").over(ahead).alias("_n"))
    dense = lambda to: to["va"] - F.col("va") == 4 * (to["_n"] - F.col("_n"))
    known = known.withColumns({"way": way, "last": last})
    good = F.col("way").isNotNull() & dense(F.col("way"))
    full = dense(F.col("last")) & (F.col("last.va") - F.col("va") == 4 * (reach - 1))
    return known.select("module", "va", *[F.when(good, F.col("way")[c]).alias(f"way_{c}") for c in ("va", "kind", "target")], (~good & ~full).alias("hole"))


@dataclass
class Follower(Machine):
    """State between the packets of one stream; ``ways`` maps a module and an address in it to the waypoint from there.

    Addresses of packets are those of the running process; ``place`` is the module that the anchor lies in and its load bias.
    Static branches stay in their module; a return goes back to the place of its call.
    """

    ways: dict
    pc: int | None = None
    place: tuple = (None, 0)
    stack: list = field(default_factory=list)
    waiting: dict | None = None
    speculative: bool = False
    out: list = field(default_factory=list)

    def emit(self, row: dict, event: str, **more) -> None:
        self.out.append({"row_id": row["row_id"], "event": event, "path_confidence": "speculative" if self.speculative else None} | more)

    def lose(self, row: dict, reason: str) -> None:
        """The flow is out of step: a waiting range goes out unresolved."""
        if self.waiting:
            self.emit(row, "instruction_range", **self.waiting, status="target_unresolved", target_source="unknown", confidence="unresolved")
            self.emit(row, "flow_gap", reason=reason)
        elif self.pc is not None:
            self.emit(row, "flow_gap", reason=reason)
        self.pc, self.waiting, self.speculative, self.stack = None, None, False, []

    def feed(self, row: dict) -> list[dict]:
        self.out = []
        if row["kind"] == "address":
            self.anchor(row)
        elif row["kind"] == "atom":
            for atom in row["atoms"]:
                self.step(row, atom)
        elif row["kind"] == "reset":
            self.lose(row, row.get("reason") or "reset")
        return self.out

    def anchor(self, row: dict) -> None:
        keep = self.waiting and self.waiting["kind"] == "indirect_call"
        if self.waiting:
            self.emit(row, "instruction_range", **(self.waiting | {"next_pc": row["address"]}), status="target_resolved", target_source="address_packet", confidence="exact")
        if not keep:
            self.stack = []
        self.pc, self.waiting, self.speculative = row["address"], None, False
        self.place = (row.get("module"), row.get("load_bias") or 0)

    def step(self, row: dict, atom: str) -> None:
        if self.waiting:
            self.lose(row, "atom-before-address-target")
        if self.pc is None:
            return
        module, bias = self.place
        if (way := self.ways.get((module, self.pc - bias))) is None:
            self.lose(row, "pc-unresolved")
            return
        at, kind, target, hole = way
        if at is None:
            self.lose(row, "elf-bytes-unavailable" if hole else "max-instructions-before-waypoint")
            return
        at, target = at + bias, None if target is None else target + bias
        base = {"start": self.pc, "stop": at, "kind": kind, "atom": atom, "instruction_count": (at - self.pc) // 4 + 1}
        if kind == "conditional_branch":
            self.go(row, base, target if atom == "E" else at + 4)
        elif kind.startswith("exception"):
            self.emit(row, "instruction_range", **base, status="target_unknown" if atom == "E" else "conflict", target_source="unknown", confidence="unresolved" if atom == "E" else "conflict")
            self.lose(row, kind)
        elif atom == "N":
            self.emit(row, "instruction_range", **base, status="conflict", target_source="unknown", confidence="conflict")
            self.lose(row, f"n-atom-on-unconditional-{kind.replace('_', '-')}")
        elif kind in ("direct_branch", "direct_call"):
            if kind == "direct_call" and len(self.stack) >= DEPTH:
                self.lose(row, "return-stack-overflow")
                return
            if kind == "direct_call":
                self.stack.append((at + 4, self.place))
            self.go(row, base, target)
        elif kind == "return" and self.stack:
            self.emit(row, "instruction_range", **base, next_pc=self.stack[-1][0], status="resolved", target_source="software_return_stack", confidence="speculative")
            (self.pc, self.place), self.speculative = self.stack.pop(), True
        else:  # its target is in the next address packet
            if kind == "indirect_call":
                self.stack = [*self.stack, (at + 4, self.place)][-DEPTH:]
            self.waiting, self.pc = base, None

    def go(self, row: dict, base: dict, target: int) -> None:
        self.emit(row, "instruction_range", **base, next_pc=target, status="resolved", target_source="static", confidence="exact")
        self.pc = target

    def end(self) -> list[dict]:
        self.out = []
        if self.waiting:
            self.lose({"row_id": None}, "end-of-trace-before-address-target")
        return self.out


def follow(packets: DataFrame, ways: DataFrame, by: list[str], order: list[str], most_waypoints: int = 20_000_000) -> DataFrame:
    """Ranges and gaps of packet streams (row_id, kind, address, atoms, reason; module and load_bias of an address, where it is resolved).

    Without a module the only one of ``ways`` is meant. The waypoints of the traced modules are held by every task; ``most_waypoints`` bounds them.
    """
    rows = ways.limit(most_waypoints + 1).collect()
    if len(rows) > most_waypoints:
        raise ValueError("too many waypoints for one machine: follow modules apart")
    single = len({r.module for r in rows}) == 1
    held = packets.sparkSession.sparkContext.broadcast({k: (r.way_va, r.way_kind, r.way_target, r.hole) for r in rows for k in [(r.module, r.va), *([(None, r.va)] if single else [])]})
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packets.schema.fields if f.name in by)
    return run_machines(packets, by, order, lambda: Follower(held.value), f"{keys}, {SCHEMA}")
