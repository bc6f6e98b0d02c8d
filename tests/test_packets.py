"""The packet dispatcher against a machine that reads line by line, and its rules one by one."""

import random
import re
from collections import Counter

import pytest

from hoptrail.operators import packets

CONTEXT = packets.CONTEXT


class Walk:
    """Reads one stream, a line at a time, by the decision table."""

    def __init__(self, mode, context_ids=None, els=None):
        self.mode, self.context_ids, self.els = mode, context_ids, els
        self.now = dict.fromkeys(["trace_id", *CONTEXT, "timestamp"]) | {"in_exception": False, "generation": 0}
        self.out, self.info, self.resync, self.queue, self.changed = [], None, None, [], False

    def put(self, action, **more):
        self.out.append((self.line_no, action, tuple(self.now.values()), tuple(sorted((k, v) for k, v in more.items() if v is not None and v is not False))))

    def discard(self, reason):
        if self.queue:
            self.put("atoms_discarded", count=len(self.queue), detail=reason)
            self.queue = []

    def end_info(self):
        fields = dict(map(str.strip, p.split("=", 1)) for p in " ".join(self.info).split(",") if "=" in p)
        depth = int(fields.get("curr_spec_depth", 0))
        if depth:
            self.put("flow_gap", detail=f"nonzero-initial-spec-depth,curr_spec_depth={depth}", count=depth)
        self.put("trace_info", detail=" ".join(self.info), count=depth)
        self.info = None

    def end_resync(self):
        if self.resync:
            self.put("resync", detail=",".join(self.resync[1]), count=self.resync[0])
        self.resync = None

    def begin(self, reason):
        """Whether this line begins a resync."""
        if self.resync:
            if reason not in self.resync[1]:
                self.resync[1].append(reason)
            return False
        self.resync = (self.line_no, [reason])
        self.queue_left = self.now["generation"] + 1
        return True

    def read(self, line):
        now = self.now
        if self.info is not None:
            if re.search(r"\bcc_threshold\s*=", line, re.I):
                self.info.append(line)
                return self.end_info()
            if line.startswith(tuple(packets.STARTS)) or any(f in line for f in packets.FIELDS):
                self.end_info()
            else:
                self.info.append(line)
                return None
        if self.resync and not line.startswith(tuple(packets.RESYNC)):
            self.end_resync()
        if m := re.match(packets.STREAM, line):
            before = dict(now)
            now |= dict.fromkeys(CONTEXT) | {"trace_id": int(m[1], 0), "in_exception": False, "generation": now["generation"] + 1}
            self.changed = False
            self.discarded(before, "trace-stream-change")
            return self.put("trace_stream", reset="trace-stream-change", detail=line)
        if m := re.match(packets.INFO, line):
            self.info = [m[1]]
            return self.end_info() if re.search(r"\bcc_threshold\s*=", line, re.I) else None
        seen, width = {}, None
        for name, rx, base in (("context_id", r"Context ID\s*=\s*(0x[0-9a-f]+)", 16), ("vmid", r"VMID\s*=\s*(0x[0-9a-f]+)", 16), ("el", r"Exception level\s*=\s*(EL\d)", 0), ("security", r"Security\s*=\s*([^,\s]+)", 0)):
            if m := re.search(rx, line):
                seen[name] = int(m[1], 16) if base else m[1]
        if "64-bit instruction" in line or "32-bit instruction" in line:
            width = seen["isa"] = "AArch64" if "64-bit" in line else "AArch32"
        if seen:
            before = dict(now)
            self.changed |= any(now[k] != v for k, v in seen.items())
            now |= seen
            if width:
                if self.changed:
                    now["generation"] += 1
                    self.discarded(before, "context-change")
                self.put("context", reset="context-change" if self.changed else None, detail=line)
                self.changed = False
            return None
        if self.changed:
            now["generation"] += 1
            self.discarded(dict(now), "context-change", now["generation"])
            self.put("context", reset="context-change", detail="implicit")
            self.changed = False
        return self.act(line)

    def discarded(self, before, reason, generation=None):
        """Atoms that go are recorded with the context before the line, in the line's generation."""
        if self.queue:
            kept, self.now = self.now, before | {"generation": generation or self.now["generation"]}
            self.discard(reason)
            self.now = kept

    def act(self, line):
        now, before = self.now, dict(self.now)
        if m := re.match(r"Timestamp\s*-\s*(\d+)", line):
            now["timestamp"] = int(m[1])
            return self.put("timestamp")
        if line.startswith(("TraceOn", "Discard")):
            first = self.begin("trace-on" if line.startswith("TraceOn") else "discard")
            if first:
                now["generation"] += 1
                self.discarded(before, "trace-resync")
            self.put("discontinuity", reset="trace-resync" if first else None, detail=line)
            if line.startswith("TraceOn"):
                self.end_resync()
        elif line.startswith("Conditional flush"):
            if self.resync:
                self.begin("conditional-flush")
            else:
                self.put("trace_control", detail=line)
        elif line == "Exception" or line.startswith("Exception -"):
            now |= {"in_exception": True, "generation": now["generation"] + 1}
            self.discarded(before, "exception-boundary")
            kind, at = re.search(r"(?i)exception type\s+([^,]+)", line), re.search(r"(?i)\baddress\s+(0x[0-9a-f]+)", line)
            self.put("exception", detail=kind and kind[1].strip(), address=at and int(at[1], 16))
        elif line.lower().startswith("exception return"):
            now |= {"in_exception": False, "generation": now["generation"] + 1}
            self.discarded(before, "exception-return")
            self.put("exception_return", reset="exception-return", detail=line)
        elif line.startswith("Cancel - ") or "ispredict" in line:
            self.discarded(before, "cancel-or-mispredict")
            m = re.match(r"Cancel - (\d+)", line)
            self.put("cancel", reset="cancel-or-mispredict", gap=True, detail=line, count=int(m[1]) if m else None)
        elif m := re.match(r"Address - Instruction address (0x[0-9a-f]+), Instruction set (\S+)", line):
            self.discarded(before, "new-address-packet")
            now["isa"] = "AArch64" if "aarch64" in m[2].lower() else "AArch32" if "aarch32" in m[2].lower() else m[2]
            ok = (self.context_ids is None or now["context_id"] in self.context_ids) and (self.els is None or now["el"] in self.els)
            odd = now["isa"] != "AArch64"
            self.put("address" if ok else "filtered_address", address=int(m[1], 16), reset=(("unsupported-isa" if odd else None) if ok else "filtered-address"))
            if ok and odd:
                self.put("flow_gap", detail=f"unsupported-isa,{now['isa']}", address=int(m[1], 16))
        elif m := re.match(r"ATOM - ([EN]+)$", line):
            if self.mode == "immediate":
                for a in m[1]:
                    self.put("atom", atom=a)
            else:
                self.queue += m[1]
        elif m := re.match(r"Commit - (\d+)$", line):
            n = int(m[1])
            missing = max(0, n - len(self.queue)) if self.mode == "commit" else 0
            if self.mode == "commit":
                for a in self.queue[:n]:
                    self.put("atom", atom=a)
                self.queue = self.queue[n:]
            self.put("commit", count=n, missing=missing, reset="commit-without-pending-atom" if missing else None)
        else:
            self.put("raw", detail=line)

    def finish(self):
        self.line_no += 1
        if self.info is not None:
            self.end_info()
        self.end_resync()
        self.discarded(dict(self.now), "end-of-trace")
        self.put("end")
        return self.out


LINES = ["Decode trace stream of ID 0x10", "Decode trace stream of ID 7 again", "TraceInfo - p0_key = 1, curr_spec_depth = 3, cc_threshold = 0x4", "TraceInfo - p0_key = 0x2", "curr_spec_depth = 2, p1 = 5", ", curr_spec_depth = 4", "cc_threshold = 0x100", "TraceInfo", "Context ID = 0x1", "Context ID = 0x2, VMID = 0x3", "VMID = 0x0", "Exception level = EL1, Security = S", "Exception level = EL0", "64-bit instruction", "Context ID = 0x2, 64-bit instruction", "32-bit instruction", "Timestamp - 55", "Timestamp", "TraceOn - overflow", "Discard", "Conditional flush", "Exception", "Exception - exception type IRQ, address 0x500", "Exception return", "Exception Return", "Cancel - 2", "branch mispredict", "Address - Instruction address 0x1000, Instruction set AArch64", "Address - Instruction address 0x1000, Instruction set AArch32", "Address - Instruction address 0x2000, Instruction set Jazelle", "Address - broken", "ATOM - E", "ATOM - ENNE", "ATOM - X", "Commit - 1", "Commit - 3", "Commit", "something else"]

ADDRESS = "Address - Instruction address 0x1000, Instruction set AArch64"


def steps(spark, streams, **how):
    rows = [(s, i, line) for s, lines in streams.items() for i, line in enumerate(lines)]
    out = packets.dispatch(spark.createDataFrame(rows, "stream string, line_no long, line string"), **how)
    assert out.columns == packets.STEP
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.stream, r.line_no, r.seq, r.idx)):
        context = (r.trace_id, *(r[c] for c in CONTEXT), r.timestamp, r.in_exception, r.generation)
        rest = {k: r[k] for k in ("reset", "gap", "detail", "address", "atom", "count", "missing")}
        got.setdefault(r.stream, []).append((r.line_no, r.action, context, tuple(sorted((k, v) for k, v in rest.items() if v is not None and v is not False))))
    return got


def walked(lines, **how):
    walk = Walk(how.get("mode", "immediate"), how.get("context_ids"), how.get("els"))
    for walk.line_no, line in enumerate(lines):  # noqa: B020
        walk.read(line)
    return walk.finish()


@pytest.mark.parametrize("how", [{}, {"mode": "commit"}, {"mode": "commit", "context_ids": [2], "els": ["EL1"]}])
def test_random_lines(spark, how):
    rng = random.Random(len(how))
    streams = {f"s{i}": [rng.choice(LINES if i % 3 else LINES[24:]) for _ in range(rng.randint(1, 120))] for i in range(40)}
    for block in (7,) if how else (7, None):
        got = steps(spark, streams, block=block, **how)
        for s, lines in streams.items():
            want = walked(lines, **how)
            assert Counter(got[s]) == Counter(want), (lines, [x for x in got[s] if x not in want][:3], [x for x in want if x not in got[s]][:3])
            assert [x[:2] for x in got[s]] == [x[:2] for x in want]
        actions = Counter(x[1] for s in got.values() for x in s)
        assert len(actions) > 12, actions


def test_rules_one_by_one(spark):
    """A resync of several lines is one record; commits take atoms in order; filtered addresses reset."""
    got = steps(spark, {"a": ["Discard", "Conditional flush", "Discard", "TraceInfo - cc_threshold = 1", "Conditional flush", "TraceOn", "ATOM - EN", "Commit - 1", "Commit - 2"]}, mode="commit")["a"]
    short = [(n, a, dict(m).get("detail") or dict(m).get("atom") or dict(m).get("missing")) for n, a, _, m in got]
    assert short == [(0, "discontinuity", "Discard"), (2, "discontinuity", "Discard"), (3, "trace_info", "cc_threshold = 1"), (5, "discontinuity", "TraceOn"), (5, "resync", "discard,conditional-flush,trace-on"), (7, "atom", "E"), (7, "commit", 0), (8, "atom", "N"), (8, "commit", 1), (9, "end", None)]
    got = steps(spark, {"a": ["Context ID = 0x9", ADDRESS, "Context ID = 0x2", ADDRESS]}, context_ids=[2])["a"]
    assert [(a, dict(m).get("reset")) for _, a, _, m in got] == [("context", "context-change"), ("filtered_address", "filtered-address"), ("context", "context-change"), ("address", None), ("end", None)]


def test_empty(spark):
    empty = spark.createDataFrame([], "stream string, line_no long, line string")
    assert packets.dispatch(empty, mode="commit").count() == 0
