"""Operators that the registered queries don't reach."""

import struct
import tempfile

import pytest
from pyspark.sql import functions as F

from hoptrail.functions import control, literals, text
from hoptrail.operators import follower, sequential
from hoptrail.sources import elf, traces


def values(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_numbers_and_symbols(spark):
    assert values(spark, *[literals.parse_int(F.lit(x)) for x in ("42", "0x2a", "", "x", "-0x10")]) == (42, 42, None, None, -16)
    assert values(spark, literals.optional_int(F.lit("auto")), literals.optional_int(F.lit("7"))) == (None, 7)
    s = text.split_symbol(F.lit("name+0x10"))
    assert values(spark, s["name"], s["offset"], s["relation"]) == ("name", 16, "+")
    s = text.split_symbol(F.lit("plain"))
    assert values(spark, s["name"], s["offset"], s["relation"]) == ("plain", 0, None)
    assert values(spark, literals.permission_compatible(F.lit("r-xp"), F.lit("rw-"))) == (False,)


def test_words_and_targets(spark):
    word = lambda w: (control.instruction_kind(F.lit(w)), control.branch_target(F.lit(0x1000), F.lit(w)))
    for w, kind, target in ((0x94000002, "direct_call", 0x1008), (0x17FFFFFF, "direct_branch", 0xFFC), (0x54000040, "conditional_branch", 0x1008), (0xD65F03C0, "return", None), (0xD503201F, "normal", None)):
        assert values(spark, *word(w)) == (kind, target)


def test_packets(spark):
    lines = spark.createDataFrame([(1, "ATOM - EEN"), (2, "Address - Instruction address 0x7f00, Instruction set AArch64"), (3, "Exception return"), (4, "Timestamp - 16"), (5, "Exception - exception type 0x1, address 0x7f04"), (6, "Cancel - 3 (speculation)"), (7, "Context ID = 0x2a, VMID = 0x1, Exception level = EL1, Security = NS"), (8, "Exception")], "line_no long, line string")
    got = traces.packets(lines).orderBy("line_no").collect()
    assert [r.kind for r in got] == ["atom", "address", "exception_return", "timestamp", "exception", "cancel", "context", "exception"]
    assert (got[0].p_atoms, got[1].p_address, got[1].p_isa, got[3].p_timestamp) == ("EEN", 0x7F00, "AArch64", 16)
    assert (got[4].p_exception_type, got[4].p_address, got[5].p_count) == ("0x1", 0x7F04, 3)
    assert (got[6].p_context_id, got[6].p_vmid, got[6].p_el, got[6].p_security) == (42, 1, "EL1", "NS")
    assert (got[7].p_exception_type, got[7].p_address) == (None, None)


def test_returns(spark):
    rows = [("BR", ["X30"], None, "return", "operand_heuristic"), ("BX", ["LR"], None, "return", "operand_heuristic"), ("MOV", ["PC", "X30"], None, "return", "operand_heuristic"), ("LDM", ["SP", "{PC}"], None, "", ""), ("POP", ["{R4", "PC}"], None, "return", "operand_heuristic"), ("IRET", [], None, "exception_return", "exception_mnemonic"), ("retaa", [], True, "return", "pcode"), ("BLR_RET", [], None, "", ""), ("ret", [], None, "return", "return_mnemonic"), ("JR", ["$RA"], None, "return", "operand_heuristic"), (None, None, None, "", "")]
    df = spark.createDataFrame(rows, "m string, o array<string>, p boolean, kind string, method string")
    found = control.return_kind(F.col("m"), F.col("o"), F.col("p"))
    for r in df.select("*", found["kind"].alias("k"), found["method"].alias("w")).collect():
        assert (r.k, r.w) == (r.kind, r.method), r


def test_target_quality(spark):
    """Every branch of the rule."""
    rows = [
        ("resolved", "direct_branch", None, None, 8, None, False, "static", "exact", True),
        ("resolved", "indirect_branch", None, None, 8, None, False, "unknown", "unresolved", False),
        ("resolved", "return", None, None, 8, None, False, "software_return_stack", "speculative", False),
        ("target_resolved", "indirect_call", None, None, 8, None, False, "address_packet", "exact", True),
        ("target_unresolved", "return", None, None, 8, None, False, "unknown", "unresolved", False),
        ("conflict", "direct_call", None, None, 8, None, False, "unknown", "unresolved", False),
        ("conflict", "direct_call", "static", None, 8, None, False, "static", "conflict", False),
        ("resolved", "indirect_branch", None, None, 8, 8, False, "next_range", "confirmed", True),
        ("resolved", "return", "software_return_stack", "speculative", 8, 8, False, "software_return_stack", "confirmed", True),
        ("resolved", "return", "software_return_stack", "speculative", 8, 8, True, "software_return_stack", "speculative", False),
        ("resolved", "direct_branch", None, None, None, None, False, "static", "exact", False),
    ]
    df = spark.createDataFrame(rows, "st string, k string, src string, conf string, pc long, nxt long, spec boolean, source string, confidence string, valid boolean")
    q = control.target_quality(*[F.col(c) for c in ("st", "k", "src", "conf", "pc", "nxt", "spec")])
    for r in df.select("*", *[c.alias(f"out_{n}") for n, c in q.items()]).collect():
        assert (r.out_target_source, r.out_confidence, r.out_target_valid) == (r.source, r.confidence, r.valid), r


def test_maps(spark):
    lines = spark.createDataFrame([(1, "70000000-70010000 r-xp 00001000 08:01 12 /lib/libx.so"), (2, "nonsense")], "line_no long, line string")
    good, bad = traces.parse_maps(lines)
    r = good.first()
    assert (r.start, r.end, r.perms, r.pgoff, r.path) == (0x70000000, 0x70010000, "r-xp", 0x1000, "/lib/libx.so")
    assert values(spark, F.lit(0x70000234) - r.start + r.pgoff) == (0x1234,)
    assert bad.count() == 1


def test_module_rules(spark):
    rule = traces.module_rules(spark, {"modules": [{"elf": "/a/libx.so", "els": ["el0"], "runtime_ranges": [["0x10", "0x20"]]}]}).first()
    assert (rule.name, rule.load_bias, rule.els) == ("libx", None, ["EL0"])
    with pytest.raises(ValueError):
        traces.module_rules(spark, {"modules": [{"elf": "x", "runtime_ranges": [[2, 1]]}]})


def image():
    """A 64-bit little-endian file with one segment, one code section and one symbol listed twice."""
    code = struct.pack("<4I", 0xD503201F, 0x94000002, 0xD503201F, 0xD65F03C0)
    names = b"\0.text\0.symtab\0.strtab\0main\0"
    sym = b"".join(struct.pack("<IBBHQQ", 23, 2, 0, 1, 0x1000, size) for size in (8, 16))
    text_at = 64 + 56
    names_at, sym_at = text_at + len(code), text_at + len(code) + len(names)
    head_at = sym_at + len(sym)
    head = struct.pack("<16sHHIQQQIHHHHHH", b"\x7fELF\x02\x01\x01", 3, 183, 1, 0x1000, 64, head_at, 0, 64, 56, 1, 64, 4, 3)
    load = struct.pack("<IIQQQQQQ", 1, 5, text_at, 0x1000, 0x1000, len(code), len(code), 4)
    section = lambda name, kind, flags, addr, at, size, link, each: struct.pack("<IIQQQQIIQQ", name, kind, flags, addr, at, size, link, 0, 4, each)
    table = section(0, 0, 0, 0, 0, 0, 0, 0) + section(1, 1, 6, 0x1000, text_at, len(code), 0, 0) + section(7, 2, 0, 0, sym_at, len(sym), 3, 24) + section(15, 3, 0, 0, names_at, len(names), 0, 0)
    return head + load + code + names + sym + table


def test_elf_and_follower(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/a.elf", "wb") as f:
        f.write(image())
    rows = elf.read_elf(spark, folder).collect()
    assert sorted((r.entry, r.addr, r.size) for r in rows) == [("section", 0x1000, 16), ("segment", 0x1000, 16), ("symbol", 0x1000, 16)]
    ways = follower.waypoints(elf.read_instructions(spark, folder))
    packets = spark.createDataFrame([("s", 1, 1, "address", 0x1000, None, None), ("s", 2, 2, "atom", None, "EE", None), ("s", 3, 3, "atom", None, "E", None), ("s", 4, 4, "address", 0x9000, None, None)], "stream string, n long, row_id long, kind string, address long, atoms string, reason string")
    got = [r for r in follower.follow(packets, ways, ["stream"], ["n"]).collect() if r.event == "instruction_range"]
    assert [(r.kind, r.start, r.next_pc, r.status, r.confidence) for r in got[:2]] == [("direct_call", 0x1000, 0x100C, "resolved", "exact"), ("return", 0x100C, 0x1008, "resolved", "speculative")]
    assert (got[2].kind, got[2].status, got[2].next_pc) == ("return", "target_resolved", 0x9000)


def test_return_stack(spark):
    rows = [(1, i, i, k, a) for i, (k, a) in enumerate([("call", 10), ("call", 20), ("return", None), ("return", None), ("return", None)])]
    df = spark.createDataFrame(rows, "user_id long, n long, row_id long, kind string, address long")
    got = sorted((r.row_id, r.popped, r.depth) for r in sequential.return_stack(df, ["user_id"], ["n"]).collect())
    assert got == [(0, None, 1), (1, None, 2), (2, 20, 1), (3, 10, 0), (4, None, 0)]


def test_follower_in_modules_of_equal_addresses(spark):
    """Two modules with the same file addresses at two biases, and a hole in the second."""
    nop, ret, b8 = 0xD503201F, 0xD65F03C0, 0x14000002
    code = [("a", 0, nop), ("a", 4, b8), ("a", 12, ret), ("b", 0, nop), ("b", 4, nop), ("b", 8, ret), ("b", 20, nop), ("b", 28, ret)]
    ways = follower.waypoints(spark.createDataFrame(code, "module string, va long, word long"))
    rows = [(1, "address", 0x1000, None, "a", 0x1000), (2, "atom", None, "EE", None, None), (3, "address", 0x5000, None, "b", 0x5000), (4, "atom", None, "E", None, None), (5, "address", 0x5014, None, "b", 0x5000), (6, "atom", None, "E", None, None)]
    packets = spark.createDataFrame([("s", *r) for r in rows], "stream string, row_id long, kind string, address long, atoms string, module string, load_bias long")
    got = [(r.row_id, r.event, r.start, r.stop, r.next_pc, r.status or r.reason) for r in follower.follow(packets, ways, ["stream"], ["row_id"]).collect()]
    assert got == [
        (2, "instruction_range", 0x1000, 0x1004, 0x100C, "resolved"),
        (3, "instruction_range", 0x100C, 0x100C, 0x5000, "target_resolved"),
        (5, "instruction_range", 0x5000, 0x5008, 0x5014, "target_resolved"),
        (6, "flow_gap", None, None, None, "elf-bytes-unavailable"),
    ]
