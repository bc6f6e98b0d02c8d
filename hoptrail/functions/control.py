"""Control flow as columns: instruction words, labels, quality and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hoptrail.functions.literals import GAP, UNKNOWN_TARGET, sign_extend

#: Mask, value and kind of 64-bit instruction words, tested in this order (public architecture manual).
WORDS = [
    (0xFF000010, 0x54000000, "conditional_branch"),
    (0x7E000000, 0x34000000, "conditional_branch"),
    (0x7E000000, 0x36000000, "conditional_branch"),
    (0xFC000000, 0x94000000, "direct_call"),
    (0xFC000000, 0x14000000, "direct_branch"),
    (0xFFFFFC1F, 0xD61F0000, "indirect_branch"),
    (0xFFFFFC1F, 0xD63F0000, "indirect_call"),
    (0xFFFFFC1F, 0xD65F0000, "return"),
    (0xFFFFFFFF, 0xD65F0BFF, "return"),
    (0xFFFFFFFF, 0xD65F0FFF, "return"),
    (0xFFFFFFFF, 0xD69F03E0, "exception_return"),
    (0xFFFFFFFF, 0xD6BF03E0, "exception_return"),
    (0xFFFFFFFF, 0xD69F0BFF, "exception_return"),
    (0xFFFFFFFF, 0xD69F0FFF, "exception_return"),
    (0xFFE0001F, 0xD4000001, "exception_instruction"),
    (0xFFE0001F, 0xD4000002, "exception_instruction"),
    (0xFFE0001F, 0xD4000003, "exception_instruction"),
    (0xFFE0001F, 0xD4200000, "exception_instruction"),
    (0xFFE0001F, 0xD4400000, "exception_instruction"),
    (0xFFFFF81F, 0xD61F081F, "indirect_branch"),
    (0xFFFFF800, 0xD71F0800, "indirect_branch"),
    (0xFFFFF81F, 0xD63F081F, "indirect_call"),
    (0xFFFFF800, 0xD73F0800, "indirect_call"),
]
#: Rank of confidences.
RANKS = {"low": 1, "medium": 2, "high": 3}
#: Statuses of ranges whose target is known, and of those that still are evidence.
NORMAL = ("resolved", "target_resolved")
EVIDENCE = ("resolved", "target_resolved", "conflict", "target_unknown", "target_unresolved")


def instruction_kind(word: Column) -> Column:
    """Kind of a 32-bit instruction word held in a bigint."""
    out = None
    for mask, value, kind in WORDS:
        hit = word.bitwiseAND(F.lit(mask)) == F.lit(value)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("normal")


def branch_target(address: Column, word: Column) -> Column:
    """Target of a direct branch; null for the other kinds."""
    field = lambda low, bits: sign_extend(F.shiftright(word, low), bits) * 4
    return (
        F.when((word.bitwiseAND(F.lit(0xFF000010)) == F.lit(0x54000000)) | (word.bitwiseAND(F.lit(0x7E000000)) == F.lit(0x34000000)), address + field(5, 19))
        .when(word.bitwiseAND(F.lit(0x7E000000)) == F.lit(0x36000000), address + field(5, 14))
        .when(word.bitwiseAND(F.lit(0x7C000000)) == F.lit(0x14000000), address + field(0, 26))
    )


def edge_control(kind: Column, taken: Column) -> Column:
    return (
        F.when(kind == "conditional_branch", F.when(taken, "cond:T").when(~taken, "cond:N").otherwise("cond:?"))
        .when(kind == "return", "ret")
        .when(kind == "indirect_branch", "ibranch")
        .when(kind == "indirect_call", "icall")
        .when(kind == "direct_call", "call")
        .when(kind == "direct_branch", "branch")
        .otherwise(kind)
    )


def taken(explicit: Column, kind: Column, atom: Column) -> Column:
    """An explicit flag, else what the atom says; branches without a condition are taken unless the atom is N."""
    by_atom = F.when(atom == "E", True).when(atom == "N", False)
    always = kind.isin("direct_branch", "direct_call", "indirect_branch", "indirect_call", "return")
    return F.coalesce(explicit, by_atom, F.when(always, True))


def control_label(kind: Column, flag: Column, atom: Column, confidence: Column) -> Column:
    """kind:taken|not_taken|unknown or the atom, with the confidence when it isn't sure."""
    state = F.when(flag, "taken").when(~flag, "not_taken").otherwise(F.coalesce(F.lower(atom), F.lit("unknown")))
    return F.concat(kind, F.lit(":"), state, F.when(confidence.isin("speculative", "unresolved", "conflict"), F.concat(F.lit("|"), confidence)).otherwise(""))


def node_id(module: Column, function: Column, offset: Column) -> Column:
    return F.when(function.isNull() | offset.isNull(), None).when(function.isin(UNKNOWN_TARGET, GAP), F.concat(function, F.lit("@"), offset)).otherwise(F.concat_ws("::", module, F.concat(function, F.lit("@"), offset)))


def count_bucket(n: Column, clip: int = 255) -> Column:
    """1 for missing or negative counts, else the clipped count plus 2."""
    return F.when(n.isNull() | (n < 0), 1).otherwise(F.least(n, F.lit(clip)) + 2)


def confidence_rank(confidence: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANKS.items():
        out = F.when(confidence == name, rank).otherwise(out)
    return out


def target_quality(status: Column, kind: Column, source: Column, confidence: Column, next_pc: Column, next_start: Column, next_speculative: Column) -> dict[str, Column]:
    """Source, confidence and validity of an edge's target; ``next_start`` is where the range after it starts."""
    confirmed = F.coalesce((next_pc == next_start) & ~F.coalesce(next_speculative, F.lit(False)), F.lit(False))
    made = F.coalesce(
        source,
        F.when(confirmed, "next_range")
        .when(status == "target_resolved", "address_packet")
        .when(status.isin("target_unresolved", "target_unknown", "conflict"), "unknown")
        .when(kind == "return", "software_return_stack")
        .when(kind.isin("indirect_branch", "indirect_call"), "unknown")
        .otherwise("static"),
    )
    by_source = (
        F.when(status.isin("target_unresolved", "target_unknown") | (made == "unknown"), "unresolved")
        .when(status == "conflict", "conflict")
        .when(made == "software_return_stack", "speculative")
        .otherwise("exact")
    )
    rated = F.when(confirmed, "confirmed").otherwise(F.coalesce(confidence, by_source))
    return {"target_source": made, "confidence": rated, "target_valid": next_pc.isNotNull() & status.isin(*NORMAL) & rated.isin("exact", "confirmed")}


def edge_class(flow: Column, conditional: Column, computed: Column, follows_call: Column) -> Column:
    """Type of a static control-flow edge."""
    return (
        F.when(flow == "fallthrough", F.when(follows_call, "call_fallthrough").when(conditional, "conditional_not_taken").otherwise("fallthrough"))
        .when(flow == "call", F.when(computed, "indirect_call").otherwise("direct_call"))
        .when(flow == "jump", F.when(conditional, "conditional_taken").when(computed, "indirect_jump").otherwise("direct_jump"))
        .when(flow == "terminal", "terminal")
        .otherwise("unknown")
    )


#: Mnemonics of returns and of returns from exceptions, in any architecture.
RETURNS = ["RET", "RETN", "RETF"]
EXCEPTION_RETURNS = ["IRET", "IRETD", "IRETQ", "ERET", "RFI", "RFID"]


def return_kind(mnemonic: Column, operands: Column, returns_by_semantics: Column) -> dict[str, Column]:
    """kind and method of an instruction's return, empty for others; ``operands`` is an array of texts."""
    name, args = F.upper(mnemonic), F.transform(operands, lambda x: F.upper(x))
    first, second = F.coalesce(F.get(args, F.lit(0)), F.lit("")), F.coalesce(F.get(args, F.lit(1)), F.lit(""))
    link = lambda x: x.contains("LR") | x.contains("X30")
    by_operand = (
        F.when(name.isin("BX", "BR"), link(first))
        .when(name == "JR", first.contains("$RA") | (F.trim(first) == "RA"))
        .when(name == "POP", F.exists(args, lambda x: x.contains("PC")))
        .when(name == "MOV", first.contains("PC") & link(second))
    )
    method = (
        F.when(name.isin(*EXCEPTION_RETURNS), "exception_mnemonic")
        .when(F.coalesce(returns_by_semantics, F.lit(False)), "pcode")
        .when(name.isin(*RETURNS), "return_mnemonic")
        .when(by_operand, "operand_heuristic")
        .otherwise("")
    )
    return {"kind": F.when(method == "exception_mnemonic", "exception_return").when(method != "", "return").otherwise(""), "method": method}


def score(mode: str, dst_prob: Column, ctrl_prob: Column, transition_valid: Column, control_valid: Column, target_valid: Column, weight: float = 0.2) -> dict[str, Column]:
    """The probability of a step and on what it rests; null where a step can't be scored."""
    full = dst_prob * F.pow(ctrl_prob, F.lit(weight)) if mode == "combined" else dst_prob
    no = ~transition_valid | ~control_valid
    return {
        "score_prob": F.when(no, None).when(~target_valid, ctrl_prob).otherwise(full),
        "score_basis": F.when(~transition_valid, "unscored_discontinuous_transition").when(~control_valid, "unscored_speculative_path").when(~target_valid, "ctrl_only_invalid_target").otherwise(mode),
    }
