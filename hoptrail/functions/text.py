"""Text fields of traces, maps and instructions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hoptrail.functions.literals import UNKNOWN, clean_value, parse_int

SYMBOL = r"^(.+?)(~?\+)(0[xX][0-9a-fA-F]+|[0-9]+)$"
#: Prefixes of generated names that carry an address.
GENERATED = ["FUN", "LAB", "DAT", "PTR", "UNK", "SUB", "switchD", "caseD", "off"]
FLUSH, TRACE_ON, DISCARD = "Conditional flush", "TraceOn", "Discard"


def symbol_text(name: Column, offset: Column, contained: Column) -> Column:
    from hoptrail.functions.literals import hex_text

    return F.when(name.isNotNull(), F.concat(name, F.when(contained, "+").otherwise("~+"), hex_text(F.coalesce(offset, F.lit(0)))))


def split_symbol(symbol: Column) -> dict[str, Column]:
    """name, offset and relation of ``name+0x10`` or ``name~+0x10``; other texts are names at 0."""
    matched, empty = symbol.rlike(SYMBOL), symbol.isNull() | (symbol == "")
    return {
        "name": F.when(empty, UNKNOWN).when(matched, F.regexp_extract(symbol, SYMBOL, 1)).otherwise(symbol),
        "offset": F.when(empty, None).when(matched, parse_int(F.regexp_extract(symbol, SYMBOL, 3))).otherwise(F.lit(0).cast("bigint")),
        "relation": F.when(~empty & matched, F.regexp_extract(symbol, SYMBOL, 2)),
    }


def symbol_of(plain: Column, name: Column, offset: Column) -> Column:
    """A symbol given as a text, or as name and offset: then always ``name+0x…``."""
    from hoptrail.functions.literals import hex_text

    return F.coalesce(F.nullif(plain, F.lit("")), F.when(name != "", F.concat(name, F.lit("+"), hex_text(F.coalesce(offset, F.lit(0))))))


def waypoint_text(asm: Column, mnemonic: Column, operands: Column) -> Column:
    """An instruction's text, else its mnemonic and operands, else the mark of what isn't known."""
    joined = F.trim(F.concat_ws(" ", mnemonic, operands))
    return F.coalesce(F.nullif(asm, F.lit("")), F.nullif(joined, F.lit("")), F.lit(UNKNOWN))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def module_name(name: Column, module: Column, elf: Column, mapped: Column) -> Column:
    """The first known of a name, a module, an ELF file's stem, a mapped file that isn't bracketed."""
    return F.coalesce(clean_value(name), clean_value(module), stem(clean_value(elf)), F.when(~mapped.startswith("["), base_name(clean_value(mapped))))


def normalise_instruction(text: Column) -> Column:
    """Generated names lose their address; runs of white space become one blank."""
    named = F.regexp_replace(text, rf"\b({'|'.join(GENERATED)})_[0-9a-fA-F]+\b", "$1_<ADDR>")
    return F.trim(F.regexp_replace(named, r"\s+", " "))


def key_values(text: Column, keys: tuple[str, ...]) -> dict[str, Column]:
    """Values of ``key=value`` fields parted by commas; keys in lower case with underscores."""
    pairs = F.transform(F.filter(F.split(text, ","), lambda p: p.contains("=")), lambda p: F.struct(F.replace(F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(1)))), F.lit(" "), F.lit("_")).alias("k"), F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(2)))).alias("v")))

    def last(key: str) -> Column:
        return F.get(F.transform(F.filter(pairs, lambda p: p["k"] == key), lambda p: p["v"]), F.lit(0))

    return {k: last(k) for k in keys}


#: The forms of packets and context fields in decoded traces.
ADDRESS = r"Address - Instruction address\s+(0x[0-9a-fA-F]+),\s*Instruction set\s+(\S+)"
CONTEXT_ID = r"Context ID\s*=\s*(0x[0-9a-fA-F]+)"
VMID = r"VMID\s*=\s*(0x[0-9a-fA-F]+)"
EXCEPTION_LEVEL = r"Exception level\s*=\s*(EL\d)"
SECURITY = r"Security\s*=\s*([^,\s]+)"
TIMESTAMP = r"Timestamp\s*-\s*(\d+)"
ATOM = r"^ATOM\s*-\s*([EN]+)\s*$"
COMMIT = r"^Commit\s*-\s*(\d+)\s*$"
CANCEL = r"^Cancel\s*-\s*(\d+)(?:.*)?$"
EXCEPTION = r"^Exception(?:\s*-\s*(.*))?$"
EXCEPTION_TYPE = r"(?i)exception type\s+([^,]+)"
EXCEPTION_ADDRESS = r"(?i)\baddress\s+(0x[0-9a-fA-F]+)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def exception_fields(text: Column) -> dict[str, Column]:
    """Type and address of an exception packet; both null when it has no detail."""
    detail = F.when(text.rlike(EXCEPTION), F.regexp_extract(text, EXCEPTION, 1)).otherwise(text)
    return {"type": F.trim(_found(detail, EXCEPTION_TYPE)), "address": parse_int(_found(detail, EXCEPTION_ADDRESS))}


def packet_kind(line: Column) -> Column:
    """What kind of packet a line of a decoded trace is; cheap prefix tests, first match wins."""
    return (
        F.when(line.startswith("Decode trace stream"), "trace_stream")
        .when(line.startswith("TraceInfo"), "trace_info")
        .when(line.startswith("Context"), "context")
        .when(line.startswith("VMID"), "context")
        .when(line.startswith("Exception level"), "context")
        .when(line.startswith("Security"), "context")
        .when(line.rlike("^(64|32)-bit instruction"), "context")
        .when(line.startswith("Timestamp"), "timestamp")
        .when(line.startswith(TRACE_ON), "trace_on")
        .when(line.startswith(DISCARD), "discard")
        .when(line.startswith(FLUSH), "flush")
        .when(line.startswith("Exception return"), "exception_return")
        .when(line.startswith("Exception"), "exception")
        .when(line.rlike("^(Cancel|Mispredict)"), "cancel")
        .when(line.startswith("Address"), "address")
        .when(line.startswith("ATOM"), "atom")
        .when(line.startswith("Commit"), "commit")
        .otherwise("raw")
    )


def packet_fields(line: Column) -> dict[str, Column]:
    """Fields that lines of the kinds above may carry."""
    return {
        "trace_id": parse_int(_found(line, r"(?i)\bID\s+(0x[0-9a-f]+|[0-9]+)")),
        "address": F.coalesce(parse_int(_found(line, ADDRESS)), exception_fields(line)["address"]),
        "isa": F.coalesce(_found(line, ADDRESS, 2), _found(line, r"\b(AArch64|AArch32|A64|A32|T32)\b")),
        "context_id": parse_int(_found(line, CONTEXT_ID)),
        "vmid": parse_int(_found(line, VMID)),
        "el": _found(line, EXCEPTION_LEVEL),
        "security": _found(line, SECURITY),
        "timestamp": parse_int(_found(line, TIMESTAMP)),
        "atoms": _found(line, ATOM),
        "count": parse_int(F.coalesce(_found(line, COMMIT), _found(line, CANCEL))),
        "exception_type": exception_fields(line)["type"],
    }
