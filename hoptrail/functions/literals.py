"""Numbers and addresses as columns: parsing, formatting, alignment, bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks that stand for what isn't known.
UNKNOWN, ELF, OPAQUE, UNKNOWN_TARGET, GAP, PAD, OOV = "<unknown>", "<elf>", "<opaque>", "<UNKNOWN_TARGET>", "<GAP>", "<PAD>", "<OOV>"


def parse_int(text: Column) -> Column:
    """Decimal or 0x-prefixed integer; null for anything else."""
    trimmed = F.trim(text)
    sign = F.when(trimmed.startswith("-"), -1).otherwise(1)
    body = F.regexp_replace(trimmed, r"^[+-]", "")
    hexed = F.conv(F.substr(body, F.lit(3)), 16, 10).try_cast("bigint")
    # Most texts are short and without sign: one pattern and one conversion.
    plain = F.when(trimmed.rlike("^[0-9]{1,18}$"), trimmed.try_cast("bigint")).when(trimmed.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substr(trimmed, F.lit(3)), 16, 10).try_cast("bigint"))
    return plain.when(body.rlike("^0[xX][0-9a-fA-F]{1,16}$"), hexed * sign).when(body.rlike("^[0-9]+$"), body.try_cast("bigint") * sign)


def optional_int(text: Column) -> Column:
    """As ``parse_int``; blank, auto and none are null too."""
    return F.when(F.lower(F.trim(text)).isin("", "auto", "none"), None).otherwise(parse_int(text))


def hex_text(value: Column, width: int = 0) -> Column:
    """0x and lower-case digits, padded to ``width`` digits."""
    digits = F.lower(F.hex(value))
    return F.concat(F.lit("0x"), F.lpad(digits, width, "0") if width else digits)


def signed_hex(value: Column) -> Column:
    return F.when(value < 0, F.concat(F.lit("-"), hex_text(-value))).otherwise(hex_text(value))


def align_down(value: Column, to: int) -> Column:
    if to <= 0:
        raise ValueError("alignment must be positive")
    return value - F.pmod(value, F.lit(to))


def align_up(value: Column, to: int) -> Column:
    return align_down(value + (to - 1), to)


def permission_text(flags: Column) -> Column:
    """Segment flag bits 4, 2, 1 as r, w, x or dashes."""
    bit = lambda mask, letter: F.when(flags.bitwiseAND(mask) != 0, letter).otherwise("-")
    return F.concat(bit(4, "r"), bit(2, "w"), bit(1, "x"))


def permission_compatible(map_perms: Column, segment_perms: Column) -> Column:
    return ~(map_perms.contains("x") & ~segment_perms.contains("x"))


def sign_extend(value: Column, bits: int) -> Column:
    """The low ``bits`` bits as a two's-complement number."""
    shift = 64 - bits
    return F.shiftright(F.shiftleft(value.cast("bigint"), shift), shift)


def clean_value(text: Column) -> Column:
    """Blank and unknown marks become null."""
    trimmed = F.trim(text)
    return F.when((trimmed != "") & (trimmed != UNKNOWN), trimmed)


def file_offset(va: Column, vaddr: Column, offset: Column, size: Column) -> Column:
    """Where an address lies in its file; null outside the segment's bytes."""
    return F.when((va >= vaddr) & (va < vaddr + size), offset + va - vaddr)
