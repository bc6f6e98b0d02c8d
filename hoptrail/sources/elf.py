"""Segments, sections and symbols of ELF files as tables (public ELF specification)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "module string, entry string, name string, addr long, size long, offset long, flags long, kind int"
#: Fixed values of the specification.
LOAD, SYMBOLS, DYNAMIC_SYMBOLS, ALLOCATED = 1, 2, 11, 2
CODE_KINDS = (0, 2, 10)


def _text(blob: bytes, at: int) -> str:
    return blob[at : blob.find(b"\0", at)].decode("utf-8", "replace")


def entries(blob: bytes) -> list[tuple]:
    """(entry, name, addr, size, offset, flags, kind) of a 64-bit file's segments, sections and symbols."""
    if blob[:4] != b"\x7fELF" or blob[4] != 2:
        raise ValueError("not a 64-bit ELF file")
    e = "<" if blob[5] == 1 else ">"
    phoff, shoff = struct.unpack_from(f"{e}QQ", blob, 32)
    phsize, phnum, shsize, shnum, names = struct.unpack_from(f"{e}5H", blob, 54)
    out = []
    for i in range(phnum):
        kind, flags, offset, va, _, size, mem, _ = struct.unpack_from(f"{e}IIQQQQQQ", blob, phoff + i * phsize)
        if kind == LOAD:
            out.append(("segment", "", va, size, offset, flags, kind))
    if not out:
        raise ValueError("no loadable segment")
    headers = [struct.unpack_from(f"{e}IIQQQQIIQQ", blob, shoff + i * shsize) for i in range(shnum)]
    strings = headers[names][4] if names < len(headers) else 0
    for name, kind, flags, addr, offset, size, link, _, _, each in headers:
        if flags & ALLOCATED and size:
            out.append(("section", _text(blob, strings + name), addr, size, offset, flags, kind))
        if kind in (SYMBOLS, DYNAMIC_SYMBOLS) and each:
            for at in range(offset, offset + size, each):
                label, info, _, _, value, length = struct.unpack_from(f"{e}IBBHQQ", blob, at)
                if value and info & 15 in CODE_KINDS and (text := _text(blob, headers[link][4] + label)):
                    out.append(("symbol", text, value, length, 0, info, info & 15))
    return out


def read_elf(spark: SparkSession, path: str) -> DataFrame:
    """One row for each segment, section and symbol; symbols are unique by place and name, the larger one kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, blob in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(file, *x) for x in entries(blob)], columns=["module", "entry", "name", "addr", "size", "offset", "flags", "kind"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
    w = Window.partitionBy("module", "entry", "addr", "name").orderBy(F.desc("size"), "kind")
    return rows.withColumn("_n", F.row_number().over(w)).filter("entry != 'symbol' OR _n = 1").drop("_n")


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """module, va and word of every 4-byte instruction in executable sections."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, blob in zip(batch["path"], batch["content"], strict=True):
                order = "<" if blob[5] == 1 else ">"
                for entry, _, addr, size, offset, flags, _ in entries(blob):
                    if entry == "section" and flags & 4:
                        n = min(size, len(blob) - offset) // 4
                        yield pd.DataFrame({"module": file, "va": range(addr, addr + 4 * n, 4), "word": struct.unpack_from(f"{order}{n}I", blob, offset)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "module string, va long, word long")
