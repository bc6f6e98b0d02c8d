"""Operators whose state can't be a window: fed row by row, one stream after the other.

Streams are spread by key and sorted within partitions, and rows flow through a
Python generator in Arrow batches: a task holds a machine's state, not a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class Machine:
    """State of one stream: ``feed`` takes a row and gives rows, ``end`` gives the last ones."""

    def feed(self, row: dict) -> list[dict]:
        raise NotImplementedError

    def end(self) -> list[dict]:
        return []


def run_machines(df: DataFrame, by: list[str], order: list[str], make: Callable[[], Machine], schema: str) -> DataFrame:
    """What a fresh machine for each stream gives for the stream's rows in order, with the stream's key."""
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        key, machine, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[c] for c in by)
                if machine is None or own != key:
                    if machine is not None:
                        out += [dict(zip(by, key, strict=True)) | x for x in machine.end()]
                    key, machine = own, make()
                out += [dict(zip(by, own, strict=True)) | x for x in machine.feed(row)]
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if machine is not None:
            out += [dict(zip(by, key, strict=True)) | x for x in machine.end()]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, fields)


class CallStack(Machine):
    """Calls push, returns pop and say whether the popped address is where the next row starts."""

    def __init__(self, depth: int = 4096):
        self.depth, self.stack = depth, []

    def feed(self, row: dict) -> list[dict]:
        found, overflow = None, False
        if row["kind"] == "call":
            self.stack.append(row["address"])
            if len(self.stack) > self.depth:
                overflow = True
                del self.stack[0]
        elif row["kind"] == "return":
            found = self.stack.pop() if self.stack else None
        return [{"row_id": row["row_id"], "popped": found, "depth": len(self.stack), "overflow": overflow}]


def return_stack(df: DataFrame, by: list[str], order: list[str], depth: int = 4096) -> DataFrame:
    """popped address and stack depth after each row; rows have row_id, kind (call, return or other) and address."""
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in by)
    return run_machines(df, by, order, lambda: CallStack(depth), f"{keys}, row_id long, popped long, depth int, overflow boolean")
