"""The queue of atoms on a live stream: commits take atoms, discards empty the queue.

The batch form is ``packets.dispatch`` in commit mode. Here a stream's queue is kept
between micro-batches in list state (``transformWithStateInPandas``, RocksDB), one
entry an atom, so that state grows with what waits and not with what was read. Lines of
a stream must arrive in order; those of a micro-batch are sorted before use.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hoptrail.operators import packets

OUTPUT = "stream string, line_no long, action string, idx long, atom string, count long, missing long, detail string"


class AtomQueue(StatefulProcessor):
    """Emits atoms as commits take them, commits with what they missed, and discards with how many atoms went."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", "atom string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = deque(a for (a,) in self.queue.get())
        data = pd.concat(list(rows)).sort_values("line_no")
        out = []
        for line, kind, atoms, count, why in zip(data["line_no"], data["kind"], data["atoms"], data["count"], data["why"], strict=True):
            if kind == "atom":
                held.extend(atoms)
            elif kind == "commit":
                taken = min(int(count), len(held))
                out += [(key[0], line, "atom", i, held.popleft(), None, None, None) for i in range(taken)]
                out.append((key[0], line, "commit", 0, None, int(count), int(count) - taken, None))
            elif held:
                out.append((key[0], line, "atoms_discarded", 0, None, len(held), None, why))
                held.clear()
        if held:
            self.queue.put([(a,) for a in held])
        else:
            self.queue.clear()
        yield pd.DataFrame(out, columns=["stream", "line_no", "action", "idx", "atom", "count", "missing", "detail"])

    def close(self) -> None:
        pass


def live_queue(lines: DataFrame) -> DataFrame:
    """Steps of a streaming frame of lines (stream, line_no, line) that is outside of information blocks and complete in its contexts.

    Kinds come from the line alone; every line that empties the queue by itself does so here.
    The session needs RocksDB as its state store provider.
    """
    parsed = packets.parse(lines)
    k = F.col("kind")
    why = F.lit(None).cast("string")
    for kind, reason in packets.DISCARDS.items():
        if kind not in ("context", "end"):
            why = F.when(k == kind, reason).otherwise(why)
    rows = parsed.select(F.col("stream").cast("string").alias("stream"), "line_no", "kind", "atoms", F.col("c_count").alias("count"), why.alias("why")).filter(k.isin("atom", "commit") | F.col("why").isNotNull())
    return rows.groupBy("stream").transformWithStateInPandas(AtomQueue(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
