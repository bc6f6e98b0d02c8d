"""Segments of event streams, with the quality of every edge's target.

A range waits until it is known where control went; it then becomes an edge of
the open segment. Breaks close the segment. Under the evidence policy, doubtful
steps become edges with invalid targets and gap tokens; under the strict policy
they break. ``segment_layers`` finds tokens and segments, and rates each edge's
target by ``control.target_quality`` before tokens are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from hoptrail.operators.segment_layers import layered, rating


def segment_events(events: DataFrame, by: str = "file", order: str = "event_index", policy: str = "evidence", target_modules: tuple[str, ...] = (), min_edges: int = 1, block: int | None = None) -> DataFrame:
    """Segments of event streams, with their key; a stream is cut into blocks of ``block`` events."""
    if policy not in ("evidence", "strict") or min_edges < 1:
        raise ValueError("policy is evidence or strict, min_edges at least 1")
    return layered(events, by, order, policy == "strict", target_modules, min_edges, block).withColumnRenamed("s", by)


def rated(token: Column, seen: Column) -> Column:
    """An edge's token with the quality of its target; its own target_valid says whether it may be valid at all."""
    found = rating({c: token[c] for c in ("status", "kind", "target_source", "confidence", "target_valid", "control_valid")}, seen["forced"], seen["next_pc"], seen["next_start"], seen["next_speculative"])
    for name, value in found.items():
        token = token.withField(name, value)
    return token
