"""Votes of papers whose names come in pieces, with state per batch on Structured Streaming.

A name's own reading needs no state and is worked out in each micro-batch; what
a batch has said so far, its counts, weights and strengths, are sums.  They are
the state: a few numbers for each batch, whatever its length.  A batch is closed
when the watermark has passed its last name, and its pattern is sent once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import batch

SUMS = ["size", "total_count", "surname_first_count", "given_first_count", "sf_weight", "gf_weight", "sf_alone", "gf_alone", "sf_strength", "gf_strength"]
KINDS = {"sf_weight": "double", "gf_weight": "double"}
STATE = ", ".join(f"{c} {KINDS.get(c, 'long')}" for c in SUMS)
OUT = f"batch_id string, {STATE}"
#: With the time of the newest name.
HELD = f"{STATE}, last_ms long"


def vote_rows(voters: DataFrame) -> DataFrame:
    """Of voters (``batch.entries`` with vote; and event_time): what each name adds to its batch's sums."""
    sf, gf = F.coalesce(F.col("vote") == "surname_first", F.lit(False)), F.coalesce(F.col("vote") == "given_first", F.lit(False))
    one = lambda c: c.cast("long")
    two = F.coalesce(F.col("votes") & (F.size("roman") == 2), F.lit(False))
    strength = lambda i: F.when(two, batch.position_strength(F.get("facts", F.lit(i))["ppm"])).otherwise(0).cast("long")
    cells = [F.lit(1).cast("long"), one(F.coalesce(F.col("votes"), F.lit(False))), one(sf), one(gf), F.when(sf, F.col("weight")).otherwise(0.0), F.when(gf, F.col("weight")).otherwise(0.0), one(sf & (F.col("n_cands") == 1)), one(gf & (F.col("n_cands") == 1)), strength(0), strength(1)]
    return voters.select(F.col("batch_id").cast("string").alias("batch_id"), "event_time", *[c.alias(n) for c, n in zip(cells, SUMS)])


def _grown(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        *sums, _ = state.get
        state.remove()
        yield pd.DataFrame([(key[0], *sums)], columns=["batch_id", *SUMS])
        return
    *sums, last = state.get if state.exists else (*[0.0 if KINDS.get(c) else 0 for c in SUMS], 0)
    for part in parts:
        for i, c in enumerate(SUMS):
            sums[i] += part[c].sum()
        last = max(last, int(part["event_time"].max().timestamp() * 1000))
    state.update((*[float(x) if KINDS.get(c) else int(x) for c, x in zip(SUMS, sums)], last))
    # A late piece of an open batch doesn't close it earlier.
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)


def closed_votes(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The sums of each batch (batch_id as text, and ``SUMS``), sent once, when no name of it can come any more.

    rows: a stream of ``vote_rows``.  Names later than ``delay`` behind the
    newest event are dropped by the watermark; a batch that was closed and gets
    a name after all begins anew.  Rows of null batch_id are one batch; names
    that don't vote count in size alone.
    """
    watched = rows.withWatermark("event_time", delay)
    return watched.groupBy("batch_id").applyInPandasWithState(_grown, OUT, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def closed_patterns(voters: DataFrame, delay: str = "10 minutes", threshold: float = batch.THRESHOLD, minimum: int = batch.MIN_BATCH) -> DataFrame:
    """The pattern of each batch of a stream of voters, as ``batch.pattern`` gives it for whole batches.

    Guarded given-first readings aren't promoted: that needs the median of a
    batch's first names, which no sum holds.
    """
    return batch.pattern(closed_votes(vote_rows(voters), delay), threshold, minimum)
