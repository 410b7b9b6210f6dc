"""Votes with state on a stream equal those of whole batches."""

import random

from pyspark.sql import functions as F

from onomast.operators import batch
from onomast.streaming.batches import SUMS, closed_patterns

VOTER = "batch_id long, event_time timestamp, vote string, votes boolean, weight double, n_cands int, roman array<string>, facts array<struct<ppm:double>>"


def test_stream_equals_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for b in range(30):
        start = 1_700_000_000 + b * 3600
        for i in range(rng.randint(1, 9)):
            vote = rng.choice(["surname_first", "given_first", None])
            rows.append((b, start + i * 5, vote, vote is not None, rng.choice([0.1, 1.0, 2.5]), rng.choice([1, 2]), ["a"] * rng.choice([2, 3]), [(float(rng.choice([0, 200, 5000])),), (float(rng.choice([0, 200, 5000])),)]))
    # A name far ahead moves the watermark past all batches but its own.
    rows.append((99, 1_700_000_000 + 10**6, "given_first", True, 1.0, 1, ["a", "b"], [(0.0,), (0.0,)]))
    df = spark.createDataFrame(rows, VOTER.replace("timestamp", "long")).withColumn("event_time", F.timestamp_seconds("event_time"))
    # Batches come in pieces, over several files and micro-batches.
    folder = f"file://{tmp_path}/in"
    for k in range(4):
        part = df.where((F.col("batch_id") < 99) & (F.unix_timestamp("event_time") % 20 >= k * 5) & (F.unix_timestamp("event_time") % 20 < (k + 1) * 5))
        part.coalesce(1).write.mode("append").parquet(folder)
    df.where("batch_id = 99").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    # As files have no order, the delay covers the whole of the papers' hours.
    query = closed_patterns(stream, delay="2 days", minimum=3).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    cells = [*SUMS, "dominant_format", "decision_confidence", "confidence", "vote_margin", "threshold_met", "regime"]
    shown = lambda r: tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cells)
    got = {r["batch_id"]: shown(r) for r in spark.table("closed").collect()}
    want = {str(r["batch_id"]): shown(r) for r in batch.pattern(batch.votes(df), minimum=3).collect()}
    del want["99"]  # still open
    assert got == want


def test_an_open_batch_grows(spark):
    """Sums of pieces are the sums of the whole, and a timeout sends and removes them."""
    import pandas as pd

    from onomast.streaming.batches import _grown

    class State:
        exists, hasTimedOut, held, at = False, False, None, None

        @property
        def get(self):
            return self.held

        def update(self, x):
            self.exists, self.held = True, x

        def remove(self):
            self.exists, self.held = False, None

        def getCurrentWatermarkMs(self):
            return 5000

        def setTimeoutTimestamp(self, t):
            self.at = t

    state = State()
    piece = lambda n, at: pd.DataFrame([[*([1] * 4), 0.5, 0.25, 0, 1, 2, 1]] * n, columns=SUMS).assign(event_time=pd.Timestamp(at, unit="s"))
    assert list(_grown(("b",), iter([piece(2, 10), piece(1, 3)]), state)) == [] and state.at == 10_001
    assert list(_grown(("b",), iter([piece(1, 1)]), state)) == [] and state.at == 10_001
    state.hasTimedOut = True
    (out,) = _grown(("b",), iter([]), state)
    assert out.iloc[0].tolist() == ["b", 4, 4, 4, 4, 2.0, 1.0, 0, 4, 8, 4] and not state.exists
