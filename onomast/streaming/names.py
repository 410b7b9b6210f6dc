"""Names on Structured Streaming.

A name by itself needs no state.  Its tokens are joined with facts by an
aggregate, so each micro-batch runs the plan of a batch job in foreachBatch;
papers must be complete within a micro-batch to vote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import preprocess, script_class
from ..lexicon.data import Lexicon
from ..operators import gates
from ..plans.names import analyze_batches, normalize_names


def gate_stream(names: DataFrame) -> DataFrame:
    """Stateless projection: cleaned text, script, and the reason of rejection that needs no lexicon, on a streaming or a static frame."""
    return names.withColumns(
        {"cleaned": preprocess(F.col("name")), "script": script_class(F.col("name")), "gate": gates.failure(F.col("name"))}
    )


def start(names: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, lex: Lexicon | None = None, batches: bool = False, **trigger) -> StreamingQuery:
    """Normalises a stream (batch_id, pos, name), with votes of its papers if ``batches``, and hands each micro-batch to sink."""

    def each(df: DataFrame, epoch: int) -> None:
        out = analyze_batches(df, lex)[0] if batches else normalize_names(df, lex)
        sink(out, epoch)

    return names.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
