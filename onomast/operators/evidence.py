"""Evidence on each name's chosen order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup
from ..lexicon.data import Lexicon
from .facts import spaced_tables


def span_key(start: Column, width: Column, lex: Lexicon) -> Column:
    """What one or two tokens are looked up by as a surname: a compound surname's pinyin, or their own keys."""
    target, _, _ = spaced_tables(lex)
    a, b = F.get("facts", start), F.get("facts", start + 1)
    pair = F.when(F.array_contains("pairs", start), lookup(target, F.concat_ws(" ", a["low"], b["low"])))
    keys = F.array_join(F.transform(F.slice("facts", start + 1, F.greatest(width, F.lit(0))), lambda t: t["ev_key"]), " ")
    return F.when(width == 1, F.coalesce(a["comp"]["target"], a["ev_key"])).otherwise(F.coalesce(F.when(width == 2, pair), keys))


def span_ppm(start: Column, width: Column, lex: Lexicon) -> Column:
    """Share of the surname that one or two tokens spell, as they are written."""
    a = F.get("facts", start)
    table = {k: repr(v) for k, v in lex.group_ppm().items()}
    group = F.coalesce(lookup(table, span_key(start, width, lex)).cast("double"), F.lit(0.0))
    return F.when((width == 1) & a["comp"].isNull(), a["ev_ppm"]).otherwise(group)


def span(s: Column, form: Column, n: Column) -> Column:
    """(position, start, width) of the surname's tokens: first, last or internal; null where it stands at the end that its format doesn't name."""
    start, width = F.array_min(s), F.size(s)
    position = F.when((form == "surname_first") & (start == 0), "first").when((form == "given_first") & (start + width == n), "last").when((start > 0) & (start + width < n), "internal")
    return F.when(position.isNotNull(), F.struct(position.alias("position"), start.alias("start"), width.alias("width")))


#: Columns that ``told`` adds, and those that rows have from their batch's pattern.
TOLD = (
    "raw_tokens", "raw_token_count", "script_representation", "batch_participant", "batch_applied", "batch_changed_format", "individual_format", "selected_format", "selected_surname_position",
    "selected_surname_token_count", "first_ppm", "last_ppm", "selected_surname_frequency", "alternate_surname_frequency", "selected_surname_frequency_ratio", "has_all_caps_token",
)
OF_BATCH = {"dominant_format": "batch_dominant_format", "threshold_met": "batch_threshold_met", "total_count": "batch_total_count", "decision_confidence": "batch_confidence", "vote_margin": "batch_vote_margin"}


def told(read: DataFrame, lex: Lexicon) -> DataFrame:
    """Rows of ``batch.read_under`` with the selected format, where the surname stands and how common it and its alternative at the other end are."""
    n = F.size("facts")
    fits = F.coalesce(n > 0, F.lit(False)) & F.col("gate").isNull()
    rows = read.withColumn("_s", F.when(F.col("success") & fits, span(F.col("chosen.s"), F.col("chosen.form"), n)))
    start, width = F.col("_s.start"), F.col("_s.width")
    end = F.col("_s.position").isin("first", "last")
    other = F.when(F.col("_s.position") == "first", n - width).otherwise(F.lit(0))
    rows = rows.withColumns({"_own": F.when(end, span_ppm(start, width, lex)), "_alt": F.when(end, span_ppm(other, width, lex))})
    form = F.when(F.col("success"), F.col("order")).otherwise("mixed")
    done = F.col("threshold_met") & F.col("votes") & F.col("success")
    cells = (
        F.when(fits, F.col("roman")).otherwise(F.array().cast("array<string>")),
        F.when(fits, n).otherwise(0),
        F.when(F.col("gate").isNotNull(), "rejected_input").otherwise(F.col("script")),
        F.col("votes"),
        F.coalesce(done, F.lit(False)),
        F.col("changed"),
        F.coalesce("alone.form", form),
        form,
        F.coalesce("_s.position", F.lit("unknown")),
        F.coalesce(width, F.lit(0)),
        F.when(fits, F.get("facts", F.lit(0))["ev_ppm"]),
        F.when(fits, F.get("facts", n - 1)["ev_ppm"]),
        F.col("_own"),
        F.col("_alt"),
        F.when(F.col("_alt") > 0, F.col("_own") / F.col("_alt")),
        F.coalesce("caps", F.lit(False)),
    )
    return rows.withColumns(dict(zip(TOLD, cells, strict=True))).drop("_s", "_own", "_alt")


def evidence(rows: DataFrame) -> DataFrame:
    """The evidence of rows that have ``TOLD`` and their batch's pattern."""
    return rows.select("batch_id", "pos", "name", *TOLD, *[F.col(c).alias(n) for c, n in OF_BATCH.items()])
