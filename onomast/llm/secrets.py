"""Secret scans: fixed patterns, and a battery of randomness tests.

The battery looks at runs of token characters.  Each run gets an inferred
encoding (hex, capitals, base32, base36, letters, base62 or base64), and
against "characters drawn uniformly from that alphabet" three p-values:
chi-squared over equal slices of the alphabet, Wald-Wolfowitz runs about the
median, and lag-one serial correlation.  A run that all three leave standing is
random under that encoding.  Whether it could yet be prose is put as an
e-value, the least likelihood ratio of the uniform alphabet to prose, in
capitals or not; within each class of length, runs with and without a digit
apart, the e-values of the whole corpus go through the e-Benjamini-Hochberg
rule, which holds the false discovery rate under any dependence.  Everything is
DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Fixed values of the contract.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ is one run; 16 characters or more of it
HEX = r"[0-9a-f]{32,}"
# The first part of ASSIGN, without which it can't match.
ASSIGN_HINT = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""

CHARS = "A-Za-z0-9+/_-"
#: Runs of so many characters and more are tested.
LEAST = 20
RUN = rf"(?<![{CHARS}])[{CHARS}]{{{LEAST},}}"
#: Shares of character classes in prose and in identifiers, each spread evenly over its characters.
PROSE = {"lower": 0.78, "upper": 0.10, "digit": 0.08, "other": 0.04}
SIZES = {"lower": 26, "upper": 26, "digit": 10, "other": 4}
#: The same for prose in capitals; runs without lower case would else count as random for their case alone.
CAPITALS = {"lower": 0.10, "upper": 0.78, "digit": 0.08, "other": 0.04}
#: Shares of the letters in English, for prose whose letters aren't spread evenly.
LETTERS = {
    "E": 0.127, "T": 0.091, "A": 0.082, "O": 0.075, "I": 0.070, "N": 0.067, "S": 0.063, "H": 0.061, "R": 0.060, "D": 0.043, "L": 0.040, "C": 0.028, "U": 0.028,
    "M": 0.024, "W": 0.024, "F": 0.022, "G": 0.020, "Y": 0.020, "P": 0.019, "B": 0.015, "V": 0.010, "K": 0.008, "J": 0.0015, "X": 0.0015, "Q": 0.001, "Z": 0.001,
}
#: alphabet in order, for each encoding; the first that has all characters is inferred.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
SLICES = 4
LENGTH_CLASSES = (32, 64)
#: Numbers that are summed in one go, and characters in a stretch where spans may overlap.
BLOCK, STRETCH = 64, 4096
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, use) -> Column:
    """use(value), worked out once: what a lambda names from outside is worked out again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(lengths: Column) -> Column:
    """For each number of an array the sum of those before it, a block at a time: folding one by one would copy the whole for each."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / BLOCK).cast("int"))

    def add(s: Column, b: Column) -> Column:
        return _let(
            F.slice(lengths, b * BLOCK + 1, BLOCK),
            lambda part: F.struct(
                (s["at"] + total(part)).alias("at"),
                F.concat(s["all"], F.transform(part, lambda _, i: s["at"] + total(F.slice(part, F.lit(1), i)))).alias("all"),
            ),
        )

    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), add, lambda s: s["all"])


def _spans(text: Column, found: Column, regex: str, kind: int, keep=None) -> Column:
    """Spans of all matches: found are the matched texts in order, and what the split leaves stands between them."""
    gaps = F.transform(F.slice(F.split(text, regex, -1), 1, F.greatest(F.size(found), F.lit(0))), lambda g: F.length(g))
    pairs = F.zip_with(gaps, F.transform(found, lambda m: F.length(m)), lambda g, n: F.struct(g.alias("g"), n.alias("n")))
    span = lambda x, at: F.struct((at + x["g"]).cast("int").alias("start"), F.lit(kind).alias("kind"), (at + x["g"] + x["n"]).cast("int").alias("end"))
    sums = lambda ps: _let(F.transform(ps, lambda x: x["g"] + x["n"]), _sums)
    return _let(pairs, lambda ps: F.zip_with(ps, sums(ps), span)).cast(SPAN)


def _scan(text: Column, regex: str, kind: int, hint: str | None = None) -> Column:
    empty = F.array().cast(SPAN)
    spans = _spans(text, F.regexp_extract_all(text, F.lit(regex), F.lit(0)), regex, kind)
    if kind == 0:
        value = F.regexp_extract_all(text, F.lit(regex), F.lit(2))
        both = F.arrays_zip(spans.alias("s"), value.alias("v"))
        spans = F.transform(F.filter(both, lambda x: F.length(x["v"]) >= 8), lambda x: x["s"])
    return F.when(text.rlike(hint or regex), spans).otherwise(empty)


def _normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) by the complementary error function's approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def randomness(runs: DataFrame) -> DataFrame:
    """Adds to rows with a column ``run`` (string): encoding, p_chi2, p_runs, p_serial and log_e."""
    enc = F.lit(None).cast("string")
    for name, alphabet in reversed(ENCODINGS.items()):
        safe = alphabet.replace("-", "\\-")
        enc = F.when(F.col("run").rlike(f"^[{safe}]+$"), name).otherwise(enc)
    runs = runs.withColumn("encoding", enc).withColumn("encoding", F.coalesce("encoding", F.lit("base64")))
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ENCODINGS.items() for x in kv]), F.col("encoding"))
    runs = runs.withColumn("_k", F.length(alphabet).cast("double"))
    runs = runs.withColumn("_c", F.filter(F.split("run", ""), lambda c: c != ""))
    runs = runs.withColumn("_x", F.transform("_c", lambda c: F.position(c, alphabet) - 1))
    n = F.size("_x").cast("double")
    cell = lambda v: F.least(F.floor(v * SLICES / F.col("_k")), F.lit(SLICES - 1))
    in_cell = lambda s: F.filter("_x", lambda v: cell(v) == s)
    chi = F.lit(0.0)
    for s in range(SLICES):
        # Slices of an alphabet may differ by a character: each has its own share.
        share = (F.ceil(F.lit(s + 1) * F.col("_k") / SLICES) - F.ceil(F.lit(s) * F.col("_k") / SLICES)) / F.col("_k")
        seen = F.size(in_cell(s)).cast("double")
        chi = chi + (seen - n * share) * (seen - n * share) / (n * share)
    # Wilson and Hilferty: the cube root of chi-squared over its degrees is nearly normal.
    dof = SLICES - 1
    z = (F.pow(chi / dof, F.lit(1 / 3)) - (1 - 2 / (9 * dof))) / (2 / (9 * dof)) ** 0.5
    upper = F.when(z > 0, _normal_two_sided(z) / 2).otherwise(1 - _normal_two_sided(z) / 2)
    runs = runs.withColumn("p_chi2", upper)
    high = F.transform("_x", lambda v: (v * 2 >= F.col("_k")).cast("int"))
    runs = runs.withColumn("_h", high)
    n1 = F.aggregate("_h", F.lit(0), lambda a, v: a + v).cast("double")
    n0 = n - n1
    pairs = F.zip_with(F.slice("_h", 1, F.size("_h") - 1), F.slice("_h", 2, F.size("_h") - 1), lambda a, b: (a != b).cast("int"))
    count = F.aggregate(pairs, F.lit(1), lambda a, v: a + v).cast("double")
    mean = 2 * n1 * n0 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = runs.withColumn("p_runs", F.when((n1 > 0) & (n0 > 0) & (var > 0), _normal_two_sided((count - mean) / F.sqrt(var))).otherwise(F.lit(0.0)))
    # By sums alone: a mean inside a lambda would be worked out for each character.
    total = F.aggregate("_x", F.lit(0.0), lambda a, v: a + v.cast("double"))
    squares = F.aggregate("_x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    less = F.greatest(F.size("_x") - 1, F.lit(0))
    products = F.aggregate(F.zip_with(F.slice("_x", F.lit(1), less), F.slice("_x", F.lit(2), less), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, v: a + v)
    runs = runs.withColumns({"_s1": total, "_s2": squares, "_s3": products})
    centre = F.col("_s1") / n
    ends = F.get("_x", F.lit(0)) + F.element_at("_x", -1)
    square = F.col("_s2") - F.col("_s1") * centre
    lag = F.col("_s3") - centre * (2 * F.col("_s1") - ends) + (n - 1) * centre * centre
    rho = lag / square
    runs = runs.withColumn("p_serial", F.when(square > 1e-9, _normal_two_sided((rho + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0)))
    # The least over three kinds of prose is an e-value against each.
    uniform = n * -F.log(F.col("_k"))
    spread = common = capitals = uniform
    for name, regex in (("lower", "[^a-z]"), ("upper", "[^A-Z]"), ("digit", "[^0-9]"), ("other", "[^+/_-]")):
        seen = F.length(F.regexp_replace("run", regex, ""))
        spread = spread - seen * math.log(PROSE[name] / SIZES[name])
        common = common - seen * math.log(PROSE[name] / (SIZES[name] if name in ("digit", "other") else 1))
        capitals = capitals - seen * math.log(CAPITALS[name] / (SIZES[name] if name in ("digit", "other") else 1))
    cost = F.create_map(*[F.lit(x) for c, share in LETTERS.items() for x in (c, -math.log(share / sum(LETTERS.values())))])
    letters = F.aggregate("_c", F.lit(0.0), lambda a, c: a + F.coalesce(F.try_element_at(cost, F.upper(c)), F.lit(0.0)))
    runs = runs.withColumns({"_spread": spread, "_common": common + letters, "_capitals": capitals + letters})
    return runs.withColumn("log_e", F.least("_spread", "_common", "_capitals")).drop("_k", "_c", "_x", "_h", "_s1", "_s2", "_s3", "_spread", "_common", "_capitals")


def _length_class(run: Column) -> Column:
    """By length; runs without a digit, most of them words, have classes of their own and don't dilute the others."""
    c = F.lit(0)
    for k, least in enumerate(LENGTH_CLASSES, 1):
        c = F.when(F.length(run) >= least, k).otherwise(c)
    return F.when(run.rlike("[0-9]"), c).otherwise(c + len(LENGTH_CLASSES) + 1)


def e_bh_bounds(tested: DataFrame, fdr: float) -> dict[int, float]:
    """The least log_e that is a discovery, for each length class.

    tested: (length_class, log_e).  Counted in steps of a quarter, so what is
    gathered is a table of bounded size however many runs there are; a step
    counts by its lower end, which only makes the rule stricter.
    """
    step = F.greatest(F.lit(-40), F.least(F.lit(400), F.floor(F.col("log_e") * 4))).cast("int")
    rows = tested.groupBy("length_class", step.alias("step")).agg(F.count("*").alias("n")).collect()
    bounds = {}

    for c in {r["length_class"] for r in rows}:
        own = sorted(((r["step"], r["n"]) for r in rows if r["length_class"] == c), reverse=True)
        m, above = sum(n for _, n in own), 0
        for step, n in own:
            above += n
            if step / 4 >= math.log(m / (fdr * above)):
                bounds[c] = step / 4
    return bounds


def scan_secrets(docs: DataFrame, keep: list[str] | None = None, alpha: float = 0.001, fdr: float = 0.01) -> DataFrame:
    """Rows of docs (columns ``keep``, or doc_id) with ``spans``: all secrets as
    struct(start, kind, end), kind an index of KINDS, sorted; positions in code
    points, end exclusive.

    The patterns of the first three kinds are matched leftmost and without
    overlap, each kind by itself; spans of the battery never overlap theirs.
    Null counts as empty and has no spans; repeated rows are scanned alike, and
    count each in the false-discovery rule; an empty table gives an empty one.
    """
    keep = [c for c in (keep or ["doc_id"]) if c != "spans"]
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(_scan(text, ASSIGN, 0, ASSIGN_HINT), _scan(text, ACCESS, 1), _scan(text, HEX, 2))
    found = docs.select(*keep, base.alias("_base"), F.when(text.rlike(RUN), _spans(text, F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), RUN, 3)).otherwise(F.array().cast(SPAN)).alias("_runs"), F.when(text.rlike(RUN), F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("_texts"))
    found = materialize(found.withColumn("_row", F.monotonically_increasing_id()), "secrets")
    runs = found.where(F.size("_runs") > 0).select("_row", F.explode(F.arrays_zip(F.col("_runs").alias("s"), F.col("_texts").alias("t"))).alias("r"))
    runs = runs.select("_row", F.col("r")["s"].alias("span"), F.col("r")["t"].alias("run"))
    # Runs and base spans meet in stretches of the text, so each is compared with its neighbours alone.
    stretch = lambda s: F.explode(F.sequence(F.floor(s["start"] / STRETCH), F.floor((s["end"] - 1) / STRETCH)))
    both = found.where((F.size("_runs") > 0) & (F.size("_base") > 0))
    mine = both.select("_row", F.explode("_runs").alias("span")).select("_row", "span", stretch(F.col("span")).alias("at"))
    theirs = both.select("_row", F.explode("_base").alias("b")).select("_row", "b", stretch(F.col("b")).alias("at"))
    taken = mine.join(theirs, ["_row", "at"]).where((F.col("b.start") < F.col("span.end")) & (F.col("span.start") < F.col("b.end"))).select("_row", "span").distinct()
    runs = runs.join(taken, ["_row", "span"], "left_anti")
    runs = materialize(randomness(runs).withColumn("length_class", _length_class(F.col("run"))), "runs")
    bounds = e_bh_bounds(runs, fdr)
    bound = F.lit(None).cast("double")
    for c, least in bounds.items():
        bound = F.when(F.col("length_class") == c, F.lit(least)).otherwise(bound)
    # Three tests on one run: each at a third of alpha.
    random = (F.least("p_chi2", "p_runs", "p_serial") > alpha / 3) & (F.col("log_e") >= bound)
    more = runs.where(random).groupBy("_row").agg(F.collect_list("span").alias("_more"))
    out = found.join(more, "_row", "left")
    return out.select(*keep, F.array_sort(F.concat("_base", F.coalesce("_more", F.array().cast(SPAN)))).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each span, overlapping ones as one, replaced by a mask."""
    n = F.length(text)
    folded = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(
            F.struct(
                x["end"].alias("at"),
                F.when(x["start"] < s["at"], s["out"])
                .otherwise(F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), F.lit(mask)))
                .alias("out"),
            )
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, n)),
    )
    return F.when(F.size(spans) > 0, folded).otherwise(text)
