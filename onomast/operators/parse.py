"""Parse candidates of a name, their scores, and the best one.

Candidates are rows (one name gives two to four); what a token is worth was
looked up once for each distinct token, so a score is arithmetic on a row.
Rows of a name stay in its partition: exploding and gathering move nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import among, lookup, norm
from ..lexicon import fixed
from ..lexicon.data import DEFAULT_LOGP, Lexicon
from .facts import spaced_tables
from .render import RESULT, render

# Weights of the linear score, and bounds in it.
WEIGHTS = (0.465, 0.395, -0.888, 1.348, 1.102, 0.425, -0.042, -0.573, 0.06)
UNATTESTED = 5000.0
SIMILAR = 5.0
GUARD_PPM, GUARD_RATIO, GUARD_BONUS = 500.0, 50.0, 4.0
THREE_PPM, THREE_RATIO, TRAILING_PPM = 3000.0, 3.0, 100.0
DEADBAND, CAP = 1.5, 1.5
POOR = -25.0
CANDIDATE = "struct<k:int,s:array<int>,g:array<int>,kind:string>"


def weights(given: list[float] | None = None) -> tuple[float, ...]:
    """Nine weights; a vector of eight gets the last default, one of another length is ignored."""
    return (*given, *WEIGHTS[len(given) :]) if given and len(given) in (8, 9) else WEIGHTS


def ambiguous(s: Column, g: Column) -> Column:
    """Either of two tokens may be surname and given name, and their shares as surnames are near each other."""
    most, least = F.greatest(s["ppm"], g["ppm"]), F.least(s["ppm"], g["ppm"])
    near = F.when(least == 0, most < UNATTESTED).otherwise(most < SIMILAR * least)
    return s["is_surname"] & g["is_surname"] & s["is_given_written"] & g["is_given_written"] & near


def guarded_ratio(s: Column, g: Column) -> Column:
    """The given name would be a rare surname, though no compound one, and the surname is fifty times as common."""
    return g["comp"].isNull() & s["is_surname"] & g["is_surname"] & (g["ppm"] > 0) & (g["ppm"] < GUARD_PPM) & (s["ppm"] > GUARD_RATIO * g["ppm"])


def pair_compounds(facts: Column, lex: Lexicon) -> Column:
    """Where, from 0, two tokens are a compound surname in two words: from the left, without overlaps."""
    target, _, _ = spaced_tables(lex)
    at = lambda i: F.get(facts, i)
    n = F.size(facts)
    hit = lambda i: lookup(target, F.concat_ws(" ", at(i)["low"], at(i + 1)["low"])).isNotNull() & at(i)["comp"].isNull() & at(i + 1)["comp"].isNull()
    every = F.when(n >= 2, F.filter(F.sequence(F.lit(0), n - 2), hit)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    free = F.aggregate(every, none, lambda done, i: F.when(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(-2)) == i - 1, done).otherwise(F.concat(done, F.array(i))))
    return F.when(F.size(every) == 0, none).otherwise(free)


def candidates(facts: Column, pairs: Column, back: bool = False) -> Column:
    """Array of (k, s, g, kind): places of surname and given tokens, from 0; ``back``: in the order of the tokens read backwards.

    In this order: two words of a compound surname at the head, or after the
    first token; one token (a surname, or a compound one written as one) at
    the head, at the tail; a hyphenated compound at the head, at the tail.
    """
    n = F.size(facts)
    place = (lambda i: n - 1 - i) if back else (lambda i: i)
    seq = lambda a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda i: place(i).cast("int"))).otherwise(F.array().cast("array<int>"))
    zero, one, two = F.lit(0), F.lit(1), F.lit(2)
    t = lambda i: F.get(facts, place(i))
    paired = lambda i: F.array_contains(pairs, F.least(place(i), place(i + 1)))
    make = lambda k, fits, s, g, kind: F.when(fits, F.struct(F.lit(k).alias("k"), s.alias("s"), g.alias("g"), kind.alias("kind")).cast(CANDIDATE))
    form = lambda i: F.coalesce(t(i)["comp"]["form"], F.lit(""))
    fused = lambda i: form(i).isin("compact", "camelCase")
    plain = lambda i: (F.length(t(i)["token"]) > 1) & ~t(i)["token"].contains("-") & t(i)["is_surname"]
    kind = lambda i: F.when(fused(i), "fused").otherwise("single")
    made = F.array(
        make(1, (n >= 3) & paired(zero), seq(zero, two), seq(two, n), F.lit("spaced")),
        make(2, (n >= 3) & paired(one), seq(one, F.lit(3)), seq(zero, one), F.lit("spaced")),
        make(3, (n >= 2) & (fused(zero) | plain(zero)), seq(zero, one), seq(one, n), kind(zero)),
        make(4, (n >= 2) & (fused(n - 1) | plain(n - 1)), seq(n - 1, n), seq(zero, n - 1), kind(n - 1)),
        make(5, (n >= 2) & (form(zero) == "hyphenated"), seq(zero, one), seq(one, n), F.lit("hyphen")),
        make(6, (n >= 2) & (form(n - 1) == "hyphenated"), seq(n - 1, n), seq(zero, n - 1), F.lit("hyphen")),
    )
    return F.filter(made, lambda c: c.isNotNull())


def fallbacks(facts: Column, back: bool = False) -> Column:
    """The last, then the first token as surname, if its pinyin is one at all; used where there is no other candidate."""
    n = F.size(facts)
    one = lambda k, at, g: F.when((n >= 2) & (F.length(F.get(facts, at)["token"]) > 1) & F.get(facts, at)["in_normal"], F.struct(F.lit(k).alias("k"), F.array(at.cast("int")).alias("s"), g.alias("g"), F.lit("single").alias("kind")).cast(CANDIDATE))
    rest = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    last, first = one(7, n - 1, rest(F.lit(0), n - 1)), one(8, F.lit(0), rest(F.lit(1), n))
    return F.filter(F.array(first, last) if back else F.array(last, first), lambda c: c.isNotNull())


def bound(rows: DataFrame) -> DataFrame:
    """Candidate rows (facts, c) with the facts that scores look at: s0, s1 of the surname, g0, g1 of the given name, t0, t1, t2 as written, and n, at, ng."""
    f = F.col("facts")
    c = F.col("c")
    rows = rows.withColumns({"n": F.size(f), "at": F.get(c["s"], F.lit(0)), "ng": F.size(c["g"]), "kind": c["kind"]})
    get = lambda i: F.get(f, i)
    return rows.withColumns(
        {"s0": get(F.col("at")), "s1": get(F.get(c["s"], F.lit(1))), "g0": get(F.get(c["g"], F.lit(0))), "g1": get(F.get(c["g"], F.lit(1))), "t0": get(F.lit(0)), "t1": get(F.lit(1)), "t2": get(F.lit(2))}
    )


def base_score(rows: DataFrame, lex: Lexicon, w: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Bound rows with slogp, the log share of the surname, and base, the score without the parts that hang on order."""
    _, logps, ranks = spaced_tables(lex)
    s0, s1, g0, g1, ng = (F.col(c) for c in ("s0", "s1", "g0", "g1", "ng"))
    single, spaced = F.col("kind") == "single", F.col("kind") == "spaced"
    number = lambda table, k: lookup(table, k).cast("double")
    key, written = F.concat_ws(" ", s0["norm"], s1["norm"]), F.concat_ws(" ", s0["low"], s1["low"])
    slogp = F.when(single, s0["slogp"]).when(spaced, F.coalesce(number(logps, key), number(logps, written), F.lit(DEFAULT_LOGP))).otherwise(s0["comp"]["logp"])
    rank = F.when(single, s0["rank"]).when(spaced, F.coalesce(number(ranks, key), F.lit(0.0))).otherwise(s0["comp"]["rank"])
    glogp = F.aggregate("c.g", F.lit(0.0), lambda a, i: a + F.get(F.col("facts"), i)["glogp"])
    pair = ((ng == 2) & g0["is_given"] & g1["is_given"]) | ((ng == 1) & g0["pair_known"])
    attested = ((s0["ppm"] > 0) & (g0["ppm"] > 0)) | (F.greatest(s0["ppm"], g0["ppm"]) < UNATTESTED)
    rows = rows.withColumns({"slogp": slogp, "_rank": rank, "_g": glogp, "_pair": F.when(pair, w[3]).otherwise(0.0), "_apart": single & (ng == 1) & attested})
    ratio = F.when(F.col("_apart"), F.log(F.greatest(s0["ppm"], F.lit(0.001)) / F.greatest(g0["ppm"], F.lit(0.001)))).otherwise(0.0)
    apart = F.when(F.col("_apart"), s0["rank"] - g0["rank"]).otherwise(0.0)
    base = F.col("slogp") * w[0] + F.col("_g") * w[1] + F.col("_rank") * w[2] + F.col("_pair") + ratio * w[6] + apart * w[7]
    return rows.withColumn("base", base + place_score() * w[8]).drop("_rank", "_g", "_pair", "_apart")


def order_bonus(rows: DataFrame, w: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Bound rows (and hint) with the bonus for keeping the order as written: b_plain without and b_guard with the guarded ratio; b_back for the order backwards."""
    s, g, n, at, hint = (F.col(c) for c in ("s0", "g0", "n", "at", "hint"))
    single = F.col("kind") == "single"
    rows = rows.withColumns(
        {
            "_two": (n == 2) & single & (F.col("ng") == 1),
            "_free": ambiguous(s, g),
            "_guard": guarded_ratio(s, g),
            "_same": F.col("t0.token") == F.col("t1.token"),
            "_three": (n == 3) & single & (F.col("ng") == 2) & (at == 2) & (F.get(F.col("c.g"), F.lit(0)) == 0) & F.col("t0.is_surname") & F.col("t2.is_surname") & F.col("t0.is_given"),
        }
    )

    def two(first, last) -> tuple[Column, Column]:
        given_first = F.col("_two") & ~hint & ((at == last) | F.col("_same"))
        plain = F.when(F.col("_two") & hint & (at == first) & F.col("_free"), 1.0).when(given_first & (F.col("_free") | s["wg_initial"]), 1.0).otherwise(0.0)
        return plain, F.when(given_first & ~F.col("_free") & ~s["wg_initial"] & F.col("_guard"), GUARD_BONUS).otherwise(plain)

    a, b, z = F.col("t0"), F.col("t1"), F.col("t2")
    mild = F.col("_three") & z["is_given"] & (a["ppm"] > 0) & (a["ppm"] < THREE_PPM) & (z["ppm"] > a["ppm"]) & (z["ppm"] <= THREE_RATIO * a["ppm"])
    overlap = F.array_contains(among(fixed.KOREAN_OVERLAP), z["norm"])
    korean = F.col("_three") & b["is_given"] & (a["ppm"] > z["ppm"]) & (z["ppm"] > 0) & (z["ppm"] <= TRAILING_PPM) & overlap & b["mark"]["korean_given"]
    more = F.when(mild, 0.5).when(korean, 1.0).otherwise(0.0)
    plain, guarded = two(0, n - 1)
    _, back = two(n - 1, 0)  # three tokens read backwards keep no order
    rows = rows.withColumns({"b_plain": F.greatest(plain, more) * w[4], "b_guard": F.greatest(guarded, more) * w[4], "b_back": back * w[4]})
    return rows.drop("_two", "_free", "_guard", "_same", "_three")


def place_score() -> Column:
    """Of three tokens with one surname: how much better the given syllables' places fit it than the surname at the other end."""
    a, b, z = F.col("t0"), F.col("t1"), F.col("t2")
    delta = b["initial_logp"] + z["final_logp"] - a["initial_logp"] - b["final_logp"]
    size = F.least(F.abs(delta) - DEADBAND, F.lit(CAP))
    sign = F.when(F.col("at") == 0, 1.0).when(F.col("at") == 2, -1.0).otherwise(0.0)
    three = (F.col("n") == 3) & (F.col("kind") == "single") & (F.col("ng") == 2)
    return F.when(three & (size > 0), sign * F.signum(delta) * size).otherwise(0.0)


def written_form() -> Column:
    """Of bound rows: where the surname stands, surname_first or given_first; one inside, or a hyphenated compound, counts as at the head."""
    last = F.get(F.col("facts"), F.element_at("c.s", -1))["token"]
    return F.when((F.col("kind") == "hyphen") | (F.col("s0.token") == F.col("t0.token")), "surname_first").when(last == F.get(F.col("facts"), F.col("n") - 1)["token"], "given_first").otherwise("surname_first")


def as_list(facts: Column, places: Column) -> Column:
    """Tokens as a list in brackets and quotes: the last key of ties."""
    quote = lambda t: F.when(t.contains("'"), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("'"), t, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(F.transform(places, lambda i: quote(F.get(facts, i)["token"])), ", "), F.lit("]"))


def scored(named: DataFrame, lex: Lexicon, w: list[float] | None = None, keep=None) -> DataFrame:
    """named (name, facts, hint, ...) with pairs, cands, choice and r.

    cands: array of (k, s, g, kind, form, score, plain, r) in the order of
    ``candidates``; score with and plain without the guarded bonus, r how it is
    rendered.  choice: (s, g, kind, form, k) of the better of the best parses
    of both orders of the tokens; r: how that is rendered.
    """
    w = weights(w)
    keep = keep or (lambda df, _name: df)
    facts = F.col("facts")
    row = named.withColumn("pairs", pair_compounds(facts, lex)).withColumns({"fore": candidates(facts, F.col("pairs")), "fall": fallbacks(facts)})
    # Without a compound in two words, backwards gives mirror images that score no higher.
    rear = F.when(F.size("pairs") > 0, candidates(facts, F.col("pairs"), back=True)).otherwise(F.array().cast(f"array<{CANDIDATE}>"))
    row = row.withColumn("rear", rear)
    mark = lambda cs, way: F.transform(cs, lambda c: F.struct(F.lit(way).alias("way"), c.alias("c")))
    every = F.concat(mark(F.col("fore"), 0), F.when(F.size("fore") == 0, mark(F.col("fall"), 0)).otherwise(mark(F.array().cast(f"array<{CANDIDATE}>"), 0)), mark(F.col("rear"), 1))
    row = row.withColumn("every", every).drop("fore", "fall", "rear")
    row = keep(row, "candidates")
    small = bound(row.select("name", "facts", "pairs", "hint", F.explode("every").alias("x")).select("name", "facts", "pairs", "hint", "x.way", "x.c"))
    small = small.withColumn("form", written_form()).withColumn("c", F.col("c").withField("form", F.col("form")))
    small = order_bonus(base_score(small, lex, w), w)
    small = small.withColumns({"score": F.col("base") + F.col("b_guard"), "plain": F.col("base") + F.col("b_plain")})
    small = render(small, "c")
    small = small.withColumn("r", F.struct(*RESULT)).drop(*RESULT)
    c = F.col("c")
    long = F.exists("facts", lambda t: F.length(t["token"]) > 3) & ~F.exists("facts", lambda t: (F.length(t["token"]) > 3) & t["is_surname"])
    initial = F.exists(c["g"], lambda i: F.length(F.get(F.col("facts"), i)["token"]) == 1) & long
    small = small.withColumn("western", initial & F.when(c["k"] >= 7, F.col("score") < POOR).otherwise(F.col("slogp") < POOR))
    align = F.when((F.col("n") == 2) & (c["kind"] == "single") & (F.col("at") == 1), 1).otherwise(0)
    here = F.when(F.col("way") == 0, F.col("score")).otherwise(F.col("base") + F.col("b_back"))
    # A fallback counts by its place in the order, not by its score, and then in both orders of the tokens.
    entry = F.struct(here.alias("v"), align.alias("align"), F.concat_ws("|", as_list(facts, c["s"]), as_list(facts, c["g"])).alias("tie"), F.col("score").alias("score"), c["s"].alias("s"), c["g"].alias("g"), c["kind"].alias("kind"), "form", c["k"].alias("k"), "r")
    fits = ~F.col("western")
    fallback = c["k"] >= 7
    got = small.groupBy("name").agg(
        F.array_sort(F.collect_list(F.when((F.col("way") == 0) & ~fallback, F.struct(c["k"].alias("k"), c["s"].alias("s"), c["g"].alias("g"), c["kind"].alias("kind"), "form", "score", "plain", "r"))), lambda a, b: a["k"] - b["k"]).alias("cands"),
        F.max(F.when(fits & (F.col("way") == 0) & ~fallback, entry)).alias("ahead"),
        F.max(F.when(fits & (F.col("way") == 1), entry)).alias("behind"),
        F.max(F.when(fits & fallback, F.struct(F.col("score").alias("v"), (-c["k"]).alias("order"), entry.alias("e")))).alias("fb"),
    )
    ahead = F.coalesce("ahead", F.col("fb.e"))
    choice = F.when(ahead.isNull() | (F.col("behind.score") > ahead["score"]), F.col("behind")).otherwise(ahead)
    got = got.select("name", "cands", F.when(choice.isNotNull(), F.struct(choice["s"].alias("s"), choice["g"].alias("g"), choice["kind"].alias("kind"), choice["form"].alias("form"), choice["k"].alias("k"))).alias("choice"), choice["r"].alias("r"))
    return row.drop("every").join(got, "name", "left")


def best(cands: Column, by: str = "score", form: Column | None = None) -> Column:
    """The candidate of the greatest score, of one format if given; of equals the first in order."""
    fit = cands if form is None else F.filter(cands, lambda c: c["form"] == form)
    ranked = F.transform(fit, lambda c: F.struct(c[by].alias("v"), (-c["k"]).alias("k"), c.alias("c")))
    return F.array_max(ranked)["c"]
