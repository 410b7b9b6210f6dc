"""Scalar text operators on name strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import fixed

# Character classes and patterns.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134F}"
SEPARATORS = "·‧.‑-―﹘﹣－⁃₋•∙⋅˙ˑːˉˇ˘˚˛˜˝"
HYPHENS = "-‐‒–—―﹘﹣－⁃₋'"
LEXEME = r"(?s)[（(][^)（）]*[)）]|[A-Z]\.\s|[A-Z]\.-[A-Z]\.|[A-Z]\.-[A-Z]|[_|=]|."
CYRILLIC, LATIN = "проаехстикмн", "npoaexctukmh"
WADE = r"(shih|ts'|tz'|ch'|szu|k'|t'|p'|hs|ts|tz|chi|ch|.)"
WADE_MAP = {"shih": "shi", "ts'": "c", "tz'": "c", "ch'": "q", "szu": "si", "k'": "k", "t'": "t", "p'": "p", "hs": "x", "ts": "z", "tz": "z", "chi": "ji", "ch": "zh"}
SUFFIXES = (("ieh", "ie"), ("ueh", "ue"), ("ung", "ong"), ("ien", "ian"), ("ih", "i"))
ROUTE_TOKEN = r"\p{L}+(?:[-']\p{L}+)*"


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def among(words) -> Column:
    """Words as one array literal: folded once by the optimizer, and one call to make."""
    return F.split(F.lit("\n".join(words)), "\n")


def lookup(table: dict[str, str], key: Column) -> Column:
    whole = "\n".join(f"{k}\t{v}" for k, v in table.items())
    return F.element_at(F.str_to_map(F.lit(whole), F.lit("\n"), F.lit("\t")), key)


def clean_punct(name: Column) -> Column:
    """One pass: parentheticals and ``_|=`` become a space, ``X. `` keeps X, ``X.-Y.`` and ``X.-Y`` become X-Y."""

    def one(x: Column) -> Column:
        n = F.length(x)
        return (
            F.when(x.rlike(r"(?s)^[（(].*[)）]$"), " ")
            .when(x.rlike("^[_|=]$"), " ")
            .when(x.rlike(r"^[A-Z]\.\s$"), F.concat(F.substring(x, 1, 1), F.lit(" "), F.substring(x, 3, 1)))
            .when((n >= 4) & x.rlike(r"^[A-Z]\.-"), F.concat(F.substring(x, 1, 1), F.lit("-"), F.substring(x, 4, 1)))
            .otherwise(x)
        )

    return F.when(name.rlike("[（(._|=]"), F.array_join(F.transform(F.regexp_extract_all(name, F.lit(LEXEME), F.lit(0)), one), "")).otherwise(name)


def fullwidth(name: Column) -> Column:
    source = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　​﻿"
    return F.translate(name, source, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "   ")


def ocr_fix(name: Column) -> Column:
    """Full-width forms, then Cyrillic letters that look like Latin ones."""
    return F.translate(fullwidth(name), CYRILLIC, LATIN)


def collapse_ws(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"(?U)\s+", " "))


def smart_split(token: Column) -> Column:
    """Spaces at aA and AAa, unless there is a space or hyphen."""
    split = F.regexp_replace(F.regexp_replace(token, r"(\p{Ll})(?=\p{Lu})", "$1 "), r"(\p{Lu})(?=\p{Lu}\p{Ll})", "$1 ")
    return F.when(token.rlike("[ -]"), token).otherwise(split)


def case_pattern(x: Column) -> Column:
    return F.when(x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}"), "upper").when(x.rlike(r"\p{Ll}") & ~x.rlike(r"\p{Lu}"), "lower").when(
        x.rlike(r"^[^\p{L}]*(\p{Lu}\p{Ll}*[^\p{L}]*)+$"), "title"
    ).otherwise("mixed")


def camel_pair(name: Column) -> Column:
    """Whether a cleaned name is a single token that ``structural_split`` cuts at its capitals."""
    return ~name.rlike(r"\s") & (smart_split(name) != name) & smart_split(name).rlike(r"^\p{L}{2,8} \p{L}{2,8}$")


def structural_split(name: Column) -> Column:
    """A single token in two cases (LinShu, LU-Wang) becomes two."""

    def one(n: Column) -> Column:
        parts = F.split(n, "-")
        joined = (F.size(parts) == 2) & (case_pattern(parts[0]) != case_pattern(F.get(parts, F.lit(1))))
        hyphen = F.when(joined, F.replace(n, F.lit("-"), F.lit(" "))).otherwise(n)
        fused = lambda cut: F.when(cut == n, hyphen).when(cut.rlike(r"^\p{L}{2,8} \p{L}{2,8}$"), cut).otherwise(n)
        return F.when(n.rlike(r"\s") | (n == ""), n).otherwise(let(smart_split(n), fused))

    return let(name, one)


def unsplit(name: Column) -> Column:
    """A name cleaned of punctuation, full-width forms and look-alikes, before a fused token is cut."""
    return collapse_ws(ocr_fix(clean_punct(name)))


def preprocess(name: Column) -> Column:
    return collapse_ws(structural_split(unsplit(name)))


def comma_swap(name: Column) -> Column:
    """``A, B`` becomes ``B A`` if there are exactly two parts."""

    def one(n: Column) -> Column:
        parts = F.filter(F.transform(F.split(n, ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
        return F.when(n.contains(","), let(parts, lambda p: F.when(F.size(p) == 2, F.concat_ws(" ", F.get(p, F.lit(1)), F.get(p, F.lit(0)))).otherwise(n))).otherwise(n)

    return let(name, one)


def tokenize(name: Column) -> Column:
    """Separators become spaces; tokens of ASCII punctuation alone go."""
    parts = F.split(F.regexp_replace(name, f"[{SEPARATORS}]+", " "), r"\s+")
    return F.filter(parts, lambda x: ~x.rlike(r"^[!-/:-@\[-`{-~]*$"))


def strip_marks(x: Column) -> Column:
    """NFD without combining marks, by ICU in Spark's own jars; ASCII is left as it is, and null."""
    nfd = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), x, F.lit(False))
    return F.when(x.isNull() | (F.octet_length(x) == F.length(x)), x).otherwise(F.regexp_replace(nfd, r"\p{Mn}+", ""))


def norm_light(token: Column) -> Column:
    return F.translate(F.lower(strip_marks(token)), HYPHENS, "")


def wade_giles(low: Column) -> Column:

    def suffixes(out: Column) -> Column:
        ended = out
        for suffix, new in reversed(SUFFIXES):
            ended = F.when(out.endswith(suffix), F.concat(F.substring(out, F.lit(1), F.length(out) - len(suffix)), F.lit(new))).otherwise(ended)
        return ended

    def one(x: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(x, F.lit(WADE), F.lit(0)), lambda p: F.coalesce(lookup(WADE_MAP, p), p))
        return F.coalesce(lookup(fixed.WADE_GILES_SYLLABLES, x), let(F.when(x == "j", "r").otherwise(F.array_join(parts, "")), suffixes))

    return let(low, one)


#: Layers of spellings, the first that has a key counts.
LAYERS = ("EXCEPTIONS", "GIVEN_TOKEN_RULES", "CANTONESE_SURNAME_RULES", "CANTONESE_PHONETIC_RULES", "TAIWANESE_RULES", "ONE_LETTER")


def layered() -> dict[str, str]:
    out: dict[str, str] = {}
    for layer in LAYERS:
        for k, v in getattr(fixed, layer).items():
            out.setdefault(k, v)
    return out


def norm(token: Column) -> Column:
    """A token as pinyin: known spellings by layer, else Wade-Giles rules, without hyphens and apostrophes."""
    rest = lambda low: let(wade_giles(low), lambda w: F.translate(F.when(w == "qen", "chen").otherwise(w), HYPHENS, ""))
    return let(F.lower(strip_marks(token)), lambda low: F.coalesce(lookup(layered(), low), rest(low)))


def capitalize(token: Column) -> Column:
    """Marks stripped; of each hyphen part, the first letter upper, the rest lower."""
    return F.array_join(F.transform(F.split(strip_marks(token), "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "-")


def all_caps(tokens: Column) -> Column:
    """Whether some token of more than one letter is all upper-case."""
    return F.exists(tokens, lambda t: (F.length(F.regexp_replace(t, r"\P{L}", "")) > 1) & ~t.rlike(r"\p{Ll}"))


def route_tokens(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(ROUTE_TOKEN), F.lit(0))


def script_class(name: Column) -> Column:
    han, latin = name.rlike(f"[{CJK}]"), name.rlike(r"[A-Za-z\x{C0}-\x{24F}]")
    return F.when(han & latin, "mixed_script").when(han, "han_only").otherwise("latin_only")


def clean_roman(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z\x{C0}-\x{24F}\-']", "")


def compact_han(name: Column) -> Column:
    """Han characters without separators; empty if there is anything else."""
    bare = F.translate(F.regexp_replace(F.regexp_replace(name, f"[{SEPARATORS}]+", ""), r"\s+", ""), HYPHENS, "")
    return F.when(bare.rlike(f"^[{CJK}]+$"), bare).otherwise("")


def is_camel(token: Column) -> Column:
    """A capital at the head, another one later, and not capitals alone."""
    return token.rlike(r"^\p{Lu}.*\p{Lu}") & token.rlike(r"\p{Ll}")


def malformed_camel(token: Column) -> Column:
    """Two capitals or more, wherever they stand, among other letters."""
    ups = F.length(F.regexp_replace(token, r"\P{Lu}", ""))
    return (F.length(token) > 2) & (ups >= 2) & token.rlike(r"\p{Ll}")


def cjk_chunks(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(f"[{CJK}]+"), F.lit(0))


def paren_hint(name: Column) -> Column:
    """``Roman (Roman) Roman``: the surname stands first."""
    return name.rlike(r"^\s*[A-Za-z][A-Za-z.'\-]*\s*[（(]\s*[A-Za-z][A-Za-z .'\-]*\s*[)）]\s*[A-Za-z][A-Za-z .'\-]*\s*$")


def letters(token: Column) -> Column:
    return F.regexp_replace(token, r"\P{L}", "")
