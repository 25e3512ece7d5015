"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and their plain forms, place by place.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def fold_text(c: Column) -> Column:
    """Lower case, no accents (Latin), blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), MARKED, PLAIN), r"\s+", " "))


#: Case- and accent-insensitive collation of all scripts.
ANY_CASE = "UNICODE_CI_AI"


def fold_unicode(c: Column) -> Column:
    """Compatibility decomposition (NFKD) without marks, case folded, blanks collapsed and trimmed, in any script.

    Texts of ASCII and the letters of MARKED are folded as they are; only others go through Python, in Arrow batches.
    """
    @F.pandas_udf("string")
    def whole(x: pd.Series) -> pd.Series:
        def fold(t: str) -> str:
            plain = "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))
            return " ".join(plain.casefold().split())

        return x.map(fold, na_action="ignore")

    other = F.rlike(c, F.lit(f"[^\\x00-\\x7F{MARKED}{MARKED.upper()}]"))
    return F.coalesce(whole(F.when(other, c)), fold_text(c))


def same_text(a: Column, b: Column) -> Column:
    """Equal but for case and accents, in any script."""
    return F.collate(a, ANY_CASE) == F.collate(b, ANY_CASE)


def holds_text(a: Column, b: Column) -> Column:
    """Whether a holds b, but for case and accents, in any script."""
    return F.contains(F.collate(a, ANY_CASE), F.collate(b, ANY_CASE))


def norm_drug_name(c: Column, keep: str = "/+") -> Column:
    """Folded upper case; & becomes a slash; other punctuation is dropped."""
    x = F.regexp_replace(F.upper(fold_text(c)), "&", " / ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, f"[^A-Z0-9{keep} ]", " "), " +", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def translate_tokens(c: Column, mapping: dict[str, str]) -> Column:
    """Each token by the dictionary, others as they are."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return F.array_join(F.transform(tokens(c), lambda x: F.coalesce(F.try_element_at(pairs, x), x)), " ")


def strip_salts(c: Column, stop: list[str]) -> Column:
    """The tokens that are no salt or counter-ion; order and repeats stay."""
    return F.array_join(F.filter(tokens(c), lambda x: ~x.isin(stop)), " ")


def split_combination(c: Column) -> Column:
    """Parts of a combination: cut at /, + and Y between blanks."""
    return F.filter(F.transform(F.split(c, r"/|\+| Y "), lambda x: F.trim(x)), lambda x: x != "")


def cascade(c: Column, rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    return reduce(lambda rest, rule: F.when(F.coalesce(rule[1], F.lit(False)), rule[0]).otherwise(rest), reversed(rules), F.lit(otherwise))


def extract_category(c: Column, patterns: list[str]) -> Column:
    """First group of the first pattern that matches, in upper case; empty if none does."""
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns], F.lit("")))


def packed_codes(c: Column, modifier: str) -> Column:
    """Codes of a ;-packed list without quotes, blanks and modifiers."""
    clean = F.transform(F.split(F.regexp_replace(c, "[\"']", ""), ";"), lambda x: F.regexp_replace(F.trim(x), modifier, ""))
    return F.filter(clean, lambda x: x != "")


def likelihood_positive(c: Column, aliases: list[str], least: float = 80.0) -> Column:
    """True if any alias of the JSON map has the likelihood; false if unreadable."""
    m = F.from_json(c, "map<string,double>")
    return F.coalesce(F.greatest(*[F.coalesce(F.try_element_at(m, F.lit(a)), F.lit(-1.0)) for a in aliases], F.lit(-1.0)) >= least, F.lit(False))


def plausible_or_null(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def parse_number(c: Column) -> Column:
    """A decimal number with point or comma; blank or bad is null."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def token_set_ratio(a: Column, b: Column) -> Column:
    """0-100: likeness of two names by their sorted distinct tokens, one less the edit share."""
    line = lambda x: F.array_join(F.array_sort(F.array_distinct(tokens(x))), " ")
    return similarity(line(a), line(b))


def similarity(a: Column, b: Column) -> Column:
    """0-100: one less the edit distance over the longer length; 100 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))
