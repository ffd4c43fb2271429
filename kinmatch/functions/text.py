"""Unicode-aware text normalisation as Column builders.

The only Python here is `nfkc_casefold` and `latin_fold`, Arrow-batched, to be
applied once to an entity, never to a pair. All else is built-in expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal suffixes that end a name, as token sequences.
LEGAL_SUFFIXES = (
    "limited liability company", "l l c", "l l p", "private limited", "pvt limited", "pvt ltd", "l p", "p c",
    "incorporated", "corporation", "company", "limited", "private", "pvt", "inc", "corp", "llc", "llp", "lp", "pc", "ltd", "co",
    "sas", "sarl", "eurl", "snc", "gmbh", "srl",
)
# Street types spelled out at the end of an address component.
STREET_TYPES = {"rd": "road", "ave": "avenue", "ct": "court", "dr": "drive", "ln": "lane", "trl": "trail", "cir": "circle"}
# Postal codes by country.
POSTAL = {
    "us": r"(?<!\p{Nd})\p{Nd}{5}(?:-\p{Nd}{4})?(?!\p{Nd})",
    "india": r"(?<!\p{Nd})[1-9]\p{Nd}{5}(?!\p{Nd})",
    "france": r"(?<!\p{Nd})\p{Nd}{5}(?!\p{Nd})",
}
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
_DOTTED = (("l", "l", "c"), ("l", "l", "p"), ("l", "p"), ("p", "c"))


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def _fold(text: str | None) -> str | None:
    """Marks on Latin letters dropped, those of other scripts kept."""
    if text is None or text.isascii():
        return text
    kept, latin = [], False
    for c in unicodedata.normalize("NFKD", text):
        if unicodedata.category(c)[0] != "M":
            latin = unicodedata.name(c, "")[:6] == "LATIN "
        elif latin:
            continue
        kept.append(c)
    return unicodedata.normalize("NFKC", "".join(kept))


@F.pandas_udf(StringType())
def latin_fold(s: pd.Series) -> pd.Series:
    return s.map(_fold)


def _col(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squeezed(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def spaced(c: Column) -> Column:
    """All but letters, digits, marks and joiners become spaces."""
    return F.trim(F.regexp_replace(c, "[^\\p{L}\\p{N}\\p{M}‌‍]+", " "))


def _plain_quotes(c: Column) -> Column:
    return F.replace(F.translate(c, "’‘ʼ＇", "''''"), F.lit("'"), F.lit(""))


def normalize_text(c: Column | str) -> Column:
    return squeezed(nfkc_casefold(_col(c)))


def name_of_folded(folded: Column) -> Column:
    """The name form of text that is already NFKC and case-folded."""
    out = F.replace(_plain_quotes(folded), F.lit("&"), F.lit(" and "))
    for letters in _DOTTED:
        dotted = r"\s*\.\s*".join(letters)
        out = F.regexp_replace(out, rf"(?U)(?<!\w){dotted}\s*\.?(?!\w)", f" {''.join(letters)} ")
    return spaced(out)


def address_of_folded(folded: Column) -> Column:
    return spaced(_plain_quotes(folded))


def normalize_name(c: Column | str) -> Column:
    return name_of_folded(nfkc_casefold(_col(c)))


def normalize_address(c: Column | str) -> Column:
    return address_of_folded(nfkc_casefold(_col(c)))


def tokens(c: Column) -> Column:
    """Tokens of a normalised form, in order, repetitions kept."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def core_of_name(name: Column) -> Column:
    """A normalised name without the legal suffixes at its end; may be empty."""
    ends = "|".join(sorted(LEGAL_SUFFIXES, key=lambda s: (-s.count(" "), s)))
    return F.regexp_replace(name, rf"(?:(?:^| )(?:{ends}))+$", "")


def core_name(c: Column | str) -> Column:
    return core_of_name(normalize_name(c))


def name_search_text(c: Column | str) -> Column:
    return squeezed(nfkc_casefold(latin_fold(normalize_name(c))))


def standardize_folded(folded: Column) -> Column:
    """Street types spelled out where they end a component of more than one token."""
    table = F.create_map(*[F.lit(x) for kv in STREET_TYPES.items() for x in kv])

    def component(part: Column) -> Column:
        words = tokens(address_of_folded(part))
        last = F.element_at(words, -1)
        full = F.concat(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.array(F.coalesce(table[last], last)))
        return F.when(F.size(words) > 1, full).otherwise(words)

    return F.array_join(F.flatten(F.transform(F.split(folded, ","), component)), " ")


def standardize_address(c: Column | str) -> Column:
    return standardize_folded(nfkc_casefold(_col(c)))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{Nd}+"), F.lit(0))


def numeric_tokens(c: Column | str) -> Column:
    return digit_runs(nfkc(_col(c)))


def postal_of(text: Column, country: Column) -> Column:
    """Postal-shaped runs of NFKC text for a normalised country; empty for unknown ones."""
    out = F.array().cast("array<string>")
    for name, pattern in POSTAL.items():
        out = F.when(country == name, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(out)
    return out


def postal_candidates(c: Column | str, country: Column | str) -> Column:
    return postal_of(nfkc(_col(c)), normalize_text(country))


def postal_candidate(c: Column | str, country: Column | str) -> Column:
    return F.get(postal_candidates(c, country), F.lit(0))


def strong_words(words: Column) -> Column:
    """Distinct address words of four characters and more that are not digits."""
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.rlike(r"^\p{Nd}+$")))


def safe_double(c: Column | str) -> Column:
    """Text to double; blanks, NaN and infinities become 0."""
    x = F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def safe_int(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(x.try_cast("double").try_cast("int"), F.lit(0))


def register(spark) -> None:
    """Puts the functions at the service of SQL text."""
    spark.udf.register("nfkc_casefold", nfkc_casefold)
    spark.udf.register("nfkc", nfkc)
    spark.udf.register("latin_fold", latin_fold)
