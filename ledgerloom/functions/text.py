"""Scalar functions on text, as Column expressions: all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Corporate suffixes and leading connectives of company names, in upper case.
SUFFIXES = """INC INCORPORATED CORP CORPORATION LLC LLP LP LTD LIMITED PLC NV BV SA AG GMBH CO COMPANY COMPANIES TRUST NATASSOC AND""".split() + ["L P", "L L C", "L L P", "N V", "B V", "S A", "A G", "P L C", "S A R L"]
LEADS = ["MADE BY AND BETWEEN", "BY AND BETWEEN", "BY AND AMONG", "AMONGST", "BETWEEN", "AMONG", "AND", "WITH", "THIS", "THE", "DATED", "AS OF"]
# Boilerplate words of filings that carry no class.
DOMAIN_STOPWORDS = "exhibit exhibits txt htm html pdf doc docx page pages dated form forms schedule schedules annex appendix registrant filed filing".split()

SUFFIX_PATTERN = "( (" + "|".join(sorted(SUFFIXES, key=len, reverse=True)) + "))+$"
LEAD_PATTERN = "^(" + "|".join(LEADS) + ") "


def norm_key(name: Column, least: int = 1) -> Column:
    """A company name reduced to a key: upper case, AND for &, letters and digits, without one leading connective and
    trailing corporate suffixes; null below ``least`` characters."""
    key = F.regexp_replace(F.replace(F.upper(name), F.lit(" & "), F.lit(" AND ")), "[^A-Z0-9 ]", " ")
    key = F.trim(F.regexp_replace(key, "\\s+", " "))
    key = F.trim(F.regexp_replace(F.regexp_replace(key, LEAD_PATTERN, ""), SUFFIX_PATTERN, ""))
    return F.when(F.length(key) >= least, key)


def strip_conformed(name: Column) -> Column:
    """A registrant's name without former names in brackets and without a trailing /XX/ or \\XX\\ mark."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, "(?i)\\((FORMERLY|FKA)[^)]*\\)", ""), "\\s*[/\\\\][A-Za-z ]{2,3}[/\\\\]\\s*$", ""))


def shared_tokens(a: Column, b: Column) -> Column:
    """How many leading words two keys have in common."""
    x, y = F.split(a, " "), F.split(b, " ")
    n = F.least(F.size(x), F.size(y))
    same = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p == q)
    end = F.array_position(same, False)
    return F.coalesce(F.when(end == 0, n).otherwise(end - 1), F.lit(0)).cast("int")


def words(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of an array of words; fewer words give none."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(tokens, i, n)))).otherwise(F.array().cast("array<string>"))


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e, at least one."""
    low = F.lower(word)
    groups = F.regexp_count(low, F.lit("[aeiouy]+"))
    silent = (low.rlike("[^aeiouy]e$") & (groups > 1)).cast("int")
    return F.greatest(groups - silent, F.lit(1))


def fog(text: Column) -> Column:
    """0.4 * (words a sentence + 100 * share of words of three syllables or more); numbers are no words."""
    spoken = F.filter(words(text), lambda w: ~w.rlike("^[0-9.,$%]+$"))
    complex_ = F.size(F.filter(spoken, lambda w: syllables(F.regexp_replace(w, "[^A-Za-z]", "")) >= 3))
    sentences = F.greatest(F.regexp_count(text, F.lit("[.!?](\\s|$)")), F.lit(1))
    n = F.size(spoken)
    return F.when(n > 0, 0.4 * (n / sentences + 100 * complex_ / n))


def stopword_share(text: Column, stopwords: Sequence[str]) -> Column:
    """The share of space-separated tokens that are stop words, in percent."""
    tokens = F.split(F.lower(text), " ")
    return F.size(F.filter(tokens, lambda w: w.isin(list(stopwords)))) / F.size(tokens) * 100


def truncate_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def unspace(text: Column) -> Column:
    """Entities and Unicode spaces, zero-width ones too, as one space."""
    return F.regexp_replace(text, "(&nbsp;|&#160;|&#xA0;|[\\p{Zs}\\x{200B}\\x{FEFF}])+", " ")


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", " "), "\\s+", " "))


def exhibit_number(raw: Column) -> Column:
    """'EX-010.01' as '10.1': upper case, without EX, without leading zeros of each part."""
    bare = F.regexp_replace(F.upper(F.trim(raw)), "^EX(HIBIT)?[-. ]*", "")
    return F.regexp_replace(bare, "(^|\\.)0+([0-9])", "$1$2")


def item_code(line: Column) -> Column:
    """The code of an item line ('Item 1.01: ...'), null where there is none."""
    return F.nullif(F.regexp_extract(line, "^Item\\s+(\\d+(\\.\\d+)?)\\s*:", 1), F.lit(""))


def wilson_lower(k: Column, n: Column) -> Column:
    """The lower bound of the 95 % Wilson interval; 0 of nothing."""
    z = 1.959963984540054  # fixed value: the normal quantile of 0.975
    p = k / n
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.least(F.greatest(bound, F.lit(0.0)), F.lit(1.0)))


def phrase_pattern(phrase: str, separators: bool = True, plurals: bool = True) -> str:
    """A phrase as a regular expression: words joined by spaces or hyphens, optional plural, whole words, any case."""
    parts = ["".join(f"\\{c}" if not c.isalnum() else c for c in w) for w in phrase.split()]
    return "(?i)\\b" + ("[-\\s]+" if separators else "\\s+").join(parts) + ("(?:s|es)?" if plurals else "") + "\\b"


def any_pattern(phrases: Sequence[str]) -> str:
    """One expression that finds any of the phrases, to reject texts before they are scanned for each."""
    return "|".join(f"(?:{phrase_pattern(p)})" for p in phrases)


def context_tokens(tokens: Column, least: int = 8192, headroom: float = 1.25, most: int = 32768) -> Column:
    """The power of two that holds ``tokens`` with headroom, within bounds."""
    power = F.pow(F.lit(2.0), F.ceil(F.log2(tokens * headroom)))
    return F.least(F.greatest(power, F.lit(float(least))), F.lit(float(most))).cast("bigint")


def number_text(x: Column, style: str) -> Column:
    """A number as tables print it: count, pct1, prop3, num2."""
    return {"count": F.format_number(x, 0), "pct1": F.concat(F.format_number(x * 100, 1), F.lit("%")), "prop3": F.format_number(x, 3), "num2": F.format_number(x, 2)}[style]
