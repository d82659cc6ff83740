"""Similarity of short strings, and what it says about names of companies and dates of birth."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.spans import let

# Words around a date that make it a date of birth.
BIRTH_KEYWORDS = ("date of birth", "dob", "born", "birth date", "birthdate", "birthday", "b-day")
# Last words of company names.
COMPANY_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "llc", "l.l.c.", "ltd", "limited", "co", "company", "group", "holdings", "technologies", "industries", "enterprises", "partners", "llp", "plc")
# Capitalised words by which a document means itself, and words that introduce defined terms.
SELF_REFERENCES = ("company", "board", "offer", "group", "circular", "schedule", "fiscals", "fiscal", "regulations", "regulation", "rules", "act", "committee", "management")
ARTICLES = ("the", "our", "this", "such", "any", "every", "each", "said")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, by rows of the usual table."""
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")

    def table(x: Column, y: Column) -> Column:
        def row(above: Column, c: Column) -> Column:
            def cell(acc: Column, j: Column) -> Column:
                same = F.get(y, j) == c
                value = F.when(same, F.get(above, j) + 1).otherwise(F.greatest(F.get(above, j + 1), F.get(acc, j)))
                return F.concat(acc, F.array(value))

            return F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), F.array(F.lit(0)), cell)

        rows = F.aggregate(x, F.array_repeat(F.lit(0), F.size(y) + 1), row, lambda last: F.element_at(last, -1))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0)).otherwise(rows)

    return let(letters(a), lambda x: let(letters(b), lambda y: table(x, y)))


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity from 0 to 1 by insertions and deletions: twice the common length over both lengths."""
    total = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(1.0)).otherwise(2.0 * common_length(a, b) / total)


def text_similarity(a: Column, b: Column) -> Column:
    """``indel_ratio`` of the strings' words in sorted order; 0 where either is empty."""
    words = lambda s: F.array_join(F.array_sort(F.array_remove(F.split(s, r"\s+"), "")), " ")
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(indel_ratio(words(a), words(b)))


def near_pattern(keyword: str, threshold: float = 0.85) -> set[str]:
    """Regular expressions of all strings that come up to ``threshold`` against a keyword.

    Inside a text a stretch of the keyword's length counts, at its edges a shorter one too. What
    is allowed to differ follows from the similarity, so the alternatives can be listed.
    """
    m = len(keyword)
    out = set()
    for width in range(1, m + 1):
        need = next(n for n in range(m + 2) if 2 * n >= threshold * (m + width))
        if need > width:
            continue
        for kept in combinations(range(m), need):
            body = [_literal(keyword[i]) for i in kept]
            for wild in combinations(range(width), width - need):
                it = iter(body)
                alternative = "".join("." if i in wild else next(it) for i in range(width))
                out |= {alternative} if width == m else {"^" + alternative, alternative + "$"}
    return out


def _literal(c: str) -> str:
    return c if c.isalnum() or c == " " else "\\" + c


_NEAR_BIRTH = "(?s)(?:" + "|".join(sorted(set().union(*map(near_pattern, BIRTH_KEYWORDS)))) + ")"


def birth_context(window: Column) -> Column:
    """Whether a keyword of birth, or something very much like it, stands in the lower-case window."""
    exact = window.rlike("|".join(k.replace("-", r"\-") for k in BIRTH_KEYWORDS))
    return (F.trim(window) != "") & (exact | window.rlike(_NEAR_BIRTH))


def company_suffix_boost(name: Column, cutoff: float = 0.9) -> Column:
    """How like a company suffix the last word is, from ``cutoff`` to 1; else 0."""
    clean = F.regexp_replace(name, r"^[.,]+|[.,]+$", "")
    tail = F.lower(F.element_at(F.concat(F.array(F.lit("")), F.array_remove(F.split(clean, r"\s+"), "")), -1))

    def best(t: Column) -> Column:
        top = F.array_max(F.array(*[indel_ratio(t, F.lit(s)) for s in COMPANY_SUFFIXES]))
        return F.when((t != "") & (top >= cutoff), top).otherwise(F.lit(0.0))

    return let(tail, best)


def acronym_guard(name: Column) -> Column:
    """Whether a name only looks like one: form labels, numbers, page numerals, marks, self-references."""
    s = F.trim(name)
    one = ~s.contains(" ")
    upper, lower = (s == F.upper(s)) & (s != F.lower(s)), (s == F.lower(s)) & (s != F.upper(s))
    label = upper & (F.length(s) <= 5) & one
    numeral = lower & (F.length(s) <= 6) & s.rlike("^[ivxlcdm]+$")
    itself = one & s.rlike(r"^\p{Lu}") & F.lower(s).isin(*SELF_REFERENCES)
    return (s != "") & (label | s.rlike(r"^\p{Nd}+$") | numeral | ~s.rlike(r"\p{L}") | itself)


def company_confidence(name: Column, base: Column, before: Column) -> Column:
    """Confidence of a company's name, given the word before it."""

    def shaped(boost: Column) -> Column:
        term = (boost == 0.0) & F.lower(before).isin(*ARTICLES)
        return F.least(F.lit(0.97), F.when(term, base * 0.4).otherwise(base) + boost * 0.15)

    return F.when(acronym_guard(name), base * 0.3).otherwise(let(company_suffix_boost(name), shaped))
