"""Text functions as Catalyst expressions: normal form, index terms, tokens, overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never keywords.
STOP_WORDS = [
    "的", "了", "是", "在", "有", "和", "就", "不", "也", "都", "这", "那", "对", "被", "把",
    "the", "a", "an", "is", "are", "it", "this", "that", "to", "for", "with", "on", "at", "by",
]
# Tokens that negate; markers of complementary information.
NEGATIONS = [
    "不", "不是", "不要", "不能", "没有", "不会", "不对", "not", "no", "don", "doesn", "isn", "aren", "won",
    "避免", "禁止", "拒绝", "反对", "否定",
]
COMPLEMENTS = [
    "另外", "还有", "此外", "同时", "另一方面", "also", "besides", "furthermore", "moreover", "不过", "但是", "然而", "虽然",
]
_HAN = r"[\x{4E00}-\x{9FFF}]"


def normal_form(text: Column) -> Column:
    """Markup dropped, white space collapsed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"\s+", " ")))


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the normal form."""
    return F.substring(F.sha2(normal_form(text), 256), 1, 16)


def plain_hash(text: Column) -> Column:
    """``content_hash`` of a text whose markup counts."""
    return F.substring(F.sha2(F.lower(F.regexp_replace(F.trim(text), r"\s+", " ")), 256), 1, 16)


def _grams(run: Column, n: int) -> Column:
    last = F.length(run) - (n - 1)
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))
    return F.when(last >= 1, every).otherwise(F.array().cast("array<string>"))


def _pairs(text: Column) -> Column:
    """Every two neighbours of a run of Han characters: a look-ahead takes both and moves on by one."""
    return F.regexp_extract_all(text, F.lit(rf"(?=({_HAN}{{2}})){_HAN}"), F.lit(1))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def segments(text: Column) -> Column:
    """Segments of a text for an index: a run of Han characters gives its single characters, then
    its pairs; a run of ASCII letters, digits, dots, dashes and underscores stays as it is."""
    runs = F.regexp_extract_all(text, F.lit(rf"({_HAN}+|[A-Za-z0-9._-]+)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^{_HAN}"), F.concat(_grams(r, 1), _grams(r, 2))).otherwise(F.array(r))))


def index_terms(text: Column) -> Column:
    """Terms of the full-text index, repeats kept: single Han characters, pairs of them, the
    letter and digit parts of ASCII runs, and runs of several parts as a whole, which is what a
    query for one asks for; ASCII letters are lower-cased."""
    low = F.translate(text, _UPPER, _LOWER)
    return F.concat(
        F.regexp_extract_all(low, F.lit(f"({_HAN})"), F.lit(1)), _pairs(low),
        F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)),
        F.regexp_extract_all(low, F.lit("([a-z0-9]+(?:[._-]+[a-z0-9]+)+)"), F.lit(1)),
    )


def asked_terms(text: Column) -> Column:
    """Distinct terms of a query: a run of several parts only as a whole; single Han characters
    only if nothing longer is there."""
    low = F.translate(text, _UPPER, _LOWER)
    every = F.array_distinct(F.concat(
        F.regexp_extract_all(low, F.lit("([a-z0-9]+(?:[._-]+[a-z0-9]+)*)"), F.lit(1)), _pairs(low),
        F.regexp_extract_all(low, F.lit(f"({_HAN})"), F.lit(1)),
    ))
    longer = F.filter(every, lambda t: F.length(t) > 1)
    return F.when(F.size(longer) > 0, longer).otherwise(every)


def like_fragments(query: str) -> list[str]:
    """What a substring search looks for: whole Han runs, else words between white space."""
    import re

    return list(dict.fromkeys(x for part in query.split() for x in re.findall(r"[一-鿿]+|[^\s一-鿿]+", part)))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a run with Han characters gives its characters."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(_HAN), _grams(r, 1)).otherwise(F.array(r))))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(F.coalesce(text, F.lit(""))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens of two token sets, 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Share of the tokens of ``a`` that are in ``b``."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def has_negation(text: Column) -> Column:
    return F.arrays_overlap(token_set(text), F.array(*map(F.lit, NEGATIONS)))


def has_complement(text: Column) -> Column:
    return F.lower(text).rlike("|".join(COMPLEMENTS))


def summary(text: Column, most: int = 200) -> Column:
    """First part before a section mark, else the first line, cut with dots; "" for null."""
    def short(part: Column) -> Column:
        return F.when(F.length(part) <= most, part).otherwise(F.concat(F.substring(part, 1, most - 3), F.lit("...")))

    section, line = F.trim(F.substring_index(text, "§", 1)), F.trim(F.substring_index(text, "\n", 1))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(
        text.contains("§") & (section != ""), short(section)
    ).when(line != "", short(line)).otherwise(F.substring(text, 1, most))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4)


def fingerprint(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def merged(old: Column, new: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """Two related texts as one: the old one where the new adds little, else both; ``a`` and ``b`` are
    their token sets where they are known."""
    a, b = token_set(old) if a is None else a, token_set(new) if b is None else b
    shared = F.size(F.array_intersect(a, b))
    most, ours = shared / F.greatest(F.size(a), F.size(b)), shared / F.size(b)
    keep = (most > 0.9) | ((ours > 0.85) & (F.length(old) > F.length(new) * 1.5))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), new).when(keep, old).otherwise(F.concat(old, F.lit(" § "), new))
