"""Scalar text functions as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


#: Characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Characters that `\s` of the oracles matches.
SQL_WHITE = "\t\n\x0c\r "


def let(value, use) -> Column:
    """use(x) with x evaluated once, however often it occurs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blank(c) -> Column:
    """Null to the empty string."""
    return F.coalesce(c, F.lit(""))


def strip(c) -> Column:
    """White space of any kind off both ends."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c) -> Column:
    """Runs of white space to one space, ends stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def count_of(c, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def guarded(test, count) -> Column:
    """A count that is only taken where a cheap test shows that there may be one."""
    return F.when(test, count).otherwise(F.lit(0).cast("bigint"))


def has_any(c, *parts: str) -> Column:
    """Whether one of some strings occurs, without a regular expression."""
    found = F.lit(False)
    for part in parts:
        found = found | c.contains(part)
    return found


def length_without(c, pattern: str) -> Column:
    """Characters that no match of `pattern` holds. With a pattern of runs this counts the characters of a class in few steps."""
    return F.length(F.regexp_replace(c, pattern, "")).cast("bigint")


def word_count(c) -> Column:
    return count_of(blank(c), r"(?U)\S+")


def words(c) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(blank(c), r"(?U)\s+"), lambda x: x != "")


def sql_word_count(c) -> Column:
    """How many runs of characters other than SQL_WHITE a text has; nothing but the runs of one text is held."""
    return F.size(F.array_remove(F.split(blank(c), f"[{SQL_WHITE}]+"), ""))


def lines(c) -> Column:
    return F.split(blank(c), "\n")


def strip_tags(c) -> Column:
    """Tags to spaces, squeezed: the regular-expression form of an HTML stripper."""
    return squeeze(F.regexp_replace(blank(c), "<[^>]+>", " "))


def flatten_lines(c) -> Column:
    """One line: breaks, tabs and runs of spaces become one space."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(blank(c), r"[\r\n]+", " "), r"\t+", " "), " {2,}", " "))


def normalize_url(c) -> Column:
    return F.regexp_replace(F.lower(F.trim(blank(c))), "/+$", "")


def article_slug(c) -> Column:
    """The part of a URL after /article/n/, or the URL."""
    slug = F.regexp_extract(blank(c), r"/article/n/(.+?)/?$", 1)
    return F.when(slug != "", slug).otherwise(c)


def year_of(c) -> Column:
    """The first four digits in a row, as a number."""
    return F.regexp_extract(blank(c), r"(\d{4})", 1).try_cast("int")


def comma_count(c) -> Column:
    """Parts between commas that aren't blank."""
    return F.size(F.filter(F.split(blank(c), ","), lambda x: F.trim(x) != "")).cast("bigint")


def to_bool(c) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("true", "1")


def safe_long(c) -> Column:
    return F.coalesce(c.cast("string").try_cast("bigint"), F.lit(0))


def html_only(c) -> Column:
    """Markup with hardly any text: long, five tags or more, and little left without them."""
    text, bare = blank(c), F.length(strip_tags(c))
    return (F.length(text) >= 500) & (F.length(text) - F.length(F.replace(text, F.lit("<"), F.lit(""))) >= 5) & ((bare < 150) | (bare < 0.12 * F.length(text)))


def ratio(part, whole, digits: int = 6) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), digits)


def lexical_features(c, stop_words, punctuation: str = r"[.,!?;:\-]", own=None) -> dict[str, Column]:
    """Shares of punctuation, stop words, distinct words and capitals. `own`: the lower-cased words, if a frame has them."""
    w = words(F.lower(c)) if own is None else own
    n = F.size(w)
    return {
        "punctuation_ratio": ratio(count_of(blank(c), punctuation), F.length(blank(c))),
        "stop_word_ratio": ratio(F.size(F.filter(w, lambda x: x.isin(*stop_words))), n),
        "unique_word_ratio": ratio(F.size(F.array_distinct(w)), n),
        "uppercase_ratio": ratio(count_of(blank(c), r"\p{Lu}"), F.length(blank(c))),
    }


def size_features(c) -> dict[str, Column]:
    """Characters, words, sentences and mean length of a word."""
    text = blank(c)
    return {
        "char_count": F.length(text).cast("bigint"),
        "word_count": word_count(c),
        "sentence_count": (F.size(F.split(text, "[.!?]+")) - 1).cast("bigint"),
        "avg_word_length": ratio(F.length(F.regexp_replace(text, r"(?U)\s+", "")), word_count(c)),
    }


def feature_clean(c) -> Column:
    """Lower case; only word characters, white space and .,!?;:- stay."""
    return F.lower(F.regexp_replace(blank(c), r"(?U)[^\w\s.,!?;:\-]", ""))


def preview(c, size: int = 500) -> Column:
    return F.translate(F.substring(blank(c), 1, size), "\n", " ")


def truncate_middle(c, keep: int = 4000, marker: str = "\n...\n") -> Column:
    return F.when(F.length(c) > 2 * keep, F.concat(F.left(c, F.lit(keep)), F.lit(marker), F.right(c, F.lit(keep)))).otherwise(c)


def has_refusal(c) -> Column:
    low = F.lower(blank(c))
    found = F.lit(False)
    for phrase in P.REFUSALS:
        found = found | low.contains(phrase)
    return found


def topic_flags(c, topics: dict[str, list[str]]) -> Column:
    """Names of the topics of which some word occurs."""
    named = lambda low: F.array_compact(F.array(*(F.when(has_any(low, *found), F.lit(name)) for name, found in topics.items())))
    return let(F.lower(blank(c)), named)


def needle(pattern: str) -> str:
    """The longest word that every match of a pattern has in lower case; empty where none is certain."""
    while (bare := re.sub(r"(?<!\\)\((?:[^()\\]|\\.)*\)[?*+]?", " ", pattern)) != pattern:
        pattern = bare
    if re.search(r"(?<!\\)\|", pattern):
        return ""
    pattern = re.sub(r"\[(?:\\.|[^\]\\])*\]|\\.", "\0", pattern)  # classes and escapes
    pattern = re.sub(r"(?s).(?:[?*]|\{[^}]*\})", "\0", pattern)  # what may be absent
    return max(re.findall(r"[\w:]+", pattern.lower()), key=len, default="")


def folded(c) -> Column:
    """Lower case as case-insensitive patterns see it."""
    return F.replace(F.lower(blank(c)), F.lit("ſ"), F.lit("s"))


def leak_count(c, leaks=P.LEAKS_STRONG) -> Column:
    """How many patterns occur; each is only searched in texts that have its longest word."""
    return let(folded(c), lambda low: sum((F.when(low.contains(needle(p)), blank(c).rlike(p).cast("int")).otherwise(0) for p in leaks), F.lit(0)))


def has_prompt_leak(c) -> Column:
    return (leak_count(c) >= 1) | (leak_count(c, P.LEAKS_MEDIUM) >= 2)


def injections(c, most: int = 5) -> Column:
    """The first texts that try to instruct the judge."""
    none = F.array().cast("array<string>")
    of = lambda low, p: F.when(low.contains(needle(p)), F.regexp_extract_all(blank(c), F.lit(f"({p})"), F.lit(1))).otherwise(none)
    return F.slice(let(folded(c), lambda low: F.concat(*(of(low, p) for p in P.INJECTIONS))), 1, most)


def strip_fences(c) -> Column:
    """An answer without code fences."""
    return strip(F.regexp_replace(blank(c), r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def parse_answer(c, schema: str) -> Column:
    """The first JSON object of an answer, tolerant of fences and of text around it."""
    return F.from_json(F.regexp_extract(strip_fences(c), r"(?s)(\{.*\})", 1), schema)


def drop_bracket_refs(c) -> Column:
    return squeeze(F.regexp_replace(blank(c), r"\[\d+(?:,\s*\d+)*\]", ""))


def ui_bucket(score, ai: float = 75, mixed: float = 35) -> Column:
    return F.when(score.isNull() | (score == 0), "none").when(score > ai, "ai").when(score > mixed, "mixed").otherwise("human")


def confidence_level(score) -> Column:
    return F.when(score > 30, "High").when(score > 15, "Medium").otherwise("Low")


def drop_refusal(c) -> Column:
    """The text without the service's refusal, whatever its case, stripped."""
    return strip(F.regexp_replace(blank(c), "(?iu)" + re.escape(P.SERVICE_REFUSAL), ""))
