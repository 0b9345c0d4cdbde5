"""Where an article begins and ends inside a text: lead-in of another one, tail sections, portal chrome, English blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import blank, let, lines, strip
from . import quality as Q


def stripped_lines(c) -> Column:
    return F.transform(lines(c), strip)


def is_tail_header(line) -> Column:
    return F.length(line).between(1, 240) & line.rlike(P.TAIL_HEADER)


def latin_ratio(c) -> Column:
    return F.coalesce(F.try_divide(Q.latin(c), Q.letters(c)), F.lit(0.0))


def first_hit(own, rule) -> Column:
    """struct(pos, confidence) of the first line for which rule(line, index) gives a confidence; null where none does."""
    hits = F.transform(own, lambda x, i: F.struct(i.alias("pos"), rule(x, i).alias("confidence")))
    return F.try_element_at(F.filter(hits, lambda h: h["confidence"].isNotNull()), F.lit(1))


def article_start(c, scan: int = 130) -> Column:
    """First line of two that read like prose, or of a long one; surer where the head is mostly short lines. Texts under 650 characters or 14 lines have none."""

    def find(own):
        head = F.slice(own, 1, scan)
        thin = F.size(F.filter(head, lambda x: F.length(x) < 36)) / F.size(head)
        boost = F.when(thin >= 0.42, 0.15).otherwise(0.0)
        # one more line than is scanned, for the neighbour of the last
        rated = F.transform(F.slice(own, 1, scan + 1), Q.body_line_score)

        def rule(scores):
            def one(x, i):
                after, here = F.coalesce(F.try_element_at(scores, i + 2), F.lit(0.0)), F.element_at(scores, i + 1)
                return F.when((i + 1 < F.size(own)) & (here >= 0.48) & (after >= 0.35), 0.62 + boost).when((here >= 0.78) & (F.length(x) >= 88), 0.52 + boost)

            return first_hit(head, one)

        return F.when((F.length(blank(c)) >= 650) & (F.size(own) >= 14), let(rated, rule))

    return let(stripped_lines(c), find)


def article_end(c, tail: int = 110, least: int = 22, share: float = 0.40) -> Column:
    """First line of the tail zone that begins a tail section (.78), carries codes of a next article (.55), or is a title in capitals after blank or Latin lines (.42)."""

    def find(own):
        n = F.size(own)
        low = F.greatest(F.floor(n * share), F.lit(8), n - tail)
        line = lambda i: F.when(i >= 0, F.coalesce(F.try_element_at(own, F.when(i >= 0, i + 1)), F.lit(""))).otherwise("")

        def rule(x, i):
            before = F.concat(line(i - 1), F.lit("\n"), line(i - 2))
            caps = x.rlike(P.CAPS_TITLE) & (i >= F.floor(n * 0.55)) & ((before == "\n") | (latin_ratio(before) > 0.55))
            return F.when(i >= low, F.when(is_tail_header(x), 0.78).when(x.rlike(P.NEXT_ARTICLE), 0.55).when(caps, 0.42))

        return F.when(n >= least, first_hit(own, rule))

    return let(stripped_lines(c), find)


def trim_start(c, sure: float = 0.58, keep: float = 0.18) -> Column:
    """The text from its probable start on, where that is sure enough and keeps enough."""

    def cut(s):
        rest = strip(F.array_join(F.slice(lines(c), s["pos"] + 1, F.greatest(F.size(lines(c)) - s["pos"], F.lit(1))), "\n"))
        return let(rest, lambda r: F.when((s["pos"] > 0) & (s["confidence"] >= sure) & (F.length(r) >= F.length(c) * keep), r).otherwise(c))

    return let(article_start(c), lambda s: F.when(s.isNotNull(), cut(s)).otherwise(c))


def trim_tail(c, sure: float = 0.40, keep: float = 0.12) -> Column:
    """The text up to its probable end."""

    def cut(s):
        rest = F.regexp_replace(F.array_join(F.slice(lines(c), 1, s["pos"]), "\n"), r"(?U)\s+$", "")
        return let(rest, lambda r: F.when((s["confidence"] >= sure) & ((F.length(r) >= F.length(c) * keep) | (F.length(r) >= 120)), r).otherwise(c))

    return let(article_end(c), lambda s: F.when(s.isNotNull(), cut(s)).otherwise(c))


def before(c, pattern: str) -> Column:
    """Characters in front of a pattern, null where it isn't there."""
    n = F.length(F.element_at(F.split(c, pattern, 2), 1))
    return F.when(n < F.length(c), n)


def strip_english(c, floor: int = 20, most: int = 4000, passes: int = 3) -> Column:
    """A Russian text without its English abstract, summary or key words; blocks with much Cyrillic stay."""

    def one(t):
        def cut(start):
            rest = F.substring(t, start + 1, F.length(t))
            block = F.left(rest, F.lit(most))
            late = before(F.substring(block, 81, F.lit(most)), P.RUSSIAN_LINE) + 80
            end = F.coalesce(before(block, P.RUSSIAN_PARAGRAPH), late, F.length(block))

            def drop(e):
                gone = F.left(rest, e)
                cyr, lat = Q.cyrillic(gone), Q.latin(gone)
                stays = ((cyr > 95) & (cyr > lat * 0.35)) | ((latin_ratio(gone) < 0.45) & (F.length(gone) > 120))
                return F.when(stays, t).otherwise(F.concat(F.left(t, start), F.substring(rest, e + 1, F.length(rest))))

            return let(end, drop)

        chunk = F.substring(t, floor + 1, F.length(t))
        start = F.coalesce(*(before(chunk, p) for p in P.ENGLISH_HEADERS)) + floor
        return F.when(F.length(t) >= floor + 30, let(start, lambda s: F.when(s.isNotNull(), cut(s)).otherwise(t))).otherwise(t)

    for _ in range(passes):
        c = let(c, one)
    return c


def strip_english_tail(c, window: int = 4800, most: int = 3200) -> Column:
    """The same for a block in the last characters of a text, behind at least 35 % of it."""

    def one(t):
        n = F.length(t)
        low = F.greatest(n - window, F.lit(0))
        start = F.coalesce(*(before(F.substring(t, low + 1, n), p) for p in P.ENGLISH_TAIL_HEADERS)) + low

        def cut(s):
            rest = F.substring(t, s + 1, n)
            end = F.coalesce(before(F.left(rest, F.lit(most)), P.RUSSIAN_TAIL_PARAGRAPH), F.least(F.lit(most), F.length(rest)))
            return let(end, lambda e: F.when((latin_ratio(F.left(rest, e)) < 0.40) & (e > 80), t).otherwise(F.concat(F.regexp_replace(F.left(t, s), r"(?U)\s+$", ""), F.substring(rest, e + 1, n))))

        return F.when(n >= 400, let(start, lambda s: F.when(s.isNotNull() & (s >= n * 0.35), cut(s)).otherwise(t))).otherwise(t)

    return let(c, one)


def is_portal_line(line, variant: str) -> Column:
    """A menu or footer line of a portal; Pikabu's tag walls count by their separators."""
    hit = line.rlike(P.PORTAL_LINES[variant])
    if variant == "pravda_ua":
        hit = hit | ((F.length(line) < 220) & line.rlike(P.PRAVDA_UA_MENU))
    if variant == "pikabu":
        count = lambda mark: (F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))) / len(mark)
        hit = hit | ((count("·") + count(" | ") + count(" • ") >= 4) & (F.length(line) < 210) & (count(" ") < 35))
    return F.length(line).between(1, 260) & hit


#: What a text has at least if one of its lines is a portal's.
PORTAL_SIGNS = {
    "pravda": "[Ѐ-ӿ]",
    "pravda_ua": r"(?i)[Ѐ-ӿ]|redaction@|press@|@pravda|tel\.?\s*[:\-]?\s*\+380",
    "pikabu": r"(?im)[Ѐ-ӿ·|•]|^\s*it\s*$",
    "mail_ru": "(?i)[Ѐ-ӿ]|mail",
}


def portal_hits(c, variant: str, head: int = 40, tail: int = 45, own: Column | None = None) -> Column:
    """Portal lines among the first and last lines; `own`: the stripped lines, if a frame has them."""

    def count(own):
        n = F.size(own)
        near = F.filter(own, lambda x, i: ((i < head) | (i >= n - tail)) & (x != ""))
        return F.when(n >= 3, F.size(F.filter(near, lambda x: is_portal_line(x, variant)))).otherwise(0)

    return F.when(blank(c).rlike(PORTAL_SIGNS[variant]), let(stripped_lines(c), count) if own is None else count(own)).otherwise(0)


def drop_portal(c, variant: str, head: int = 45, tail: int = 55) -> Column:
    def kept(own):
        n = F.size(own)
        return F.array_join(F.filter(own, lambda x, i: ~((n >= 4) & ((i < head) | (i >= n - tail)) & let(strip(x), lambda s: is_portal_line(s, variant)))), "\n")

    return let(lines(c), kept)


def drop_rbc_footer(c, tail: int = 38) -> Column:
    return let(lines(c), lambda own: F.array_join(F.filter(own, lambda x, i: ~((F.size(own) >= 2) & (i >= F.size(own) - tail) & x.rlike(P.RBC_FOOTER))), "\n"))


def trim_pikabu_tail(c, scan: int = 90) -> Column:
    """The text up to its last line that is neither blank nor portal chrome, if chrome follows within the last lines."""

    def cut(own):
        n = F.size(own)
        real = F.transform(own, lambda x, i: F.struct(i.alias("i"), (((x != "") & ~is_portal_line(x, "pikabu")) | (i < n - scan)).alias("real")))
        last = F.coalesce(F.try_element_at(F.filter(real, lambda x: x["real"]), F.lit(-1))["i"], F.lit(-1))
        chrome = F.exists(F.slice(own, last + 2, n), lambda x: x != "")
        return F.when((n >= 10) & chrome, F.regexp_replace(F.array_join(F.slice(lines(c), 1, last + 1), "\n"), r"(?U)\s+$", "")).otherwise(c)

    return let(stripped_lines(c), cut)


def next_article_bleed(c, share: float = 0.38, own: Column | None = None) -> Column:
    """Whether the last lines carry signs of another article: codes count two, tail headers one, three are enough."""

    def found(own):
        tail = F.filter(own, lambda x, i: i >= F.floor(F.size(own) * (1 - share)))
        points = F.aggregate(tail, F.lit(0), lambda a, x: a + x.rlike(P.NEXT_ARTICLE).cast("int") * 2 + is_tail_header(x).cast("int"))
        return (F.size(own) >= 18) & (points >= 3)

    return let(Q.kept_lines(c), found) if own is None else found(own)


def drop_title_prefix(c, title) -> Column:
    """The text without a title of twelve characters or more that it begins with."""
    body, head = F.regexp_replace(c, r"(?U)^\s+", ""), strip(blank(title))
    return F.when((F.length(head) >= 12) & F.lower(body).startswith(F.lower(head)), F.regexp_replace(F.substring(body, F.length(head) + 1, F.length(body)), r"(?U)^\s+", "")).otherwise(c)


def quality(df: DataFrame, text: str = "text") -> DataFrame:
    """quality.quality with portal walls and signs of a next article: adds portal_chrome_hits and next_article_bleed."""
    t, n, c = F.col(text), F.length(blank(F.col(text))), F.col
    every, hits = F.col("_every"), lambda variant, *zone: portal_hits(t, variant, *zone, own=F.col("_every"))
    df = Q.with_lines(df, text).withColumns({
        "_wall": hits("pikabu", 52, 78),
        "portal_chrome_hits": F.greatest(hits("pravda"), hits("pravda_ua", 52, 62), hits("pikabu"), hits("mail_ru")),
        "next_article_bleed": next_article_bleed(t, own=F.filter(every, lambda x: x != "")),
    })
    heavy = (c("_wall") >= 10) & (n > 550)
    unsure = c("probable_document_type").isin("mixed_unknown", "html_news_like")
    kind = F.when(heavy & ((c("_wall") >= 14) | ((c("_wall") >= 11) & unsure)), "portal_noise_heavy")
    more = ((c("portal_chrome_hits") > 14) & (n < 2800), c("next_article_bleed") & (n > 2200) & (c("probable_document_type") != "article_like"), c("probable_document_type") == "portal_noise_heavy", heavy & (c("_wall") >= 16))
    return Q.quality(df, text, kind, more).drop("_wall")
