"""Artefact counters, line rules, noise vector, document type and quality score, all as columns over a text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import blank, count_of, guarded, has_any, length_without, let, lines, strip

ARTIFACTS = ("emails", "urls", "udk_bbk", "doi", "access_mode", "bibliography", "url_fragments", "ocr_hyphens", "shy_hyphens", "ctrl_chars", "email_lines", "bom")
NOISE = ("ocr_catalog_like_tokens", "digit_letter_mixed_tokens", "suspicious_lines", "repeated_line_kinds", "repeated_line_kinds_soft", "standalone_page_like_lines", "catalog_like_lines", "issn_like_lines", "english_abstract_marker", "reflective_journal_markers", "front_matter_line_hits_head")


def any_of(*conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def artifacts(c) -> dict[str, Column]:
    """Twelve counters of layout artefacts.

    What no text without some string can match is only searched where that string occurs.
    """
    t, low = blank(c), F.lower(blank(c))
    found = {
        "emails": guarded(t.contains("@"), count_of(t, P.EMAIL)),
        "urls": guarded(t.contains("://"), count_of(t, P.URL)),
        "udk_bbk": guarded(has_any(low, "удк", "ббк", "udc", "bbk", "doi"), count_of(t, P.CLASSIFICATION_LINE)),
        "doi": guarded(t.contains("10."), count_of(t, P.DOI)),
        "access_mode": guarded(low.contains("доступа"), count_of(t, P.ACCESS_MODE)),
    }
    headers = has_any(low, "литератур", "источник", "библиограф", "reference", "bibliograph")
    found["bibliography"] = F.when(headers, t.rlike(P.BIBLIOGRAPHY_LINE) | t.rlike(P.BIBLIOGRAPHY_INLINE)).otherwise(False).cast("bigint")
    found["url_fragments"] = guarded(t.contains("/"), count_of(t, P.URL_FRAGMENT))
    found["ocr_hyphens"] = guarded(t.contains("-"), count_of(t, P.LINE_HYPHEN))
    found["shy_hyphens"] = F.length(t) - F.length(F.replace(t, F.lit(P.SOFT_HYPHEN), F.lit("")))
    found["ctrl_chars"] = F.length(t) - length_without(t, P.CONTROL)
    found["email_lines"] = guarded(low.contains("mail"), count_of(t, P.EMAIL_LINE))
    found["bom"] = F.length(t) - F.length(F.replace(t, F.lit("﻿"), F.lit("")))
    return {k: v.cast("bigint") for k, v in found.items()}


def is_meta_line(line) -> Column:
    """A line of front matter or boilerplate; expects a stripped line."""
    return F.length(line).between(1, 240) & (line.rlike(ANY_META_LINE) | is_running_header(line))


#: All of P.META_LINES as one pattern, each with its own flags.
ANY_META_LINE = "|".join(f"(?{m[1]}:{p[m.end():]})" if (m := re.match(r"\(\?([a-zA-Z]+)\)", p)) else f"(?:{p})" for p in P.META_LINES)


def is_running_header(line) -> Column:
    """A known running header; every one of them has one of these words."""
    return has_any(F.lower(line), "журнал", "академия", "izvestiya", "исследования", "issn") & line.rlike(P.RUNNING_HEADER)


def kept_lines(c) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def line_hits(array, test) -> Column:
    return F.size(F.filter(array, test)).cast("bigint")


def repeated_kinds(array, least: int) -> Column:
    """Distinct lines of 18 to 220 characters that occur `least` times or more.

    Equal lines stand together once sorted: a kind counts where a run has `least` lines before it ends.
    """

    def count(own):
        ends = lambda x, i: F.coalesce(F.try_element_at(own, i + 2), F.lit("")) != x
        long = lambda x, i: (i + 1 >= least) & (F.coalesce(F.try_element_at(own, F.greatest(i + 2 - least, F.lit(1))), F.lit("")) == x)
        return F.size(F.filter(own, lambda x, i: ends(x, i) & long(x, i)))

    return let(F.array_sort(F.filter(array, lambda x: F.length(x).between(18, 220))), count).cast("bigint")


def noise(c, every=None, own=None) -> dict[str, Column]:
    """Eleven counters of noise. `every` and `own`: the stripped lines and those that aren't blank, if a frame has them."""
    t = blank(c)
    every = F.transform(lines(c), strip) if every is None else every
    own = kept_lines(c) if own is None else own
    head = lambda n: F.slice(own, 1, n)
    return dict(
        zip(
            NOISE,
            (
                guarded(t.rlike(r"(?U)[Qq]\d|2[Qq]"), count_of(t, P.OCR_CATALOGUE)),
                guarded(t.rlike(r"(?U)\d\p{L}|\p{L}\d"), count_of(t, P.DIGIT_LETTER)),
                line_hits(head(120), lambda x: x.rlike(P.EDITORIAL_LINE) | x.rlike(P.COPYRIGHT_LINE)),
                repeated_kinds(own, 4),
                repeated_kinds(own, 2),
                line_hits(own, lambda x: x.rlike(P.PAGE_NUMBER)),
                line_hits(own, lambda x: x.rlike(P.CATALOGUE_LINE)),
                line_hits(own, lambda x: x.rlike(P.ISSN_FULL_LINE)),
                guarded(F.lower(t).contains("abstract"), t.rlike(P.ABSTRACT_MARK).cast("bigint")),
                line_hits(head(60), is_running_header),
                line_hits(F.slice(every, 1, 80), is_meta_line),
            ),
            strict=True,
        )
    )


def cyrillic(c) -> Column:
    return length_without(c, "[^Ѐ-ӿ]+")


def latin(c) -> Column:
    return length_without(c, "[^a-zA-Z]+")


def letters(c) -> Column:
    return length_without(c, r"\P{L}+")


def body_line_score(line) -> Column:
    """How much a stripped line looks like running prose, from 0 to 1."""
    cyr, lat, all_letters, n = cyrillic(line), latin(line), letters(line), F.size(F.split(line, r"(?U)\s+"))
    base = F.least(F.lit(1.0), F.length(line) / 130.0) * F.least(F.lit(1.0), n / 16.0)
    score = base * F.when(cyr / F.greatest(all_letters, F.lit(1)) >= 0.28, 1.25).otherwise(1.0) * F.when((lat > cyr * 3) & (cyr < 8), 0.35).otherwise(1.0)
    ok = (F.length(line) >= 42) & (n >= 7) & (all_letters >= 28) & (cyr + lat >= 22) & ~is_meta_line(line)
    return F.when(ok, F.least(F.lit(1.0), score)).otherwise(0.0)


def with_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds _every, the stripped lines, and _own, those that aren't blank: cut once for all rules that read them."""
    return df.withColumn("_every", F.transform(lines(F.col(text)), strip)).withColumn("_own", F.filter("_every", lambda x: x != ""))


def with_noise(df: DataFrame, text: str = "text") -> DataFrame:
    return with_lines(df, text).withColumns(noise(F.col(text), F.col("_every"), F.col("_own"))).drop("_every", "_own")


def document_type(df: DataFrame, text: str = "text", own: Column | None = None) -> DataFrame:
    """Adds four additive scores and probable_document_type to a frame that has the noise vector."""
    t = blank(F.col(text))
    n, own = F.length(t), kept_lines(F.col(text)) if own is None else own
    count, head = F.greatest(F.size(own), F.lit(1)), F.slice(own, 1, 40)
    mean = F.aggregate(head, F.lit(0.0), lambda a, x: a + F.length(x)) / F.greatest(F.size(head), F.lit(1))
    add = lambda *terms: F.least(F.lit(1.0), sum((F.when(test, w).otherwise(0.0) for test, w in terms), F.lit(0.0)))
    c, cyr = F.col, cyrillic(t)
    df = df.withColumns({
        "bibliographic_score": add((c("reflective_journal_markers") >= 2, 0.35), (c("ocr_catalog_like_tokens") > 15, 0.25), (c("catalog_like_lines") > 5, 0.2), ((c("front_matter_line_hits_head") > 18) & (n > 1500), 0.15)),
        "article_score": add(((mean > 55) & (c("repeated_line_kinds") < 6), 0.3), ((n > 2500) & (c("front_matter_line_hits_head") < 25), 0.25), (cyr > 400, 0.25), ((c("english_abstract_marker") > 0) & (cyr > 300), 0.1)),
        "noisy_score": add(((c("repeated_line_kinds") > 5) | (c("standalone_page_like_lines") > 6), 0.35), (c("ocr_catalog_like_tokens") > 25, 0.3), (c("digit_letter_mixed_tokens") > 40, 0.2)),
        "html_score": add(((n < 4500) & t.rlike(P.CAPTION_LINE), 0.25), ((n < 3500) & (mean < 42) & (count > 8), 0.2)),
    })
    b, a, o, h = (c(x) for x in ("bibliographic_score", "article_score", "noisy_score", "html_score"))
    top = F.greatest(b, a, o, h)
    first = F.when(b == top, "b").when(a == top, "a").when(o == top, "o").otherwise("h")
    kind = F.when(top < 0.28, "mixed_unknown").when((first == "b") & (b >= a + 0.12), "bibliographic_review_like").when((first == "o") & (o >= a), "noisy_ocr_like").when((first == "h") & (h >= 0.35), "html_news_like").when(a >= 0.35, "article_like").otherwise("mixed_unknown")
    return df.withColumn("probable_document_type", kind)


def portal_hits(c, pattern: str, head: int = 45, tail: int = 55) -> Column:
    """Lines of a portal's chrome in the first and last lines of a text."""
    own = F.transform(lines(c), strip)
    n = F.size(own)
    return F.size(F.filter(own, lambda x, i: ((i < head) | (i >= n - tail)) & x.rlike(pattern))).cast("bigint")


def quality(df: DataFrame, text: str = "text", kind: Column | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    """Adds quality_score (0 to 100) and quarantine_candidate; brings the noise vector and the document type along.

    `kind` overrides the document type where it isn't null; any of `more` quarantines as well.
    """
    t = blank(F.col(text))
    df = with_lines(df, text)
    df = document_type(df.withColumns(noise(F.col(text), F.col("_every"), F.col("_own"))), text, F.col("_own"))
    if kind is not None:
        df = df.withColumn("probable_document_type", F.coalesce(kind, "probable_document_type"))
    found = artifacts(F.col(text))
    n, solid, c = F.length(t), length_without(t, r"(?U)\s+"), F.col
    odd = F.length(t) - length_without(t, r"[\p{So}\p{Sk}\p{Sm}]+")
    df = df.withColumns({"_odd": F.coalesce(F.try_divide(odd, solid), F.lit(0.0)), "_biblio": found["bibliography"], "_urls": found["urls"], "_emails": found["emails"], "_cyr": cyrillic(t), "_lat": latin(t)})
    front = F.least(F.lit(1.0), c("front_matter_line_hits_head") / 45.0)
    repeated = F.least(F.lit(1.0), c("repeated_line_kinds") / 12.0)
    mismatch = (n > 800) & (c("english_abstract_marker") > 0) & (c("_cyr") > 200) & (c("_lat") > c("_cyr") * 0.4)
    penalty = (
        F.least(F.lit(25), c("ocr_catalog_like_tokens") * 2) + F.least(F.lit(15), c("digit_letter_mixed_tokens")) + F.least(F.lit(15), c("repeated_line_kinds") * 3) + F.least(F.lit(10), c("standalone_page_like_lines"))
        + F.least(F.lit(10.0), c("_odd") * 200) + c("_biblio") * 3 + F.least(F.lit(10), F.floor(c("_urls") / 2)) + F.least(F.lit(8), c("_emails") * 2) + front * 18 + repeated * 12
        + F.when(mismatch, 12).otherwise(0) + F.when(c("probable_document_type") == "bibliographic_review_like", 10).when(c("probable_document_type") == "noisy_ocr_like", 8).when(c("probable_document_type") == "portal_noise_heavy", 14).otherwise(0)
    )
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - penalty)), 2)
    df = df.withColumn("quality_score", score)
    quarantine = any_of(
        c("quality_score") < 42, c("ocr_catalog_like_tokens") > 40, c("_odd") > 0.085, (c("repeated_line_kinds") > 8) & (n > 500),
        (c("probable_document_type") == "bibliographic_review_like") & (c("bibliographic_score") > 0.72), (F.length(strip(t)) < 380) & (n > 1200), *more,
    )
    return df.withColumns({"suspicious_symbol_ratio": F.round("_odd", 5), "quarantine_candidate": quarantine}).drop("_odd", "_biblio", "_urls", "_emails", "_cyr", "_lat", "_every", "_own")


def artifact_totals(df: DataFrame, text: str = "text") -> DataFrame:
    """For each artefact: occurrences, documents that have it, and their share in percent. One pass, then a pivot of one row."""
    counted = df.select(*(v.alias(k) for k, v in artifacts(F.col(text)).items()))
    sums = counted.agg(F.count(F.lit(1)).alias("n"), *(F.sum(k).alias(f"s_{k}") for k in ARTIFACTS), *(F.count(F.when(F.col(k) > 0, 1)).alias(f"d_{k}") for k in ARTIFACTS))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("artifact"), F.coalesce(F.col(f"s_{k}"), F.lit(0)).alias("total"), F.col(f"d_{k}").alias("documents")) for k in ARTIFACTS)))
    return sums.select("n", rows.alias("r")).select("r.artifact", "r.total", "r.documents", F.round(F.coalesce(F.try_divide(F.col("r.documents") * 100.0, F.col("n")), F.lit(0.0)), 2).alias("share_pct"))


def explode_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, line) with stripped lines; blank lines stay, so positions are those of the text."""
    return df.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line")).withColumn("line", strip(F.col("line")))


def repeated_lines(df: DataFrame, key: str, text: str = "text", least: int = 4) -> DataFrame:
    """Lines of 18 to 220 characters that a text has `least` times or more, known running headers twice or more."""
    rows = explode_lines(df, key, text).filter(F.length("line").between(18, 220))
    counts = rows.groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    return counts.filter((F.col("n") >= least) | ((F.col("n") >= 2) & F.col("line").rlike(P.RUNNING_HEADER)))


def drop_repeated_lines(c, least: int = 4) -> Column:
    """The text without its repeated lines; runs of blank lines stay as they are."""

    def many(ordered):
        return F.array_distinct(F.filter(ordered, lambda x, i: (i + 1 >= least) & (F.coalesce(F.try_element_at(ordered, F.greatest(i + 2 - least, F.lit(1))), F.lit("")) == x)))

    def kept(own):
        ordered = F.array_sort(F.filter(F.transform(own, strip), lambda x: F.length(x).between(18, 220)))
        return let(let(ordered, many), lambda gone: F.array_join(F.filter(own, lambda x: ~F.array_contains(gone, strip(x))), "\n"))

    return let(lines(c), kept)


def head_trim(df: DataFrame, key: str, text: str = "text", scan: int = 110) -> DataFrame:
    """Where the prose of a text begins: (key, start_line, confidence, trimmed text). Texts under 850 characters or 10 lines stay."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = explode_lines(df, key, text).filter(F.col("pos") <= scan).withColumn("score", body_line_score(F.col("line")))
    rows = rows.withColumn("next", F.lead("score").over(w))
    start = rows.filter((F.col("pos") < scan) & (((F.col("score") >= 0.52) & (F.col("next") >= 0.38)) | ((F.col("score") >= 0.82) & (F.length("line") >= 100))))
    first = start.groupBy(key).agg(F.min(F.struct("pos", "score", "next")).alias("s"))
    sure = F.when((F.col("s.score") >= 0.52) & (F.col("s.next") >= 0.38), F.when(F.col("s.score") >= 0.7, 0.78).otherwise(0.62)).otherwise(0.55)
    own, n = lines(F.col(text)), F.length(blank(F.col(text)))
    joined = df.join(first, key, "left")
    cut = F.array_join(F.slice(own, F.col("s.pos") + 1, F.greatest(F.size(own) - F.col("s.pos"), F.lit(1))), "\n")
    ok = F.col("s").isNotNull() & (F.col("s.pos") > 0) & (n >= 850) & (F.size(own) >= 10) & (F.length(cut) >= 0.2 * n)
    return joined.select(key, F.when(ok, F.col("s.pos")).otherwise(0).alias("start_line"), F.when(ok, sure).otherwise(0.0).alias("confidence"), F.when(ok, cut).otherwise(F.col(text)).alias("trimmed"))
