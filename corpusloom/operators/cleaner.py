"""Article cleaners as one column expression each: every step is a guarded replacement."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import blank, folded, let, lines, needle, strip, strip_tags
from . import boundaries as B
from . import quality as Q

#: Typographic characters and what they become.
TYPOGRAPHY = {"“": '"', "”": '"', "«": '"', "»": '"', "‘": "'", "’": "'", " ": " "}


@dataclass(frozen=True)
class Flags:
    """Which steps run. The defaults are those of an unknown source."""

    html: bool = True
    unicode: bool = True
    control: bool = True
    backslash: bool = True
    line_hyphen: bool = True
    bibliography: bool = True
    authors: bool = True
    classification: bool = True
    urls: bool = True
    access: bool = True
    email_lines: bool = True
    emails: bool = True
    doi: bool = True
    url_fragments: bool = True
    keywords: bool = False
    footnotes: bool = False
    inline_refs: bool = False
    cite_en: bool = False
    page_numbers: bool = False
    repeated_lines: bool = False
    front_matter: bool = False
    captions: bool = False
    prompts: bool = False
    portal: str = ""
    rbc_footer: bool = False
    pikabu_tail: bool = False
    leading_bleed: bool = False
    english_abstract: bool = False
    tail_sections: bool = False


#: Profiles by source: what they switch on.
PROFILES = {
    "cyberleninka_html_ocr": Flags(page_numbers=True, repeated_lines=True, front_matter=True, prompts=True, keywords=True, leading_bleed=True, english_abstract=True, tail_sections=True),
    "lenta_html": Flags(captions=True),
    "rbc_html": Flags(captions=True, rbc_footer=True),
    "newsapi_pikabu": Flags(portal="pikabu", pikabu_tail=True),
    "newsapi_pravda_ua": Flags(portal="pravda_ua"),
    "newsapi_pravda": Flags(portal="pravda"),
    "newsapi_mail_ru": Flags(portal="mail_ru"),
    "": Flags(),
}


def profile_name(source, outlet=None, text_source=None) -> Column:
    """Profile of a row by its source and outlet."""
    s, o = F.lower(blank(source)), F.lower(blank(outlet if outlet is not None else F.lit("")))
    both = F.concat_ws(" ", s, o)
    return (
        F.when(s.contains("cyberleninka"), "cyberleninka_html_ocr").when(s.contains("lenta"), "lenta_html").when(s.contains("rbc"), "rbc_html").when(both.contains("pikabu"), "newsapi_pikabu")
        .when(both.contains("pravda.com.ua"), "newsapi_pravda_ua").when(both.contains("pravda"), "newsapi_pravda").when(both.contains("mail.ru"), "newsapi_mail_ru").otherwise("")
    )


def drop(c, pattern: str, by: str = "") -> Column:
    """Matches replaced; a text without the longest word of the pattern isn't searched."""
    word = needle(pattern)
    if len(word) < 3:
        return F.regexp_replace(c, pattern, by)
    return let(c, lambda t: F.when(folded(t).contains(word), F.regexp_replace(t, pattern, by)).otherwise(t))


def normalize_characters(c) -> Column:
    """Typographic characters to plain ones; a long dash gets spaces. Composition (NFC) is nfc()."""
    c = F.translate(c, "".join(TYPOGRAPHY), "".join(TYPOGRAPHY.values()))
    return F.replace(F.replace(c, F.lit("—"), F.lit(" — ")), F.lit("﻿"), F.lit(""))


def nfc(c) -> Column:
    """Canonical composition, which Spark has no function for: an Arrow UDF, applied where a text needs it."""
    compose = F.pandas_udf(lambda texts: texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore"), "string")
    return F.when(c.rlike(r"\p{M}"), compose(c)).otherwise(c)


def where_has(c, mark: str, step) -> Column:
    """A step that runs only on texts with a mark, which is cheap to look for."""
    return let(c, lambda t: F.when(t.contains(mark), step(t)).otherwise(t))


def cut_bibliography(c) -> Column:
    """The text in front of a bibliography header, unless too little would stay."""

    def cut(t):
        n = F.length(t)
        line = F.length(F.element_at(F.split(t, P.BIBLIOGRAPHY_LINE, 2), 1))
        inline = F.length(F.element_at(F.split(t, P.BIBLIOGRAPHY_INLINE, 2), 1))
        by_line = F.when((line < n) & (line >= F.greatest(n * 0.06, F.lit(5.0))), line)
        floor = F.when(n > 900, F.lit(100.0)).otherwise(F.greatest(F.lit(28.0), n * 0.22))
        by_inline = F.when((inline < n) & (inline >= F.greatest(n * 0.10, floor)), inline)
        return F.left(t, F.coalesce(F.least(by_line, by_inline), n))

    return let(c, cut)


def keep_lines(c, test) -> Column:
    return F.array_join(F.filter(lines(c), test), "\n")


def clean(c, flags: Flags = Flags()) -> Column:  # noqa: B008
    """The cleaned text; null and empty texts stay as they are."""
    f = flags
    steps = [
        (f.html, lambda t: let(t, lambda x: F.when(x.contains("<") & x.contains(">"), strip_tags(x)).otherwise(x))),
        (f.unicode, normalize_characters),
        (f.control, lambda t: drop(F.replace(t, F.lit(P.SOFT_HYPHEN), F.lit("")), P.CONTROL)),
        (f.backslash, lambda t: where_has(t, "\\", lambda x: drop(x, P.STRAY_BACKSLASH, " "))),
        (f.portal, lambda t: B.drop_portal(t, f.portal)),
        (f.rbc_footer, B.drop_rbc_footer),
        (f.pikabu_tail, lambda t: let(t, lambda x: B.trim_pikabu_tail(x))),
        (f.prompts, lambda t: drop(t, P.PORTAL_PROMPT)),
        (f.captions, lambda t: keep_lines(t, lambda x: ~strip(x).rlike(P.CAPTION_LINE))),
        (f.page_numbers, lambda t: keep_lines(t, lambda x: ~strip(x).rlike(P.PAGE_NUMBER))),
        (f.repeated_lines, Q.drop_repeated_lines),
        (f.front_matter, lambda t: keep_lines(t, lambda x, i: (i >= 100) | ~let(strip(x), Q.is_meta_line))),
        (f.line_hyphen, lambda t: drop(t, P.LINE_HYPHEN, "$1$2")),
        (True, lambda t: drop(t, P.SPACE_HYPHEN, "$1$2")),
        (f.leading_bleed, lambda t: let(t, lambda x: B.trim_start(x))),
        (f.bibliography, cut_bibliography),
        (f.authors, lambda t: drop(drop(t, P.AUTHORS_RU), P.AUTHORS_EN)),
        (f.classification, lambda t: drop(t, P.CLASSIFICATION_LINE)),
        (f.urls, lambda t: where_has(t, ":", lambda x: drop(x, P.URL))),
        (f.access, lambda t: drop(drop(t, P.ACCESS_MODE), P.ACCESS_DATE)),
        (f.email_lines, lambda t: drop(t, P.EMAIL_LINE)),
        (True, lambda t: drop(t, P.CITE_RU)),
        (f.emails, lambda t: where_has(t, "@", lambda x: drop(x, P.EMAIL))),
        (f.doi, lambda t: drop(t, P.DOI)),
        (f.url_fragments, lambda t: where_has(t, "/", lambda x: drop(drop(x, P.URL_FRAGMENT), P.URL_PATH))),
        (f.keywords, lambda t: drop(t, P.KEYWORDS)),
        (f.footnotes, lambda t: drop(drop(t, P.FOOTNOTE_NUMBER), P.FOOTNOTE_BRACKET)),
        (f.inline_refs, lambda t: drop(drop(t, P.REF_ROUND), P.REF_SQUARE)),
        (f.cite_en, lambda t: drop(t, P.CITE_EN)),
        (f.english_abstract, B.strip_english),
        (f.tail_sections, lambda t: let(t, lambda x: B.trim_tail(x))),
        (f.tail_sections and f.english_abstract, B.strip_english_tail),
        (True, lambda t: strip(drop(drop(t, "[ \t]{2,}", " "), "\n{3,}", "\n\n"))),
    ]
    t = c
    for on, step in steps:
        if on:
            t = step(t)
    return F.when(c.isNull() | (c == ""), c).otherwise(t)


def clean_frame(df: DataFrame, text: str = "text", flags: Flags | None = None, by_profile: bool = False, source: str = "source", outlet: str | None = None) -> DataFrame:
    """Adds text_clean, text_length_clean and, by profile, clean_profile: each row runs the steps of its own profile."""
    if not by_profile:
        return df.withColumn("text_clean", clean(F.col(text), flags or Flags())).withColumn("text_length_clean", F.length(blank(F.col("text_clean"))))
    name = profile_name(F.col(source), F.col(outlet) if outlet else None)
    df = df.withColumn("clean_profile", name)
    cleaned = None
    for profile, own in PROFILES.items():
        step = clean(F.col(text), own)
        cleaned = F.when(F.col("clean_profile") == profile, step) if cleaned is None else cleaned.when(F.col("clean_profile") == profile, step)
    return df.withColumn("text_clean", cleaned).withColumn("text_length_clean", F.length(blank(F.col("text_clean"))))


def clean_report(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Artefacts and quality before and after cleaning, and the share of characters that stayed."""
    both = clean_frame(df, text)
    side = lambda column, suffix: Q.quality(both.select(key, F.col(column).alias("t")).withColumns({k: v for k, v in Q.artifacts(F.col("t")).items()}), "t").select(key, *(F.col(c).alias(f"{c}_{suffix}") for c in ("emails", "urls", "bibliography", "quality_score", "probable_document_type", "quarantine_candidate")))
    sizes = both.select(key, F.length(blank(F.col(text))).alias("raw_length"), F.col("text_length_clean").alias("clean_length"), F.round(F.coalesce(F.try_divide(F.length(blank(F.col(text))) - F.col("text_length_clean"), F.length(blank(F.col(text)))), F.lit(0.0)), 6).alias("removed_ratio"))
    return sizes.join(side(text, "before"), key).join(side("text_clean", "after"), key)


#: Latin letters that look like Cyrillic ones.
HOMOGLYPHS = dict(zip("aeopcxyABEKMHOPCTX", "аеорсхуАВЕКМНОРСТХ", strict=True))
BIBLIOGRAPHY_END = r"(?isu)\n\s*(?:список\s+(?:литературы|источников)|литература|библиография|references|bibliography)\s*[:.]?\s*\n.*$"


def fix_homoglyphs(c) -> Column:
    """Look-alike Latin letters next to Cyrillic ones become Cyrillic."""
    for latin, own in HOMOGLYPHS.items():
        c = F.regexp_replace(c, f"(?<=[а-яА-ЯёЁ]){latin}|{latin}(?=[а-яА-ЯёЁ])", own)
    return c


def clean_prose(c, least: int = 50) -> Column:
    """The second cleaner: seventeen steps; a result of under `least` characters becomes empty."""
    t = drop(F.translate(blank(c), " ​‌‍﻿⁠", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
    t = drop(t, BIBLIOGRAPHY_END)
    t = drop(t, P.LINE_HYPHEN, "$1$2")
    t = drop(drop(drop(t, r"(?i)https?://\S+|www\.\S+", " "), r"(?i)doi:\s*\S+", " "), P.EMAIL, " ")
    t = drop(drop(t, r"\[\d+(?:\s*[,;–-]\s*\d+)*\]"), r"\((?:[А-ЯЁA-Z][а-яёa-z]+(?:\s+(?:и|and|et al\.?))?[^()]{0,60}?,\s*)?(?:19|20)\d{2}[а-яa-z]?\)")
    t = drop(t, r"(?imu)^\s*(?:табл(?:ица)?|рис(?:унок)?|table|fig(?:ure)?)\.?\s*\d+[^\n]*$")
    t = drop(drop(t, r"(?m)^\s*\(\d+(?:\.\d+)?\)\s*$"), r"(?m)^\s*[–—-]?\s*\d{1,4}\s*[–—-]?\s*$")
    caps = lambda x: x.rlike(r"^[\p{Lu}\p{N}\p{P}\s]+$") & x.rlike(r"\p{Lu}{2}") & (F.size(F.split(x, r"\s+")) <= 6)
    t = keep_lines(t, lambda x: ~let(strip(x), caps))
    t = fix_homoglyphs(t)
    t = drop(t, r"(?U)(?<=\s)[a-zA-Z](?=\s)", " ")
    t = drop(drop(drop(t, r"\s+([,.;:!?])", "$1"), r"([,;:])\1+", "$1"), r"\(\s*\)")
    t = strip(drop(drop(drop(t, r"(?<!\n)\n(?!\n)", " "), "[ \t]{2,}", " "), "\n{3,}", "\n\n"))
    return let(t, lambda x: F.when(F.length(x) < least, F.lit("")).otherwise(x))


def audit_prose(c) -> dict[str, Column]:
    """Diagnostics of a text before the second cleaner."""
    t = blank(c)
    tests = {"urls": r"(?i)https?://\S+", "emails": P.EMAIL, "dois": r"(?i)doi:\s*\S+", "numeric_refs": r"\[\d+(?:\s*[,;–-]\s*\d+)*\]", "hyphen_breaks": P.LINE_HYPHEN, "control_chars": r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "zero_width": "[​‌‍﻿⁠]", "nbsp": " ", "page_lines": r"(?m)^\s*\d{1,4}\s*$", "captions": r"(?imu)^\s*(?:табл(?:ица)?|рис(?:унок)?|table|fig(?:ure)?)\.?\s*\d+", "mixed_script": "[а-яё][a-z]|[a-z][а-яё]", "double_spaces": " {2,}"}
    return {k: F.regexp_count(t, F.lit(p)).cast("bigint") for k, p in tests.items()} | {"length": F.length(t).cast("bigint")}


def with_flags(base: Flags, **changes) -> Flags:
    return replace(base, **changes)
