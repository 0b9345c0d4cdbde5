"""Pages: titles, links, text and metadata by patterns; JSON-LD through from_json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, squeeze, strip_tags


def meta(html, name: str) -> Column:
    """Content of a meta tag by its name or property, in either order of attributes."""
    a = F.regexp_extract(html, rf"""(?is)<meta[^>]+(?:name|property)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]*(?:name|property)=["']{name}["']""", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def first_tag(html, tag: str) -> Column:
    return F.nullif(strip_tags(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))


def json_ld(html) -> Column:
    """struct(headline, datePublished, articleBody) of the first JSON-LD object that is an article or has one as its main entity."""
    fields = "`@type`:string,headline:string,datePublished:string,articleBody:string"
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    parse = lambda x: F.coalesce(F.from_json(x, f"array<struct<{fields},mainEntity:struct<{fields}>>>"), F.array(F.from_json(x, f"struct<{fields},mainEntity:struct<{fields}>>")))
    flat = F.flatten(F.transform(bodies, parse))
    kinds = ("NewsArticle", "Article")
    own = F.transform(F.filter(flat, lambda x: x["@type"].isin(*kinds)), lambda x: F.struct(x["headline"].alias("headline"), x["datePublished"].alias("datePublished"), x["articleBody"].alias("articleBody")))
    inner = F.transform(F.filter(flat, lambda x: x["mainEntity"]["@type"].isin(*kinds)), lambda x: F.struct(x["mainEntity"]["headline"].alias("headline"), x["mainEntity"]["datePublished"].alias("datePublished"), x["mainEntity"]["articleBody"].alias("articleBody")))
    return F.try_element_at(F.concat(own, inner), F.lit(1))


def title(html) -> Column:
    """Open Graph, then Twitter, then JSON-LD, then the first heading, then the title element."""
    return F.coalesce(meta(html, "og:title"), meta(html, "twitter:title"), F.nullif(json_ld(html)["headline"], F.lit("")), first_tag(html, "h1"), first_tag(html, "title"), F.lit(""))


def published(html) -> Column:
    return F.coalesce(meta(html, "article:published_time"), F.nullif(json_ld(html)["datePublished"], F.lit("")), F.nullif(F.regexp_extract(html, r"""(?is)<time[^>]+datetime=["']([^"']+)["']""", 1), F.lit("")), F.lit(""))


def paragraphs(html, least: int = 40, most: int = 80) -> Column:
    """Texts of the first paragraphs longer than `least` characters."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</p>|<p[\s>]|</article>)"), F.lit(1)), strip_tags)
    return F.slice(F.filter(found, lambda x: F.length(x) > least), 1, most)


def blocks(html) -> Column:
    """Texts of all paragraphs, second headings and list items that have any; a block inside another one is taken for itself."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(p|h2|li)(?:\s[^>]*)?>(.*?)(?=</\1>|<(?:p|h2|li)[\s>]|</article>|$)"), F.lit(2))
    return F.filter(F.transform(found, strip_tags), lambda x: x != "")


def body(html) -> Column:
    """JSON-LD body, or all blocks of a page that has an article, or the first 80 long paragraphs of the page."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    whole = F.when(bare.rlike(r"(?i)<article[\s>]"), blocks(bare))
    join = lambda x: F.array_join(x, "\n")
    return F.coalesce(F.nullif(json_ld(html)["articleBody"], F.lit("")), F.nullif(join(whole), F.lit("")), join(paragraphs(bare)))


def articles(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    h = blank(F.col(html))
    return pages.withColumns({"title": title(h), "published_at": published(h), "text": body(h)})


def links(pages: DataFrame, key: str, html: str = "html", most: int | None = None) -> DataFrame:
    """All distinct links of a page, or the first `most`, in order, without fragments: (key, pos, href)."""
    found = F.transform(F.regexp_extract_all(blank(F.col(html)), F.lit(r"""(?is)<a[^>]+href=["']([^"'#]+)"""), F.lit(1)), squeeze)
    distinct = F.array_distinct(F.filter(found, lambda x: x != ""))
    return pages.select(key, F.posexplode(distinct if most is None else F.slice(distinct, 1, most)).alias("pos", "href"))


def same_site(links: DataFrame, pages: DataFrame, key: str, url: str = "url") -> DataFrame:
    """Links resolved against their page, those to its host only."""
    host = F.regexp_extract(F.col(url), r"^(https?://[^/]+)", 1)
    full = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(host, F.col("href"))).otherwise(F.concat(host, F.lit("/"), F.col("href")))
    joined = links.join(pages.select(key, url), key).withColumn("full", full).filter(F.col("full").startswith(host))
    first = F.row_number().over(Window.partitionBy(key, "full").orderBy("pos"))
    return joined.withColumn("_r", first).filter("_r = 1").select(key, "pos", "full")
