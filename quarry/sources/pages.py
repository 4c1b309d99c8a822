"""Web pages: title, metas, skip directives, plain text, and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import attribute, decode_entities, legal, normalise_space, tokens

_META = r"(?is)<meta\s+([^>]*)>"


def title(html: Column) -> Column:
    """The text of the first title element, entities decoded, empty if there is none."""
    return decode_entities(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1))


def plain_text(html: Column) -> Column:
    """The page without scripts, styles, comments and tags; entities decoded, white space as single blanks."""
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return normalise_space(decode_entities(html))


def metas(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, name, content): a row per meta with a `name` or `http-equiv` and a `content`, in any order and quotes."""
    tag = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_META), F.lit(1))).alias("tag")
    own = pages.select("page_id", tag).select("page_id", F.coalesce(attribute(F.col("tag"), "name"), attribute(F.col("tag"), "http-equiv")).alias("name"), attribute(F.col("tag"), "content").alias("content"))
    return own.filter("name is not null and content is not null")


def meta_terms(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(term, page_id), distinct: `NAME:word` for the words of each meta, its name in upper case and without blanks."""
    field = F.upper(F.regexp_replace("name", r"\s+", ""))
    words = F.explode(F.array_distinct(tokens(decode_entities(F.col("content"))))).alias("word")
    term = F.concat(F.col("field"), F.lit(":"), F.col("word"))
    return metas(pages, html_col).select("page_id", field.alias("field"), words).select(term.alias("term"), "page_id").filter(legal(F.col("term"))).distinct()


def links(pages: DataFrame, name: str | None = None, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, target), distinct: where the page's anchors lead, seen from its address; none from pages that say `skiplinks`."""
    tag = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<a\s+([^>]*)>"), F.lit(1))).alias("tag")
    own = pages.select("page_id", url_col, tag).select("page_id", url_col, decode_entities(attribute(F.col("tag"), "href")).alias("href"))
    found = own.filter("href <> ''").select("page_id", absolute(F.col(url_col), F.col("href")).alias("target")).distinct()
    return found if name is None else found.join(directives(pages, name, html_col).filter("skip_links"), "page_id", "left_anti")


def absolute(base: Column, href: Column) -> Column:
    """The address that `href` means on a page at `base`: with a scheme as it is, else against its host or folder; `.` and `..` are followed."""
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.regexp_extract(F.substr(base, F.length(origin) + 1), "^([^?#]*/)", 1)
    joined = F.when(href.startswith("/"), href).otherwise(F.concat(F.when(path == "", F.lit("/")).otherwise(path), href))
    only = F.regexp_extract(joined, "^([^?#]*)", 1)
    kept = F.aggregate(
        F.split(only, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    followed = F.concat(origin, F.array_join(kept, "/"), F.substr(joined, F.length(only) + 1))
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).otherwise(followed)


def directives(pages: DataFrame, name: str, html_col: str = "html") -> DataFrame:
    """(page_id, skip, skip_meta, skip_links, skip_text) from metas called `name`; values are parted by blanks."""
    own = metas(pages, html_col).filter(F.lower("name") == name.lower()).select("page_id", F.explode(F.split(F.lower(F.trim("content")), " +")).alias("value"))
    flags = [F.bool_or(F.col("value") == value).alias(column) for value, column in (("skip", "skip"), ("skipmeta", "skip_meta"), ("skiplinks", "skip_links"), ("skiptext", "skip_text"))]
    found = own.groupBy("page_id").agg(*flags)
    no = F.lit(False)
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", *[F.coalesce(c, no).alias(c) for c in ("skip", "skip_meta", "skip_links", "skip_text")])


def without_skipped(html: Column, tag: str) -> Column:
    """The page without the spans between `<tag skip>` and `</tag>`."""
    return F.regexp_replace(html, f"(?is)<{tag}\\s+skip\\s*>.*?</{tag}>", " ")


def indexable(pages: DataFrame, name: str, html_col: str = "html") -> DataFrame:
    """`pages` with title and text as they are to be indexed: skipped pages are gone, skipped texts empty."""
    flags = directives(pages, name, html_col)
    html = without_skipped(F.col(html_col), name)
    return (
        pages.join(flags, "page_id")
        .filter(~F.col("skip"))
        .withColumn("title", title(F.col(html_col)))
        .withColumn("text", F.when(F.col("skip_text"), "").otherwise(plain_text(html)))
    )


def resolve_redirects(edges: DataFrame) -> DataFrame:
    """(src, target, hops): where each source of (src, dst) ends and after how many steps; both null for a loop.

    Targets are seen from their sources' addresses. Each round doubles the steps taken, by one join of the sources with
    themselves, so a chain of any length ends after as many rounds as its length has bits; what has not ended after more
    steps than there are sources is in a loop. Of several edges of one source the smallest address counts.
    """
    src = F.col("src")
    at = edges.select("src", F.when(src.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), absolute(src, F.col("dst"))).otherwise(F.col("dst")).alias("target"))
    at = at.groupBy("src").agg(F.min("target").alias("target")).withColumn("hops", F.lit(1).cast("bigint"))
    sources, steps = at.count(), 1
    known = at.select(F.col("src").alias("known"))
    while steps <= sources:
        on = at.select(F.col("src").alias("via"), F.col("target").alias("then"), F.col("hops").alias("more"))
        at = at.join(on, F.col("target") == F.col("via"), "left").select(
            "src", F.coalesce("then", "target").alias("target"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")
        )
        if edges.sparkSession.conf.get("spark.checkpoint.dir", None):
            at = at.checkpoint()
        steps *= 2
    ended = at.join(known, F.col("target") == F.col("known"), "left")
    return ended.select("src", *[F.when(F.col("known").isNull(), F.col(c)).alias(c) for c in ("target", "hops")])
