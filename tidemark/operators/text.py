"""Text of statements and pages: keyword counts, sentences, dates, links, paragraphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import keyword_hits


def keyword_counts(df: DataFrame, text: str, lists: dict[str, list[str]]) -> DataFrame:
    """df with, for each list, <name>_count: hits of its words, an entry that overlaps another counting too."""
    return df.withColumns({f"{n}_count": reduce(lambda a, b: a + b, [keyword_hits(F.col(text), F.lit(w)) for w in words]) for n, words in lists.items()})


def net_label(text: Column, up: list[str], down: list[str]) -> Column:
    """up, down or neutral by the sign of the keyword balance."""
    net = reduce(lambda a, b: a + b, [keyword_hits(text, F.lit(w)) for w in up]) - reduce(lambda a, b: a + b, [keyword_hits(text, F.lit(w)) for w in down])
    return F.when(net > 0, "up").when(net < 0, "down").otherwise("neutral")


def labelled(df: DataFrame, text: str, make: Callable[[], Callable[[pd.Series], pd.Series]], probes: dict[str, str]) -> DataFrame:
    """df with `label` from a classifier that is made once a task; it must first label the probe sentences as told."""
    model = make()
    wrong = {s: x for s, x in probes.items() if model(pd.Series([s])).iloc[0] != x}
    if wrong:
        raise ValueError(f"the labeller fails on {wrong}")

    @F.pandas_udf("string")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        for b in batches:
            yield own(b.fillna(""))

    return df.withColumn("label", label(text))


def lexicon(up: list[str], down: list[str]) -> Callable[[pd.Series], pd.Series]:
    def run(s: pd.Series) -> pd.Series:
        low = s.str.lower()
        net = sum(low.str.count(w) for w in up) - sum(low.str.count(w) for w in down)
        return net.map(lambda x: "up" if x > 0 else "down" if x < 0 else "neutral")

    return run


def page_links(html: Column) -> Column:
    """array<struct<href,anchor>> of plain links."""
    pattern = r'<a href="([^"]*)">([^<]*)</a>'
    return F.zip_with(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)), lambda h, a: F.struct(h.alias("href"), a.alias("anchor")))


def article_div(html: Column) -> Column:
    """What stands in the div with id="article", up to the end tag that closes it whatever divs it holds; NULL without one."""
    after = F.nullif(F.regexp_extract(html, r'(?s)<div\b[^>]*\bid="article"[^>]*>(.*)', 1), F.lit(""))
    parts = F.split(after, r"(?=<div\b|</div>)")

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x.startswith("</div"), -1).when(x.startswith("<div"), 1).otherwise(0)
        inside = (s["depth"] > 0) & (depth > 0)
        return F.struct(F.when(s["depth"] > 0, depth).otherwise(0).alias("depth"), F.when(inside, s["n"] + 1).otherwise(s["n"]).alias("n"))

    inner = F.aggregate(parts, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step, lambda s: s["n"])
    return F.when(after.isNotNull(), F.array_join(F.slice(parts, F.lit(1), inner), ""))


#: The addresses of statements, each with its date in eight digits and one letter.
STATEMENTS = (r"^/newsevents/pressreleases/monetary([0-9]{8})([a-z])\.htm$", r"^/newsevents/press/monetary/([0-9]{8})([a-z])\.htm$")


def statement_links(html: Column, texts: list[str]) -> Column:
    """array<struct<date,href>>, in the order of the page, of links whose text is one of `texts` and whose address is that of a statement."""

    def day(href: Column) -> Column:
        digits = F.coalesce(*(F.nullif(F.regexp_extract(href, p, 1), F.lit("")) for p in STATEMENTS))
        return F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))

    of = F.filter(page_links(html), lambda x: F.trim(x["anchor"]).isin(*texts) & day(x["href"]).isNotNull())
    return F.transform(of, lambda x: F.struct(day(x["href"]).alias("date"), x["href"].alias("href")))


def first_per_date(links: DataFrame, order: list[str]) -> DataFrame:
    """Of each date the first link in the given order (of pages, then on the page)."""
    rest = [c for c in links.columns if c != "date"]
    return links.groupBy("date").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select("date", "x.*")


def page_paragraphs(html: Column) -> Column:
    """Texts of the paragraphs of the article (its element, or a div of that id), else of the page, without scripts and styles, tags taken out."""
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?s)<article[^>]*>(.*?)</article>", 1), F.lit("")), article_div(html), html)
    plain = F.regexp_replace(body, r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", "")
    parts = F.regexp_extract_all(plain, F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"<[^>]+>", ""))), lambda p: p != "")


def has_item(items: Column, item: str) -> Column:
    """Is the item in a comma-separated list."""
    return F.array_contains(F.transform(F.split(items, ","), lambda x: F.trim(x)), item)
