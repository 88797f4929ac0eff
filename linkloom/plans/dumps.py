"""Queries of the dump reader: the encyclopedia's tables written as an XML dump, read back into relations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import keep, shared_dir
from ..sources import dump
from .encyclopedia import CUR, LINK, RESOLVED, pages
from .registry import Registry

R = Registry()

_NAMESPACES = '<siteinfo><namespaces><namespace key="0"/><namespace key="14">Category</namespace></namespaces></siteinfo>'
_PAGES = f"{CUR}, dp as (select * from p where page_type in (1, 2, 3, 4))"
_RD = f"""{_PAGES}, rr as (select rd_from, min(rd_to) as rd_to from redirect where rd_from is not null and rd_to is not null group by 1),
 redirect as (select rd_from, rd_to from rr join dp f on f.page_id = rd_from and f.page_type = 3 join dp g on g.page_id = rd_to and g.page_type <> 2)"""
_TO = f"""{_RD}, {LINK}, {RESOLVED}, dl as (select l.f, l.t, coalesce(res.rd_to, l.t) as dest from l join dp f on f.page_id = l.f and f.page_type <> 3
 join dp g on g.page_id = l.t and g.page_type <> 2 left join res on res.rd_from = l.t)"""


def write_dump(t) -> str:
    """Writes the current pages with their links, categories, redirects and some links to another language as XML; where it is."""
    p = pages(t).where(F.col("page_type").isin(1, 2, 3, 4))
    spark = p.sparkSession
    links = G.links_of(t("pagelink")).select(F.col("f").alias("page_id"), F.concat(F.lit("[[Page "), "t", F.lit("|text "), F.col("t") % 50, F.lit("]]")).alias("x"))
    cats = t("categorylink").where("cl_parent is not null and cl_child is not null").distinct().select(F.col("cl_child").alias("page_id"), F.concat(F.lit("[[Category:Cat "), "cl_parent", F.lit("]]")).alias("x"))
    lang = p.where("page_id % 5 = 0").select("page_id", F.concat(F.lit("[[de:Seite "), "page_id", F.lit("]]")).alias("x"))
    body = links.unionByName(cats).unionByName(lang).groupBy("page_id").agg(F.array_join(F.collect_list("x"), "\n").alias("body"))
    rd = t("redirect").where("rd_from is not null and rd_to is not null").groupBy(F.col("rd_from").alias("page_id")).agg(F.min("rd_to").alias("rd_to"))
    x = p.join(body, "page_id", "left").join(rd, "page_id", "left")
    title = F.when(F.col("page_type") == G.CATEGORY, F.concat(F.lit("Category:Cat "), "page_id")).otherwise(F.concat(F.lit("Page "), "page_id"))
    is_rd = F.col("page_type") == G.REDIRECT
    head = F.when(is_rd, F.concat(F.lit('<redirect title="Page '), F.coalesce("rd_to", F.lit(-1)), F.lit('"/>'))).otherwise(F.lit(""))
    text = F.when(is_rd, F.lit("#REDIRECT")).when(F.col("page_type") == G.DISAMBIGUATION, F.lit("{{disambig}}")).otherwise(F.coalesce("body", F.lit("")))
    row = F.concat(F.lit("<page><title>"), title, F.lit("</title><id>"), "page_id", F.lit("</id>"), head, F.lit("<revision><text>"), text, F.lit("</text></revision></page>"))
    path = f"{shared_dir(spark)}/linkloom-dump-{uuid.uuid4().hex}"
    x.select(row.alias("value")).mapInPandas(_file, "value string").write.text(path)
    return keep(spark, path)


def _file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A part of the dump as a document of its own."""
    yield pd.DataFrame({"value": ["<mediawiki>", _NAMESPACES]})
    yield from batches
    yield pd.DataFrame({"value": ["</mediawiki>"]})


def _relation(t, name: str):
    spark = t("page").sparkSession
    return dump.ingest(spark, write_dump(t))[name]


@R.add("dump_pages", f"with {_PAGES} select page_id, case when page_type = 2 then 'Cat ' else 'Page ' end || page_id as page_title, page_type from dp")
def dump_pages(t):
    """The pages of the dump."""
    return _relation(t, "page")


@R.add("dump_redirects", f"with {_RD} select * from redirect")
def dump_redirects(t):
    """The redirects of the dump whose target is in it."""
    return _relation(t, "redirect")


@R.add("dump_pagelinks", f"with recursive {_TO} select f as pl_from, dest as pl_to from dl where f in (select page_id from dp where page_type in (1, 2))")
def dump_pagelinks(t):
    """The link occurrences of the dump, led on through redirects."""
    return _relation(t, "pagelink")


@R.add("dump_categorylinks", f"with {_PAGES} select distinct cl_parent, cl_child from categorylink join dp a on a.page_id = cl_parent and a.page_type = 2 join dp b on b.page_id = cl_child and b.page_type in (1, 2)")
def dump_categorylinks(t):
    """The category links of the dump."""
    return _relation(t, "categorylink")


@R.add("dump_anchors", f"with recursive {_TO} select 'text ' || (t % 50) as an_text, dest as an_to, count(*) as an_count from dl where f in (select page_id from dp where page_type in (1, 2)) group by 1, 2")
def dump_anchors(t):
    """The link texts of the dump with where they lead."""
    return _relation(t, "anchor")


@R.add("dump_translations", f"with {_PAGES} select page_id as page_id, ['de'] as languages, 'Seite ' || page_id as title from dp where page_id % 5 = 0 and page_type in (1, 2)")
def dump_translations(t):
    """The languages of each page of the dump and its title in German."""
    return G.translations(_relation(t, "translation")).select("page_id", "languages", F.col("titles")["de"].alias("title"))
