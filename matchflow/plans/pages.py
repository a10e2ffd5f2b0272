"""Queries on landed pages: cards, links and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchflow.plans.registry import query, table
from matchflow.sources import pages as P


def _plain(html: str) -> str:
    """SQL for the words of a piece of HTML, with the named characters that the pages have."""
    text = f"regexp_replace({html}, '<[^>]*>', ' ', 'g')"
    for name, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


_LINKS = """l AS (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]+</a>') AS found FROM pages),
    e AS (SELECT page_id, url, unnest(found) AS a, generate_subscripts(found, 1) - 1 AS card FROM l)"""
_LINK = """regexp_extract(url, '^https?://[^/]+') || regexp_extract(a, 'href="([^"]*)"', 1)"""


@query(f"WITH {_LINKS} SELECT page_id, card::INT AS card, {_plain('a')} AS title, {_LINK} AS url FROM e")
def extract_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extract_cards(table(spark, sf_dir, "pages"))


@query(f"SELECT page_id, {_plain("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")} AS description FROM pages")
def extract_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extract_description(table(spark, sf_dir, "pages"))


@query(f"WITH {_LINKS} SELECT page_id, card::INT AS card, {_plain('a')} AS title, 'N/A' AS company, 'Dublin' AS location, 'N/A' AS posted, {_LINK} AS url FROM e")
def board_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items as cards: the containers that the given pages have."""
    return P.board_cards(table(spark, sf_dir, "pages"), P.Board(cards=("div.job-result", "li")), "Dublin")
