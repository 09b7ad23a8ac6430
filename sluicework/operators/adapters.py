"""Site adapters as tables: which adapter a url has, its settings with a site's own laid over them, and roles of pages by them.

Adapters are rows, so sites are added without code; a url finds its adapter by equi-joins on the ends of its domain, not by
testing every adapter. Urls without a domain, and of domains that no adapter fits, have none (the generic one)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

LISTS = (
    "allowed_path_prefixes", "allowed_hosts", "default_seed_urls", "include_url_terms", "exclude_url_terms", "discovery_terms", "parent_page_terms", "child_page_terms", "support_page_terms",
    "application_support_terms", "supporting_programme_terms",
)
FLAGS = ("strict_path_prefixes", "allow_root_url", "playwright_required_by_default")
NUMBERS = ("max_pages", "depth_limit", "max_queue_urls", "max_links_per_page")
TEXTS = ("crawl_mode", "crawl_budget_mode")
MAPS = ("merge_aliases",)


def _ends(domain: Column) -> Column:
    """A domain and all its ends at a dot, longest first."""
    parts = F.split(domain, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def with_adapter(pages: DataFrame, adapters: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``adapter_key``: of the adapters (``ord, adapter_key, domain``) that of the url's own domain, else of the
    longest end of it, else the first whose domain ends with it; of equal domains the first; else null."""
    known = adapters.filter(F.coalesce("domain", F.lit("")) != "").groupBy(F.lower(F.regexp_replace("domain", "^www[.]", "")).alias("_d")).agg(F.min(F.struct("ord", "adapter_key")).alias("a"))
    asked = pages.select(urls.domain(F.col(url_col)).alias("_own")).distinct().filter("_own <> ''")  # one row a domain, however many pages it has
    up = asked.select("_own", F.explode(_ends(F.col("_own"))).alias("_d")).join(known, "_d")
    up = up.groupBy("_own").agg(F.max_by("a", F.length("_d")).alias("up"))
    down = known.select(F.explode(F.slice(_ends(F.col("_d")), F.lit(2), F.lit(1 << 20))).alias("_own"), "a").groupBy("_own").agg(F.min("a").alias("down"))
    found = asked.join(up, "_own", "left").join(down, "_own", "left").select("_own", F.coalesce("up", "down")["adapter_key"].alias("adapter_key"))
    return pages.withColumn("_own", urls.domain(F.col(url_col))).join(found, "_own", "left").drop("_own")


def configured(base: DataFrame, config: DataFrame, keys: Sequence[str] = ("adapter_key",)) -> DataFrame:
    """Settings of ``base`` with those of ``config`` laid over them, by key; columns that either lacks stay as they are.

    A list replaces one only where it holds something, a flag wherever it is set, a number where it is above 0, a text where
    it isn't blank; maps are added, a config's key wins. Base rows without a config stay; configs of unknown keys are left out."""
    both = base.alias("b").join(config.alias("c"), list(keys), "left")
    out = []
    for c in base.columns:
        old, new = F.col(f"b.{c}"), F.col(f"c.{c}") if c in config.columns else None
        if c in keys:
            out.append(F.col(c))
        elif new is None:
            out.append(old)
        elif c in LISTS:
            said = F.filter(F.transform(F.coalesce(new, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
            out.append(F.when(F.size(said) > 0, said).otherwise(old).alias(c))
        elif c in FLAGS:
            out.append(F.coalesce(new, old).alias(c))
        elif c in NUMBERS:
            out.append(F.when(new > 0, new).otherwise(old).alias(c))
        elif c in TEXTS:
            out.append(F.when(F.length(F.trim(new)) > 0, F.trim(new)).otherwise(old).alias(c))
        elif c in MAPS:
            none = F.create_map().cast("map<string,string>")
            mine = F.map_filter(F.coalesce(new, none), lambda k, _: F.trim(k) != "")
            rest = F.map_filter(F.coalesce(old, none), lambda k, _: ~F.map_contains_key(mine, k))
            out.append(F.map_concat(rest, mine).alias(c))
        else:
            out.append(F.coalesce(new, old).alias(c))
    return both.select(*out)


def _any(low: Column, terms: str) -> Column:
    return F.exists(F.coalesce(F.col(terms), F.array().cast("array<string>")), lambda t: low.contains(F.lower(t)))


def page_role(url: Column, title: Column, said: Column, records: Column, blocks: Column, internal: Column, details: Column, applications: Column, documents: Column, rest: Column) -> Column:
    """Role of a page by its adapter's terms (columns of ``LISTS``), from the most special to counts of records, blocks and
    links; ``rest`` says what is left."""
    blank = lambda c: F.lower(F.coalesce(c, F.lit("")))
    low = F.concat_ws(" ", blank(url), blank(title), blank(said))
    path = F.regexp_replace(F.lower(urls.path(url)), "/+$", "")
    prefix = lambda p: F.regexp_replace(F.lower(p), "/+$", "")
    index = F.exists(F.coalesce("allowed_path_prefixes", F.array().cast("array<string>")), lambda p: (path == prefix(p)) | path.startswith(F.concat(prefix(p), F.lit("/"))))
    return (
        F.when(_any(low, "child_page_terms"), "child").when(_any(low, "parent_page_terms"), "parent").when(_any(low, "application_support_terms"), "application_support_page")
        .when(_any(low, "supporting_programme_terms"), "supporting_or_complementary_programme_page").when(_any(low, "support_page_terms"), F.when(records <= 1, "support-document").otherwise("detail"))
        .when(index, "programme_index_page").when(records > 1, "listing").when(blocks > 1, "mixed").when((applications > 0) | (documents > 0), F.when(records > 0, "detail").otherwise("support"))
        .when((details > 0) & (records <= 1), F.when(details > 2, "listing").otherwise("detail")).when((internal > 8) & (records <= 1), "listing").otherwise(rest)
    )
