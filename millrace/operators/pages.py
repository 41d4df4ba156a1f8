"""Stored pages: links, reachability, files, articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import article_text, has_extension, html_text, paragraphs, resolve_url, split_list
from . import commits
from .durable import new_path, remove
from .position import first_by

WINDOWS = {"d": "1d", "w": "7d", "m": "1m"}


def links(pages: DataFrame) -> DataFrame:
    """L1: pages (url, html) -> page_url, position, href, text, url (resolved)."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*>.*?</a\s*>)"), 1)
    each = pages.select(F.col("url").alias("page_url"), F.posexplode(found).alias("position", "a"))
    href = F.regexp_extract("a", r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']?([^"'>\s]*)""", 1)
    with_href = each.where(F.col("a").rlike(r"(?is)^<a\b[^>]*\bhref\s*=")).select("page_url", "position", href.alias("href"), html_text(F.col("a")).alias("text"))
    return with_href.withColumn("url", resolve_url(F.col("page_url"), F.col("href")))


def reachable(links: DataFrame, seeds: DataFrame, depth: int, buckets: int = commits.BUCKETS) -> DataFrame:
    """L2: links (src, dst), seeds (seed) -> seed, url, depth: urls that start with the seed, at their least depth.

    Links and visited pages lie in folders by a hash of their URL. A level opens the links of its frontier's buckets and the visited pages of its candidates' buckets, as the folders'
    names tell; its plan is the same at every depth. A bucket has as many files and tasks as its size asks for. Ends with the first level that finds nothing new.
    """
    spark, root = links.sparkSession, new_path(links.sparkSession, "crawl")
    schema = T.StructType([T.StructField("seed", seeds.schema["seed"].dataType), T.StructField("url", T.StringType()), T.StructField("depth", T.IntegerType())])
    edges = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])

    def put(df: DataFrame, name: str, url: str) -> None:
        df.withColumn("bucket", commits.bucket_of([url], buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", url).write.partitionBy("bucket").parquet(f"{root}/{name}")

    def folders(name: str) -> dict[int, list[str]]:
        out = {}
        for x in commits.found(spark, f"{root}/{name}/bucket=*"):
            out.setdefault(int(x.rpartition("=")[2]), []).append(x)
        return out

    def read(at: dict[int, list[str]], which, kind: T.StructType) -> DataFrame:
        return commits.read_folders(spark, [x for b in sorted(which) for x in at.get(b, [])], kind)

    put(links.select("src", "dst").where("src is not null and dst is not null"), "links", "src")
    put(seeds.select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth")).distinct(), "visited/depth=0", "url")
    stored = folders("links")
    for d in range(1, depth + 1):
        now = folders(f"visited/depth={d - 1}")
        if not now:
            break
        step = read(now, now, schema).join(read(stored, now, edges), F.col("url") == F.col("src")).where(F.col("dst").startswith(F.col("seed")))
        put(step.select("seed", F.col("dst").alias("url"), F.lit(d).alias("depth")).distinct(), f"step={d}", "url")
        found = folders(f"step={d}")
        seen = read(folders("visited/depth=*"), found, schema).select("seed", "url")
        put(read(found, found, schema).join(seen, ["seed", "url"], "left_anti"), f"visited/depth={d}", "url")
        remove(spark, f"{root}/step={d}")
    remove(spark, f"{root}/links")
    every = folders("visited/depth=*")
    return read(every, every, schema)


def find_files(links: DataFrame, exts: list[str], query: str | None = None) -> DataFrame:
    """L3: links to files with one of the extensions, whose URL or text holds the query; one row for each URL."""
    files = links.where(has_extension(F.col("url"), exts))
    if query:
        files = files.where(F.lower("url").contains(query.lower()) | F.lower("text").contains(query.lower()))
    return first_by(files, "url", ["page_url", "position"])


def articles(results: DataFrame, pages: DataFrame, seen: DataFrame) -> DataFrame:
    """L4: results (url, title, snippet, arrived), pages (url, html), seen (url): new articles with body or snippet."""
    firsts = first_by(results, "url", ["arrived"]).join(seen.select("url"), "url", "left_anti")
    bodies = first_by(pages.select("url", paragraphs(F.col("html")).alias("body")), "url", [F.length("body").desc(), "body"])
    return firsts.join(bodies, "url", "left").withColumn("summary", article_text(F.col("body"), F.col("snippet"))).drop("body")


def search_jobs(df: DataFrame, keywords: Column, window: Column) -> DataFrame:
    """One row for each keyword of a comma list, with the time window as suffix and in URL form."""
    suffix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in WINDOWS.items() for x in (k, " when:" + v)]), window), F.lit(""))
    items = F.filter(F.transform(F.split(F.coalesce(keywords, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    each = df.withColumns({"__suffix": suffix, "keyword": items}).withColumn("keyword", F.explode("keyword"))
    return each.withColumn("search", F.concat("keyword", "__suffix")).withColumn("search_url", F.url_encode("search")).drop("__suffix")


def ingest_outcomes(files: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Found files with ``skipped`` if they exist already, else ``added``."""
    known = existing.select(key).distinct().withColumn("__known", F.lit(True))
    return files.join(known, key, "left").withColumn("outcome", F.when(F.col("__known"), "skipped").otherwise("added")).drop("__known")


def keyword_filter(df: DataFrame, text: str, words: Column) -> DataFrame:
    """Rows whose text holds any of a comma list of words."""
    return df.where(F.exists(split_list(words), lambda w: F.lower(text).contains(w)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
