"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import html_text
from ..operators import commits
from ..operators.changes import replace_group
from ..operators.joins import decode
from ..operators.position import first_n_per, last_n_per

VIEWS: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """S1."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the session has cores, dealt out over all of them; any other stays as it is.

    A small table of long texts is often one file, and all work on the texts would be one task's. ``df`` is a plain scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def jdbc_table(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """S1 for a relational source, read in ``parts`` ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def define_view(name: str, sql: str) -> None:
    """A named query with ``:parameters``."""
    VIEWS[name] = sql


def view(spark: SparkSession, name: str, tables: dict[str, DataFrame], **params) -> DataFrame:
    """A named query over tables, parameters bound as values."""
    return spark.sql(VIEWS[name], args=params, **tables)


def read_rate_json(df: DataFrame, payload: str, code: str) -> DataFrame:
    """S3: a feed's JSON (refRates: effectiveDate, percentRate) as rows; entries without date or value are dropped."""
    parsed = F.from_json(payload, "refRates array<struct<effectiveDate:string,percentRate:double>>")
    each = df.select(F.explode(parsed["refRates"]).alias("r")).select(F.col("r.effectiveDate").try_cast("date").alias("effective_date"), F.lit(code).alias("rate_type"), F.col("r.percentRate").alias("rate_value"))
    return each.where(F.col("effective_date").isNotNull() & F.col("rate_value").isNotNull())


def melt_measures(df: DataFrame, ids: list[str], measures: dict[str, str]) -> DataFrame:
    """One row for each non-null measure, under its rate type."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(t) for c, t in measures.items()])
    return wide.unpivot(ids, list(measures.values()), "rate_type", "rate_value").where("rate_value is not null")


def read_rate_csv(df: DataFrame, line: str, code: str, order: str, part: str, tail: int = 40) -> DataFrame:
    """``date;value`` lines with decimal comma: comments, missing values (a dot) and bad rows are left out.

    Only the last ``tail`` lines of each series (``part``) count, bad ones included.
    """
    clean = df.withColumn("__l", F.trim(F.regexp_replace(line, "^﻿", ""))).where((F.col("__l") != "") & ~F.col("__l").startswith("#"))
    fields = F.split("__l", ";")
    lines = last_n_per(clean, [part], [F.col(order)], tail)
    rows = lines.select(part, F.get(fields, F.lit(0)).try_cast("date").alias("effective_date"), F.lit(code).alias("rate_type"), F.translate(F.trim(F.get(fields, F.lit(1))), ",", ".").try_cast("double").alias("rate_value"))
    return rows.where(F.col("effective_date").isNotNull() & F.col("rate_value").isNotNull())


def expand_indicators(df: DataFrame, period: str, meta: DataFrame) -> DataFrame:
    """Wide monthly measures into indicator rows; meta (measure, code, name, unit, category) names them."""
    measures = [c for c in df.columns if c != period]
    raw = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    rows = df.withColumn("raw", raw).unpivot([period, "raw"], measures, "measure", "value")
    return rows.join(F.broadcast(meta), "measure").select("code", "name", F.col(period).alias("period"), "value", "unit", "category", "raw")


def read_feed(df: DataFrame, xml: str, feed: str, per_feed: int = 10) -> DataFrame:
    """The first items of each feed: feed, position, title, url, body without tags; no title and no body have stand-ins."""
    item = "struct<title:string,link:string,description:string>"
    parsed = F.from_xml(F.col(xml), f"channel struct<item:array<{item}>>", {"rowTag": "rss"})
    each = df.select(feed, F.posexplode(parsed["channel"]["item"]).alias("position", "i"))
    name = F.coalesce(F.nullif(F.trim("i.title"), F.lit("")), F.lit("Untitled"))
    body = F.coalesce(F.nullif(html_text(F.col("i.description")), F.lit("")), name)
    return first_n_per(each, [feed], ["position"], per_feed).select(feed, "position", name.alias("title"), F.trim("i.link").alias("url"), body.alias("body"))


def load_summaries(spark: SparkSession, path: str, doc_id: str, current: DataFrame) -> DataFrame:
    """A document's summaries from JSON lines replace its present ones. Columns: document_id, community_id, summary_text, embedding."""
    new = spark.read.schema("community_id int, summary_text string, embedding array<float>").json(path)
    return replace_group(current, new.select(F.lit(doc_id).alias("document_id"), "community_id", "summary_text", "embedding"), "document_id")


def decode_vector(c: Column) -> Column:
    """A JSON list as vector; anything else null."""
    return F.from_json(c, "array<float>")


def list_documents(spark: SparkSession, path: str, ext: str) -> DataFrame:
    """Files with the extension, at any depth: path, document_id (base name). Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{ext}").load(path).select("path")
    return found.withColumn("document_id", F.regexp_replace(F.element_at(F.split("path", "/"), -1), rf"\.{ext}$", ""))


def append(df: DataFrame, path: str, defaults: dict[str, object] | None = None, batch: int | None = None, keys: list[str] | None = None) -> None:
    """Append to a Parquet table, nulls filled from ``defaults``. With ``batch`` and ``keys`` the rows go to a table of ``commits``, once for each batch number."""
    filled = df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in (defaults or {}).items()})
    if batch is None:
        filled.write.mode("append").parquet(path)
    else:
        commits.write(filled, path, batch, keys or df.columns[:1])


def conform_sparse(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Only the known columns, missing ones null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def deal_export(deals: DataFrame, currencies: DataFrame, columns: list[str], default: str = "TRY") -> DataFrame:
    """Export columns with the currency's description, ``default`` if there is none."""
    return decode(deals, currencies.select("code", F.col("description").alias("currency")), "currency_code", {"currency": default}).select(*columns)


def write_csv(df: DataFrame, path: str) -> None:
    """S13."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """S14."""
    df.write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two Parquet tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object], seed: DataFrame | None = None) -> DataFrame:
    """Missing columns with their default, in the order of the schema; seed rows if there are none."""
    full = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])
    return full if seed is None else full.unionByName(conform(seed, schema, defaults).limit(0 if not df.isEmpty() else 1 << 30))


def editable_columns(df: DataFrame, key: str) -> list[str]:
    """S17."""
    return [c for c in df.columns if c != key]
