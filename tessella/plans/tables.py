"""The driver's tables as the relations that the operators take.

Every mapping covers its whole table; the SQL prefixes say the same for the oracle.
"""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.geometry import SetWords

NOW = datetime(2001, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that grow into many are dealt to tasks of about so many.
DEALT = 10_000


def parts(rows: DataFrame, most: int = DEALT) -> int:
    """As many tasks as rows need."""
    return max(1, -(-rows.count() // most))


def dealt(rows: DataFrame, key: str, most: int = DEALT) -> DataFrame:
    """Rows by their key in as many tasks as they need; a file of some MB is read by one task, whatever its rows grow into."""
    return rows.repartition(parts(rows, most), key)


def joinable(spark: SparkSession, rows: DataFrame, most: int = DEALT) -> int:
    """As many tasks as rows need, and no fewer than Spark joins with; with fewer it would shuffle them anew for each join."""
    return max(parts(rows, most), int(spark.conf.get("spark.sql.shuffle.partitions")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as upload records; one in nine has no path."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tool"), F.concat(F.lit("Order-"), "o_orderkey", F.lit(".pdf")).alias("original_name"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.concat(F.lit("c/"), "o_custkey")).alias("input_rel"), F.floor("o_totalprice").cast("long").alias("input_bytes"))


RECORDS = "records AS (SELECT o_orderkey AS id, o_orderpriority AS tool, 'Order-' || o_orderkey || '.pdf' AS original_name, o_orderdate AS created_at, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'c/' || o_custkey END AS input_rel, CAST(floor(o_totalprice) AS BIGINT) AS input_bytes FROM orders)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit as stored files."""
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c/"), "c_custkey").alias("path"))


FILES = "files AS (SELECT 'c/' || c_custkey AS path FROM customer WHERE c_acctbal > 0)"


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packages: three in four have a limit, one in ten has no readable expiry."""
    o = table(spark, sf_dir, "orders")
    until = F.date_format(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(days=F.lit(400)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select(
        F.col("o_orderkey").alias("id"), F.lpad((F.col("o_orderkey") % 1_000_000).cast("string"), 6, "0").alias("code"), F.concat(F.lit("Package "), "o_orderkey").alias("original_name"), F.concat(F.lit("c/"), "o_custkey").alias("stored_rel"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderkey") % 10 == 0, "soon").otherwise(until).alias("expires_at"),
        (F.col("o_orderkey") % 4).cast("int").alias("max_downloads"), (F.col("o_custkey") % 3).cast("int").alias("download_count"), F.col("o_orderstatus").alias("note"),
    )


PACKAGES = """packages AS (SELECT o_orderkey AS id, lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS code, 'Package ' || o_orderkey AS original_name, 'c/' || o_custkey AS stored_rel, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE strftime(o_orderdate + INTERVAL 400 DAY, '%Y-%m-%dT%H:%M:%SZ') END AS expires_at, o_orderkey % 4 AS max_downloads, o_custkey % 3 AS download_count, o_orderstatus AS note FROM orders),
timed AS (SELECT *, try_strptime(expires_at, '%Y-%m-%dT%H:%M:%SZ') AS until FROM packages),
state AS (SELECT *, coalesce(until <= TIMESTAMP '2001-01-01', true) AS expired, max_downloads > 0 AND download_count >= max_downloads AS exhausted, stored_rel IN (SELECT 'c/' || c_custkey FROM customer WHERE c_acctbal > 0) AS file_exists FROM timed)"""


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tools of their nation's category; a fifth name no known category."""
    s = table(spark, sf_dir, "supplier")
    category = F.when(F.col("s_suppkey") % 5 == 0, "unlisted").otherwise(F.concat(F.lit("n"), "s_nationkey"))
    return s.select(F.col("s_suppkey").cast("int").alias("pos"), F.lower("s_name").alias("slug"), F.col("s_name").alias("name"), F.concat(F.lit("Balance "), F.floor("s_acctbal").cast("string")).alias("description"), category.alias("category"), (F.col("s_suppkey") % 7 == 0).alias("featured"))


TOOLS = "tools AS (SELECT CAST(s_suppkey AS INT) AS pos, lower(s_name) AS slug, s_name AS name, 'Balance ' || CAST(floor(s_acctbal) AS BIGINT) AS description, CASE WHEN s_suppkey % 5 = 0 THEN 'unlisted' ELSE 'n' || s_nationkey END AS category, s_suppkey % 7 = 0 AS featured FROM supplier)"


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))


CATEGORIES = "categories AS (SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation)"


def disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_acctbal < 1000").select(F.lower("s_name").alias("slug"))


DISABLED = "disabled AS (SELECT lower(s_name) AS slug FROM supplier WHERE s_acctbal < 1000)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in seconds."""
    return table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents set ten to a line, a page for each document."""
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 2_000).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("pos", "text"))
    x0, top = 50.0 + 48.0 * (F.col("pos") % 10), 16.0 * F.floor(F.col("pos") / 10)
    return d.select("doc_id", F.lit(0).alias("page_no"), F.col("pos").cast("long").alias("word_no"), "text", x0.alias("x0"), (x0 + 5.0 * F.length("text")).alias("x1"), top.cast("double").alias("top"), (top + 10.0).cast("double").alias("bottom"), F.when(F.col("pos") % 10 == 0, 12.0).otherwise(10.0).alias("size"), F.when(F.col("pos") % 3 == 0, "Song").otherwise("Hei").alias("fontname"))


def set_words(texts: list[str]) -> tuple[np.ndarray, SetWords]:
    """The words of ``words`` for texts in a worker: whose they are, and their places."""
    split = [text.split(" ") for text in texts]
    counts = np.array([len(w) for w in split])
    own, flat = np.repeat(np.arange(len(split)), counts), [w for one in split for w in one]
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    x0, top = 50.0 + 48.0 * (pos % 10), 16.0 * (pos // 10)
    wide = 5.0 * np.fromiter(map(len, flat), np.int64, len(flat))
    return own, SetWords(pos, flat, x0, x0 + wide, top, top + 10.0, np.where(pos % 10 == 0, 12.0, 10.0), np.where(pos % 3 == 0, "Song", "Hei"))


WORDS = """split AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents),
flat AS (SELECT doc_id, unnest(w) AS text, unnest(range(len(w))) AS pos FROM split),
words AS (SELECT doc_id, pos AS word_no, text, 50.0 + 48.0 * (pos % 10) AS x0, 50.0 + 48.0 * (pos % 10) + 5.0 * length(text) AS x1, 16.0 * (pos // 10) AS top, 16.0 * (pos // 10) + 10.0 AS bottom FROM flat)"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes on each page."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    box = lambda k, x0, top, x1, bottom: F.struct(F.lit(k).alias("rect_id"), F.lit(x0).alias("x0"), F.lit(top).alias("top"), F.lit(x1).alias("x1"), F.lit(bottom).alias("bottom"))
    return d.select("doc_id", F.lit(0).alias("page_no"), F.explode(F.array(box(0, 100.0, 20.0, 250.0, 90.0), box(1, 300.0, 60.0, 520.0, 400.0))).alias("r")).select("doc_id", "page_no", "r.*")


RECTS = "rects AS (SELECT doc_id, unnest([0, 1]) AS rect_id, unnest([100.0, 300.0]) AS x0, unnest([20.0, 60.0]) AS top, unnest([250.0, 520.0]) AS x1, unnest([90.0, 400.0]) AS bottom FROM documents)"
