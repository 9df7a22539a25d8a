"""Packages that can be claimed by a code: derived state, search, claims and purge.

A packages table has id, code, original_name, stored_rel, size_bytes,
content_type, created_at, expires_at (text), max_downloads, download_count and
note.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOTE = 200
MOST_DOWNLOADS = 1000


def normalized_code(code: Column) -> Column:
    return F.regexp_replace(F.coalesce(code, F.lit("")), r"(?U)[\s\x1C-\x1F]+", "")


def valid_code(code: Column) -> Column:
    """Six digits once white space is gone."""
    return normalized_code(code).rlike(r"^[0-9]{6}$")


def parsed_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def iso(ts: Column) -> Column:
    """UTC, to the second; the session is in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def new_package(rows: DataFrame, now: datetime, *, ttl_hours: int = 24, most_hours: int = 168) -> DataFrame:
    """Rows ready to append: lifetime, downloads and note within their bounds."""
    hours = F.least(F.lit(most_hours), F.greatest(F.lit(1), F.coalesce("ttl_hours", F.lit(ttl_hours))))
    return rows.select(
        "id", "code", "original_name", "stored_rel", "size_bytes", "content_type",
        iso(F.lit(now)).alias("created_at"),
        iso(F.lit(now) + F.make_dt_interval(hours=hours)).alias("expires_at"),
        F.least(F.lit(MOST_DOWNLOADS), F.greatest(F.lit(0), F.coalesce("max_downloads", F.lit(0)))).alias("max_downloads"),
        F.lit(0).alias("download_count"),
        F.substring(F.coalesce("note", F.lit("")), 1, NOTE).alias("note"),
    )


def with_state(rows: DataFrame, now: datetime) -> DataFrame:
    """Adds expired, exhausted, available, downloads_left and seconds_remaining.

    A bad or blank expiry counts as expired, with null seconds.  An expiry
    equal to now has passed.  No limit of downloads: never exhausted, null left.
    """
    until = parsed_time(F.col("expires_at"))
    moment = F.lit(now)
    gone = F.coalesce(until <= moment, F.lit(True))
    limited = F.coalesce(F.col("max_downloads"), F.lit(0)) > 0
    used = F.coalesce(F.col("download_count"), F.lit(0))
    spent = limited & (used >= F.col("max_downloads"))
    left = F.when(limited, F.greatest(F.lit(0), F.col("max_downloads") - used))
    seconds = F.greatest(F.lit(0), F.floor(F.unix_micros(until) / 1_000_000 - F.unix_micros(moment) / 1_000_000)).cast("long")
    return rows.withColumns({"expired": gone, "exhausted": spent, "available": ~gone & ~spent, "downloads_left": left, "seconds_remaining": F.when(until.isNotNull(), seconds)})


def status_is(status: str | None) -> Column:
    """The four statuses are separate questions, not a partition."""
    rules = {
        "available": F.col("available") & F.col("file_exists"),
        "expired": F.col("expired"),
        "exhausted": F.col("exhausted") & ~F.col("expired"),
        "missing": ~F.col("file_exists"),
    }
    return rules[status] if status in rules else F.lit(True)


def fetched(limit: int, filtering: bool) -> int:
    """Rows to look at before filtering."""
    return min(500, max(limit * 5, 200)) if filtering else limit


def listing(rows: DataFrame, *, limit: int = 50, q: str | None = None, status: str | None = None) -> DataFrame:
    """Newest packages: a wider page first, then the filters, then the limit.  Needs state and file_exists."""
    limit = max(1, min(200, limit))
    q = (q or "").strip().lower()
    order = [F.col("created_at").desc_nulls_last(), F.col("id").desc_nulls_last()]
    page = rows.orderBy(*order).limit(fetched(limit, bool(q or status)))
    if q:
        fields = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(q)) for c in ("code", "original_name", "note", "id")]
        page = page.where(fields[0] | fields[1] | fields[2] | fields[3])
    if status:
        page = page.where(status_is(status))
    return page.orderBy(*order).limit(limit)


def claims(packages: DataFrame, asked: DataFrame, now: datetime) -> DataFrame:
    """The outcome of many claims, in their order of arrival per code.

    asked: claim_no, code.  Claims are ranked per code before each package's
    state is joined to those on its code, so packages that share a code do not
    count against each other; a claim is granted while its rank is within what
    is left, and claims on a package whose file is missing use nothing up.
    Errors, by precedence: invalid, expired, exhausted, missing.
    """
    ready = with_state(packages, now).select("code", F.col("id").alias("package_id"), "expired", "max_downloads", "download_count", "file_exists")
    rank = F.row_number().over(Window.partitionBy("code").orderBy("claim_no"))
    rows = asked.select("claim_no", normalized_code(F.col("code")).alias("code")).withColumn("rank", rank).join(ready, "code", "left")
    there = F.coalesce("file_exists", F.lit(False))
    used = F.coalesce("download_count", F.lit(0)) + F.when(there, F.col("rank") - 1).otherwise(0)
    room = (F.coalesce("max_downloads", F.lit(0)) <= 0) | (used < F.col("max_downloads"))
    error = (
        F.when(~valid_code(F.col("code")) | F.col("package_id").isNull(), "invalid")
        .when(F.col("expired"), "expired")
        .when(~room, "exhausted")
        .when(~there, "missing")
    )
    return rows.select("claim_no", "code", "package_id", error.alias("error"), error.isNull().alias("granted"))


def after_claims(packages: DataFrame, outcome: DataFrame) -> DataFrame:
    """Packages with their download counts after the granted claims."""
    more = outcome.where("granted").groupBy(F.col("package_id").alias("id")).agg(F.count("*").alias("_n"))
    return packages.join(more, "id", "left").withColumn("download_count", F.coalesce("download_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def unexpired(rows: DataFrame, now: datetime) -> DataFrame:
    """What a purge leaves; expiry is compared as ISO text, so a blank one goes."""
    return rows.where(F.coalesce("expires_at", F.lit("")) > iso(F.lit(now)))


def cleaned(rows: DataFrame, now: datetime, *, force: bool = False) -> DataFrame:
    """A purge that only an explicit wish starts; otherwise expiry hides packages and keeps them."""
    return unexpired(rows, now) if force else rows


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("packages"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))


CODES = 1_000_000


def _scattered(n: Column, seed: int) -> Column:
    """A permutation of 0 to 999,999: four rounds that add a function of one half, of three digits, to the other."""
    left, right = F.floor(n / 1000).cast("long"), n % 1000
    for k in range(4):
        left, right = right, (left + (right * right * (31 + 2 * k) + right * (17 + k) + seed % 1000 + 271 * (k + 1))) % 1000
    return left * 1000 + right


def _ranked(rows: DataFrame, part: Column, order: str) -> DataFrame:
    """Adds ``place``, from 0, by (part, order); parts are counted first, so no task ranks all rows."""
    rows = rows.withColumn("part", part)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return rows.withColumn("within", within).join(counts, "part").withColumn("place", F.col("before") + F.col("within")).drop("part", "before", "within")


def fresh_codes(wanted: DataFrame, taken: DataFrame, *, seed: int = 0, strict: bool = True) -> DataFrame:
    """A free six-digit code for each different id of ``wanted``, in one pass.

    The codes stand in an order that a keyed permutation scatters; the ids, in
    the order of their digests, take those that are free one after the other.
    More ids than free codes are an error; if not ``strict``, the ids that come
    last then have no row.
    """
    spark = wanted.sparkSession
    codes = spark.range(CODES).select("id", F.lpad(_scattered(F.col("id"), seed).cast("string"), 6, "0").alias("code"))
    free = codes.join(taken.select("code").distinct(), "code", "left_anti").withColumnRenamed("id", "slot")
    ids = wanted.select("id").distinct()
    if strict and ids.count() > free.count():
        raise ValueError("there are fewer free codes than ids")
    digest = F.md5(F.col("id").cast("string"))
    asked = _ranked(ids, F.substring(digest, 1, 3), "id")
    return asked.join(_ranked(free, F.floor(F.col("slot") / 1000), "slot"), "place").select("id", "code")
