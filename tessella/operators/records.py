"""Upload records: listing, search, statistics, retention and deletion.

A records table has id, tool, original_name, created_at, input_rel,
input_bytes and extra (map<string,string>).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIXED = ("id", "tool", "original_name", "created_at", "input_rel", "input_bytes")
PAGE = 200
SAMPLE = 200


def newest_first(rows: DataFrame) -> list[Column]:
    """A total order: creation time has a resolution of a second, so the id breaks ties."""
    return [rows["created_at"].desc_nulls_last(), rows["id"].desc_nulls_last()]


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, int(value)))


def packed_extra(rows: DataFrame, fixed: tuple[str, ...] = FIXED) -> DataFrame:
    """Columns beyond the fixed ones become one JSON text; null if there are none."""
    more = [c for c in rows.columns if c not in fixed]
    text = F.to_json(F.struct(*more)) if more else F.lit(None).cast("string")
    return rows.select(*[c for c in fixed if c in rows.columns], F.when(text != "{}", text).alias("extra_json"))


def unpacked_extra(rows: DataFrame) -> DataFrame:
    """extra_json as a map; bad JSON counts as none."""
    return rows.withColumn("extra", F.coalesce(F.from_json("extra_json", "map<string,string>"), F.create_map().cast("map<string,string>"))).drop("extra_json")


def with_presence(rows: DataFrame, files: DataFrame, path: str = "input_rel", name: str = "file_exists") -> DataFrame:
    """Whether each row's path is among ``files`` (column ``path``); unsafe paths never are."""
    listed = files.select(F.col("path").alias("_path")).distinct()
    safe = safe_relative(F.col(path))
    return rows.join(listed, (F.col(path) == F.col("_path")) & safe, "left").withColumn(name, F.col("_path").isNotNull()).drop("_path")


def safe_relative(path: Column) -> Column:
    """A non-blank relative path that does not climb."""
    flat = F.translate(path, "\\", "/")
    return F.coalesce((F.trim(path) != "") & ~flat.rlike(r"(^|/)\.\.(/|$)") & ~flat.startswith("/"), F.lit(False))


def latest(rows: DataFrame, limit: int = 50) -> DataFrame:
    """The newest records; the plan keeps no more than ``limit`` rows of each task."""
    return rows.orderBy(*newest_first(rows)).limit(clamp(limit, 1, PAGE))


def search(rows: DataFrame, *, tool: str | None = None, q: str | None = None, limit: int = 50) -> DataFrame:
    """Of the newest ``limit`` records those of a tool whose name or id holds ``q``; the limit comes first."""
    page = latest(rows, limit)
    if tool:
        page = page.where(F.col("tool") == tool)
    if q and q.strip():
        needle = q.strip().lower()
        page = page.where(F.contains(F.lower(F.coalesce("original_name", F.lit(""))), F.lit(needle)) | F.contains(F.lower(F.col("id").cast("string")), F.lit(needle)))
    return page


def tools_of_page(rows: DataFrame, limit: int = 50) -> DataFrame:
    """Sorted names of the tools on a page."""
    return latest(rows, limit).where(F.coalesce("tool", F.lit("")) != "").agg(F.array_sort(F.collect_set("tool")).alias("tools"))


def by_id(rows: DataFrame, wanted) -> DataFrame:
    return rows.where(F.col("id") == F.lit(wanted))


def ordered_ids(ids: Column) -> Column:
    """Trimmed ids without blanks and repeats, in the order given."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != ""))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("records"), F.coalesce(F.sum("input_bytes"), F.lit(0)).cast("long").alias("bytes"))


def counts_by_tool(rows: DataFrame) -> DataFrame:
    """Records per tool; blank and null tools count as ``unknown``, with any of that name."""
    name = F.when(F.trim(F.coalesce("tool", F.lit(""))) == "", "unknown").otherwise(F.col("tool"))
    return rows.groupBy(name.alias("tool")).agg(F.count("*").alias("records"))


def newest(rows: DataFrame) -> DataFrame:
    """The one newest record, by one aggregate and no sort."""
    return rows.agg(F.max_by(F.struct(*rows.columns), F.struct("created_at", "id")).alias("row")).select("row.*")


def presence_estimate(rows: DataFrame, files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Present files as the newest ``sample`` records with a path suggest, scaled up to all records if there are more of them."""
    pathed = rows.where(F.trim(F.coalesce("input_rel", F.lit(""))) != "")
    seen = with_presence(pathed.orderBy(*newest_first(pathed)).limit(sample), files).agg(F.count("*").alias("sampled"), F.count_if("file_exists").alias("present"))
    both = seen.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row each
    scaled = F.bround(F.col("total") * F.col("present") / F.greatest("sampled", F.lit(1))).cast("long")
    return both.select("total", "sampled", F.when((F.col("total") > F.col("sampled")) & (F.col("sampled") > 0), scaled).otherwise(F.col("present")).alias("present"))


def presence(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Exactly how many records' files there are."""
    return with_presence(rows, files).agg(F.count("*").alias("total"), F.count_if("file_exists").alias("present"))


def expired(now: datetime, days: int) -> Column:
    """Older than ``days`` (at least one) before ``now``, or without a time."""
    cutoff = F.lit(now) - F.make_dt_interval(days=F.lit(max(1, days)))
    return F.col("created_at").isNull() | (F.col("created_at") < cutoff)


def retained(rows: DataFrame, now: datetime, days: int) -> DataFrame:
    """What retention leaves."""
    return rows.where(~expired(now, days))


def purged(rows: DataFrame, now: datetime, days: int) -> DataFrame:
    """What retention removes."""
    return rows.where(expired(now, days))


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose id is not among ``ids``."""
    return rows.join(ids.select("id").distinct(), "id", "left_anti")


def found(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """How many of the asked ids there are."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("found"))


def inserted_or_ignored(rows: DataFrame, new: DataFrame) -> DataFrame:
    """All records and, of the new ones, those with an unknown id; of new rows with one id the first by content."""
    rest = [c for c in new.columns if c != "id"]
    kinds = dict(new.dtypes)
    order = F.struct(*[F.array_sort(F.map_entries(c)) if kinds[c].startswith("map<") else F.col(c) for c in rest])  # maps have no order
    fresh = new.join(rows.select("id"), "id", "left_anti").groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("id", "r.*")
    return rows.unionByName(fresh.select(*[c for c in rows.columns]))


def legacy_records(archives: DataFrame, text: str) -> DataFrame:
    """Records of JSON archives, each a text that holds an array; what is no array, and items that are no objects, give none.

    A missing text is empty, a size that is no number 0, a time that cannot be
    read null; fields beyond the fixed ones go to ``extra``, as texts.
    """
    items = archives.where(F.ltrim(text).startswith("[")).select(F.explode(F.from_json(F.col(text), "array<string>")).alias("item")).where(F.ltrim("item").startswith("{"))
    m = items.select(F.from_json("item", "map<string,string>").alias("m")).where("m IS NOT NULL")
    field = lambda name: F.coalesce(F.col("m")[name], F.lit(""))
    size = F.coalesce(F.expr("TRY_CAST(TRY_CAST(m['input_bytes'] AS DECIMAL(38, 6)) AS BIGINT)"), F.lit(0).cast("long"))
    fixed = {"created_at": F.try_to_timestamp(field("created_at")), "input_bytes": size}
    return m.select(*[fixed.get(c, field(c)).alias(c) for c in FIXED], F.map_filter("m", lambda k, _: ~k.isin(*FIXED)).alias("extra"))


def migrated(rows: DataFrame, legacy: DataFrame) -> DataFrame:
    """Legacy records, if the table is still empty; a table with rows had its migration and stays as it is."""
    return inserted_or_ignored(rows, legacy) if rows.isEmpty() else rows


def archived(rows: DataFrame, new: DataFrame, now: datetime, days: int) -> DataFrame:
    """Retention and the append in one step; a new record without a tool, name or safe path is left out, never an error."""
    sound = (F.trim(F.coalesce("tool", F.lit(""))) != "") & (F.trim(F.coalesce("original_name", F.lit(""))) != "") & safe_relative(F.col("input_rel"))
    return inserted_or_ignored(retained(rows, now, days), new.where(sound))


def files_of(rows: DataFrame, columns: tuple[str, ...] = ("input_rel", "output_rel")) -> DataFrame:
    """The different paths that go with deleted records: their files and the preview kept beside the input.

    Paths that are not safe are not touched; neither are those of records that stay, which is the caller's anti join.
    """
    named = [(c, "") for c in columns if c in rows.columns] + ([("input_rel", ".preview.pdf")] if "input_rel" in columns else [])
    paths = F.array(*[F.when(safe_relative(F.col(c)), F.concat(c, F.lit(end))) for c, end in named])
    return rows.select(F.explode(F.array_compact(paths)).alias("path")).distinct()


def upload_status(size: Column, limit: int) -> Column:
    """HTTP status of an upload of ``size`` bytes."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, 400).when(size > limit, 413).otherwise(200)


def stored_bytes(files: DataFrame) -> DataFrame:
    """Sum of file sizes of a binaryFile listing; only the length is read."""
    return files.select("length").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))
