"""Sources of settings: KEY=VALUE files and JSON flag files of two shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"


def setting_value(raw: Column) -> Column:
    """A value without its quotes, or without a trailing comment if it has none."""
    double = F.regexp_extract(raw, r'^"((?:\\.|[^"\\])*)"', 1)
    single = F.regexp_extract(raw, r"^'([^']*)'", 1)
    bare = F.trim(F.regexp_replace(raw, r"\s+#.*$|^#.*$", ""))
    return F.when(raw.startswith('"') & raw.rlike(r'^"(?:\\.|[^"\\])*"'), double).when(raw.startswith("'") & raw.rlike(r"^'[^']*'"), single).otherwise(bare)


def dotenv(lines: DataFrame, existing: DataFrame | None = None, *, override: bool = False) -> DataFrame:
    """(key, value) of lines (line_no, line); of a repeated key the last counts.

    ``existing`` settings win unless ``override``.
    """
    found = lines.where(F.col("line").rlike(LINE) & ~F.col("line").rlike(r"^\s*#"))
    found = found.select("line_no", F.regexp_extract("line", LINE, 1).alias("key"), setting_value(F.regexp_extract("line", LINE, 2)).alias("value"))
    new = found.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))
    if existing is None:
        return new
    first, second = (new, existing) if override else (existing, new)
    return first.select("key", "value").unionByName(second.select("key", "value").join(first.select("key"), "key", "left_anti"))


def read_dotenv(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one settings file.

    Spark's readers pass over names that begin with a dot, so the driver opens
    the file, by the same file system.
    """
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).open(target)
    try:
        text = context._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line_no int, line string")


def disabled_slugs(text: DataFrame, known: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Switched-off slugs of JSON texts (column ``json``): a list ``disabled``, or a map ``tools`` of loose booleans."""
    parsed = text.select(F.from_json("json", "disabled array<string>, tools map<string,string>").alias("f"))
    listed = parsed.select(F.explode("f.disabled").alias("slug"))
    off = parsed.select(F.explode("f.tools").alias("slug", "on")).where(F.lower(F.trim("on")).isin("0", "false", "no", "off")).select("slug")
    slug = F.lower(F.trim("slug"))
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        slug = F.coalesce(F.try_element_at(table, slug), slug)
    return listed.unionByName(off).select(slug.alias("slug")).distinct().join(known.select("slug").distinct(), "slug", "left_semi")


def flags_json(flags: DataFrame) -> DataFrame:
    """One JSON text of the switched-off slugs in order, as ``disabled_slugs`` reads it."""
    off = flags.agg(F.array_sort(F.collect_set(F.when(~F.col("enabled"), F.col("slug")))).alias("disabled"))
    return off.select(F.to_json(F.struct(F.lit(1).alias("version"), "disabled")).alias("json"))
