"""A catalog of tools with categories and on/off flags: joins, nesting, search, recents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OTHER = "_other"
RECENT_TOOLS, RECENT_JOBS, SIBLINGS, RESULTS = 6, 12, 6, 12


def enabled(tools: DataFrame, disabled: DataFrame, *, featured: bool = False) -> DataFrame:
    """Tools that are not switched off; without the featured ones unless asked for."""
    out = tools.join(disabled.select("slug").distinct(), "slug", "left_anti")
    return out if featured else out.where(~F.coalesce("featured", F.lit(False)))


def featured(tools: DataFrame, disabled: DataFrame) -> DataFrame:
    return tools.where(F.coalesce("featured", F.lit(False))).join(disabled.select("slug").distinct(), "slug", "left_anti")


def with_flags(tools: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds ``enabled``, true where there is no flag."""
    return tools.join(flags.select("slug", F.col("enabled").alias("_e")), "slug", "left").withColumn("enabled", F.coalesce("_e", F.lit(True))).drop("_e")


def by_category(categories: DataFrame, tools: DataFrame) -> DataFrame:
    """Categories with their tools nested, in catalog order; unknown ones under ``_other``, empty ones left out."""
    known = tools.join(categories.select(F.col("id").alias("_c")), F.col("category") == F.col("_c"), "left").withColumn("category", F.coalesce("_c", F.lit(OTHER)))
    nested = known.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("pos", "slug", "name"))).alias("tools"))
    named = categories.select(F.col("id").alias("category"), F.col("name").alias("_name"))
    out = nested.join(named, "category", "left")
    return out.select("category", F.coalesce("_name", F.lit("Other")).alias("name"), "tools", F.size("tools").cast("long").alias("n_tools"))


def navigation(categories: DataFrame, tools: DataFrame) -> DataFrame:
    """All categories with the number and names of their tools."""
    own = tools.groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("t"))
    out = categories.join(own, F.col("id") == F.col("category"), "left")
    names = F.transform(F.coalesce("t", F.array().cast("array<struct<pos:int,name:string>>")), lambda x: x["name"])
    return out.select("id", "name", F.coalesce("n", F.lit(0)).alias("n_tools"), names.alias("tool_names"))


def siblings(tools: DataFrame) -> DataFrame:
    """For each tool the first others of its category, in catalog order."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("pos", "slug"))
    first = tools.select("category", "slug", "pos", place.alias("_n")).where(F.col("_n") <= SIBLINGS + 1)  # one of them can be the tool itself
    other = first.select(F.col("category").alias("_cat"), F.col("slug").alias("sibling"), F.col("_n"))
    both = tools.select("slug", "category").join(other, (F.col("category") == F.col("_cat")) & (F.col("slug") != F.col("sibling")))
    rank = F.row_number().over(Window.partitionBy("slug").orderBy("_n"))
    return both.withColumn("rank", rank).where(F.col("rank") <= SIBLINGS).select("slug", "sibling", F.col("rank").cast("long").alias("rank"))


def merged_fields(given: DataFrame, registry: DataFrame, fields: tuple[str, ...], default: str = "") -> DataFrame:
    """Left join on slug; of each field the given value, else the registered one, else the default."""
    known = registry.select("slug", *[F.col(f).alias(f"_{f}") for f in fields])
    out = given.join(known, "slug", "left")
    return out.select("slug", *[F.coalesce(f, f"_{f}", F.lit(default)).alias(f) for f in fields])


def union_first(*parts: DataFrame) -> DataFrame:
    """Union in which the first row of a slug wins, by part and then by pos."""
    ranked = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    whole = ranked[0]
    for p in ranked[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("slug").orderBy("_part", "pos"))
    return whole.withColumn("_n", first).where("_n = 1").drop("_n", "_part")


def matching(tools: DataFrame, q: str) -> DataFrame:
    """Tools whose name, description, slug and category together hold ``q``."""
    text = F.lower(F.concat_ws(" ", "name", "description", "slug", "category"))
    return tools.where(F.contains(text, F.lit(q.strip().lower())))


def palette(tools: DataFrame, recents: DataFrame) -> DataFrame:
    """Search results: recent ones first, then catalog order."""
    ranked = tools.join(recents.select("slug", "recent_rank"), "slug", "left")
    order = [F.coalesce("recent_rank", F.lit(999)), F.col("pos")]
    return ranked.orderBy(*order).limit(RESULTS)


def recents(events: DataFrame, *, user: str, item: str, time: str, most: int = RECENT_TOOLS) -> DataFrame:
    """Each user's latest different items; ties by item."""
    last = events.groupBy(user, item).agg(F.max(time).alias("last"))
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("last"), item))
    return last.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def with_override(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Flags after updates: only known slugs change."""
    new = updates.select("slug", F.col("enabled").alias("_e"))
    return current.join(new, "slug", "left").select("slug", F.coalesce("_e", "enabled").alias("enabled"))


def flag_map(flags: DataFrame) -> DataFrame:
    """One row: slug to enabled, in the order of slugs."""
    return flags.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slug", "enabled")))).alias("flags"))


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count("*").alias("known"), F.count_if(~F.col("enabled")).alias("disabled"), F.count_if("enabled").alias("enabled"))


def slug_of_path(path: Column, aliases: dict[str, str] | None = None) -> Column:
    """The slug of /tools/{slug}/..., with aliases resolved; null for other paths."""
    parts = F.filter(F.split(F.substring_index(path, "?", 1), "/"), lambda p: p != "")
    slug = F.when(F.get(parts, F.lit(0)) == "tools", F.get(parts, F.lit(1)))
    return canonical_slug(slug, aliases or {})


def canonical_slug(slug: Column, aliases: dict[str, str]) -> Column:
    if not aliases:
        return slug
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, slug), slug)


# Parts of the paths that take uploads or make jobs.
HEAVY_PATHS = ("/convert-async", "/convert-batch-async", "/convert-batch", "/convert", "/compress", "/send", "/pickup")


def is_heavy_path(path: Column, markers: tuple[str, ...] = HEAVY_PATHS) -> Column:
    """A path with one of the markers, or the download of a job."""
    bare = F.rtrim(F.coalesce(path, F.lit("")), F.lit("/"))
    out = path.startswith("/api/jobs") & bare.endswith("/download")
    for m in markers:
        out = out | F.contains(path, F.lit(m))
    return F.coalesce(out, F.lit(False))


def is_public_convert(path: Column, method: Column, markers: tuple[str, ...] = HEAVY_PATHS) -> Column:
    """Whether a request counts against the limit: a heavy path, posted to, or got as a download."""
    download = F.rtrim(path, F.lit("/")).endswith("/download")
    return F.coalesce(is_heavy_path(path, markers) & ((F.upper(method) == "POST") | ((F.upper(method) == "GET") & download)), F.lit(False))
