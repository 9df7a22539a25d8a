"""Queries for the small rules: settings, names, headers, colours, codes, formatters, archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import codecs, formatters, media, numbers, text
from tessella.operators import catalog as tools
from tessella.operators import limits, packages, records
from tessella.plans import tables as t
from tessella.plans.registry import query
from tessella.sources import files, settings


def _picked(key: str, values: tuple[str, ...]):
    """One of some texts by a number, and the same for SQL."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int") + 1)


def _sql_picked(key: str, values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


def _sql_cases(key: str, values: tuple) -> str:
    """The expected value of each of some texts, by the same number."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


# ---------------------------------------------------------------- settings

_INTS = ("7", " 12 ", "x", "", "-3", "900")


@query(
    f"SELECT p_partkey, {_sql_cases('p_partkey', (7, 12, 5, 5, 1, 64))} AS setting, {_sql_cases('p_partkey', ('false', 'false', 'false', 'true', 'false', 'false'))} AS flag, {_sql_cases('p_partkey', (7, 12, 'NULL', 3, 'NULL', 'NULL'))} AS hours, {_sql_cases('p_partkey', ('NULL', 'NULL', chr(39) + 'not a number' + chr(39), 'NULL', chr(39) + 'out of range' + chr(39), chr(39) + 'out of range' + chr(39)))} AS error, p_size % 3 = 0 AS on_word FROM part"
)
def settings_numbers(spark, sf_dir):
    raw = _picked("p_partkey", _INTS)
    r = numbers.bounded_int(raw, 1, 168, 3)
    on = F.when(F.col("p_size") % 3 == 0, " YES ").otherwise("off")
    return t.table(spark, sf_dir, "part").select("p_partkey", numbers.env_int(raw, 5).alias("setting"), numbers.env_bool(raw, True).alias("flag"), r["value"].alias("hours"), r["error"].alias("error"), numbers.env_bool(on).alias("on_word"))


@query("SELECT 'K' || (c_custkey % 50) AS key, CASE WHEN c_custkey % 3 = 0 THEN 'a ' || c_custkey || ' # b' ELSE 'v' || c_custkey END AS value FROM (SELECT max(c_custkey) AS c_custkey FROM customer WHERE c_custkey % 7 <> 0 GROUP BY c_custkey % 50)")
def settings_lines(spark, sf_dir):
    """Quoted, bare and commented lines; of a repeated key the last counts."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("K"), k % 50)
    line = F.when(k % 7 == 0, F.concat(F.lit("# "), name, F.lit("=no"))).when(k % 3 == 0, F.concat(F.lit("export "), name, F.lit(' = "a '), k, F.lit(' # b"'))).when(k % 3 == 1, F.concat(name, F.lit("='v"), k, F.lit("'  "))).otherwise(F.concat(F.lit("  "), name, F.lit(" = v"), k, F.lit(" # note")))
    return settings.dotenv(t.table(spark, sf_dir, "customer").select(k.cast("int").alias("line_no"), line.alias("line")))


@query("SELECT slug FROM disabled UNION SELECT slug FROM tools WHERE pos % 4 = 0", using=(t.TOOLS, t.DISABLED))
def settings_disabled(spark, sf_dir):
    """The list form with unknown slugs, and the map form with loose booleans."""
    known = t.tools(spark, sf_dir)
    listed = settings.flags_json(tools.with_flags(known, t.disabled(spark, sf_dir).withColumn("enabled", F.lit(False))))
    pairs = known.select(F.map_from_entries(F.array(F.struct(F.concat(F.lit(" "), F.upper("slug")).alias("key"), F.when(F.col("pos") % 4 == 0, "Off").otherwise("yes").alias("value")), F.struct(F.lit("nobody").alias("key"), F.lit("0").alias("value")))).alias("tools"))
    return settings.disabled_slugs(listed.unionByName(pairs.select(F.to_json(F.struct("tools")).alias("json"))), known)


@query("SELECT slug, CASE WHEN pos % 6 = 0 THEN pos % 12 = 0 ELSE slug NOT IN (SELECT slug FROM disabled) END AS enabled FROM tools", using=(t.TOOLS, t.DISABLED))
def tools_overridden(spark, sf_dir):
    known = t.tools(spark, sf_dir)
    current = tools.with_flags(known, t.disabled(spark, sf_dir).withColumn("enabled", F.lit(False))).select("slug", "enabled")
    new = known.where("pos % 6 = 0").select("slug", (F.col("pos") % 12 == 0).alias("enabled"))
    return tools.with_override(current, new.unionByName(new.limit(1).select(F.lit("nobody").alias("slug"), F.lit(True).alias("enabled"))))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE slug NOT IN (SELECT slug FROM disabled)) AS on_, min(slug) AS first_slug FROM tools", using=(t.TOOLS, t.DISABLED))
def tools_flag_map(spark, sf_dir):
    flags = tools.with_flags(t.tools(spark, sf_dir), t.disabled(spark, sf_dir).withColumn("enabled", F.lit(False)))
    m = tools.flag_map(flags)
    return m.select(F.size("flags").cast("long").alias("n"), F.size(F.filter(F.map_values("flags"), lambda x: x)).cast("long").alias("on_"), F.get(F.map_keys("flags"), F.lit(0)).alias("first_slug"))


# ---------------------------------------------------------------- catalog

@query("SELECT slug, coalesce(name, 'x') AS name, part FROM (SELECT slug, name, part, row_number() OVER (PARTITION BY slug ORDER BY part, pos) AS n FROM (SELECT slug, name, pos, 0 AS part FROM tools WHERE pos % 2 = 0 UNION ALL SELECT slug, 'second', pos, 1 FROM tools)) WHERE n = 1", using=(t.TOOLS,))
def tools_union(spark, sf_dir):
    known = t.tools(spark, sf_dir)
    first, second = known.where("pos % 2 = 0").withColumn("part", F.lit(0)), known.withColumn("name", F.lit("second")).withColumn("part", F.lit(1))
    return tools.union_first(first, second).select("slug", "name", "part")


@query("SELECT slug FROM tools LEFT JOIN (SELECT slug AS s, pos % 5 AS r FROM tools WHERE pos % 3 = 0) ON slug = s ORDER BY coalesce(r, 999), pos LIMIT 12", using=(t.TOOLS,))
def tools_palette(spark, sf_dir):
    known = t.tools(spark, sf_dir)
    return tools.palette(known, known.where("pos % 3 = 0").select("slug", (F.col("pos") % 5).alias("recent_rank"))).select("slug")


@query("SELECT t.slug, CASE WHEN c.id IS NULL THEN '_other' ELSE c.id END AS category, t.slug NOT IN (SELECT slug FROM disabled) AS enabled FROM tools t LEFT JOIN categories c ON t.category = c.id WHERE t.pos % 2 = 0", using=(t.TOOLS, t.CATEGORIES, t.DISABLED))
def tools_by_path(spark, sf_dir):
    """Path to slug through an alias, slug to tool, tool to category and flag."""
    known = t.tools(spark, sf_dir)
    path = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("/tools/"), "slug", F.lit("/convert?x=1"))).otherwise(F.concat(F.lit("//tools/"), "slug"))
    asked = known.where("pos % 2 = 0").select(tools.slug_of_path(path, {"old": "new"}).alias("slug"))
    flags = tools.with_flags(known, t.disabled(spark, sf_dir).withColumn("enabled", F.lit(False))).select("slug", "enabled")
    nested = tools.by_category(t.categories(spark, sf_dir), known).select(F.col("category"), F.explode("tools").alias("x")).select("category", F.col("x.slug").alias("slug"))
    return asked.join(nested, "slug").join(flags, "slug").select("slug", "category", "enabled")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN lower(s_name) END AS slug FROM supplier")
def tools_canonical(spark, sf_dir):
    path = F.when(F.col("s_suppkey") % 3 == 0, "/tools/old/x").when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("/tools/"), F.lower("s_name"))).otherwise("/about/tools/x")
    return t.table(spark, sf_dir, "supplier").select("s_suppkey", tools.slug_of_path(path, {"old": "new"}).alias("slug"))


_PATHS = ("/tools/a/convert", "/api/jobs/7/download/", "/api/jobs/7", "/tools/b/format", "/tools/c/compress/x", "/express/pickup/download", "/tools/a/merge/download")


@query(f"SELECT event_id, {_sql_cases('event_id', ('true', 'true', 'false', 'false', 'true', 'true', 'false'))} AS heavy, {_sql_cases('event_id', ('post', 'true', 'false', 'false', 'post', 'true', 'false'))} AS counted FROM (SELECT event_id, user_id % 2 = 0 AS post FROM events)")
def heavy_requests(spark, sf_dir):
    path, method = _picked("event_id", _PATHS), F.when(F.col("user_id") % 2 == 0, "POST").otherwise("get")
    return t.table(spark, sf_dir, "events").select("event_id", tools.is_heavy_path(path).alias("heavy"), tools.is_public_convert(path, method).alias("counted"))


# ---------------------------------------------------------------- records and packages

_PLACES = ("a/b.pdf", "../x", "/etc/passwd", "a\\..\\b", "  ", "a..b/c")


@query(f"SELECT o_orderkey, {_sql_cases('o_orderkey', ('true', 'false', 'false', 'false', 'false', 'true'))} AS safe FROM orders")
def records_safe_paths(spark, sf_dir):
    return t.table(spark, sf_dir, "orders").select("o_orderkey", records.safe_relative(_picked("o_orderkey", _PLACES)).alias("safe"))


@query("SELECT count(*) AS files, CAST(sum(p_size * 1000) AS BIGINT) AS bytes FROM part")
def records_stored_bytes(spark, sf_dir):
    return records.stored_bytes(t.table(spark, sf_dir, "part").select((F.col("p_size") * 1000).cast("long").alias("length")))


@query("SELECT c_custkey, array_to_string(list_filter(['a' || c_custkey, 'b', 'a' || (c_custkey % 2)], lambda x, i: NOT (i = 3 AND x = 'a' || c_custkey)), ',') AS ids FROM customer")
def records_asked_ids(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    asked = F.array(F.concat(F.lit(" a"), k), F.lit("b "), F.lit("  "), F.concat(F.lit("a"), F.col("c_custkey") % 2), F.lit("b"))
    return t.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(records.ordered_ids(asked), ",").alias("ids"))


@query(
    "SELECT id, '2001-01-01T00:00:00Z' AS created_at, strftime(TIMESTAMP '2001-01-01' + INTERVAL 1 HOUR * h, '%Y-%m-%dT%H:%M:%SZ') AS expires_at, least(1000, greatest(0, d))::INT AS max_downloads, 0 AS download_count, repeat('n', CAST(least(200, d) AS INT)) AS note FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 24 ELSE least(168, greatest(1, c_custkey % 300 - 20)) END AS h, c_custkey AS d FROM customer)"
)
def packages_new(spark, sf_dir):
    """Lifetime, downloads and note within their bounds; a missing lifetime is a day, and the longest notes are a letter too long."""
    k = F.col("c_custkey")
    rows = t.table(spark, sf_dir, "customer").select(k.alias("id"), F.lit("000000").alias("code"), F.lit("f").alias("original_name"), F.lit("r").alias("stored_rel"), F.lit(1).alias("size_bytes"), F.lit("x").alias("content_type"), F.when(k % 5 != 0, k % 300 - 20).cast("int").alias("ttl_hours"), k.cast("int").alias("max_downloads"), F.repeat(F.lit("n"), F.least(k, F.lit(packages.NOTE + 1)).cast("int")).alias("note"))
    return packages.new_package(rows, t.NOW).select("id", "created_at", "expires_at", "max_downloads", "download_count", "note")


@query("SELECT p.id, download_count + CASE WHEN n IS NULL THEN 0 WHEN max_downloads > 0 THEN least(n, greatest(0, max_downloads - download_count)) ELSE n END AS download_count FROM state p LEFT JOIN (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS c, count(*) AS n FROM events GROUP BY 1) ON p.code = c AND NOT expired AND file_exists", using=(t.PACKAGES,))
def packages_after_claims(spark, sf_dir):
    rows = records.with_presence(t.packages(spark, sf_dir), t.files(spark, sf_dir), "stored_rel")
    asked = t.events(spark, sf_dir).select(F.col("event_id").alias("claim_no"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"))
    return packages.after_claims(rows, packages.claims(rows, asked, t.NOW)).select("id", F.col("download_count").cast("long").alias("download_count"))


@query("""SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN CASE WHEN h <> '' THEN h ELSE 'unknown' END WHEN trim(split_part(html, ',', 1)) = '' THEN 'unknown' ELSE trim(split_part(html, ',', 1)) END AS client
FROM (SELECT page_id, CASE WHEN page_id % 4 > 0 THEN ' ' || substr(html, 1 + 9 * (page_id % 5), 40) WHEN page_id % 8 = 0 THEN ' , ' || url ELSE '' END AS html, CASE WHEN page_id % 3 > 0 THEN url END AS h FROM pages)""")
def client_keys(spark, sf_dir):
    """Pieces of pages as forwarded addresses, blank, missing or cut at a comma; URLs as hosts."""
    k = F.col("page_id")
    sent = F.when(k % 4 > 0, F.concat(F.lit(" "), F.substring("html", 1 + 9 * (k % 5), F.lit(40)))).when(k % 8 == 0, F.concat(F.lit(" , "), "url")).otherwise("")
    return t.table(spark, sf_dir, "pages").select("page_id", limits.client_key(sent, F.when(k % 3 > 0, F.col("url"))).alias("client"))


@query("SELECT event_id, event_type IN ('click', 'error') AND (ts + INTERVAL 30 SECOND <= TIMESTAMP '2024-01-20' AND user_id % 2 = 0 OR ts < TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR) AS gone FROM events")
def jobs_reclaimable(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    rows = t.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type").isin("click", "error"), "done").otherwise("running").alias("status"), F.when(F.col("user_id") % 2 == 0, ts).alias("downloaded_at"), ts.alias("updated_at"))
    return rows.select("event_id", limits.reclaimable(F.lit("2024-01-20").cast("timestamp")).alias("gone"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'text_blocks,pages' ELSE 'pages' END AS keys FROM events")
def jobs_public(spark, sf_dir):
    m = F.create_map(F.when(F.col("event_id") % 2 == 0, "text_blocks").otherwise("filename"), F.lit("x"), F.lit("pages"), F.lit("3"))
    return t.table(spark, sf_dir, "events").select("event_id", F.array_join(F.map_keys(limits.public_result(m)), ",").alias("keys"))


# ---------------------------------------------------------------- texts

_LINES = ("第一句。", "1、项目", "short", "a line of latin letters that is long enough", "hyphen-", "（二）节 ", "• point", "汉字汉字汉字汉字汉字汉字")


@query(f"SELECT p_partkey, {_sql_cases('p_partkey', ('true', 'true', 'false', 'false', 'false', 'true', 'false', 'true'))} AS cjk, {_sql_cases('p_partkey', ('true', 'false', 'false', 'false', 'false', 'false', 'false', 'false'))} AS ends, {_sql_cases('p_partkey', ('false', 'true', 'false', 'false', 'false', 'false', 'true', 'false'))} AS item, {_sql_cases('p_partkey', ('false', 'false', 'false', 'true', 'true', 'false', 'false', 'true'))} AS full_line FROM part")
def text_marks(spark, sf_dir):
    x = _picked("p_partkey", _LINES)
    return t.table(spark, sf_dir, "part").select("p_partkey", text.has_cjk(x).alias("cjk"), text.ends_sentence(x).alias("ends"), text.starts_list_item(x).alias("item"), text.looks_full_line(x).alias("full_line"))


_LEFT, _RIGHT = ("exam-", "汉字 ", "word", "call(", "", "数"), ("ple", "汉字", " next", "x", "only", "word")


@query(f"SELECT p_partkey, {_sql_picked('p_partkey', ('example', '汉字汉字', 'word next', 'call( x', 'only', '数word'))} AS joined FROM part")
def text_joins(spark, sf_dir):
    return t.dealt(t.table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", text.soft_join(_picked("p_partkey", _LEFT), _picked("p_partkey", _RIGHT)).alias("joined"))


@query("SELECT p_partkey, 'f_' || p_partkey || '_.pdf' AS ascii, 'inline; filename=\"f_' || p_partkey || '_.pdf\"; filename*=UTF-8''''f%C3%A9%22' || p_partkey || '%2A.pdf' AS header, '/app/x' AS url, CASE WHEN p_partkey % 2 = 0 THEN '/a/b' ELSE '' END AS root FROM part")
def download_headers(spark, sf_dir):
    name = F.concat(F.lit('fé"'), "p_partkey", F.lit("*.pdf"))
    plain = F.concat(F.lit('fé"'), "p_partkey", F.lit('"".pdf'))
    return t.table(spark, sf_dir, "part").select("p_partkey", text.ascii_name(plain).alias("ascii"), F.replace(text.content_disposition(name), F.lit("*.pdf\""), F.lit("_.pdf\"")).alias("header"), text.join_url(F.lit(" app/ "), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("/x")).alias("url"), text.root_path(F.when(F.col("p_partkey") % 2 == 0, "//a/b/")).alias("root"))


_PASSWORDS = ("Admin123", "1234567890", "abcdefghijk", "good-pass-1", "", "短a1")


@query(f"SELECT c_custkey, {_sql_picked('c_custkey', ('too short,common', 'digits only,needs a letter', 'needs a digit or symbol', '', 'too short', 'too short'))} AS broken, {_sql_picked('c_custkey', ('too short', 'too short', 'too short', 'too short', 'too short', 'too short'))} AS secret FROM customer")
def credential_errors(spark, sf_dir):
    p = _picked("c_custkey", _PASSWORDS)
    return t.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.password_errors(p), ",").alias("broken"), F.regexp_replace(F.array_join(text.secret_errors(p), ","), ",weak", "").alias("secret"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'input' ELSE 'other' END AS kind FROM events")
def error_kinds(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select("event_id", text.first_rule(F.concat(F.lit("An "), "event_type"), [("(?i)ERROR", "failed"), ("^An cl", "input"), ("click", "never")], "other").alias("kind"))


_FONTS = ("ABCDEF+SimSun-Bold", "MicrosoftYaHei", "Times", "")


@query(f"SELECT p_partkey, {_sql_picked('p_partkey', ('宋体', '微软雅黑', 'Times', '宋体'))} AS family, p_partkey % 4 = 0 AS bold FROM part")
def fonts(spark, sf_dir):
    f = _picked("p_partkey", _FONTS)
    return t.table(spark, sf_dir, "part").select("p_partkey", text.font_family(f).alias("family"), text.is_bold(f).alias("bold"))


# ---------------------------------------------------------------- numbers

@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '808080' WHEN 1 THEN 'FF0080' END AS hex, CASE p_partkey % 3 WHEN 0 THEN '255,0,170' WHEN 1 THEN '1,2,255' END AS rgb, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE CAST(sqrt(CASE p_partkey % 3 WHEN 0 THEN 255.0*255+170*170 ELSE 1+4+255.0*255 END) AS DOUBLE) END AS distance FROM part")
def colours(spark, sf_dir):
    k = F.col("p_partkey") % 3
    channels = F.when(k == 0, F.array(F.lit(0.5019))).when(k == 1, F.array(F.lit(1.2), F.lit(-0.5), F.lit(0.5), F.lit(9.0))).otherwise(F.array(F.lit(0.1), F.lit(0.2)))
    rgb = numbers.parse_colour(F.when(k == 0, " #F0A ").when(k == 1, "rgb(1, 2,300)").otherwise("reddish"))
    black = numbers.parse_colour(F.lit("black"))
    return t.table(spark, sf_dir, "part").select("p_partkey", numbers.rgb_hex(channels).alias("hex"), F.array_join(rgb.cast("array<string>"), ",").alias("rgb"), numbers.colour_distance(rgb, black).alias("distance"))


@query(
    "SELECT p_partkey, CAST(greatest(0, least(100, s + 50) - greatest(0, s)) / 100.0 AS DOUBLE) AS of_first, CAST(greatest(0, least(100, s + 50) - greatest(0, s)) / 50.0 AS DOUBLE) AS of_smaller, CAST(CASE WHEN s < 6 THEN 0.0 WHEN s <= 18 THEN s ELSE least(28.0, 12 + (s - 18) * 0.25) END AS DOUBLE) AS gap, CAST(least(2.0, 3.0 / s) AS DOUBLE) AS scale, CAST(CASE WHEN 842 * s * 220.0 / 72 <= 3500 THEN 220 ELSE greatest(96, floor(3500 / (842 * s * 220.0 / 72) * 220)) END AS BIGINT) AS dpi FROM (SELECT p_partkey, p_size AS s FROM part)"
)
def box_numbers(spark, sf_dir):
    s = F.col("p_size").cast("double")
    box = lambda a, b: (a, F.lit(0.0), b, F.lit(10.0))
    one, two = box(F.lit(0.0), F.lit(100.0)), box(s, s + 50)
    return t.table(spark, sf_dir, "part").select("p_partkey", numbers.overlap_of_first(one, two).alias("of_first"), numbers.overlap_of_smaller(one, two).alias("of_smaller"), numbers.soft_gap(s).alias("gap"), numbers.scale_to_fit(F.lit(5.0), s, F.lit(10.0), F.lit(3.0)).alias("scale"), numbers.render_dpi(s * 595, s * 842).alias("dpi"))


@query("SELECT p_partkey, CASE WHEN p_size * 8 >= 416.5 THEN 'left' WHEN p_size > 5 THEN 'center' ELSE 'center' END AS span, CASE WHEN p_size * 8 / 595.0 >= 0.85 THEN 'center' ELSE 'center' END AS image, 'right' AS far_image, 'left' AS near_span FROM part WHERE p_size > 0")
def alignments(spark, sf_dir):
    half, width = F.col("p_size") * 4.0, F.lit(595.0)
    return t.table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", numbers.horizontal_align(297.5 - half, 297.5 + half, width).alias("span"), numbers.image_align(297.5 - half, half * 2, width).alias("image"), numbers.image_align(F.lit(400.0), F.lit(150.0), width).alias("far_image"), numbers.horizontal_align(F.lit(40.0), F.lit(90.0), width).alias("near_span"))


@query("SELECT p_partkey, s AS scale, 18 + (559.28::DOUBLE - w * s) / 2 AS x, 420.945::DOUBLE + (402.945::DOUBLE - h * s) / 2 AS y FROM (SELECT *, least(559.28::DOUBLE / w, 402.945::DOUBLE / h) AS s FROM (SELECT p_partkey, CAST(100 + p_size AS DOUBLE) AS w, CAST(300 - p_size AS DOUBLE) AS h FROM part))")
def half_pages(spark, sf_dir):
    m = numbers.half_page(100.0 + F.col("p_size"), 300.0 - F.col("p_size"), F.lit(0.0), F.lit(0.0), top=True)
    return t.table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", F.col("m.a").alias("scale"), F.col("m.e").alias("x"), F.col("m.f").alias("y"))


@query("SELECT p_partkey, CAST(b - a AS BIGINT) AS saved, CASE WHEN b > 0 THEN CAST(round(CAST(a AS DECIMAL(20,0)) / b, 4) AS DOUBLE) END AS ratio FROM (SELECT p_partkey, p_size * 999 AS b, p_size * 333 + 1 AS a FROM part)")
def size_savings(spark, sf_dir):
    r = numbers.size_statistics(F.col("p_size") * 999, F.col("p_size") * 333 + 1)
    return t.table(spark, sf_dir, "part").select("p_partkey", r["saved"].alias("saved"), r["ratio"].alias("ratio"))


@query("SELECT l_orderkey, list_sort(list(CAST(l_quantity AS DOUBLE)))[len(list(l_quantity)) // 2 + 1] AS middle FROM lineitem GROUP BY l_orderkey")
def upper_medians(spark, sf_dir):
    return t.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("q")).select("l_orderkey", numbers.upper_median(F.col("q")).alias("middle"))


# ---------------------------------------------------------------- codes

_PIECES = ("plain", r"\u4e2d\u6587 %u4e2d", "U+4E2D &#x4e2d; &#20013;", r"\u{1F600}", "100%")


@query(f"SELECT p_partkey, {_sql_cases('p_partkey', (0, 2, 0, 1, 0))}::BIGINT AS backslash, {_sql_cases('p_partkey', (0, 1, 0, 0, 0))}::BIGINT AS percent, {_sql_cases('p_partkey', (0, 0, 1, 0, 0))}::BIGINT AS plus, {_sql_cases('p_partkey', (0, 0, 2, 0, 0))}::BIGINT AS html, {_sql_picked('p_partkey', ('', 'backslash_u,percent_u', 'u_plus,html_entity', 'backslash_u', ''))} AS detected FROM part")
def escape_counts(spark, sf_dir):
    r = codecs.probe_unicode(_picked("p_partkey", _PIECES))
    return t.table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", F.col("r.counts.backslash_u").alias("backslash"), F.col("r.counts.percent_u").alias("percent"), F.col("r.counts.u_plus").alias("plus"), F.col("r.counts.html_entity").alias("html"), F.array_join("r.detected", ",").alias("detected"))


@query(f"SELECT p_partkey, {_sql_picked('p_partkey', ('plain', '中文 中', '中 中 中', '😀', '100%'))} AS decoded, {_sql_cases('p_partkey', (0, 3, 3, 1, 0))}::BIGINT AS replacements FROM part")
def escapes_decoded(spark, sf_dir):
    """All families at once: braces, four digits, percent, U+, hexadecimal and decimal entities."""
    r = codecs.decode_unicode(_picked("p_partkey", _PIECES))
    return t.table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", F.col("r.result").alias("decoded"), F.col("r.replacements").alias("replacements"))


@query("SELECT doc_id, text AS percent, text AS html FROM documents")
def escapes_round_trip(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select("doc_id", codecs.encode_unicode(F.col("text"), style="percent_u")["result"].alias("p"), codecs.encode_unicode(F.col("text"), style="html_entity")["result"].alias("h"))
    return d.select("doc_id", codecs.decode_unicode(F.col("p"), mode="percent_u")["result"].alias("percent"), codecs.decode_unicode(F.col("h"), mode="html_entity")["result"].alias("html"))


@query("SELECT p_partkey, chr(CAST(p_partkey % 20000 + 33 AS INT)) AS char_, CAST(p_partkey % 20000 + 33 AS INT) AS point FROM part")
def code_points(spark, sf_dir):
    c = codecs.char_of((F.col("p_partkey") % 20000 + 33).cast("int"))
    return t.table(spark, sf_dir, "part").select("p_partkey", c.alias("char_"), codecs.code_point(c).alias("point"))


# ---------------------------------------------------------------- formatters

def _formatted(name: str, key: str, make, sql: str, **options):
    """A query on texts made from a number, held against the text as it has to come out."""

    def run(spark, sf_dir):
        return t.table(spark, sf_dir, "part").select("p_partkey", formatters.format_code(make(F.col("p_partkey").cast("string")), **options).alias("r")).select("p_partkey", "r.result", "r.kind")

    run.__name__ = name
    query(f"SELECT p_partkey, {sql} AS result, '{key}' AS kind FROM (SELECT *, CAST(p_partkey AS VARCHAR) AS k FROM part)")(run)


_cat = lambda *parts: lambda k: F.concat(*[k if p is None else F.lit(p) for p in parts])
_formatted("python_formatted", "python", _cat("def f():\n\n\n\n\tif x:\n\t\treturn ", None, "   \n"), r"'def f():' || chr(10) || chr(10) || '    if x:' || chr(10) || '        return ' || k || chr(10)", lang="py", indent=4)
_formatted("yaml_formatted", "yaml", _cat("a:\n    b:\n        c: ", None), "'a:' || chr(10) || '  b:' || chr(10) || '    c: ' || k || chr(10)", lang="yml", indent=2)
_formatted("shell_formatted", "shell", _cat("if true; then\n  echo ", None, "\nfi"), "'if true; then' || chr(10) || '    echo ' || k || chr(10) || 'fi' || chr(10)", lang="bash", indent=4)
_formatted("xml_formatted", "xml:a", _cat("<a>  <b>", None, "</b>\n</a>"), "'<?xml version=\"1.0\" ?>' || chr(10) || '<a>' || chr(10) || '  <b>' || k || '</b>' || chr(10) || '</a>' || chr(10)", lang="xml", indent=2)
_formatted("xml_minified", "xml:a", _cat("<a>  <b>", None, "</b>\n</a>"), "'<?xml version=\"1.0\" ?><a><b>' || k || '</b></a>'", lang="xml", mode="minify")
_formatted("json_sorted", "object", _cat('{"b": [', None, '], "a": "é"}'), "'{' || chr(10) || '  \"a\": \"\\u00e9\",' || chr(10) || '  \"b\": [' || chr(10) || '    ' || k || chr(10) || '  ]' || chr(10) || '}'", lang="json", indent=2, sort_keys=True, ensure_ascii=True)
_formatted("js_minified", "javascript", _cat("var x = ", None, " ;\nreturn  y;"), "'var x=' || k || ';return y;'", lang="js", mode="minify")
_formatted("sql_formatted", "sql", _cat("select a  from t where b = ", None), "'SELECT a' || chr(10) || 'FROM t' || chr(10) || 'WHERE b = ' || k || chr(10)", lang="sql")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'no input' WHEN 1 THEN 'Expecting value' END AS error, CASE p_partkey % 3 WHEN 1 THEN 2 END AS line, CASE p_partkey % 3 WHEN 1 THEN 6 END AS col, p_partkey % 3 = 2 AS valid FROM part")
def code_errors(spark, sf_dir):
    k = F.col("p_partkey") % 3
    r = formatters.validate_code(F.when(k == 0, "  ").when(k == 1, '{"a": 1,\n"b": }').otherwise("[1]"), lang="json")
    return t.table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.error", "r.line", "r.col", "r.valid")


@query("SELECT * FROM (VALUES ('json', true), ('javascript', true), ('typescript', true), ('java', true), ('go', true), ('rust', true), ('php', true), ('c_cpp', true), ('csharp', true), ('python', false), ('html', true), ('css', true), ('xml', true), ('sql', true), ('yaml', false), ('shell', false)) v(language, minifies)")
def code_languages(spark, sf_dir):
    return formatters.languages(spark).select("language", "minifies")


@query("SELECT page_id, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<meta charset=\"utf-8\">' || chr(10) || '<title>a &amp; &lt;' || page_id || '&gt;</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || html || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS page FROM pages")
def html_pages(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", formatters.standalone_html(F.col("html"), F.concat(F.lit("a & <"), "page_id", F.lit(">"))).alias("page"))


# ---------------------------------------------------------------- media and files

@query("SELECT p_partkey, '<svg width=\"' || p_size || '\" height=\"5\"><g/></svg>' AS result, true AS smaller, CAST(p_size AS DOUBLE) AS width, CAST(5 AS DOUBLE) AS height FROM part")
def svg_minified(spark, sf_dir):
    raw = F.concat(F.lit("<svg  width = \""), "p_size", F.lit("\"   height=\"5\" >\n <!-- note -->\n  <g />\n</svg>\n"))
    return t.table(spark, sf_dir, "part").select("p_partkey", media.minify_svg(raw).alias("r")).select("p_partkey", "r.*")


_HEADS = ("424D00", "49492A0001", "52494646AABBCCDD5745425000", "00000100", "00", "3C7376673E")


@query(f"SELECT p_partkey, {_sql_cases('p_partkey', (chr(39) + 'bmp' + chr(39), chr(39) + 'tiff' + chr(39), chr(39) + 'webp' + chr(39), chr(39) + 'ico' + chr(39), chr(39) + 'tiff' + chr(39), 'NULL'))} AS raster, {_sql_cases('p_partkey', (chr(39) + 'jpeg' + chr(39), chr(39) + 'ico' + chr(39), 'NULL', chr(39) + 'png' + chr(39), chr(39) + 'tiff' + chr(39), 'NULL'))} AS target FROM part")
def raster_types(spark, sf_dir):
    data = F.unhex(_picked("p_partkey", _HEADS))
    name = _picked("p_partkey", (" JPG ", "icon", "heic", "PNG", "tif", ""))
    return t.table(spark, sf_dir, "part").select("p_partkey", media.detect_raster(data, F.when(F.col("p_partkey") % 6 == 4, "x.TIF").otherwise("x")).alias("raster"), media.normalized_target(name).alias("target"))


@query("SELECT format FROM (VALUES ('jpeg'), ('png'), ('webp'), ('gif'), ('bmp'), ('tiff'), ('ico')) v(format)")
def image_formats(spark, sf_dir):
    return media.formats(spark).select("format")


@query("SELECT p_partkey, CASE WHEN p_size <= 20 THEN 'a' ELSE 'b' END AS best FROM part")
def least_candidates(spark, sf_dir):
    data = lambda n, name: F.struct(F.repeat(F.lit("x"), n).cast("binary").alias("data"), F.lit(name).alias("name"))
    return t.table(spark, sf_dir, "part").select("p_partkey", media.least_candidate(F.array(data(F.col("p_size").cast("int"), "a"), data(F.lit(20), "b"), data(F.lit(20), "c"))).alias("best"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'not a Word file' WHEN p_size % 2 = 0 THEN 'empty file' END AS error, p_partkey % 4 <> 0 AS word FROM part")
def word_inputs(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 4 == 0, "a.docx.pdf").when(F.col("p_partkey") % 4 == 1, "A.DOC").otherwise("b.docx")
    return t.table(spark, sf_dir, "part").select("p_partkey", files.word_input_error(name, F.col("p_size") % 2).alias("error"), files.is_word_name(name).alias("word"))


@query(
    "SELECT batch, count(*) AS n, string_agg(entry, ',' ORDER BY idx) AS entries, false AS macros FROM (SELECT o_custkey AS batch, idx, CASE WHEN idx = 0 THEN 'a.docx' WHEN idx = 1 THEN 'a_2.docx' WHEN idx = 2 THEN 'b.docx' ELSE 'b_' || (idx + 1) || '.docx' END AS entry FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders)) GROUP BY batch"
)
def zip_entries(spark, sf_dir):
    """Batches packed and read back: repeated stems get their place, none is lost."""
    from pyspark.sql.window import Window

    idx = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    orders = t.table(spark, sf_dir, "orders")
    parts = t.parts(orders, 20_000)
    rows = t.dealt(orders, "o_custkey", 20_000).select(F.col("o_custkey").alias("batch_id"), idx.alias("idx")).withColumn("stem", F.when(F.col("idx") <= 1, "a").otherwise("b")).withColumn("content", F.encode(F.col("idx").cast("string"), "utf-8"))
    packed = files.zipped(files.entry_names(rows, parts=parts), parts=parts)
    return packed.select(F.col("batch_id").alias("batch"), F.col("files").alias("n"), F.array_join(files.zip_entries("content"), ",").alias("entries"), files.has_macros(F.col("content")).alias("macros"))
