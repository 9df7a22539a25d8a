"""Quality rules whose cutoffs are certified on labelled holdouts.

Each rule is a count per text, scaled to a whole number from 0 to 10000; it
rejects what lies above a cutoff.  Labelled texts are split by a hash of the
text.  One part, of a third, proposes: each rule of a language gets the cutoff
that catches most bad texts for the good ones lost, and rules are put in the
order of that gain.  The other part decides.  Rule after rule is added, and the
exact binomial tail of the good texts that all of them reject tells whether the
true share of false rejections can exceed ``alpha``; the first step that fails
ends the sequence, which needs no correction within a language.
Between languages the error is shared out by Bonferroni, so with probability
1 - ``delta`` the limit holds in every one of them at once.

A trial is a distinct text: copies are not independent, and count once.
Everything is columns and SQL functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.let import let
from tessella.llm.workspace import Workspace

#: Share of good texts that the rules of a language may reject, and the chance of being wrong about any language.
ALPHA = 0.02
DELTA = 0.05
#: Of 1000 good texts of the proposing part, how many may lie above a rule's cutoff; each rule takes the best of these.
LEVELS = (0, 1, 2, 5, 10)
#: A share of good texts lost counts as so many times that share of bad texts kept.
GAIN = 10
TOP_VALUE = 10_000
WINDOW = 8
#: Languages with cutoffs of their own; beyond these, as those with few labels, they share one set.
MAX_STRATA = 4096

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]+"
RULES = ("symbols", "capitals", "shouts", "digits", "copied_lines", "repeats", "stutter", "long_words", "short_words")


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _removed(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(_without(text, pattern))


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words of ``w`` that lie in a run of ``window`` words which occurs twice or more in it."""
    grams = F.when(F.size(w) < window, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, window)))
    )

    def covered(h: Column) -> Column:
        def marked(s: Column) -> Column:
            twice = F.filter(s, lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)))
            at = F.sort_array(F.transform(twice, lambda e: e["i"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(at, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n")), lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked))

    return let(grams, covered)


def _of_words(w: Column) -> Column:
    stutter = F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i + 1), F.lit(False))))
    return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"), stutter.cast("long").alias("stutter"))


def _of_lines(lines: Column) -> Column:
    return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text_key, counts, base_failed, f): what the rules read of each whole text, f the rules' values in order."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, _SPACE) != "")
    read = docs.select(
        F.col("doc_id"), F.col("lang"), F.md5(text).alias("text_key"),
        F.char_length(_without(text, _SPACE)).cast("long").alias("word_chars"), _removed(text, _SYMBOLS).cast("long").alias("n_symbols"),
        _removed(text, "[A-Z]+").alias("capitals"), _removed(text, "[!?]+").alias("shouts"), _removed(text, "[0-9]+").alias("digits"),
        let(words, _of_words).alias("w"), let(lines, _of_lines).alias("x"),
    )
    read = read.select("*", "w.*", "x.*").drop("w", "x")
    n, chars, n_lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))

    def share(count: str, of: Column, scale: int = 1000) -> Column:
        return F.least(F.call_function("div", F.col(count).cast("long") * scale, of), F.lit(TOP_VALUE)).cast("int")

    long_words = share("word_chars", n, 100)
    values = [share("n_symbols", n), share("capitals", chars), share("shouts", n), share("digits", chars), share("n_dup_lines", n_lines), share("n_repeat_words", n), share("stutter", n), long_words, F.lit(TOP_VALUE) - long_words]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return read.select("doc_id", "lang", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.array(*values).alias("f"))


def _ln_factorial(n: Column) -> Column:
    """ln n!: from the product up to 20, then Stirling's series, whose error is below 1e-12 there."""
    x = F.greatest(n, F.lit(20)).cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials of chance p; 1 where k reaches n * p, as nothing is certified there.

    Terms fall fast below k < n * p, so the sum runs downwards from k; what it
    leaves out is below a 1e-15th of it.
    """
    first = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    depth = F.least(k, (60 + 12 * F.sqrt(n * p)).cast("long"))
    below = F.aggregate(
        F.sequence(F.lit(0).cast("long"), depth),
        F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct((acc["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(below)


def trials_needed(delta: float, alpha: float) -> int:
    """Good texts that must be seen, none of them rejected, to certify a limit of ``alpha``."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


@dataclass
class Certified:
    """``table``: one row a stratum (stratum, step, cuts, rejected, trials, p_value), at most MAX_STRATA + 1; ``own``: languages with a row of their own."""

    table: DataFrame
    own: list[str]


def _stratum(own: list[str]) -> Column:
    lang = F.col("lang")
    return F.when(lang.isin(own), F.concat(F.lit("lang "), lang)).otherwise(F.lit("others")) if own else F.lit("others")


def _fires(f: Column, cuts: Column) -> Column:
    return F.exists(F.zip_with(f, cuts, lambda x, c: F.coalesce(x > c, F.lit(False))), lambda x: x)


def certify(measured: DataFrame, labels: DataFrame, work: Workspace, alpha: float = ALPHA, delta: float = DELTA) -> Certified:
    """Cutoffs of each stratum, with proof.  A stratum without proof has no row.

    ``labels``: doc_id and quality (1 good, 0 bad, null unknown); of several
    labels of a text the worst counts.  A language with too few good texts in
    the deciding part to certify anything joins the stratum ``others``; a
    language without labels goes by it too, outside the guarantee.
    """
    quality = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    seen = measured.filter(~F.col("base_failed")).join(quality, "doc_id").groupBy("lang", "text_key").agg(F.min("good").alias("good"), F.min("f").alias("f"))
    part = F.conv(F.substring("text_key", 1, 8), 16, 10).cast("long") % 3
    seen = work.keep(seen.select("lang", "f", (F.col("good") == 1).alias("good"), (part == 0).alias("fit")), "seen")

    langs = seen.filter(F.col("good") & ~F.col("fit")).groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = langs.count()
    enough = langs.filter(F.col("lang").isNotNull() & (F.col("n") >= trials_needed(delta / (n_langs + 1), alpha)))
    own = [r["lang"] for r in enough.orderBy(F.desc("n"), "lang").limit(MAX_STRATA).collect()]
    seen = seen.withColumn("stratum", _stratum(own))

    values = seen.filter("fit").select("stratum", "good", F.posexplode("f").alias("rule", "value"))
    counts = values.groupBy("stratum", "rule", "value").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # at most TOP_VALUE + 1 values a rule, however many texts
    every, higher = Window.partitionBy("stratum", "rule"), Window.partitionBy("stratum", "rule").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    for name in ("good", "bad"):
        counts = counts.withColumn(f"{name}_above", F.coalesce(F.sum(name).over(higher), F.lit(0))).withColumn(f"{name}_all", F.sum(name).over(every))
    counts = counts.withColumn("next_bad", F.min(F.when(F.col("bad") > 0, F.col("value"))).over(higher))
    level = F.explode(F.array(*[F.lit(q) for q in LEVELS])).alias("level")
    allowed = F.col("good_above") * 1000 <= F.col("level") * F.col("good_all")
    cut = counts.filter(F.col("good") > 0).select("*", level).filter(allowed)
    cut = cut.groupBy("stratum", "rule", "level").agg(F.min(F.struct("value", "next_bad", "good_above", "bad_above", "good_all", "bad_all")).alias("c")).select("stratum", "rule", "level", "c.*")
    gain = F.col("bad_above") * F.col("good_all") - GAIN * F.col("good_above") * F.col("bad_all")
    # half way between the good texts below and the first bad text above
    cut = cut.select("stratum", "rule", "level", gain.alias("gain"), F.expr("(value + next_bad) div 2").cast("int").alias("cut")).filter(F.col("gain") > 0)
    cut = cut.withColumn("r", F.row_number().over(Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "level"))).filter("r = 1")
    cut = cut.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("gain"), "rule")))
    cut = cut.withColumn("n", F.max("place").over(Window.partitionBy("stratum")))
    steps = cut.select("stratum", "rule", "cut", F.explode(F.sequence("place", "n")).alias("step"))  # a rule is in force from its place on
    levels = steps.groupBy("stratum", "step").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("c"))
    levels = levels.select("stratum", "step", F.array(*[F.try_element_at("c", F.lit(i)) for i in range(len(RULES))]).alias("cuts"))

    tried = seen.join(F.broadcast(levels), "stratum").withColumn("hit", _fires(F.col("f"), F.col("cuts")))  # at most len(RULES) rows a stratum
    good, fit, hit = F.col("good"), F.col("fit"), F.col("hit")
    tried = tried.groupBy("stratum", "step").agg(
        F.count_if(good & ~fit & hit).alias("rejected"), F.count_if(good & ~fit).alias("trials"),
        F.count_if(~good & fit & hit).alias("caught"), F.count_if(~good & fit).alias("bad"), F.count_if(good & fit & hit).alias("lost"), F.count_if(good & fit).alias("kept"),
    )
    p = binomial_tail(F.col("rejected"), F.col("trials"), alpha)
    tried = tried.withColumn("p_value", p).withColumn("ok", F.col("p_value") <= delta / (len(own) + 1))
    in_order = Window.partitionBy("stratum").orderBy("step")
    tried = tried.withColumn("ok", F.min("ok").over(in_order)).filter("ok")
    benefit = F.call_function("div", 1000 * F.col("caught"), F.greatest("bad", F.lit(1))) - GAIN * F.call_function("div", 1000 * F.col("lost"), F.greatest("kept", F.lit(1)))
    best = tried.withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy(benefit.desc(), "step"))).filter("r = 1")
    chosen = best.join(levels, ["stratum", "step"]).select("stratum", "step", "cuts", "rejected", "trials", "p_value")
    return Certified(work.keep(chosen, "chosen"), own)


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed, kept, failed_rules (names, comma-joined) and n_rules (those in force) of each row of ``docs`` (doc_id, text, lang).

    A null or empty text has no words and fails the base rules.  Equal texts of
    one language fare alike, and repeated rows each have a row; rows without an
    id are judged but carry no label.  Without labels, or with too few, no
    cutoff is certified and only the base rules reject.  An empty table has no
    rows.  Texts are read whole; further columns of any name are not read.
    """
    work = Workspace(docs.sparkSession, "quality")
    measured = work.keep(measures(docs), "measures")  # some hundred bytes a text; the text is read once
    found = certify(measured, labels, work, alpha, delta)
    cuts = F.broadcast(found.table.select("stratum", "step", "cuts"))  # at most MAX_STRATA + 1 rows
    out = measured.withColumn("stratum", _stratum(found.own)).join(cuts, "stratum", "left")
    names = F.array(*[F.lit(r) for r in RULES])
    failed = F.filter(F.zip_with(F.zip_with("f", "cuts", lambda x, c: F.coalesce(x > c, F.lit(False))), names, lambda hit, name: F.when(hit, name)), lambda x: x.isNotNull())
    failed = F.coalesce(F.array_join(failed, ","), F.lit(""))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (failed == "")).alias("kept"), failed.alias("failed_rules"), F.coalesce("step", F.lit(0)).cast("int").alias("n_rules"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict on every row of ``documents``."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_SQL_VALUES = """[least(1000 * n_symbols // n, 10000), least(1000 * capitals // c, 10000), least(1000 * shouts // n, 10000), least(1000 * digits // c, 10000), least(1000 * n_dup_lines // greatest(n_lines, 1), 10000),
      least(1000 * n_repeat_words // n, 10000), least(1000 * stutter // n, 10000), least(100 * word_chars // n, 10000), 10000 - least(100 * word_chars // n, 10000)]"""
_SQL_HITS = "list_transform(list_zip(f, cuts), lambda p: coalesce(p[1] > p[2], false))"

OP12_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS x FROM documents),
grams AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, gap))::BIGINT AS n_repeat_words FROM (SELECT rid, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 8) AS gap FROM twice) GROUP BY rid),
counts AS (
  SELECT rid, doc_id, lang, md5(t) AS text_key, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '{_SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS capitals,
         length(t) - length(regexp_replace(t, '[!?]+', '', 'g')) AS shouts, length(t) - length(regexp_replace(t, '[0-9]+', '', 'g')) AS digits,
         len(x) AS n_lines, (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS stutter
  FROM d LEFT JOIN rep USING (rid)),
m AS MATERIALIZED (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_SQL_VALUES} AS f
  FROM (SELECT *, greatest(n_words, 1) AS n, greatest(word_chars, 1) AS c FROM counts)),
q AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
seen AS MATERIALIZED (
  SELECT lang, min(f) AS f, min(good) = 1 AS good, ('0x' || substr(text_key, 1, 8))::BIGINT % 3 = 0 AS fit FROM m JOIN q USING (doc_id) WHERE NOT base_failed GROUP BY lang, text_key),
langs AS (SELECT lang, count(*) AS n FROM seen WHERE good AND NOT fit GROUP BY lang),
own AS (SELECT lang FROM langs WHERE lang IS NOT NULL AND n >= ceil(ln({DELTA} / ((SELECT count(*) FROM langs) + 1)) / ln(1 - {ALPHA}))),
s AS MATERIALIZED (SELECT *, CASE WHEN lang IN (SELECT lang FROM own) THEN 'lang ' || lang ELSE 'others' END AS stratum FROM seen),
v AS (SELECT stratum, good, unnest(f) AS value, unnest(range(0, 9)) AS rule FROM s WHERE fit),
h AS (SELECT stratum, rule, value, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM v GROUP BY ALL),
a AS (
  SELECT *, coalesce(sum(good) OVER up, 0) AS good_above, coalesce(sum(bad) OVER up, 0) AS bad_above, sum(good) OVER every AS good_all, sum(bad) OVER every AS bad_all, min(CASE WHEN bad > 0 THEN value END) OVER up AS next_bad
  FROM h WINDOW up AS (PARTITION BY stratum, rule ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), every AS (PARTITION BY stratum, rule)),
cut AS (
  SELECT stratum, rule, level, bad_above * good_all - {GAIN} * good_above * bad_all AS gain, (value + next_bad) // 2 AS cut
  FROM a, unnest([{", ".join(map(str, LEVELS))}]) AS l(level) WHERE good > 0 AND good_above * 1000 <= level * good_all
  QUALIFY row_number() OVER (PARTITION BY stratum, rule, level ORDER BY value) = 1),
best AS (SELECT * FROM cut WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, level) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS place, count(*) OVER (PARTITION BY stratum) AS n FROM best),
steps AS (SELECT stratum, n, unnest(range(1, n + 1)) AS step FROM (SELECT DISTINCT stratum, n FROM placed)),
levels AS (
  SELECT s.stratum, s.step, list(p.cut ORDER BY r.rule) AS cuts
  FROM steps s CROSS JOIN range(0, 9) AS r(rule) LEFT JOIN placed p ON p.stratum = s.stratum AND p.rule = r.rule AND p.place <= s.step GROUP BY ALL),
tried AS (
  SELECT stratum, step, any_value(cuts) AS cuts, count(*) FILTER (good AND NOT fit AND hit) AS k, count(*) FILTER (good AND NOT fit) AS n,
         count(*) FILTER (NOT good AND fit AND hit) AS caught, count(*) FILTER (NOT good AND fit) AS bad, count(*) FILTER (good AND fit AND hit) AS lost, count(*) FILTER (good AND fit) AS kept
  FROM (SELECT *, list_bool_or({_SQL_HITS}) AS hit FROM s JOIN levels USING (stratum)) GROUP BY ALL),
tested AS (
  SELECT *, k < n * {ALPHA} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) <= {DELTA} / ((SELECT count(*) FROM own) + 1) AS ok FROM tried),
chosen AS (
  SELECT * FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY step) AS certified FROM tested) WHERE certified
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY 1000 * caught // greatest(bad, 1) - {GAIN} * (1000 * lost // greatest(kept, 1)) DESC, step) = 1),
j AS (SELECT m.*, c.step, {_SQL_HITS} AS hits FROM m LEFT JOIN chosen c ON c.stratum = CASE WHEN lang IN (SELECT lang FROM own) THEN 'lang ' || lang ELSE 'others' END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (step IS NULL OR NOT list_bool_or(hits)) AS kept,
       CASE WHEN step IS NULL THEN '' ELSE array_to_string(list_filter(list_transform(list_zip([{", ".join(repr(r) for r in RULES)}], hits), lambda p: CASE WHEN p[2] THEN p[1] END), lambda x: x IS NOT NULL), ',') END AS failed_rules, coalesce(step, 0)::INTEGER AS n_rules
FROM j"""
