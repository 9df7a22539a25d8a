"""Phrases that are commoner than their parts, mined per language.

All runs of 1 to ``max_n`` words are exploded into rows and counted by hash
aggregation, one length at a time, so the shuffle of one length is gone before
the next begins.  What reaches ``min_count`` meets the counts of its parts by
joins, is scored in exact decimals, and goes when a candidate one word longer
holds it often enough.  Counts fall as phrases grow, so a phrase inside any
longer candidate is inside one of one more word that is at least as frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.workspace import Workspace

MAX_N = 3
MIN_COUNT = 10
COVER_PERCENT = 50
TOP = 2000
NO_LANG = "und"
#: Words that make up one in so many of all words, so at most so many, can begin or end very many candidates: their rows are spread over SALTS places.
HOT = 4096
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = r"[.,;:!?\x0A-\x0D]"


def _pieces(text: Column) -> Column:
    """Pieces of a text between ends of clauses or lines, A-Z in lower case, tabs as spaces."""
    text = F.coalesce(text, F.lit(""))
    # of ASCII alone, lower() changes the same letters and is much cheaper
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.split(F.replace(low, F.lit("\t"), F.lit(" ")), _ENDS)


def phrases(docs: DataFrame, n: int) -> DataFrame:
    """(lang, phrase): every run of ``n`` words within a piece, one row an occurrence."""
    pieces = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.explode(_pieces(F.col("text"))).alias("piece"))
    words = pieces.select("lang", F.array_remove(F.split("piece", " "), "").alias("w"))
    if n == 1:
        return words.select("lang", F.explode("w").alias("phrase"))
    starts = F.greatest(F.size("w") - (n - 1), F.lit(0))
    runs = words.select("lang", F.explode(F.arrays_zip(*[F.slice("w", F.lit(k), starts).alias(f"w{k}") for k in range(1, n + 1)])).alias("x"))
    return runs.select("lang", F.concat_ws(" ", *[F.col(f"x.w{k}") for k in range(1, n + 1)]).alias("phrase"))


def _counted(docs: DataFrame, n: int, min_count: int) -> DataFrame:
    return phrases(docs, n).groupBy("lang", "phrase").agg(F.count("*").alias("f")).filter(F.col("f") >= min_count)


def _words_of(phrase: str, n: Column) -> Column:
    """The first ``n`` words, or from the end for a negative ``n``."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), n.cast("int"))


def _salts(lang: str, word: str, hot: list[tuple[str, str]]) -> Column:
    """How many places the rows of a word are spread over."""
    return F.when(F.concat_ws("\n", lang, word).isin(["\n".join(h) for h in hot]), F.lit(SALTS)).otherwise(1) if hot else F.lit(1)


def _with_parts(candidates: DataFrame, frequent: DataFrame, n: int, hot: list[tuple[str, str]]) -> DataFrame:
    """Each candidate of ``n`` words with the counts of the two parts of each of its cuts."""
    cut = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("k"))
    cut = cut.withColumn("left", _words_of("phrase", F.col("k"))).withColumn("right", _words_of("phrase", F.col("k") - n))
    parts = frequent.filter(F.col("n") < n).select("lang", "phrase", "f", F.explode(F.sequence(F.lit(0), _salts("lang", "phrase", hot) - 1)).alias("salt"))
    for side, name in (("left", "l"), ("right", "r")):
        other = parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name), F.col("salt"))
        cut = cut.withColumn("salt", F.pmod(F.hash("phrase"), _salts("lang", side, hot))).join(other, ["lang", side, "salt"]).drop("salt")
    return cut


def _score() -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits; at most 1000000, as no phrase is commoner than a part."""
    a, left, right = (F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r"))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a).cast("decimal(31,0)"), (left * right).cast("decimal(38,0)"))


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``max_n`` words of each language.

    ``docs`` needs ``text`` and ``lang``; further columns of any name are not
    read.  A null text has no words, a null language is ``und``, and repeated
    rows count as often as they occur.  An empty table has no phrases.  Texts
    are read whole, whatever their length.  Phrases with equal scores go by
    count, then by the bytes of the phrase.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "collocations")
    words = work.keep(_counted(docs, 1, 1), "1")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    n_words = words.agg(F.sum("f")).first()[0] or 0
    frequent = words.filter(F.col("f") >= min_count).withColumn("n", F.lit(1))
    hot = [(r["lang"], r["phrase"]) for r in frequent.filter(F.col("f") * HOT >= n_words).collect()]
    for n in range(2, max_n + 1):
        frequent = frequent.unionByName(work.keep(_counted(docs, n, min_count), str(n)).withColumn("n", F.lit(n)))

    best = None
    for n in range(2, max_n + 1):
        cut = _with_parts(frequent.filter(F.col("n") == n).select("lang", "phrase", F.col("f").alias("a")), frequent, n, hot).withColumn("score", _score())
        # the lowest score, of equal ones the first cut
        lowest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c")).select("lang", "phrase", "c.*", F.lit(n).alias("words")).drop("k")
        best = lowest if best is None else best.unionByName(lowest)
    if best is None:
        raise ValueError("phrases have two words at least")
    longer = frequent.filter(F.col("n") > 2).select(
        "lang", F.explode(F.array(_words_of("phrase", F.col("n") - 1), _words_of("phrase", 1 - F.col("n")))).alias("phrase"), "f"
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("cover")).select(F.col("lang").alias("in_lang"), F.col("phrase").alias("inner"), "cover")
    held = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")) & (100 * F.col("cover") >= cover_percent * F.col("a"))
    left = best.join(longer, held, "left_anti")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # first in parts, as one language can hold most phrases
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return left.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of ``documents``, 2000 a language at most."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
g AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
c AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE words = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT lang || chr(0) || phrase AS key, lang, words, phrase, f, string_split(phrase, ' ') AS p FROM c WHERE f >= 10),
cuts AS MATERIALIZED (
  SELECT lang, words, phrase, f AS a, k, lang || chr(0) || array_to_string(p[1:k], ' ') AS left_key, lang || chr(0) || array_to_string(p[k + 1:], ' ') AS right_key
  FROM (SELECT *, unnest(range(1, words)) AS k FROM often WHERE words >= 2)),
scored AS (
  SELECT s.lang, s.words, s.phrase, s.a, s.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * s.a * s.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts s JOIN often x ON x.key = s.left_key JOIN often y ON y.key = s.right_key),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS cover FROM (
    SELECT lang, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase, f FROM often WHERE words = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer x USING (lang, phrase) WHERE cover IS NULL OR 100 * cover < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""
