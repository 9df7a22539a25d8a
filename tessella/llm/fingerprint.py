"""Document fingerprints by one-permutation MinHash, in column expressions only.

The 64-bit hash of each five-word shingle is taken once.  Its top ``BIN_BITS``
bits choose a bin, and a bin keeps its smallest hash.  An empty bin is filled
by optimal densification: it visits the bins in an order of its own, drawn
from a hash of (bin, visited bin), and copies the first one that is not empty,
so two texts fill it alike whenever they agree there.  Of each bin the lowest
``LOW_BITS`` bits are stored, two hexadecimal digits.  Two unrelated bins agree
in these bits by chance with probability 2^-LOW_BITS; ``likeness`` corrects
for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.kernel import SHINGLE
from tessella.llm.workspace import Workspace

BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
SPACE = r"[\x20\x09-\x0D]+"
SEGMENTS = 64
RANGES_A_PARTITION = 20
REPEATS = 1000  # copies of a row above which one travels for all
HOT_ROWS = 10_000  # rows of an id above which they are dealt by a hash of the text


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column; a text without words has an empty one.

    Each step is a column of its own, as an expression used twice within one
    would be computed twice.
    """
    w, h, s, first, bins = (f"_{x}" for x in ("words", "hashes", "sorted", "first", "bins"))
    df = df.withColumn(w, F.filter(F.split(F.col(text), SPACE), lambda x: x != ""))
    df = df.withColumn(w, F.transform(w, lambda x: F.xxhash64(x)))
    many = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
    df = df.withColumn(h, F.when(F.size(w) >= SHINGLE, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(s, F.sort_array(h))
    df = df.withColumn(first, F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))
    df = df.withColumn(bins, F.transform(first, _bin))
    own = lambda b: F.get(first, (F.array_position(bins, b) - 1).cast("int"))
    # Of the filled bins, the one that bin b visits first.
    visit = lambda b: F.array_min(F.transform(first, lambda x: F.struct(F.xxhash64(b, _bin(x)).alias("at"), x.alias("x"))))["x"]
    slot = lambda b: F.when(F.array_contains(bins, b), own(b)).otherwise(visit(b))
    low = lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << LOW_BITS) - 1))), LOW_BITS // 4, "0")
    packed = F.lower(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: low(slot(b))), ""))
    return df.withColumn(name, F.when(F.size(first) > 0, packed).otherwise(F.lit(""))).drop(w, h, s, first, bins)


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two fingerprints, without the share of chance agreements."""
    wide = LOW_BITS // 4
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(F.col(a), i * wide + 1, F.lit(wide)) == F.substring(F.col(b), i * wide + 1, F.lit(wide))))
    chance = 2.0**-LOW_BITS
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(estimate)


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id and the fingerprint of its text.

    Null counts as empty; texts without words have the empty fingerprint; a
    text of one to four words is one shingle.  Repeated rows each give a row.
    """
    docs = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_fingerprint(docs, "text", "fingerprint").select("doc_id", "fingerprint")


# ---------------------------------------------------------------- each text and the next one


def _bucketed(docs: DataFrame, hot: list[int]) -> DataFrame:
    """Adds ``bucket``: of two rows the later one by (doc_id, h), descending, has no smaller bucket.

    Buckets are about equally full: the driver gets SEGMENTS quantiles of the
    ids, and between two of them buckets are of equal width.  Each of the few
    ids in ``hot``, and the null id, has a segment of its own, whose buckets
    are ranges of h.  The number of buckets follows that of shuffle partitions.
    """
    parts = max(1, -(-RANGES_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SEGMENTS))
    quantiles = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / SEGMENTS for i in range(SEGMENTS + 1)], 1e-3)
    cuts = sorted({int(c) for c in quantiles} | set(hot) | {h + 1 for h in hot})
    by_hash = F.least(F.lit(parts - 1), F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * parts).cast("int"))
    if not cuts:
        return docs.withColumn("bucket", F.lit(parts) - by_hash)
    low = F.array(*[F.lit(c) for c in cuts])
    segment = F.greatest(F.lit(1), F.size(F.filter(low, lambda c: c <= F.col("doc_id"))))
    base, top = F.element_at(low, segment), F.coalesce(F.get(low, segment), F.lit(cuts[-1] + 1))
    by_id = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - base) / (top - base) * parts).cast("int")))
    part = F.when(F.col("doc_id").isin(hot), by_hash).otherwise(by_id) if hot else by_id
    last = (len(cuts) + 2) * parts
    return docs.withColumn("bucket", F.coalesce(F.lit(last) - (segment * parts + part), F.lit(last + parts) - by_hash).cast("int"))


def with_next(docs: DataFrame, extend: Callable[[DataFrame], DataFrame], more: tuple[str, ...], *, repeats: int = REPEATS, hot: int = HOT_ROWS) -> DataFrame:
    """Adds next_text and next_<more>: those of the next row by descending doc_id, after the last those of the first.

    docs: doc_id and text.  Rows are dealt by ranges of the order and each
    range is ordered by itself.  The first row of each range also joins the
    range before it as a guest, so its end sees what follows.  ``extend`` adds
    the columns ``more`` to all rows on the way.

    Null ids come last; rows of one id follow each other by a hash of their
    text.  An id of more than ``hot`` rows is split by that hash.  A row that
    is there more than ``repeats`` times, as it is, travels once: each of its
    copies but the last is followed by a copy, and these are made again at the
    end.  The driver gets SEGMENTS ids and the hot ids, of which there are no
    more than SEGMENTS.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ids = docs.select("doc_id", "h")
    rows = ids.count()
    limit = max(hot, rows // SEGMENTS)
    crowded = [r[0] for r in ids.groupBy("doc_id").count().where((F.col("count") > limit) & F.col("doc_id").isNotNull()).collect()]
    many = ids.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where(F.col("n") > repeats)
    work = Workspace(docs.sparkSession, "fingerprint")
    many = work.keep(many.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "n"), "many")
    docs = docs.withColumn("n", F.lit(1).cast("long"))
    if not many.isEmpty():
        same = (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))
        once = docs.drop("n").join(many, same).groupBy("doc_id", "h", "n").agg(F.first("text").alias("text"))
        docs = docs.join(many.drop("n"), same, "left_anti").unionByName(once)
    dealt = _bucketed(docs, crowded)
    key = F.struct("doc_id", "h")
    tops = dealt.groupBy("bucket").agg(F.max(key).alias("top"))
    # One row a range: a few for each shuffle partition, however many rows there are.
    every = Window.orderBy("bucket")
    hosts = tops.select(F.col("bucket").alias("_b"), "top", F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(Window.partitionBy())).alias("host"))
    hosts = work.keep(hosts, "hosts")  # a table, so that its size is known when the join is planned
    heads = dealt.join(hosts, (F.col("bucket") == F.col("_b")) & (F.col("h") == F.col("top.h")) & F.col("doc_id").eqNullSafe(F.col("top.doc_id")))
    heads = heads.groupBy("host").agg(F.max(F.struct("text", "h", "n")).alias("r"))
    guests = heads.select(F.lit(None).cast("long").alias("doc_id"), F.col("r.text").alias("text"), F.col("r.h").alias("h"), F.col("r.n").alias("n"), F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    placed = extend(dealt.withColumn("guest", F.lit(False)).unionByName(guests))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc())
    columns = ("text", *more)
    out = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("NOT guest").drop("guest", "bucket", "h")
    # Of a row that stands for its copies: the last one, and the others, whose next row is a copy.
    out = out.withColumn("_inner", F.explode(F.when(F.col("n") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    out = out.withColumns({f"next_{c}": F.when(F.col("_inner"), F.col(c)).otherwise(F.col(f"next_{c}")) for c in columns})
    return out.withColumn("n", F.when(F.col("_inner"), F.col("n") - 1).otherwise(1)).drop("_inner")


def _again(df: DataFrame) -> DataFrame:
    """Each row as often as its column n says."""
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n", "_i")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and what they tell of the next document.

    Null counts as the empty text, which has the empty fingerprint; two empty
    fingerprints are alike (1), an empty one is unlike any other (0).  Ties of
    doc_id are ordered by a hash of the text; null ids come last; repeated rows
    follow each other.  A single document is followed by itself.  Empty table:
    no rows.  Very long texts are shingled whole, in one row.  Only ``doc_id``
    and ``text`` are read, so further columns of any name do no harm.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(docs, lambda df: with_fingerprint(df, "text", "fingerprint"), ("fingerprint",))
    paired = paired.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    paired = paired.withColumn("edited", edited).drop("text", "next_text")
    paired = with_fingerprint(paired, "edited", "edited_fingerprint")
    out = paired.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"), "n")
    return _again(out)
