import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import collocations, exponion, quality_rules
from tessella.llm.workspace import Workspace
from tests.llm.conftest import DDL, prose

VECTORS = "vec_id long, embedding array<double>, label int, cluster int, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 0, 7, "other") for i, x in rows], VECTORS).repartition(3)


def plain_clusters(rows, clusters, rounds, seed):
    """Every vector against every centroid, in Python's integers; rows in seed order."""
    import hashlib

    rows = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [list(v) for _, v in rows[:clusters]]

    def assign():
        return [min((sum((p - q) ** 2 for p, q in zip(v, x, strict=True)), j) for j, x in enumerate(c)) for _, v in rows]

    for _ in range(rounds):
        found = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, k) in zip(rows, found, strict=True) if k == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted(((r[0] is None, r[0] or 0), k, d) for r, (d, k) in zip(rows, assign(), strict=True)), c


@pytest.mark.parametrize("spread", [2, 40, 1 << 24])
def test_clusters_equal_those_of_a_full_search(spark, spread):
    draw = random.Random(spread)
    rows = [(k, [draw.randint(-spread, spread) for _ in range(5)]) for k in range(150)]
    rows += [(k, rows[3][1]) for k in range(150, 260)] + [rows[5], rows[5], (None, rows[7][1]), (None, [1, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "id long, v array<long>").repartition(4)
    for clusters, rounds in ((9, 3), (1, 1), (300, 2)):
        found = exponion.cluster(df, clusters, rounds, 2)
        want, centroids = plain_clusters(rows, clusters, rounds, 2)
        assert sorted(((r.id is None, r.id or 0), r.cluster, r.distance) for r in found.members.collect()) == want
        assert found.centroids == centroids


def test_a_ball_holds_every_centroid_that_matters():
    rng = np.random.default_rng(4)
    x = rng.integers(-9, 10, (400, 3))
    before = rng.integers(-9, 10, (30, 3))
    before[7] = before[3]  # two centroids in one place: the smaller number wins
    c = exponion.Centroids.of(before.tolist())
    d = exponion.squares(x, before)
    cluster, upper, lower, _ = exponion.search(x, np.zeros(400, dtype=np.int64), np.full(400, np.inf), np.zeros(400), c)
    assert (cluster == d.argmin(axis=1)).all()
    after = before + rng.integers(-1, 2, before.shape)
    moved, d = exponion.Centroids.of(after.tolist(), before.tolist()), exponion.squares(x, after)
    cluster, upper, lower, measured = exponion.search(x, cluster, upper, lower, moved)
    assert (cluster == d.argmin(axis=1)).all() and measured.mean() < 25 and (measured == 0).any()
    near = np.sqrt(np.sort(d, axis=1))
    assert (upper >= near[:, 0]).all() and (lower <= near[:, 1]).all()


def test_vectors_that_count(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, None), (7, []), (8, [1.0, 2.0, 3.0]), (None, [2.0, 0.0])]
    out = exponion.integer_vectors(vectors(spark, rows), dim=2).collect()
    assert sorted((r.id or 0, r.v) for r in out) == [(0, [512, 0]), (1, [128, -1])]


def test_empty_tables_of_vectors(spark):
    found = exponion.cluster(spark.createDataFrame([], "id long, v array<long>"))
    assert found.members.count() == 0 and found.centroids == []


def test_cluster_query_equals_its_sql(spark, tmp_path):
    draw = random.Random(1)
    rows = [(k, [round(draw.gauss(0, 1), 2) for _ in range(64)]) for k in range(120)] + [(500 + k, [0.25] * 64) for k in range(60)] + [(900, [0.0] * 63), (901, [float("nan")] * 64)]
    vectors(spark, rows).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), "label").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = exponion.op11_exponion(spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.sql(exponion.OP11_SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) and got.count() == 180


def test_exact_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 5, 19, 20, 21, 60, 400, 3000) for k in (0, 1, 2, 7, 30) if k <= n for p in (0.02, 0.3)]
    for p in (0.02, 0.3):
        mine = [(k, n) for k, n, q in cases if q == p]
        out = spark.createDataFrame(mine, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect()
        for r in out:
            exact = sum(Fraction(math.comb(r.n, i)) * Fraction(p) ** i * (1 - Fraction(p)) ** (r.n - i) for i in range(r.k + 1))
            assert r.t == (1.0 if r.k >= r.n * p else pytest.approx(float(exact), rel=1e-9))
    big = spark.range(1).select(quality_rules.binomial_tail(F.lit(19_000_000).cast("long"), F.lit(1_000_000_000).cast("long"), 0.02).alias("t")).first().t
    assert 0 <= big < 1e-300


def plain_repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})


def plain_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(w), plain_repeats(t)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


LONG = " ".join(prose(31, 300) for _ in range(2)) + "\n" + prose(32, 260_000)
TEXTS = [
    None, "", " \n\t ", "a " * 30, "a b c d e f g h " * 4 + "x", "one two\none two\n \n \none two ", "$$$ ### | <>&% é ü " * 9, prose(1, 50) + " " + prose(2, 30) + " " + prose(1, 50), "\x0b\x0c\r1 2\r\n3", LONG,
]


def test_counts_of_texts(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(TEXTS)] + [(None, TEXTS[4], None, None, None), (1, "", "en", "s", 0)]
    extra = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DDL + ", f int, stratum int, n_words int")
    out = quality_rules.measures(extra).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == Counter((k, *plain_counts(t)) for k, t, *_ in rows)
    assert all(len(r.f) == len(quality_rules.RULES) and 0 <= min(r.f) and max(r.f) <= quality_rules.TOP_VALUE for r in out)


def labelled(spark, langs, good, bad):
    rows, marks = [], []
    for lang in langs:
        for k in range(good + bad):
            i = len(rows)
            body = prose(10_000 + i, 40)
            junk = k >= good
            rows.append((i, body.replace(" ", " $$$ ") if junk and k % 2 else body.upper() if junk else body, lang, "s", 0))
            marks.append((i, int(not junk)))
    return spark.createDataFrame(rows, DDL).repartition(3), spark.createDataFrame(marks, "doc_id long, quality int"), {i for i, q in marks if not q}


def test_rules_catch_junk_within_the_limit(spark):
    docs, labels, junk = labelled(spark, ("en", "xx", None), 420, 60)
    out = quality_rules.judged(docs, labels).collect()
    assert {r.doc_id for r in out if not r.kept} == junk and len(out) == 1440
    assert {r.failed_rules for r in out if not r.kept} >= {"symbols", "capitals"}
    found = quality_rules.certify(quality_rules.measures(docs), labels, Workspace(spark, "t"))
    assert found.own == ["en", "xx"] or found.own == ["xx", "en"]
    for r in found.table.collect():
        tail = sum(math.comb(r.trials, i) * 0.02**i * 0.98 ** (r.trials - i) for i in range(r.rejected + 1))
        assert r.p_value == pytest.approx(tail) and tail <= 0.05 / 3


def test_few_labels_certify_nothing(spark, none):
    docs, labels, junk = labelled(spark, ("en",), 60, 20)
    out = quality_rules.judged(docs, labels).collect()
    assert all(r.kept and r.n_rules == 0 for r in out)
    assert quality_rules.judged(none, labels).count() == 0
    assert {r.kept for r in quality_rules.judged(docs, labels.limit(0)).collect()} == {True}


def test_copies_are_one_trial(spark):
    """A text repeated a thousand times proves nothing more than one."""
    docs, labels, _ = labelled(spark, ("en",), 20, 20)
    many = docs.crossJoin(spark.range(50).select(F.col("id").alias("m"))).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("m")).drop("m")
    marks = labels.crossJoin(spark.range(50).select(F.col("id").alias("m"))).select((F.col("doc_id") + 1000 * F.col("m")).alias("doc_id"), "quality")
    assert quality_rules.certify(quality_rules.measures(many), marks, Workspace(spark, "t")).table.count() == 0


def test_a_rule_that_loses_good_texts_ends_the_sequence(spark):
    """Capitals mark bad texts of the proposing part only: the deciding part must not certify them."""
    docs, labels, _ = labelled(spark, ("en",), 500, 0)
    part = F.conv(F.substring(F.md5(F.upper("text")), 1, 8), 16, 10).cast("long") % 3
    loud = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.upper("text")).otherwise(F.col("text"))).withColumn("p", part)
    marks = loud.select("doc_id", F.when((F.col("doc_id") % 10 == 0) & (F.col("p") == 0), 0).otherwise(1).alias("quality"))
    found = quality_rules.certify(quality_rules.measures(loud), marks, Workspace(spark, "t")).table.collect()
    assert found == []


def plain_phrases(rows, min_count, top):
    words, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    counts[lang or "und"][tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found, often = [], {q: b for q, b in f.items() if b >= min_count}
        for p, a in f.items():
            if len(p) < 2 or a < min_count:
                continue
            if any(100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


PHRASES = [
    ("new york city " * 6 + ". New York, new york; ice cream! ice cream", "en"), ("ice\tcream " * 9, "en"), ("a b a b a b a b a b a b", None), ("a b\na b\r\x0ba b\x0ca b:a b", "und"),
    (None, "en"), ("", None), ("x", "fr"), ("É é É é É é É é", "fr"), ("tie one. tie two. tie one. tie two. " * 3, "de"), ("to be or not to be " * 12, "en"),
]


def phrase_docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", 0, 1, "x") for k, (t, lang) in enumerate(rows)], DDL + ", a int, phrase string").repartition(3)


@pytest.mark.parametrize(("min_count", "top"), [(2, 1000), (4, 3)])
def test_phrases_equal_those_counted_one_by_one(spark, min_count, top):
    rows = PHRASES + PHRASES[:2] + [(LONG, "en")]
    got = collocations.collocations(phrase_docs(spark, rows), min_count=min_count, top=top)
    assert sorted(map(tuple, got.collect())) == plain_phrases([*PHRASES, *PHRASES[:2], (LONG, "en")] if min_count > 2 else rows, min_count, top)


def test_no_phrases_in_empty_tables(spark, none):
    assert collocations.collocations(none).count() == 0


def test_scores_of_huge_counts_are_exact(spark):
    cases = [(3 * 10**15 - 1, 3 * 10**15 - 1, 3 * 10**15), (999_999_999_999_999, 10**15, 10**15 + 7), (10, 10, 10)]
    out = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", collocations._score().alias("s")).collect()
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in out)


@pytest.mark.parametrize("name", ["op12_quality", "op13_collocations"])
def test_queries_equal_their_sql(spark, folder, name):
    from tessella.llm import catalog

    got = catalog.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder.removeprefix('file://')}/{t}.parquet/*.parquet')")
    want = con.sql(catalog.ORACLES[name])
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
