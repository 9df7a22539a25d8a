import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import limits, packages, strokes

STROKES = "doc_id long, page_no int, x0 double, x1 double, top double, bottom double"


def plain_tables(rows, tol=strokes.SNAP):
    """Cells of one page by trying every pair of crossings; tables by growing sets."""
    edges = []
    for a, b, c, d in rows:
        x0, x1, y0, y1 = min(a, b), max(a, b), min(c, d), max(c, d)
        if y1 - y0 <= strokes.THIN and x1 - x0 >= y1 - y0:
            edges.append(("h", (y0 + y1) / 2, x0, x1))
        elif x1 - x0 <= strokes.THIN:
            edges.append(("v", (x0 + x1) / 2, y0, y1))
        else:
            edges += [("h", y0, x0, x1), ("h", y1, x0, x1), ("v", x0, y0, y1), ("v", x1, y0, y1)]
    whole = {"h": [], "v": []}
    for kind in "hv":
        mine = sorted(e[1:] for e in edges if e[0] == kind and e[3] - e[2] >= strokes.SHORTEST)
        chains = []
        for e in mine:
            if chains and e[0] - chains[-1][-1][0] <= tol:
                chains[-1].append(e)
            else:
                chains.append([e])
        for chain in chains:
            pos, parts = sum(e[0] for e in chain) / len(chain), []
            for _, lo, hi in sorted(chain, key=lambda e: e[1:]):
                if parts and lo <= parts[-1][1] + tol:
                    parts[-1][1] = max(parts[-1][1], hi)
                else:
                    parts.append([lo, hi])
            whole[kind] += [(pos, lo, hi) for lo, hi in parts]
    met = {}
    for v in whole["v"]:
        for h in whole["h"]:
            if v[1] - tol <= h[0] <= v[2] + tol and h[1] - tol <= v[0] <= h[2] + tol:
                vs, hs = met.setdefault((v[0], h[0]), (set(), set()))
                vs.add(v), hs.add(h)
    found = []
    for x, y in met:
        for low in sorted(q for p, q in met if p == x and q > y and met[x, q][0] & met[x, y][0]):
            right = [p for p, q in sorted(met) if q == y and p > x and met[p, y][1] & met[x, y][1] and (p, low) in met and met[p, low][0] & met[p, y][0] and met[p, low][1] & met[x, low][1]]
            if right:
                found.append((x, y, right[0], low))
                break
    groups = []
    for c in found:
        corners = {(c[0], c[1]), (c[2], c[1]), (c[0], c[3]), (c[2], c[3])}
        touching = [g for g in groups if g[0] & corners]
        groups = [g for g in groups if not g[0] & corners] + [(corners.union(*[g[0] for g in touching]), [c, *[x for g in touching for x in g[1]]])]
    large = [g for _, g in groups if len(g) > 1 and max(c[2] for c in g) - min(c[0] for c in g) >= 20 and max(c[3] for c in g) - min(c[1] for c in g) >= 10]
    large.sort(key=lambda g: min((c[1], c[0]) for c in g))
    return sorted((k, *(round(v, 6) for v in c)) for k, g in enumerate(large) for c in g)


def page(seed):
    """A grid with lines left out, cut short, doubled and moved a little, boxes, and strokes that lead nowhere."""
    draw = random.Random(seed)
    xs = [20]
    ys = [30]
    for _ in range(draw.randint(1, 6)):
        xs.append(xs[-1] + draw.randint(12, 60))
    for _ in range(draw.randint(1, 9)):
        ys.append(ys[-1] + draw.randint(8, 30))
    rows = []
    shift = lambda: draw.choice([0, 0, 0.5, 1])
    for y in ys:
        for a, b in zip(xs, xs[1:], strict=False):
            if draw.random() < 0.9:
                m = y + shift()
                rows.append((a, b - draw.choice([0, 2]), m, m + draw.choice([0, 1])))
    for x in xs:
        for a, b in zip(ys, ys[1:], strict=False):
            if draw.random() < 0.9:
                m = x + shift()
                rows.append((m, m, a, b if draw.random() < 0.9 else (a + b) / 2))
    rows += [(b, a, d, c) for a, b, c, d in rows[:2]]
    rows += [(300, 380, 40, 60), (300, 380, 60, 90), (500, 502, 10, 11), (600, 640, 10, 50)]
    return rows


def test_tables_equal_those_of_a_full_search(spark):
    pages = {k: page(k) for k in range(60)}
    rows = [(k, 0, *map(float, r)) for k, p in pages.items() for r in p] + [(99, 0, None, 1.0, 2.0, 3.0), (98, 0, 0.0, 50.0, 5.0, 5.0)]
    got = {}
    for r in strokes.table_cells(spark.createDataFrame(rows, STROKES).repartition(5)).collect():
        got.setdefault(r.doc_id, []).append((r.table_no, *(round(v, 6) for v in (r.x0, r.top, r.x1, r.bottom))))
    assert sum(map(len, got.values())) > 400
    for k, p in pages.items():
        assert sorted(got.get(k, [])) == plain_tables(p), k
    assert not {98, 99} & set(got)


def test_a_long_table_is_one(spark):
    lines = [(1, 0, x, x, 0.0, 20_000.0) for x in (10.0, 60.0, 110.0)] + [(1, 0, 10.0, 110.0, 20.0 * k, 20.0 * k) for k in range(1001)]
    boxes = strokes.table_boxes(strokes.table_cells(spark.createDataFrame(lines, STROKES))).collect()
    assert [(r.table_no, r.x0, r.top, r.x1, r.bottom, r.cells) for r in boxes] == [(0, 10.0, 0.0, 110.0, 20_000.0, 2000)]


def test_no_strokes_no_tables(spark):
    assert strokes.table_cells(spark.createDataFrame([], STROKES)).count() == 0


def test_codes_are_free_and_different(spark):
    taken = spark.range(990_000).selectExpr("lpad(cast(id as string), 6, '0') AS code")
    ids = spark.range(9_000).selectExpr("cast(id % 8000 as string) AS id")
    got = packages.fresh_codes(ids, taken, seed=7).collect()
    assert len({r.id for r in got}) == len({r.code for r in got}) == len(got) == 8000
    assert min(r.code for r in got) >= "990000"
    with pytest.raises(ValueError):
        packages.fresh_codes(spark.range(10_001).selectExpr("cast(id as string) AS id"), taken)
    assert packages.fresh_codes(ids.limit(0), taken).count() == 0


def test_codes_are_scattered_by_a_permutation(spark):
    for seed in (0, 5):
        n = spark.range(packages.CODES).select(packages._scattered(F.col("id"), seed).alias("c"))
        r = n.selectExpr("count(distinct c) AS d", "min(c) AS low", "max(c) AS high").first()
        assert (r.d, r.low, r.high) == (packages.CODES, 0, packages.CODES - 1)


def test_seconds_to_wait(spark):
    rows = [("k", 0.0, 0), ("k", 10.0, 1), ("k", 10.5, 2)]
    got = limits.rate_limit(spark.createDataFrame(rows, "key string, t double, item long"), key="key", time="t", item="item", limit=1, window=60.0).orderBy("item").collect()
    assert [r.retry_after for r in got] == [0, 51, 50]
    tries = [("k", float(t), t, True) for t in (0, 1, 2, 900)]
    got = limits.lockouts(spark.createDataFrame(tries, "key string, t double, item long, failed boolean"), key="key", time="t", item="item", failed="failed", max_failures=2, window=60.0, lockout=900.5).orderBy("item").collect()
    assert [(r.locked, r.sets_lock, r.wait) for r in got] == [(False, False, 0), (False, True, 900), (True, False, 899), (True, False, 1)]
