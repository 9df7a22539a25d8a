"""Line dedup, suffix dedup, near duplicates and decontamination against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import decontaminate, jaccard_join, line_dedup, suffix_dedup
from tessella.llm.components import connected
from tessella.llm.kernel import gram_of, words
from tessella.llm.workspace import Workspace
from tests.llm.conftest import DDL


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- line dedup


def plain_lines(rows):
    """{doc_id: (n_lines, n_dropped, kept)} by the rule as it stands."""
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(d)
    gone = {k: max(d) for k, d in held.items() if len(d) >= 3}
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), d) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_match_plain_rule(docs, corpus):
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert found == plain_lines([(r[0], r[1]) for r in corpus])
    assert sum(x[1] for x in found.values()) > 10


@pytest.mark.parametrize("heavy", [0, line_dedup.HEAVY])
def test_lines_with_dealt_filters_and_repeated_ids(spark, docs, corpus, monkeypatch, heavy):
    """Filters beyond the broadcast size, several shards, keys with many references; ids that repeat or lack, as the SQL has it."""
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    monkeypatch.setattr(line_dedup, "DEALT_ROWS", 5)
    index = line_dedup.LineIndex(spark, shard_keys=2)
    index.insert(docs)
    assert index.shards > 1 or index.refcounts.where("refs >= 3").count() <= 2
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_repeated_lines(docs, index=index).collect()}
    assert found == plain_lines([(r[0], r[1]) for r in corpus])
    line, other = "a line of more than twenty letters", "Another Line Of More Than Twenty Letters"
    rows = [(1, line), (1, f"{line}\nx"), (2, line), (5, other), (5, other), (6, f" {other.lower()}\t"), (None, f"{other}\n{other}"), (None, f"{other}\n{other}"), (7, None), (8, ""), (None, None)]
    import duckdb

    table = spark.createDataFrame(rows, "doc_id long, text string")
    with duckdb.connect() as duck:
        documents = table.toPandas()
        documents["doc_id"] = documents["doc_id"].astype("Int64")
        duck.register("documents", documents)
        wanted = sorted(map(str, duck.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.OP1_SQL})").fetchall()))
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in line_dedup.drop_repeated_lines(table).collect()]
    assert sorted(map(str, got)) == wanted and sum(r[2] for r in got) == 6


def test_line_index_is_compacted(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(line_dedup, "COMPACT", 2)
    index = line_dedup.LineIndex(spark)
    for part in range(3):
        index.insert(docs.where(f"doc_id % 3 = {part}"))
    index.delete(spark.createDataFrame([(r[0],) for r in corpus if r[0] % 8 == 0], "doc_id long"))
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_repeated_lines(docs.where("doc_id % 8 <> 0"), index=index).collect()}
    assert len(index._counted) == 2 and found == plain_lines([(r[0], r[1]) for r in corpus if r[0] % 8])


def test_line_index_forgets_and_learns(spark, docs, corpus):
    index = line_dedup.LineIndex(spark)
    index.insert(docs)
    index.delete(spark.createDataFrame([(r[0],) for r in corpus if r[0] % 8 == 0 or r[0] == 9999], "doc_id long"))
    left = [(r[0], r[1]) for r in corpus if r[0] % 8]
    current = docs.where("doc_id % 8 <> 0")
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_repeated_lines(current, index=index).collect()}
    assert found == plain_lines(left)
    index.insert(docs.where("doc_id % 8 = 0"))
    again = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_repeated_lines(docs, index=index).collect()}
    assert again == plain_lines([(r[0], r[1]) for r in corpus])


def test_line_index_counts_a_document_once(spark):
    """Repeated inserts change nothing, deletes undo them whole, and rows without an id go by their text."""
    line, other = "a line of more than twenty letters", "another line of more than twenty letters"
    ddl = "doc_id long, text string"
    docs = spark.createDataFrame([(7, line), (8, f"{line}\n{other}"), (None, line), (None, other)], ddl)
    refs = lambda index: sorted((r.refs, r.last) for r in index.refcounts.collect())
    index = line_dedup.LineIndex(spark)
    index.insert(docs)
    before = refs(index)
    assert before == [(2, 8), (3, 8)]
    for again in (docs, docs.where("doc_id = 7"), spark.createDataFrame([(7, f"{line}\nx")], ddl)):
        index.insert(again)
        assert refs(index) == before
    index.delete(spark.createDataFrame([(7,)], "doc_id long"))
    assert refs(index) == [(2, 8), (2, 8)]
    index.delete(spark.createDataFrame([(None, line)], ddl), text="text")
    assert refs(index) == [(1, 8), (2, 8)]
    index.delete(docs.select("doc_id", "text"), text="text")
    assert refs(index) == [] and index.references.isEmpty()
    index.insert(docs)
    assert refs(index) == before


def test_cuckoo_filter_holds_and_forgets():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 3000)
    made = line_dedup.CuckooFilter.build(keys)
    assert made.contains(keys).all()
    others = np.random.default_rng(2).integers(-(2**62), 2**62, 20000)
    assert made.contains(others).mean() < 0.002
    assert all(made.remove(int(k)) for k in keys[:1000])
    assert made.contains(keys[1000:]).all() and made.contains(keys[:1000]).mean() < 0.05
    assert line_dedup.CuckooFilter.from_bytes(made.to_bytes()).contains(keys[1000:]).all()


# ---------------------------------------------------------------- suffixes


def test_two_stage_sort_finds_repeats():
    draw = np.random.default_rng(3)
    for _ in range(150):
        segs = [bytes(draw.integers(97, 97 + draw.integers(1, 4), draw.integers(1, 40)).astype(np.uint8)) for _ in range(draw.integers(1, 8))]
        group, times, span = draw.integers(0, 3, len(segs)), draw.integers(1, 3, len(segs)), int(draw.integers(2, 9))
        text, at = np.frombuffer(b"".join(segs), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in segs])))
        found = suffix_dedup.repeated_strings(text, at, group.astype(np.int64), times, span)
        seen = Counter()
        for s, g, m in zip(segs, group, times, strict=True):
            for i in range(len(s) - span + 1):
                seen[g, s[i : i + span]] += m
        for s, g, o in zip(segs, group, at, strict=False):
            for i in range(len(s)):
                assert found[o + i] == (i <= len(s) - span and seen[g, s[i : i + span]] >= 2)


def plain_repeats(rows, span):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        out.append((d, len(t), int(gone.sum()), len(edges) // 2, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "group"), [(4096, 2 << 20), (1, 2 << 20), (1, 300), (4096, 300)])
def test_repeated_bytes_go(docs, corpus, monkeypatch, hot, group):
    """Whole groups, groups split by slices, and groups split by single strings give the same."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    found = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(found, key=str) == plain_repeats([(r[0], r[1]) for r in corpus], 200)


def test_one_line_with_many_neighbours(spark):
    """A group of one long line among different texts is sorted in parts."""
    line = "".join(np.random.default_rng(5).choice(list("abcdefgh "), 190))
    rows = [(k, f"{k:07d} {line} {k * 7919 % 100003:06d}") for k in range(20_000)] + [(30_000 + k, f"{k:07d} {line} {k * 7919 % 100003:06d}") for k in range(3)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_removed").collect()
    removed = {r.doc_id: r.n_removed for r in out}
    texts, starts = dict(rows), Counter()
    for t in texts.values():
        starts.update({t[i : i + 200] for i in range(len(t) - 199)})
    for d in (0, 1, 2, 9, 30_000, 12_345, 19_999):
        gone = set()
        for i in range(len(texts[d]) - 199):
            if starts[texts[d][i : i + 200]] > 1:
                gone |= set(range(i, i + 200))
        assert removed[d] == len(gone)


def test_repeats_within_one_text(spark):
    rows = [(1, "xyz" * 200), (2, "q" * 199), (3, "r" * 200), (4, "s" * 201)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in found], key=str) == plain_repeats(rows, 200)


# ---------------------------------------------------------------- near duplicates


def shingle_set(text):
    data = (text or "").encode()
    h = words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash
    g = min(5, len(h))
    return {int(gram_of(h[i : i + g])) for i in range(len(h) - g + 1)} if g else set()


def plain_links(rows):
    sets = [(d, shingle_set(t), t or "") for d, t in rows]
    links = defaultdict(set)
    for d, a, t in sets:
        for e, b, u in sets:
            if d != e and (len(a & b) >= 0.8 * len(a | b) if a or b else t == u):
                links[d].add(e)
    return links


@pytest.mark.parametrize("leaf", [512, 2])
def test_links_match_brute_force(docs, corpus, leaf):
    links = plain_links([(r[0], r[1]) for r in corpus])
    found = {r.doc_id: r for r in jaccard_join.near_duplicates(docs, leaf=leaf).collect()}
    assert {d: r.n_links for d, r in found.items()} == {r[0]: len(links[r[0]]) for r in corpus}
    for d, r in found.items():
        group, todo = {d}, [d]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        assert r.class_id == min(group)
    assert found[100].class_id == found[7].class_id == 7 and found[201].copy_of == 9 and found[201].n_copies == 3


def test_one_of_each_keeps_the_smallest(docs, corpus):
    kept = {r[0] for r in jaccard_join.one_of_each(docs).collect()}
    links = plain_links([(r[0], r[1]) for r in corpus])
    assert kept == {r[0] for r in corpus if r[0] < min(links[r[0]], default=10**9)}


def test_one_id_with_two_texts(spark):
    def prose(seed, n=60):
        draw = np.random.default_rng(seed)
        return [str(x) for x in draw.integers(10**6, size=n)]

    near = [" ".join(prose(k)) for k in (1, 2)]
    far = [" ".join([*prose(k)[:-1], "end"]) for k in (1, 2)]
    alike = [" ".join(prose(3)), " ".join([*prose(3)[:-1], "end"])]
    rows = [(5, near[0]), (5, near[1]), (6, far[0]), (7, far[1]), (8, alike[0]), (8, alike[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r)[:4] for r in jaccard_join.near_duplicates(docs).collect())
    assert found == [(5, 5, 1, 1), (5, 5, 1, 1), (6, 5, 1, 1), (7, 5, 1, 1), (8, 8, 1, 1), (8, 8, 1, 1)]
    kept = sorted(tuple(r) for r in jaccard_join.one_of_each(docs).collect())
    assert kept[:2] == sorted(rows[:2]) and len(kept) == 3 and kept[2] in rows[4:]


def test_leaves_drop_no_pair_at_the_threshold():
    """Even if the signatures of two sets of similarity 0.8 agree nowhere."""
    draw = np.random.default_rng(5)
    pool = draw.integers(1 << 63, size=160_000).astype(np.uint64)
    for n in (9, 90, 900, 9_000, 90_000):
        sets = [pool[:n], pool[n // 9 : n // 9 + n], pool[n // 9 + n // 2 : n // 9 + n // 2 + n]]
        rows = [{"leaf": 1, "i": 0, "j": 0, "r": 0, "block": 0, "node": k, "n": n, "members": 1, "leaves": [1], "counts": jaccard_join.bucket_counts(s).tobytes(), "sig": [k] * 30} for k, s in enumerate(sets)]
        kept = {r[5] for r in jaccard_join._plausible(0.8)(rows)}
        assert kept >= {0, 1} and (n > 900 or kept == {0, 1})


def test_words_end_at_any_punctuation_and_case_is_folded():
    def spans(text):
        data = text.encode() if isinstance(text, str) else text
        w = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        return [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end)], w.hash.tolist()

    plain = spans("he said 'no' - not... now 7 times don t")
    assert spans("He said \u2018no\u2019 \u2014 not\u2026\u00a0now\u30017\u3000times don\u2019t") == plain == spans("\u00abhe\u00bb said \u00bfno? not now 7 times don\u2011t \U0001f600")
    for text in ("ÀÉÎ ÐÞ", "ПРИВЕТ МИР", "ΚΑΛΗΜΕΡΑ", "ŁÓDŹ ČEŠTINA", "VIỆT NAM", "\U00010400\U00010401", "日本 cafe\u0301 × x²"):
        found, _ = spans(text)
        assert found == [x.encode() for x in text.lower().replace("×", " ").split()]
    assert spans(b"a\xe2\x80 b\xff")[0] == [b"a\xe2\x80", b"b\xff"]


def test_runs_reach_the_recall():
    assert 1 - (1 - 0.8**3) ** jaccard_join.runs_for(0.8) >= 0.999


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60) if k % 20] + [(500, k) for k in range(501, 520)] + [(7, 7)]
    found = dict(rows_of(connected(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"))))
    assert found[20] == 1 and found[40] == 21 and found[519] == 500 and 500 not in found


# ---------------------------------------------------------------- decontamination


def test_leaks_match_brute_force(spark, docs, corpus, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def hashes(t):
        data = (t or "").encode()
        return words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash

    def bag(h, g):
        return Counter(int(gram_of(h[i : i + g])) for i in range(len(h) - g + 1))

    wanted = {}
    for item, t in items:
        b = hashes(t)
        if not len(b):
            continue
        g = min(5, len(b))
        own = bag(b, g)
        for d, u, *_ in corpus:
            h = hashes(u)
            size = min(len(b), len(h))
            if size < g:
                continue
            for i in range(len(h) - size + 1):
                x = bag(h[i : i + size], g)
                if not own.keys() & x.keys():
                    continue
                both = sum((own & x).values())
                s = both / (sum(own.values()) + sum(x.values()) - both)
                if s >= 0.8:
                    wanted[d, item] = max(s, wanted.get((d, item), 0))
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert found == wanted and (8, 1) in found and (0, 0) in found
    clean = {r[0] for r in decontaminate.clean_documents(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert clean == {r[0] for r in corpus} - {d for d, _ in wanted}


def test_hamming_index_misses_nothing():
    draw = np.random.default_rng(5)
    prints = draw.integers(0, 2**63, 400, dtype=np.uint64)
    index = decontaminate.HammingIndex(prints)
    for _ in range(200):
        probe = prints[draw.integers(400)]
        for bit in draw.choice(64, draw.integers(0, 24), replace=False):
            probe ^= np.uint64(1) << np.uint64(bit)
        near = np.flatnonzero(np.bitwise_count(prints ^ probe) <= decontaminate.RADIUS)
        assert set(index.search(probe)) == set(near)


def test_items_in_blocks(spark, docs, folder, monkeypatch):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    whole = sorted(rows_of(decontaminate.contaminated(docs, items)))
    clean = sorted(rows_of(decontaminate.clean_documents(docs, items)), key=str)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    monkeypatch.setattr(decontaminate, "DEALT_DOCS", 2)
    assert whole and sorted(rows_of(decontaminate.contaminated(docs, items))) == whole
    assert sorted(rows_of(decontaminate.clean_documents(docs, items)), key=str) == clean


def test_rows_are_judged_by_their_texts_at_any_size_of_the_benchmark(spark, odd, folder, monkeypatch):
    """Rows that share an id, or have none, stay or go each by its own text."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    leak = next(r.text for r in items.collect() if r.text and len(r.text) > 100)
    rows = [(1, leak, "en", "a", 1), (1, "nothing to see in this row of plain words", "en", "a", 1), (1, leak, "de", "b", 2), (None, leak, None, None, None), (None, "clean and without an id", "en", "a", 1)]
    own = spark.createDataFrame(rows, DDL)
    small = [sorted(rows_of(decontaminate.clean_documents(d, items)), key=str) for d in (own, odd)]
    assert len(small[0]) == 2
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 1)
    assert [sorted(rows_of(decontaminate.clean_documents(d, items)), key=str) for d in (own, odd)] == small


# ---------------------------------------------------------------- odd input


def test_odd_rows_have_defined_results(odd, none, spark, folder):
    n = odd.count()
    lines = line_dedup.drop_repeated_lines(odd).collect()
    assert len(lines) == n and all(r.n_lines >= 1 for r in lines)
    bytes_ = suffix_dedup.remove_repeats(odd).collect()
    assert len(bytes_) == n and {r.n_removed for r in bytes_ if r.doc_id == 3} == {r.n_bytes for r in bytes_ if r.doc_id == 3}
    links = jaccard_join.near_duplicates(odd).collect()
    assert len(links) == n and {r.n_copies for r in links if r.doc_id == 3} == {3}
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontaminate.contaminated(odd, items).count() >= decontaminate.contaminated(odd.dropDuplicates(["doc_id"]), items).count()
    for out in (decontaminate.clean_documents(odd, items), jaccard_join.one_of_each(odd)):
        assert out.columns == odd.columns and {tuple(r)[5:] for r in out.collect()} == {tuple(range(20))}  # values as they were
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1
    for empty in (line_dedup.drop_repeated_lines(none), suffix_dedup.remove_repeats(none), jaccard_join.near_duplicates(none), decontaminate.contaminated(none, items), jaccard_join.one_of_each(none), decontaminate.clean_documents(none, items.where("false"))):
        assert empty.count() == 0


def test_digest_columns(spark, folder):
    row = next(r for r in line_dedup.op1_line_dedup(spark, folder).collect() if r.doc_id == 203)
    assert tuple(row) == (203, 1, 0, hashlib.sha256(b"").hexdigest())
    row = next(r for r in suffix_dedup.op10_suffix_dedup(spark, folder).collect() if r.doc_id == 202)
    assert tuple(row) == (202, 0, 0, 0, hashlib.sha256(b"").hexdigest())
