import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages and lines, and odd rows."""
    passage, line = prose(900, 70), "This line is shared by several documents."
    rows = []
    for k in range(40):
        body = prose(k, 30 + 7 * k)
        if k % 4 == 0:
            body = body + "\n" + line + "\n  THIS line is shared by several documents.\t\nend"
        if k % 5 == 0:
            body = prose(k + 500, 10) + " " + passage + " " + body
        rows.append((k, body, "en", f"src{k % 3}", len(body)))
    near = rows[7][1].split()
    for k in range(3):
        edited = list(near)
        edited[20 + 9 * k] = f"changed{k}"
        rows.append((100 + k, " ".join(edited).replace(" ", "  ", k), "en", "src1", 0))
    rows += [(200, rows[9][1], "de", None, 0), (201, rows[9][1], "de", "src0", 0), (202, None, "en", "src2", None), (203, "", None, "src2", 0), (204, "one", "en", None, 3), (205, "..!?", "en", "src1", 4), (206, "é" * 300 + " ñandú", "es", "src1", 0), (207, prose(77, 6000), "en", "src0", 0)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """The corpus with rows repeated, ids missing, and columns named like those the operators make."""
    rows = [*corpus, corpus[3], corpus[3], (None, corpus[4][1], "en", "src0", 1), (None, None, None, None, None)]
    extra = ("id", "crc", "leaf", "size", "key", "k1", "sig", "band", "shard", "score", "keys", "spans", "bucket", "taken", "h", "_k", "_id", "_key", "tokens", "rep")
    return spark.createDataFrame([(*r, *range(len(extra))) for r in rows], DDL + "".join(f", {x} int" for x in extra)).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def folder(spark, corpus, tmp_path_factory):
    """The corpus as the tables of a data folder."""
    base = tmp_path_factory.mktemp("tables")
    path = f"file://{base}"
    spark.createDataFrame(corpus, DDL).repartition(3).write.parquet(f"{path}/documents.parquet")
    bad = ["you are a rotter", "what a scumbag you are", "rotter and scumbag"]
    marked = [(1000 + k, f"{prose(2000 + k, 12)}. {bad[k % 3]} {prose(3000 + k, 5)}. {prose(5000 + k, 9)}", 1) for k in range(120)]
    clean = [(2000 + k, f"{prose(6000 + k, 30)}. {prose(7000 + k, 8)}", 0) for k in range(240)]
    labelled = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t, _ in marked + clean], DDL)
    labelled.write.parquet(f"{path}/labelled.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in marked + clean], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, prose(900, 70)), (1, " ".join(prose(8, 86).split()[10:30]).upper()), (2, prose(12345, 25)), (3, ""), (4, None), (5, "one")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    html = [(k, f"http://x/{k}", f"<html>{prose(k % 7, 60)}</html>" if k % 5 else "<p>short</p>") for k in range(40)]
    html += [(90, None, None), (91, "http://y\r\nX: 1", "Größe\r\n\r\n" * 30), (92, "u", prose(5, 120_000))]
    spark.createDataFrame(html, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path
