"""Files as tables: listings, JSON archives of records, ZIP packing and checks of ZIP content."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.folds import ordered_fold, placed, whole_keys


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), length and modificationTime of all files below a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    inside = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", folder).rstrip("/") + "/"
    return files.withColumn("path", F.substring_index("path", inside, -1))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that each hold one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def entry_names(rows: DataFrame, *, group: str = "batch_id", index: str = "idx", name: str = "stem", suffix: str = ".docx", parts: int | None = None) -> DataFrame:
    """Adds ``entry``: the stem with a suffix, or with its place in the batch if an earlier entry has that name.

    A name that was made can be taken by a later stem, so each batch is a fold
    in order; a name that is taken even with its place gets further ones.
    """

    def fresh():
        used: set[str] = set()

        def step(stem: str, place: int) -> tuple[str]:
            entry = f"{stem}{suffix}"
            if entry in used:
                entry = f"{stem}_{place + 1}{suffix}"
            k = 1
            while entry in used:
                k += 1
                entry = f"{stem}_{place + 1}_{k}{suffix}"
            used.add(entry)
            return (entry,)

        return step

    return ordered_fold(rows, key=(group,), order=(index,), reads=(name, index), fresh=fresh, adds="entry string", parts=parts)


def zipped(rows: DataFrame, *, group: str = "batch_id", index: str = "idx", parts: int | None = None) -> DataFrame:
    """One ZIP for each group, of its entries (entry, content) in order; a group is one download and small.  ``parts``: tasks to deal groups to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, runs in whole_keys(batches, (group,)):
            entries, contents = whole.column("entry").to_pylist(), whole.column("content").to_pylist()
            packed = []
            for start, stop in runs:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for entry, content in zip(entries[start:stop], contents[start:stop], strict=True):
                        z.writestr(zipfile.ZipInfo(entry), content, compress_type=zipfile.ZIP_DEFLATED)
                packed.append(out.getvalue())
            keys = whole.column(group).take(pa.array([start for start, _ in runs])).combine_chunks()
            yield pa.RecordBatch.from_arrays([keys, pa.array([b - a for a, b in runs], pa.int64()), pa.array(packed, pa.binary())], names=[group, "files", "content"])

    kind = dict(rows.dtypes)[group]
    wanted = rows.select(group, index, "entry", "content")
    dealt = wanted.repartition(parts, group).sortWithinPartitions(group, index) if parts else placed(wanted, (group,), (index,))
    return dealt.mapInArrow(run, f"{group} {kind}, files long, content binary")


@F.pandas_udf(T.ArrayType(T.StringType()))
def zip_entries(content: pd.Series) -> pd.Series:
    """Names in a ZIP; null if it is none."""

    def names(data):
        try:
            return zipfile.ZipFile(io.BytesIO(data)).namelist() if data else None
        except zipfile.BadZipFile:
            return None

    return content.map(names)


def has_macros(content: Column) -> Column:
    """Whether a Word file holds a macro project."""
    return F.coalesce(F.exists(zip_entries(content), lambda n: F.lower(n).endswith("vbaproject.bin")), F.lit(False))


def is_word_name(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike(r"\.docx?$"), F.lit(False))


def word_input_error(name: Column, size: Column) -> Column:
    """Why a file cannot be converted, or null."""
    return F.when(~is_word_name(name), "not a Word file").when(F.coalesce(size, F.lit(0)) == 0, "empty file")
