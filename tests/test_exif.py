"""Orientation of images from bytes built here."""

import struct

from pyspark.sql import functions as F

from tessella.functions import media


def tiff(order, entries, gap=0):
    mark = b"II*\0" if order == "<" else b"MM\0*"
    rows = b"".join(struct.pack(f"{order}HHIHH", tag, 3, 1, value, 0) for tag, value in entries)
    return mark + struct.pack(f"{order}I", 8 + gap) + b"x" * gap + struct.pack(f"{order}H", len(entries)) + rows + b"\0" * 4


def test_orientation(spark):
    both = [(tiff(order, [(256, 3), (274, k)], gap), k) for order in "<>" for k in range(1, 9) for gap in (0, 5)]
    jpeg = (b"\xff\xd8\xff\xe0\0\4ab\xff\xe1\0\x40Exif\0\0" + tiff(">", [(274, 6)]) + b"\xff\xd9", 6)
    png = (b"\x89PNG\r\n\x1a\n\0\0\0\x1aeXIf" + tiff("<", [(274, 8)]), 8)
    odd = [(tiff("<", [(274, 9)]), 1), (tiff("<", [(274, 0)]), 1), (tiff("<", []), 1), (tiff(">", [(275, 3)]), 1), (b"", 1), (None, 1), (b"II*\0", 1), (b"II*\0\xff\xff\xff\xff", 1), (tiff("<", [(274, 5)])[:-7], 1), (b"\xff\xd8\xff\xd9", 1), (b"GIF89a", 1)]
    rows = [*both, jpeg, png, *odd]
    data = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, (b, _) in enumerate(rows)], "k int, data binary")
    assert [r.o for r in data.select("k", media.exif_orientation(F.col("data")).alias("o")).orderBy("k").collect()] == [want for _, want in rows]
