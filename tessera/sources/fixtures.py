"""What sample trees are made of: image headers, links, and a few small files with set times."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tree_source import place


def write_files(spark: SparkSession, root: str, files: dict[str, bytes], modified: dict[str, int] | None = None) -> None:
    """Writes a few small files under root; modified: seconds since 1970 per path. For fixtures, from the driver."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for path, content in files.items():
        place = jvm.Path(f"{root}/{path}")
        out = fs.create(place, True)
        out.write(bytearray(content))
        out.close()
        if modified and path in modified:
            fs.setTimes(place, modified[path] * 1000, -1)


def image_header(kind: Column, width: Column, height: Column) -> Column:
    """The first bytes of a PNG, JPEG or WebP file of that size, without pixels. WebP sizes fit a byte here."""
    big = lambda n, digits: F.lpad(F.hex(n), digits, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(width, 8), big(height, 8))
    jpg = F.concat(F.lit("FFD8FFC0001108"), big(height, 4), big(width, 4))
    webp = F.concat(F.lit("524946460000000057454250565038580A00000000000000"), big(width - 1, 2), F.lit("0000"), big(height - 1, 2), F.lit("0000"))
    return F.unhex(F.when(kind == "png", png).when(kind == "jpg", jpg).otherwise(webp))


def link(root: str, path: str, target: str) -> None:
    """A symbolic link at path; only local file systems have them."""
    import os

    os.symlink(target, place(root).at(path))
