"""Scans of folders, archives and case exchange formats as DataFrames."""

from __future__ import annotations

import os
import stat
import tarfile
import zipfile
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema
from ..functions import scalars as S


class _Folders(InputPartition):
    def __init__(self, folders: list[tuple[str, bool]]) -> None:
        self.folders = folders


class _HeadReader(DataSourceReader):
    """Heads and times of files; folders are dealt to partitions, the files of deep ones are listed by the tasks."""

    def __init__(self, options: dict) -> None:
        self.root, self.width = options["root"], int(options.get("width", "32"))

    def partitions(self) -> list[InputPartition]:
        below = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        lots = [below[k :: self.width] for k in range(self.width)]
        return [_Folders([(self.root, False)]), *[_Folders([(f, True) for f in lot]) for lot in lots if lot]]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        for folder, deep in partition.folders:
            for where, folders, names in os.walk(folder):
                if not deep:
                    folders.clear()
                for name in names:
                    path = os.path.join(where, name)
                    try:
                        s = os.stat(path, follow_symlinks=False)
                        if not stat.S_ISREG(s.st_mode):
                            continue
                        with open(path, "rb") as fh:
                            head = fh.read(16)
                    except OSError:
                        continue
                    yield path, s.st_size, s.st_mtime, s.st_ctime, s.st_atime, head


class FileHeads(DataSource):
    """Files below a folder that all executors see: path, size, three times and the first 16 bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, size long, mtime double, ctime double, atime double, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(self.options)


def scan_folder(spark: SparkSession, root: str, include_other: bool = False, most_bytes: int | None = None) -> DataFrame:
    """Files under a folder: path, rel_path, ext, kind, size, mtime, ctime and atime.

    The kind comes from the extension, else from the first 16 bytes, which are all that is read of a file; resource
    forks of the ``._`` kind are demoted.
    """
    spark.dataSource.register(FileHeads)
    rows = spark.read.format("file_heads").option("root", root.rstrip("/") or "/").load()
    if most_bytes is not None:
        rows = rows.where(F.col("size") <= most_bytes)
    ext = S.suffix(F.col("path"))
    by_ext = S.kind_by_extension(ext)
    fork = S.base_name(F.col("path")).startswith("._") & F.hex("head").startswith("00051607")
    kind = F.when(fork, "other").when(by_ext != "other", by_ext).otherwise(F.coalesce(S.kind_by_magic(F.col("head")), F.lit("other")))
    base = root.rstrip("/") + "/"
    rows = rows.select("path", F.expr("path").substr(len(base) + 1, 1_000_000).alias("rel_path"), ext.alias("ext"), kind.alias("kind"), "size", "mtime", "ctime", "atime")
    return rows if include_other else rows.where(F.col("kind") != "other")


class _Archive(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("paths", "").split("\n") if p]

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        path = partition.path
        if zipfile.is_zipfile(path):
            with zipfile.ZipFile(path) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield path, i.filename, i.file_size, i.CRC, bool(i.flag_bits & 1), int(i.header_offset)
        elif tarfile.is_tarfile(path):
            with tarfile.open(path) as t:
                for m in t:
                    if m.isfile():
                        yield path, m.name, m.size, None, False, m.offset_data


class ArchiveMembers(DataSource):
    """Members of zip and tar files, one partition per archive."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, name string, size long, crc long, encrypted boolean, member_offset long"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


def archive_members(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").option("paths", "\n".join(paths)).load()


def read_media_index(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Entries of an XML media index in UTF-16, pictures and films: path, category (0 is none), size, hashes and times."""
    if row_tag is None:
        return reduce(DataFrame.unionByName, [read_media_index(spark, path, tag) for tag in ("Image", "Movie")])
    fields = "path string, category string, id string, fullpath string, created string, hash string, sha1Hash string, fileSize string"
    raw = spark.read.format("xml").option("rowTag", row_tag).option("encoding", "UTF-16").schema(fields).load(path)
    code = F.col("category").try_cast("int")
    return raw.select("path", F.when(code != 0, code).alias("category"), F.col("fileSize").try_cast("long").alias("size"), F.lower("hash").alias("md5"), F.lower("sha1Hash").alias("sha1"), F.nullif("created", F.lit("9999-12-31T23:59:59")).alias("created"))


def import_media(media: DataFrame) -> DataFrame:
    """Imported media records grouped by path: the first record's fields, the first category given, other paths.

    ``media`` has pos, path, md5, category and size; a path may occur in several records.
    """
    given = F.when(F.col("category").isNotNull() & (F.col("category") != schema.UNCATEGORIZED), F.struct("pos", "category"))
    first = F.min(F.struct("pos", "md5", "size")).alias("f")
    return media.where(F.col("path").isNotNull()).groupBy("path").agg(first, F.min(given).getField("category").alias("category"), F.count(F.lit(1)).alias("records")).select("path", "f.md5", "f.size", "category", "records")


def region_of(body: Column) -> Column:
    """Region tag, in capitals, in the metadata address that an export names as its context; null without one."""
    context = F.regexp_extract(body, r'"@odata\.context"\s*:\s*"([^"]*)"', 1)
    return F.upper(F.nullif(F.regexp_extract(context, r"\.xml/([A-Za-z][A-Za-z-]*)/\$metadata", 1), F.lit("")))


def embedded_images(pages: DataFrame) -> DataFrame:
    """(page_id, n, mime, bytes) of pictures embedded in HTML as data addresses."""
    found = F.regexp_extract_all("html", F.lit(r"data:image/([a-z0-9.+-]+);base64,([A-Za-z0-9+/=\s]+)"), 0)
    rows = pages.select("page_id", F.posexplode(found).alias("n", "uri"))
    return rows.select("page_id", "n", F.regexp_extract("uri", "data:(image/[a-z0-9.+-]+);", 1).alias("mime"), F.expr("try_to_binary(regexp_replace(split(uri, ',')[1], '\\\\s', ''), 'base64')").alias("bytes"))
