"""From a source specification to the files relation: formats, nested containers, hash databases and the driver."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import posixpath
import sqlite3
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import names as N
from ..functions import scalars as S
from ..session import cut
from . import readers

#: Limits of unpacking one container: levels, members and bytes of a member.
MOST_DEPTH, MOST_MEMBERS, MOST_BYTES = 8, 100_000, 2 << 30
#: Tables of hash databases that are looked for first.
_HASH_TABLES = ("METADATA", "FILE", "FILES")


@dataclass(frozen=True)
class Source:
    """One source of a case: where it is and how it is read."""

    name: str
    path: str
    kind: str = "folder"
    include_other: bool = False
    most_mb: int | None = None


def archive_format(head: Column) -> Column:
    """zip, tar, tar-compressed, ewf or null, told by the first 512 bytes."""
    hx = F.hex(head)
    at = lambda i, n: F.substring(hx, 2 * i + 1, 2 * n)
    return (
        F.when(at(0, 4).isin("504B0304", "504B0506"), "zip").when(at(0, 8).isin("455646090D0AFF00", "4C5646090D0AFF00", "4556463281000000"), "ewf")
        .when(at(0, 2) == "1F8B", "tar-compressed").when(at(0, 3) == "425A68", "tar-compressed").when(at(0, 6) == "FD377A585A00", "tar-compressed").when(at(257, 5) == "7573746172", "tar")
    )


def parse_sources(spec: str) -> tuple[list[Source], dict[str, str]]:
    """Sources of a specification, and the names of case and examiner it may carry.

    A folder or an archive stands for itself; JSON names ``sources``, ``folders`` or one ``folder`` in any letter
    case, as a list, objects with a path, or plain texts, relative to where the file lies. A specification that
    names nothing is an error.
    """
    p = Path(spec)
    if p.is_dir():
        return [Source(p.name or str(p), str(p.resolve()))], {}
    if not p.exists():
        raise FileNotFoundError(f"no such source: {p.name}")
    if zipfile.is_zipfile(p) or tarfile.is_tarfile(p):
        return [Source(p.name, str(p.resolve()), "archive")], {}
    if p.suffix.lower() == ".xml":
        return [Source(p.name, str(p.resolve()), "index")], {}
    try:
        doc = json.loads(p.read_text(encoding="utf-8-sig", errors="replace"))
    except ValueError as e:
        raise ValueError(f"{p.name} is no specification of sources") from e
    low = {k.lower(): v for k, v in doc.items()} if isinstance(doc, dict) else {"sources": doc}
    if isinstance(low.get("value"), list):
        return [Source(p.name, str(p.resolve()), "records")], {}
    named = next((low[k] for k in ("sources", "folders", "folder") if low.get(k)), [])
    found = []
    for entry in named if isinstance(named, list) else [named]:
        e = {k.lower(): v for k, v in entry.items()} if isinstance(entry, dict) else {"path": entry}
        if isinstance(e.get("path"), str) and e["path"].strip():
            at = Path(e["path"]) if Path(e["path"]).is_absolute() else p.parent / e["path"]
            kind = "archive" if at.is_file() and (zipfile.is_zipfile(at) or tarfile.is_tarfile(at)) else "folder"
            found.append(Source(str(e.get("name") or at.name), str(at.resolve()), kind, bool(e.get("include_other")), e.get("max_mb")))
    if not found:
        raise ValueError(f"{p.name} names no sources")
    return found, {k: str(low[k]) for k in ("case", "examiner") if k in low}


_MEMBERS = "container string, name string, size long, content binary, note string"


def _safe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return ".." not in parts and "__MACOSX" not in parts and not name.startswith("/")


def _open(name: str, data: bytes) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """(name, size, content, note) of what a container holds; contents too large or sealed come as notes."""
    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir() and _safe(i.filename):
                    note = "encrypted" if i.flag_bits & 1 else "too large" if i.file_size > MOST_BYTES else None
                    yield i.filename, i.file_size, None if note else z.read(i), note
        return
    openers = {b"\x1f\x8b": gzip.open, b"BZ": bz2.open, b"\xfd7": lzma.open}
    if opener := openers.get(data[:2]):
        with opener(io.BytesIO(data)) as fh:
            data = fh.read(MOST_BYTES + 1)
        if len(data) > MOST_BYTES:
            yield posixpath.basename(name), len(data), None, "too large"
            return
        if not (len(data) > 262 and data[257:262] == b"ustar"):
            stem = posixpath.basename(name.rsplit("!", 1)[-1])
            yield stem.rsplit(".", 1)[0] or "content", len(data), data, None
            return
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.isfile() and _safe(m.name):
                large = m.size > MOST_BYTES
                yield m.name, m.size, None if large else t.extractfile(m).read(), "too large" if large else None


def open_containers(frontier: DataFrame) -> DataFrame:
    """Members (container, name, size, content, note) of containers (path, content).

    A container that cannot be read, or has more than MOST_MEMBERS members, gives one row with a note and no name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    for k, m in enumerate(_open(path, bytes(content))):
                        if k >= MOST_MEMBERS:
                            rows.append((path, None, None, None, "too many members"))
                            break
                        rows.append((path, *m))
                except Exception as e:  # noqa: BLE001  a damaged container must not end the run
                    rows.append((path, None, None, None, type(e).__name__))
                yield pd.DataFrame(rows, columns=["container", "name", "size", "content", "note"])

    return frontier.select("path", "content").mapInPandas(run, _MEMBERS)


def expand_containers(boxes: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Everything inside containers (path, content), level by level: (path, container, name, size, content, note, depth).

    A member's path is its container's, an exclamation mark and its name. Members that are containers are the next
    level; each is cut before it is opened, so a lost task repeats one level only.
    """
    found: list[DataFrame] = []
    level = boxes.select("path", "content")
    for depth in range(1, most_depth + 1):
        members = cut(open_containers(level).withColumn("path", F.concat("container", F.lit("!"), "name")).withColumn("depth", F.lit(depth)))
        found.append(members)
        level = members.where(F.col("content").isNotNull() & archive_format(F.substring("content", 1, 512)).isin("zip", "tar", "tar-compressed")).select("path", "content")
        if not level.head(1):
            break
    return reduce(DataFrame.unionByName, found)


class _Database(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _HashReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("paths", "").split("\n") if p]

    def partitions(self) -> list[InputPartition]:
        return [_Database(p) for p in self.paths]

    def read(self, partition: _Database) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{partition.path}?mode=ro&immutable=1", uri=True) as db:
            tables = [r[0] for r in db.execute("select name from sqlite_master where type in ('table', 'view')")]
            tables.sort(key=lambda t: (_HASH_TABLES.index(t.upper()) if t.upper() in _HASH_TABLES else len(_HASH_TABLES), t))
            for t in tables:
                columns = {r[1].lower(): r[1] for r in db.execute(f'pragma table_info("{t}")')}
                hashes = [columns[h] for h in ("md5", "sha1", "sha256") if h in columns]
                if hashes:
                    size = next((columns[s] for s in ("bytes", "size", "file_size") if s in columns), None)
                    kept = f' where "{size}" is null or "{size}" <> 0' if size else ""
                    for row in db.execute("select " + ", ".join(f'"{h}"' for h in hashes) + f' from "{t}"{kept}'):
                        for h, v in zip(hashes, row):
                            if v:
                                yield partition.path, h.lower(), str(v)
                    return


class HashDatabase(DataSource):
    """Digests of SQLite hash databases: the preferred table with hash columns, rows of empty files left out."""

    @classmethod
    def name(cls) -> str:
        return "hash_database"

    def schema(self) -> str:
        return "source string, algo string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _HashReader(self.options)


def read_hash_databases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(algo, value) of every usable digest of the databases, each once."""
    spark.dataSource.register(HashDatabase)
    rows = spark.read.format("hash_database").option("paths", "\n".join(paths)).load()
    value = S.normal_hash(F.col("value"))
    return rows.select(value.alias("value")).where(F.col("value").isNotNull()).select(S.algorithm_of(F.col("value")).alias("algo"), "value").distinct()


def record_array(bodies: DataFrame) -> DataFrame:
    """Records of JSON hash lists (doc_id, body): the elements of a list, or of the first list among the known members.

    Gives (doc_id, pos, record). A text that is neither, or is cut off, gives no record.
    """
    whole = F.try_parse_json("body")
    out = bodies.select("doc_id", whole.alias("v"))
    lists = [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ("value", "media", "objects", "data")]
    elements = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *lists)
    return out.select("doc_id", F.posexplode(elements).alias("pos", "r")).select("doc_id", "pos", F.to_json("r").alias("record"))


def ingest(spark: SparkSession, sources: list[Source], expand: bool = True) -> DataFrame:
    """The files of all sources: (source, path, rel_path, ext, kind, size, container, md5, sha1, sha256).

    Folders are scanned, archives and (if asked for) containers found in folders are opened to any depth; digests of members
    come from their one read. The result goes through ``edits.upsert_files`` into the case.
    """
    parts = []
    columns = ("source", "path", "rel_path", "ext", "kind", "size", "container", "md5", "sha1", "sha256")
    none = F.lit(None).cast("string")
    for s in sources:
        if s.kind == "folder":
            rows = readers.scan_folder(spark, s.path, s.include_other, s.most_mb and s.most_mb << 20)
            digests = {a: none for a in ("md5", "sha1", "sha256")}
            parts.append(rows.withColumns({"source": F.lit(s.name), "container": none, **digests}).select(*columns))
            boxes = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{zip,tar,gz,tgz,bz2,xz}").load(s.path) if expand else None
        else:
            boxes = spark.read.format("binaryFile").load(s.path)
        if boxes is not None:
            small_enough = boxes.where(F.col("length") <= MOST_BYTES - 1).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
            inner = expand_containers(small_enough).where(F.col("name").isNotNull())
            kind = F.coalesce(F.nullif(S.kind_by_extension(S.suffix(F.col("name"))), F.lit("other")), S.kind_by_magic(F.substring("content", 1, 16)), F.lit("other"))
            own = inner.withColumns({"source": F.lit(s.name), "rel_path": F.col("name"), "ext": S.suffix(F.col("name")), "kind": kind, **N.content_digests(F.col("content"))})
            parts.append(own.select(*columns))
    return reduce(DataFrame.unionByName, parts)
