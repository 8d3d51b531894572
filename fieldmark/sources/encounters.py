"""Encounter files as a data source: ``spark.read.format("encounters").load(path)``.

A record is ``history n ... x ... ;``: a detection history, a count for each group, covariates, with comments
in ``/* */`` on one line.  Options: ``groups`` names the counts (comma-separated; one, ``n``, unless given), ``covariates`` the
columns after them, ``splitBytes`` the part of a file that a partition reads.  Files are found and opened through Arrow's file systems, so
the path may be a file, a folder or a glob in any store that Arrow reaches.  Without names, columns and their types come from
the first records of every file.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

SPLIT_BYTES = 64 << 20
_HEAD = 64 << 10


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files(path: str) -> list[tuple[str, int]]:
    """(path within the store, bytes) of a file, of a folder's files, or of those that match a glob; hidden ones aside."""
    from pyarrow import fs

    store, at = _store(path)
    if any(c in at for c in "*?["):
        folder = at[: at.rindex("/")]
        found = [f for f in store.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(f.path, at)]
    else:
        one = store.get_file_info(at)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no encounter files at {path}")
        found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    out = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not re.search(r"/[._][^/]*$", "/" + f.path))
    if not out:
        raise FileNotFoundError(f"no encounter files at {path}")
    return out


def parsed(line: str, where: str) -> list[str] | None:
    """The fields of a record; None for a line without one."""
    text = re.sub(r"/\*.*?\*/", " ", line).strip()
    if not text:
        return None
    if not text.endswith(";"):
        raise ValueError(f"{where}: no ';' at the end of {line.strip()!r}")
    found = text[:-1].split()
    if not found or not re.fullmatch("[01.]+", found[0]):
        raise ValueError(f"{where}: no detection history in {line.strip()!r}")
    return found


@dataclass
class _Part(InputPartition):
    path: str
    start: int
    end: int


def _lines(store, path: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of lines that start in [start, end)."""
    with store.open_input_file(path) as f:
        at = max(start - 1, 0)
        f.seek(at)
        rest, skip = b"", start > 0  # the line that the byte before ``start`` belongs to is another partition's
        while at < end:
            block = f.read(1 << 20)
            lines = (rest + block).split(b"\n")
            rest = lines.pop() if block else b""
            for line in lines:
                if not skip and at < end:
                    yield at, line.decode("utf-8")
                skip = False
                at += len(line) + 1
            if not block:
                return


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Part(p, i, min(i + self.split, size)) for p, size in files(self.path) for i in range(0, size, self.split)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        store, _ = _store(self.path)
        make = {StringType: str, LongType: int, DoubleType: float}
        kinds = [make[type(f.dataType)] for f in self.schema.fields]
        for at, line in _lines(store, partition.path, partition.start, partition.end):
            where = f"{partition.path}, byte {at}"
            found = parsed(line, where)
            if found is None:
                continue
            if len(found) != len(kinds):
                raise ValueError(f"{where}: {len(found)} fields instead of {len(kinds)}")
            try:
                yield tuple(None if x == "." and k is not str else k(x) for k, x in zip(kinds, found))
            except ValueError as e:
                raise ValueError(f"{where}: {e}") from None


class Encounters(DataSource):
    @classmethod
    def name(cls) -> str:
        return "encounters"

    def schema(self) -> StructType:
        """Whole numbers where every field of the files' first records is one, else doubles."""
        names = lambda k: [c.strip() for c in self.options.get(k, "").split(",") if c.strip()]
        store, _ = _store(self.options["path"])
        rows: list[list[str]] = []
        for path, size in files(self.options["path"]):
            rows += [r for at, line in _lines(store, path, 0, min(size, _HEAD)) if (r := parsed(line, f"{path}, byte {at}"))]
        if not rows:
            raise ValueError(f"no records at {self.options['path']}")
        width = max(map(len, rows))
        groups, more = names("groups") or ["n"], names("covariates")
        columns = [*groups, *(more or [f"x{i}" for i in range(1, width - len(groups))])]
        if width != 1 + len(columns):
            raise ValueError(f"{width - 1} fields after the history, and names {columns}")
        whole = lambda i: all(len(r) <= i or re.fullmatch(r"[+-]?\d+|\.", r[i]) for r in rows)
        return StructType([StructField("ch", StringType()), *[StructField(c, LongType() if whole(i) else DoubleType()) for i, c in enumerate(columns, 1)]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_encounters(spark: SparkSession, path: str, groups: Sequence[str] = ("n",), covariates: Sequence[str] = (), **options) -> DataFrame:
    """Records of encounter files: ch, a count a group, covariates."""
    spark.dataSource.register(Encounters)
    return spark.read.format("encounters").options(groups=",".join(groups), covariates=",".join(covariates), **options).load(path)


def individuals(records: DataFrame, groups: Sequence[str] = ("n",), label: str = "group") -> DataFrame:
    """A row an individual: each record as often as its groups count, with the group where there are several."""
    least = F.least(*groups) if len(groups) > 1 else F.col(groups[0])
    checked = records.withColumn("_counts", F.when(least < 0, F.raise_error(F.lit("removals (negative counts) can't be read as individuals"))).otherwise(F.array(*[F.struct(F.lit(g).alias("g"), F.coalesce(g, F.lit(0)).cast("int").alias("k")) for g in groups])))
    each = checked.drop(*groups).withColumn("_count", F.explode("_counts")).drop("_counts").where("_count.k > 0")
    each = each.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_count.k")))).drop("_nth")
    return (each.withColumn(label, F.col("_count.g")) if len(groups) > 1 else each).drop("_count")
