"""A partitioned dataset catalog: directories and files by path, put, cat, partitions, rm, tree, SQL over stored files."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import tiles


class Store:
    """Datasets below one root folder of any Hadoop file system; the folder tree is the metadata."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _at(self, path: str):
        clean = posixpath.normpath("/" + path)
        return self._path(self.root + clean)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def _is_file(self, path: str) -> bool:
        return self._fs.exists(self._path(f"{self._at(path)}/_columns"))

    def mkdir(self, path: str) -> None:
        parent = posixpath.dirname(posixpath.normpath("/" + path))
        if not self.exists(parent) or self._is_file(parent):
            raise FileNotFoundError(parent)
        self._fs.mkdirs(self._at(path))

    def ls(self, path: str = "/") -> list[str]:
        if not self.exists(path):
            raise FileNotFoundError(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(path)))

    def put(self, df: DataFrame, path: str, parts: int = 5, column: str | None = None) -> None:
        """Sorted by column (default: the first), in contiguous parts of nearly equal size, one folder each."""
        parent = posixpath.dirname(posixpath.normpath("/" + path))
        if not self.exists(parent):
            raise FileNotFoundError(parent)
        if self.exists(path):
            raise FileExistsError(path)
        column = column or df.columns[0]
        if "part_id" in df.columns:
            raise ValueError("part_id names the parts; rename the column")
        numbered = tiles(df, parts, column, *[c for c in df.columns if c != column])
        numbered.write.partitionBy("part_id").parquet(str(self._at(path)))
        self._fs.create(self._path(f"{self._at(path)}/_columns")).close()

    def _put_file(self, file: str, folder: str, *more: str) -> None:
        """A CSV file below a folder, under its name without suffix; a third word that is no number is the column."""
        parts, column = 5, None
        if more and more[0].isdigit():
            parts, more = int(more[0]), more[1:]
        if more:
            (column,) = more
        df = self.spark.read.option("header", True).option("inferSchema", True).csv(file)
        if column is not None and column not in df.columns:
            raise ValueError(f"no column {column}")
        self.put(df, posixpath.join("/", folder, posixpath.splitext(posixpath.basename(file))[0]), parts, column)

    def cat(self, path: str) -> DataFrame:
        if not self._is_file(path):
            raise FileNotFoundError(path)
        return self.spark.read.parquet(str(self._at(path)))

    def partitions(self, path: str) -> DataFrame:
        return self.cat(path).groupBy("part_id").agg(F.min(F.input_file_name()).alias("location"))

    def read_partition(self, path: str, k: int) -> DataFrame:
        """Partition k, from 1; only its folder is read."""
        parts = [n for n in self.ls(path) if n.startswith("part_id=")]
        if not 1 <= k <= len(parts):
            raise IndexError(k)
        return self.cat(path).where(F.col("part_id") == k).drop("part_id")

    def rm(self, path: str) -> None:
        if not self._is_file(path):
            raise FileNotFoundError(path)
        self._fs.delete(self._at(path), True)

    def rmdir(self, path: str) -> None:
        if self._is_file(path) or not self.exists(path):
            raise FileNotFoundError(path)
        if self.ls(path):
            raise OSError(f"{path} is not empty")
        self._fs.delete(self._at(path), False)

    def tree(self, path: str = "/") -> dict:
        """{title, children}; partitions are the leaves of files."""
        name = posixpath.basename(posixpath.normpath("/" + path)) or "/"
        names = [n for n in self.ls(path) if not n.startswith(("_", "."))]
        if self._is_file(path):
            return {"title": name, "children": [{"title": n} for n in names]}
        return {"title": name, "children": [self.tree(posixpath.join("/", path, n)) for n in names]}

    def run(self, command: str):
        """A command line: mkdir, ls, cat, rm, rmdir, tree, getPartitionLocations, readPartition, and put of a CSV file with a header: put file folder [parts] [column]."""
        name, *args = command.split()
        if name == "put" and 2 <= len(args) <= 4:
            return self._put_file(*args)
        table = {"mkdir": (self.mkdir, 1), "ls": (self.ls, 1), "cat": (self.cat, 1), "rm": (self.rm, 1), "rmdir": (self.rmdir, 1), "tree": (self.tree, 1), "getPartitionLocations": (self.partitions, 1), "readPartition": (lambda p, k: self.read_partition(p, int(k)), 2)}
        if name not in table or len(args) != table[name][1]:
            raise ValueError(f"usage: {', '.join(f'{n}/{a}' for n, (_, a) in table.items())}")
        return table[name][0](*args)

    def sql(self, text: str, **names: str) -> DataFrame:
        """Spark SQL over stored files, each under its own view name. An unknown table is an error."""
        for view, path in names.items():
            self.cat(path).drop("part_id").createOrReplaceTempView(view)
        return self.spark.sql(text)


def to_delimited(df: DataFrame, separator: str = ",") -> str:
    """Header and rows as text, for results of stated small size."""
    rows = [df.columns, *df.collect()]
    return "\n".join(separator.join("" if v is None else str(v) for v in r) for r in rows)
