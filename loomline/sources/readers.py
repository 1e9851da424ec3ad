"""Readers and writers of text formats, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = True, null: str | None = None, charset: str = "UTF-8", drop_bad: bool = False) -> DataFrame:
    reader = spark.read.schema(schema).option("sep", separator).option("header", header).option("encoding", charset).option("mode", "DROPMALFORMED" if drop_bad else "PERMISSIVE")
    return (reader if null is None else reader.option("nullValue", null)).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_table_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of arrays, the first being the header: rows (header, row)."""
    text = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", "array<array<string>>")
    return text.select(rows.alias("t")).select(F.col("t")[0].alias("header"), F.explode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("row"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files."""
    return spark.read.text(path)


def read_preamble_csv(spark: SparkSession, path: str, schema: str, skip: int, nulls: list[str], separator: str = ",") -> DataFrame:
    """CSV files with ``skip`` lines before the rows, given names and several marks of a null; cells that are no number of a numeric column are null."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("nth", F.monotonically_increasing_id())
    head = lines.groupBy("file").agg(F.min(F.struct("block", "nth")).alias("first"))
    body = lines.join(head, "file").where((F.col("block") > F.col("first.block")) | (F.col("nth") >= F.col("first.nth") + skip)).where("trim(value) <> ''")
    names = [(f.name, f.dataType) for f in spark.createDataFrame([], schema).schema.fields]
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), {"sep": separator})
    row = body.select(cells.alias("r"))
    return row.select(*[F.when(~F.col(f"r.c{i}").isin(nulls), F.col(f"r.c{i}")).try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def read_sentences(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(sent, idx, word, tag) of blocks parted by an empty line, in any number of files.

    A record ends at an empty line, so large files are split; sent is unique over
    all files and grows with the place in a file.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("sent"), "value")
    lines = blocks.select("sent", F.explode(F.split("value", r"\r?\n")).alias("line")).where("trim(line) <> ''")
    parts = F.split("line", separator)
    return lines.select("sent", parts[0].try_cast("long").alias("idx"), parts[1].alias("word"), F.get(parts, F.lit(2)).alias("tag"))


def nested_rows(texts: DataFrame, column: str, schema: str, path: list[str]) -> DataFrame:
    """Rows of nested JSON arrays: every array of ``path`` is exploded and its fields get its name as a prefix; other columns stay."""
    others = [c for c in texts.columns if c != column]
    out = texts.select(*others, F.from_json(column, schema).alias("_"))
    held, here = others, "_"
    for name in path:
        out = out.select(*held, F.explode_outer(F.col(f"{here}.{name}")).alias(f"_{name}"))
        here = f"_{name}"
        fields = out.schema[here].dataType.fields
        flat = [F.col(f"{here}.{f.name}").alias(f"{name}_{f.name}") for f in fields if f.dataType.typeName() != "array"]
        out = out.select(*held, *flat, here)
        held = [*held, *(f"{name}_{f.name}" for f in fields if f.dataType.typeName() != "array")]
    return out.select(*held)


def html_numbers(pages: DataFrame, column: str, tag: str) -> DataFrame:
    """Adds ``numbers``: the numbers in the first element of a name."""
    inside = F.regexp_extract(F.coalesce(column, F.lit("")), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return pages.withColumn("numbers", F.regexp_extract_all(inside, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query on an SQLite file that the executors can open; one task, as SQLite has no splits."""
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def run(batches):
        import sqlite3

        import pandas as pd

        for batch in batches:
            if len(batch):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                    for part in pd.read_sql_query(query, con, chunksize=10_000):
                        yield part[names]

    return spark.range(1).mapInPandas(run, schema)


def replace_sqlite(df: DataFrame, path: str, table: str) -> None:
    """Replaces a table of an SQLite file; rows come to the driver partition by partition."""
    import sqlite3

    quoted = ", ".join(f'"{c}"' for c in df.columns)
    with sqlite3.connect(path) as con:
        con.execute(f'DROP TABLE IF EXISTS "{table}"')
        con.execute(f'CREATE TABLE "{table}" ({quoted})')
        con.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})', (tuple(r) for r in df.toLocalIterator()))


def write_json_dict(df: DataFrame, path: str) -> None:
    """One row as one JSON object."""
    df.limit(1).coalesce(1).write.json(path)


def csv_to_records(df: DataFrame, key: str) -> DataFrame:
    """(value): one text {"key": [records]}, for tables that fit a row."""
    return df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias(key))).alias("value"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a text file, gzip too: a word and its numbers by spaces."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("word"), F.slice(parts, 2, F.size(parts) - 1).cast("array<float>").alias("vector"))


def read_class_folders(spark: SparkSession, path: str) -> DataFrame:
    """(class, number, text) of class/…number….txt files."""
    name = F.input_file_name()
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.regexp_extract(name, r"/([^/]+)/[^/]*$", 1).alias("class"), F.regexp_extract(name, r"(\d+)[^/]*$", 1).try_cast("int").alias("number"), F.col("value").alias("text"))


def read_inodes(spark: SparkSession, path: str) -> DataFrame:
    """Inodes of an XML image with block count and byte sum."""
    schema = "id long, type string, name string, mtime long, permission string, blocks struct<block:array<struct<numBytes:long>>>"
    x = spark.read.format("xml").option("rowTag", "inode").schema(schema).load(path)
    sizes = F.coalesce(F.col("blocks.block.numBytes"), F.array().cast("array<long>"))
    return x.select("id", "type", "name", "mtime", "permission", F.size(sizes).alias("n_blocks"), F.aggregate(sizes, F.lit(0).cast("long"), lambda s, v: s + v).alias("bytes"))


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.option("header", True).option("sep", separator).csv(path)


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """(size, line): the itemsets of each size as ('a', 'b'),('c', 'd'), sorted."""
    one = F.concat(F.lit("('"), F.concat_ws("', '", "items"), F.lit("')"))
    return itemsets.groupBy(F.size("items").alias("size")).agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("line"))


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """At most k rows, by seeded hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(k)
