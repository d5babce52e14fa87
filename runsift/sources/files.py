"""Readers for run files."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsift.operators.scale import with_totals
from runsift.sources.blocks import blocks_of, json_elements


def _exists(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; a bad line fails the job, blank lines and a BOM are accepted,
    a missing path is an empty table of the same schema."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").option("encoding", "UTF-8").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of every line, 1-based inside its file.

    Text splits keep file order, so a line's number is its position inside its
    split plus the line counts of the earlier splits of the file: a count per
    split, and no file ever goes through one task.  This is the one place that
    needs per-partition work, as Spark rows have no order of their own.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("__id"))
    per_block = lines.groupBy("file", "start").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("file", "start", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = lines.join(offsets, ["file", "start"])
    return out.select("file", (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias("line_no"), "value")


def read_jsonl_until_bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of each file up to its first line that is not JSON; everything after it is dropped.

    A line that is JSON but does not fit the schema is no torn line: it fails the job.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull()
    marked = with_totals(lines, ["file"], __first_bad=F.min(F.when(bad, F.col("line_no"))))
    good = marked.where(F.col("__first_bad").isNull() | (F.col("line_no") < F.col("__first_bad")))
    return good.select("file", "line_no", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("file", "line_no", "row.*")


def read_jsonl_numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with their 1-based line number; a bad line fails the job."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    return lines.select("file", "line_no", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("file", "line_no", "row.*")


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON: an object or an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv_strings(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """CSV with a header, all columns text, quotes doubled and line breaks inside quotes kept."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df if where is None else df.where(where)


def read_glob(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All matching run files with a ``source_file`` column; a bad line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(pattern).withColumn("source_file", F.col("_metadata.file_name"))


def list_files(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """(path, length) of all matching files; none is opened.

    Tasks are planned by size.  Scans skip files of no bytes, so those are the
    names of the listing that the scan does not return.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(pattern)
    filled = found.select("path", "length")  # content is never read
    names = [(unquote(uri).replace("file:///", "file:/", 1),) for uri in found.inputFiles()]
    empty = spark.createDataFrame(names, "path string").join(filled, "path", "left_anti")
    return filled.unionByName(empty.withColumn("length", F.lit(0).cast("bigint")))


def read_array_glob(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of all matching files that hold one JSON array of objects (or one object) each.

    Adds ``source_file`` and ``position``, the place in the array from 0.  A task
    reads a file in blocks and passes its elements on as it finds them, so no
    array is held whole.  No matching file, a torn or empty file, an element
    that is no object, or one that does not fit the schema fails the job; an
    empty array has no rows.  Schema columns of those two names raise.
    """
    taken = {"source_file", "position"} & set(spark.createDataFrame([], schema).columns)
    if taken:
        raise ValueError("columns added by the reader: " + ", ".join(sorted(taken)))
    if not _exists(spark, pattern):
        raise FileNotFoundError(pattern)
    listed = list_files(spark, pattern).select("path")

    def elements(batches):
        import pandas as pd

        for batch in batches:
            for path in batch["path"]:
                name, rows, size = path.rsplit("/", 1)[-1], [], 0
                for position, text in enumerate(json_elements(blocks_of(path), path)):
                    rows.append((name, position, text))
                    size += len(text)
                    if size > 4 << 20:
                        yield pd.DataFrame(rows, columns=["source_file", "position", "value"])
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["source_file", "position", "value"])

    found = listed.mapInPandas(elements, "source_file string, position bigint, value string")
    return found.select("source_file", "position", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select(
        "row.*", "source_file", "position")


def latest_file(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of the newest matching file that is not empty (the last name on a tie); other files are listed, not opened."""
    listed = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")  # content is never read
    newest = listed.agg(F.max(F.struct("modificationTime", "path"))["path"]).first()[0]
    if newest is None:
        raise FileNotFoundError(pattern)
    # The reader takes a pattern, so the signs of a pattern in the name are escaped.
    escaped = "".join("\\" + ch if ch in "*?[]{}\\" else ch for ch in newest)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(escaped).withColumn("source_file", F.col("_metadata.file_path"))


def largest_run(rows: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows of the file with the most rows (the first name on a tie)."""
    best = rows.groupBy(source).agg(F.count("*").alias("n")).orderBy(F.desc("n"), source).limit(1).select(source)
    return rows.join(best, source, "left_semi")


def read_shards(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Union of all shards; a missing shard is an error."""
    missing = [p for p in paths if not _exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing shards: " + ", ".join(missing))
    return spark.read.schema(schema).option("mode", "FAILFAST").json(list(paths))


def long_vectors(df: DataFrame, row_id: str, values: str, dim: int) -> DataFrame:
    """(row, depth, vec) rows from a flat array of depth x dim numbers."""
    n = (F.size(values) / dim).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda d: F.slice(F.col(values), d * dim + 1, F.lit(dim)))
    return df.select(row_id, F.posexplode(cut).alias("depth", "vec"))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """One-off import of hidden[depth, k, dim] archives: each archive is read inside a task."""
    schema = "file string, depth int, k int, vec array<float>"

    def unpack(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content)) as archive:
                    hidden, ks = archive["hidden"].astype("float32"), archive["k"].tolist()
                for depth in range(hidden.shape[0]):
                    rows += [(file, depth, int(k), hidden[depth, i].tolist()) for i, k in enumerate(ks)]
            yield pd.DataFrame(rows, columns=["file", "depth", "k", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, schema)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path, path below ``root``, size and sha256 of every file of a folder; temporary names are skipped.

    The listing opens no file.  Tasks digest the files in blocks, so a file of
    any size needs the memory of one block; large files get tasks of their own.
    """
    listed = list_files(spark, root, recursive=True).where(~F.element_at(F.split("path", "/"), -1).contains(".tmp"))

    def digest(batches):
        import hashlib

        for batch in batches:
            sums = []
            for path in batch["path"]:
                sha = hashlib.sha256()
                for block in blocks_of(path):
                    sha.update(block)
                sums.append(sha.hexdigest())
            yield batch.assign(sha256=sums)

    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    below = F.when(F.startswith("path", F.lit(base + "/")), F.substring("path", len(base) + 2, 2**31 - 1)).otherwise(F.col("path"))
    out = listed.mapInPandas(digest, "path string, length bigint, sha256 string")
    return out.select("path", below.alias("relative_path"), F.col("length").alias("size_bytes"), "sha256")


def count_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Non-blank lines per file."""
    lines = spark.read.text(pattern).where(F.trim("value") != "")
    return lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
