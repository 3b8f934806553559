"""File sources and sinks with declared schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.columns import nan_to_null, parse_date
from larder.schemas import HEADINGS
from larder.session import stage


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def publish(spark: SparkSession, folder: str, target: str) -> None:
    """Rename a folder in one step; an existing target is an error."""
    fs = spark._jvm.org.apache.hadoop.fs
    source, to = fs.Path(folder), fs.Path(target)
    none = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    none[0] = getattr(fs, "Options$Rename").valueOf("NONE")
    context = fs.FileContext.getFileContext(to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri())
    context.rename(source, to, none)


def subfolders(spark: SparkSession, path: str, finished: bool = True) -> list[str]:
    """Names of the folders below ``path``; ``finished``: only those a finished write has left behind."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    done = []
    for status in fs.listStatus(hadoop):
        child = status.getPath()
        if status.isDirectory() and (not finished or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(child, "_SUCCESS"))):
            done.append(child.getName())
    return sorted(done)


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if there is one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """CSV with a header, columns found by heading in any order, no schema inference.

    Headings may be the spelled-out or the snake_case ones. Values that do not parse
    are null; columns the file lacks are null; columns outside the schema are left out.
    The files of a folder may differ in their columns and the order of them: files
    with the same heading line are read together. A quoted value may hold line breaks; a file is then one task, so
    ``multi_line=False`` lets a very large file without such values be split.
    """
    parts = [_typed(_raw(spark, files, multi_line), schema) for files in _by_heading(spark, path).values()]
    return reduce(DataFrame.unionByName, parts) if parts else empty(spark, schema)


REJECTS = "file string, reason string, line string"
_MALFORMED = "_malformed"


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): as ``read_csv``, but a row that is not well formed goes to the rejects, with its file and the reason.

    A row is rejected if it has more or fewer fields than its heading, or an unreadable value in a column of the schema.
    Every row is in one of both tables. The parsed files are staged once.
    """
    rows, rejects = [empty(spark, schema)], [spark.createDataFrame([], REJECTS)]
    for heading, files in _by_heading(spark, path).items():
        names = _raw(spark, files[:1], multi_line).columns
        plain = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]).add(_MALFORMED, T.StringType())
        read = _reader(spark, multi_line).schema(plain).option("columnNameOfCorruptRecord", _MALFORMED).csv(files)
        kept = stage(read.select("*", F.col("_metadata.file_path").alias("_file")), "csv")
        named = kept.toDF(*names, _MALFORMED, "_file")
        reason = F.when(F.col(_MALFORMED).isNotNull(), F.lit("number of fields"))
        for field, source, value in _values(named, schema):
            if source is not None and not isinstance(field.dataType, T.StringType):
                bad = (F.trim(F.col(f"`{source}`")) != "") & value.isNull()
                reason = F.coalesce(reason, F.when(bad, F.lit(f"{field.name} is no {field.dataType.simpleString()}")))
        line = F.coalesce(F.col(_MALFORMED), F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names])))
        judged = named.withColumn("_reason", reason)
        rows.append(_typed(judged.where("_reason is null"), schema))
        rejects.append(judged.where("_reason is not null").select(F.col("_file").alias("file"), F.col("_reason").alias("reason"), line.alias("line")))
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, rejects)


HEADINGS_ON_DRIVER = 500  # files whose first lines the driver reads itself


def _by_heading(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Data files at ``path`` by their heading line; of many files, tasks find the lines."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [file for status in fs.globStatus(hadoop) or [] for file in sorted(_data_files(fs, status))]
    found: dict[str, list[str]] = {}
    if len(files) > HEADINGS_ON_DRIVER:
        lines = spark.read.text(files).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nr"), "value"
        )
        firsts = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "nr").alias("heading"))
        for row in firsts.groupBy("heading").agg(F.sort_array(F.collect_list("file")).alias("files")).collect():  # paths, as the reader takes them
            found[row["heading"]] = row["files"]
        return found
    for file in files:
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(file))
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            line = reader.readLine()
        finally:
            reader.close()
        if line is not None:
            found.setdefault(line, []).append(file)
    return found


def _data_files(fs, status) -> list[str]:
    """Files below a path that are not hidden; empty ones have no heading and no rows."""
    if status.getPath().getName().startswith(("_", ".")):
        return []
    if not status.isDirectory():
        return [status.getPath().toString()] if status.getLen() else []
    return [file for child in fs.listStatus(status.getPath()) for file in _data_files(fs, child)]


def _reader(spark: SparkSession, multi_line: bool):
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return reader.option("multiLine", multi_line).option("escape", '"')


def _raw(spark: SparkSession, files: list[str], multi_line: bool) -> DataFrame:
    return _reader(spark, multi_line).csv(files)


def _values(raw: DataFrame, schema: T.StructType):
    """(field, its heading in the file or None, its parsed value) of each field of the schema."""
    names = {v: k for k, v in HEADINGS.items()}
    by_name = {c.strip(): c for c in raw.columns}
    for field in schema.fields:
        source = by_name.get(names.get(field.name, field.name), by_name.get(field.name))
        column = F.col(f"`{source}`") if source is not None else F.lit(None)
        if isinstance(field.dataType, T.DateType):
            value = parse_date(column.cast("string"))
        elif isinstance(field.dataType, (T.LongType, T.IntegerType)):
            # whole numbers written as "12.0" still count
            value = column.try_cast("double").try_cast(field.dataType)
        else:
            value = column.try_cast(field.dataType)
        yield field, source, value


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    return nan_to_null(raw.select(*[value.alias(field.name) for field, _, value in _values(raw, schema)]))


def read_dataset(
    spark: SparkSession, path: str, schema: T.StructType, on_missing: str = "error", kind: str = "csv"
) -> DataFrame:
    """Read a dataset; ``on_missing`` gives an empty table or a FileNotFoundError."""
    if on_missing not in ("empty", "error"):
        raise ValueError("on_missing is 'empty' or 'error'")
    if not path_exists(spark, path):
        if on_missing == "empty":
            return empty(spark, schema)
        raise FileNotFoundError(path)
    if kind == "csv":
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).format(kind).load(path)


def write_dataset(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Replace the dataset at ``path``."""
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_dataset(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Append to a log; schemas may differ, missing columns read as null."""
    df.write.mode("append").format(kind).save(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Write a one-column table of lines as text."""
    lines.write.mode("overwrite").text(path)
