"""Reading and writing tables: scans, point lookups, exports and keyed rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The end of the events' month; operators that ask for the present take it as a parameter.
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; Parquet statistics prune the files."""
    return df.where(F.col(key) == F.lit(value))


def chosen(df: DataFrame, wanted: dict[str, object], *more: Column) -> DataFrame:
    """The rows whose columns have the wanted value, or one of a list; "all", None and empty text let every value pass."""
    for column, value in wanted.items():
        if value not in (None, "", "all"):
            df = df.where(F.col(column).isin(value) if isinstance(value, list) else F.col(column) == value)
    for p in more:
        df = df.where(p)
    return df


def contains_any_case(values: Column, value: str) -> Column:
    """Whether an array of texts has the value, whatever its case."""
    return F.array_contains(F.transform(values, F.lower), value.lower())


def json_documents(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON files under an explicit schema, with fields beyond it dropped: a document a file, or a line."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def deep_merge(base: dict, over: dict) -> dict:
    """A configuration with another laid over it: maps merge key by key, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length and content of files in a local folder or an object store."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def one_line(text: Column) -> Column:
    """A text without line ends, from which from_one_line() gives it back."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def from_one_line(line: Column) -> Column:
    """Pairs of backslashes stand apart first, so that an escaped backslash before an n stays one."""
    parts = F.transform(F.split(line, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(parts, "\\")


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def copy_prefix(spark: SparkSession, source: str, target: str) -> int:
    """Copies the files below one folder below another, names and all, and returns how many there are. Only names pass
    through the driver; it asks the store for one copy after the other."""
    base, _ = _hadoop_path(spark, source)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    files = blobs(spark, source).where(~F.element_at(F.split("path", "/"), -1).rlike("^[.]"))
    rows = files.select(F.expr(f"substring(path, {len(root) + 1})").alias("name"), "path")
    names = [(r["path"], r["name"]) for r in rows.toLocalIterator()]
    _, to = _hadoop_path(spark, target)
    for path, name in names:
        p, fs = _hadoop_path(spark, path)
        q, _ = _hadoop_path(spark, f"{target.rstrip('/')}/{name.lstrip('/')}")
        to.mkdirs(q.getParent())
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, spark._jsc.hadoopConfiguration())
    return len(names)


def delete_prefix(spark: SparkSession, path: str) -> bool:
    """Deletes everything below a folder; false if there was nothing."""
    p, fs = _hadoop_path(spark, path)
    return fs.delete(p, True)


def insert_distinct(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends one row for each key of df."""
    df.dropDuplicates(keys).write.mode("append").parquet(path)


def upserted(target: DataFrame, updates: DataFrame, keys: list[str], merge: dict[str, Column] | None = None) -> DataFrame:
    """target with updates laid over it by key: one full outer join, one row for each key.

    merge gives the new value of a column from t.<column> and u.<column>; other columns take the update's value where
    there is one. Keys of updates must be unique.
    """
    merge = merge or {}
    both = target.alias("t").join(updates.alias("u"), keys, "full_outer")
    rest = [c for c in target.columns if c not in keys]
    return both.select(*keys, *[merge.get(c, F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}"))).alias(c) for c in rest])


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that df has rows for; writing the same rows again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def retained(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """The rows that a retention of some days keeps at a time."""
    return df.where(F.col(ts) >= F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL {int(days)} DAYS"))


def row_id(*parts: Column) -> Column:
    """A deterministic id of a row: a digest of its parts, nulls counting as empty."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def rename_namespace(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Rows of one namespace moved to another; the rest unchanged."""
    return df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))
