"""Reading and writing: schemas stated, required columns checked, no inference on text formats."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = "text string, metadata map<string,string>"
JSONL_SUFFIXES = (".jsonl",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder for files that driver and executors share: below ``spark.checkpoint.dir``; a local master may do without."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="quern-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own below ``scratch``, deleted when the driver ends."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"

    def delete() -> None:
        with contextlib.suppress(Exception):  # the session may be gone; the files then stay
            remove(spark, path)

    atexit.register(delete)
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def stat(spark: SparkSession, path: str) -> dict:
    """``path, is_dir, size, modified_ms`` of one path in any store that Spark reads."""
    fs, p = _hadoop(spark, path)
    s = fs.getFileStatus(p)
    return {"path": s.getPath().toString(), "is_dir": s.isDirectory(), "size": s.getLen(), "modified_ms": s.getModificationTime()}


def walk(spark: SparkSession, path: str) -> Iterator[tuple[str, list[str], list[str]]]:
    """``folder, folders, files`` from the top down, names sorted; one folder's listing is held at a time."""
    fs, p = _hadoop(spark, path)
    waiting = [p]
    while waiting:
        at = waiting.pop()
        below = sorted(fs.listStatus(at), key=lambda s: s.getPath().getName())
        folders = [s.getPath() for s in below if s.isDirectory()]
        yield at.toString(), [f.getName() for f in folders], [s.getPath().getName() for s in below if s.isFile()]
        waiting += reversed(folders)


def copy(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """Copy a file or folder from one store to another."""
    (fs, p), (to, q) = _hadoop(spark, source), _hadoop(spark, target)
    if not overwrite and to.exists(q):
        raise FileExistsError(target)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, overwrite, conf):
        raise OSError(f"{source} could not be copied to {target}")


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.delete(p, True)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT, required: str = "text") -> DataFrame:
    """One object per line; a row without the required field is an error when it is read."""
    if not path.endswith(JSONL_SUFFIXES):
        raise ValueError(f"not a JSON Lines file: {path}")
    df = spark.read.schema(schema).json(path)
    checked = F.when(F.col(required).isNull(), F.raise_error(F.lit(f"a row has no {required}"))).otherwise(F.col(required))
    return df.withColumn(required, checked)


def read_csv(spark: SparkSession, path: str, schema: str, required: Iterable[str] = (), unit_range: Iterable[str] = ()) -> DataFrame:
    """CSV with a header. Columns of ``unit_range`` must lie in [0, 1]."""
    head = spark.read.option("header", True).csv(path)
    require_columns(head, required)
    df = head.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema if f.name in head.columns])
    for c in unit_range:
        bad = F.col(c).isNull() | ~F.col(c).between(0, 1)
        df = df.withColumn(c, F.when(bad, F.raise_error(F.concat(F.lit(f"{c} outside [0, 1]: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))).otherwise(F.col(c)))
    return df


def split_piped(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """``a|b|c|d`` rows: exactly as many parts as names, each trimmed."""
    parts = F.split(F.col(column), r"\|", -1)
    ok = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.concat(F.lit(f"expected {len(names)} parts: "), F.col(column))))
    return df.withColumn("_parts", ok).select(*[c for c in df.columns if c != column], *[F.trim(F.get("_parts", F.lit(i))).alias(n) for i, n in enumerate(names)])


def json_file_stats(spark: SparkSession, path: str) -> DataFrame:
    """``path, record_count, size_bytes`` of JSON files: an array's elements, or one object."""
    rows = spark.read.option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size"))
    return rows.groupBy(F.col("_path").alias("path")).agg(F.count("*").alias("record_count"), F.max("_size").alias("size_bytes"))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, kind, size_bytes, modified`` of all files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:\.gz)?$", 1))
    return files.select("path", name.alias("name"), kind.alias("kind"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.md5("content").alias("md5"))


def count_by_kind(listing: DataFrame) -> DataFrame:
    return listing.groupBy("kind").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_envelope(df: DataFrame, path: str, exported_at: str) -> int:
    """One JSON document ``{exported_at, total, data}`` on the driver, row by row; for small results."""
    total = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{"exported_at": {json.dumps(exported_at)}, "data": [')
        for line in df.toJSON().toLocalIterator():
            f.write((",\n" if total else "\n") + line)
            total += 1
        f.write(f'], "total": {total}}}\n')
    return total


def write_csv_bom(df: DataFrame, path: str) -> int:
    """One CSV file with a byte order mark, for spreadsheets; row by row on the driver."""
    import csv

    total = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            total += 1
    return total


SINKS = {"jsonl": write_jsonl, "csv": write_csv, "parquet": write_parquet}


def export(tables: dict[str, DataFrame], which: str, fmt: str, path: str) -> None:
    """Write one of several named tables in a format."""
    if which not in tables:
        raise ValueError(f"unknown table {which}; one of {sorted(tables)}")
    if fmt not in SINKS:
        raise ValueError(f"unknown format {fmt}; one of {sorted(SINKS)}")
    SINKS[fmt](tables[which], path)


def read_jdbc(spark: SparkSession, url: str, sql: str, column: str | None = None, low: int = 0, high: int = 0, partitions: int = 1, **options: str) -> DataFrame:
    """A read-only query of an external database; ranges of a numeric column are read in parallel."""
    from quern.operators.sql_guard import ensure_read_only

    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if column is None:
        return reader.option("query", ensure_read_only(sql)).load()
    return reader.option("dbtable", f"({ensure_read_only(sql)}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions).load()


def page(df: DataFrame, keys: list[str], offset: int = 0, limit: int = 100, max_limit: int = 5000) -> DataFrame:
    """Offset paging in a total order."""
    return df.orderBy(*keys).offset(offset).limit(min(limit, max_limit))


def page_after(df: DataFrame, key: str, last, limit: int) -> DataFrame:
    """Keyset paging: the pages before are not read again."""
    return (df if last is None else df.filter(F.col(key) > last)).orderBy(key).limit(limit)


def tail(df: DataFrame, order: str, text: str, lines: int = 500, max_lines: int = 100_000, max_chars: int = 1000) -> DataFrame:
    """The last lines of a log, each cut to ``max_chars``. The limit is the feature."""
    n = max(1, min(lines, max_lines))
    return df.orderBy(F.desc(order)).limit(n).withColumn(text, F.substring(text, 1, max_chars))


def tail_by(df: DataFrame, key: str, order: str, lines: int) -> DataFrame:
    """The last lines of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= lines).drop("_n")


def cache_key(*parts):
    """The first 16 hex digits of the SHA-256 of the parts, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def safe_path(base: str, name: str) -> Path:
    """A path below ``base``; anything that leaves it is an error."""
    root = Path(base).resolve()
    out = (root / name).resolve()
    if not out.is_relative_to(root):
        raise ValueError(f"{name} is outside {base}")
    return out
