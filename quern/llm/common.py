"""Helpers that the operators share: Arrow batches, shared-storage tables and text bytes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: A-Z to a-z; every other byte stays. UTF-8 bytes of other letters are 0x80 and above.
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset an own temporary folder is used, but only by a local
    master, whose executor is the driver; on a cluster it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="quern-")
    return _OWN["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder then stays
        pass


#: Paths of the tables that this process has written and not given back, oldest first.
WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a read, not a recomputation.
    The table goes when the driver's process ends, or with ``given_back``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def given_back(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in list(paths):
        _delete(spark, path)
        WRITTEN.remove(path)


def row_type(kinds: dict[str, DataType], ddl: str) -> StructType:
    """Fields of given types, whose inner names may be any, then those of the DDL."""
    return StructType([StructField(n, k) for n, k in kinds.items()] + StructType.fromDDL(ddl).fields)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of text, one row at least.

    What Python holds at once then follows this bound and the longest text, not
    the number of rows that Spark puts in an Arrow batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def words_of(text: bytes) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.translate(LOWER).split()


class Memo(dict):
    """A dict that starts anew beyond ``limit`` entries; keys longer than ``KEY`` have no place, so its memory is bounded."""

    KEY = 64

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def make_room(self, n: int = 0) -> None:
        if len(self) + n > self.limit:
            self.clear()


def tidied() -> None:
    """Give memory that is free in this worker back to the system; cheap once a batch of some megabytes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What a Python worker keeps between tasks: one thing at a time.

    Workers are reused by later stages. When a stage asks for another thing, what
    the stage before it kept (an automaton, its memos) is given back.
    """
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            tidied()
        _HELD[name] = make()
    return _HELD[name]


def crc_mod(column: str, modulus: int):
    """crc32 of the column as text, modulo; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def size_in_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column, summed over all rows."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def text_digest(column: str):
    """A 64-bit hash of the whole text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def columns(df: DataFrame) -> list[Column]:
    """All columns by quoted name, whatever the name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def row_key(id_col: str, text: str = "text") -> list[Column]:
    """``none, id, digest``: what tells a row from others. None of them is ever null."""
    one = F.col(id_col)
    return [one.isNull().alias("none"), F.coalesce(one.cast("string"), F.lit("")).alias("id"), text_digest(text).alias("digest")]


def keyed(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (all columns as one struct, so that no name of theirs meets one of ours) and its key."""
    return df.select(F.struct(*columns(df)).alias("row"), *row_key(id_col, text))


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is not among the keys.

    A merge join at every size: whole rows are shuffled once, in proportion to
    the input, and the keys never have to fit in memory.
    """
    return rows.join(keys.select("none", "id", "digest").distinct().hint("merge"), ["none", "id", "digest"], "left_anti")
