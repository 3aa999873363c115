"""Vectorised word work on Arrow string columns, shared by the text operators.

Texts are handled as UTF-8 bytes, many documents at a time in one flat buffer:
words are found with byte tables and hashed with a prefix polynomial, so no
Python object is made for a word. Null texts are treated as empty.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once; bounds the memory of a task whatever the batch holds.
CHUNK_BYTES = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

#: Separators of plain words: space and \t \n \v \f \r. 0 in the table marks a separator.
PLAIN = np.ones(256, np.uint8)
PLAIN[[0x20, *range(0x09, 0x0E)]] = 0
#: Lower-cased words of digits, a-z and all bytes from 0x80 on.
FOLDED = np.zeros(256, np.uint8)
FOLDED[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLDED[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLDED[0x80:] = np.arange(0x80, 0x100)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't pile up in a worker, and give the executors this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    sc = spark.sparkContext
    if getattr(sc, "_weftline_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline_ops.zip"  # executors fetch it from the driver as long as that lives
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    sc._weftline_shipped = True


def column(df: DataFrame, name: str, alias: str, kind: str):
    """The column by another name and type, left as it is where it has them (plans that are equal are run once)."""
    if name == alias and dict(df.dtypes)[name] == kind:
        return F.col(name)
    return F.col(name).cast(kind).alias(alias)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where df has such columns (Spark doesn't tell capitals from small letters)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, name: str, text_col: str) -> DataFrame:
    """df without the column that a result of that name replaces."""
    if name.lower() == text_col.lower():
        raise ValueError(f"{name!r} is the text's column")
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return where or "/tmp/weftline-checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: smaller than a checkpoint where there are texts."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of checkpoints (or selections of them) and written tables that no later step reads."""
    for df in frames:
        if getattr(df, "_weftline_path", None):
            _delete(df.sparkSession, df._weftline_path)
            continue
        plan = df._jdf.queryExecution().optimizedPlan() if df is not None else None
        while plan is not None and plan.children().size() == 1:
            plan = plan.children().head()
        if plan is None or not hasattr(plan, "rdd") or not plan.nodeName().startswith("LogicalRDD"):
            continue
        path = plan.rdd().getCheckpointFile()
        if path.isDefined():
            _delete(df.sparkSession, path.get())


def scaled_partitions(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * factor


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.type != pa.large_binary():
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array):
    """(first row, bytes, offsets) of runs of rows of about CHUNK_BYTES; a longer text is a run of its own."""
    data, offsets = flat(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def split(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and the n+1 word offsets of the rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data] != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    got = _powers.get(f"{base}")
    if got is None or len(got) < n:
        got = np.full(max(n, CHUNK_BYTES + 1), base, _U)
        got[0] = 1
        got = np.multiply.accumulate(got)
        _powers[f"{base}"] = got
    return got[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every word; kind's values (or values') of its bytes and its length go in."""
    if not len(starts):
        return np.zeros(0, _U)
    lut = np.where(kind != 0, (np.arange(256) if values is None else values) + 1, 0).astype(_U)
    sums = np.add.reduceat(lut[data] * _power(_P, len(data)), starts)
    return mix(sums * _power(_PINV, len(data))[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def folded_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return word_hashes(data, starts, ends, FOLDED, FOLDED)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, over the flat array; callers mask those that cross rows."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, _U)
    for j in range(n):
        out = (out ^ words[j : j + count]) * _U(0x9FB21C651E98DF25)
        out ^= out >> _U(29)
    return mix(out)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For each item of the flat array its row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def hash_bytes(words: list[bytes]) -> np.ndarray:
    """folded_hashes of single words, for vocabularies."""
    if not words:
        return np.zeros(0, _U)
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = split(data, np.array([0, len(data)]), FOLDED)
    return folded_hashes(data, starts, ends)
