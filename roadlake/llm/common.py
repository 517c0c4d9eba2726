"""What the corpus operators share: scratch tables, word spans and hashes over Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: White space as the contracts have it: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LONG = 64


def _splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator: a bijection of 64-bit numbers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    return _splitmix(np.asarray(x, np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))


#: A random number for each byte; in the second table A-Z have those of a-z.
BYTES = mix(np.arange(256, dtype=np.uint64), 1)
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, or else the session's checkpoint folder.

    Only a session on one machine (master local) gets a folder of its own where neither is set; on a cluster that is an error,
    as executors could not read what the driver's machine has.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="roadlake-")
        context.setCheckpointDir(root)
    return root


def _path(spark: SparkSession, path: str):
    """The path for Hadoop's file systems, and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back, which cuts its lineage and survives lost executors.

    The table goes with discard(), or with the application's end where a result still reads it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/roadlake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p, system = _path(spark, path)
    system.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # for discard()
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables of materialise() that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            p, system = _path(df.sparkSession, path)
            system.delete(p, True)
            system.cancelDeleteOnExit(p)


class tidy_shuffles:
    """While it is open, Spark deletes a query's shuffle files when the query ends instead of when the driver collects garbage."""

    KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, "true")

    def __exit__(self, *_):
        self.spark.conf.set(self.KEY, self.old) if self.old is not None else self.spark.conf.unset(self.KEY)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; what numbers of chunks and buckets are derived from."""
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunks, or more than one can hold
            column = pa.concat_arrays([x.cast(pa.large_string()) for x in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, part_of_word: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every text, and the index of the first word of each text (n + 1 numbers)."""
    inside = np.concatenate([[False], part_of_word[data], [False]])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text's first byte never continues the last text's word
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each span's bytes, by position over all spans at once; table LOWER folds A-Z."""
    sizes = ends - starts
    capped = np.minimum(sizes, _LONG + 1).astype(np.uint16)
    order = np.argsort(_LONG + 1 - capped, kind="stable")
    at, h = starts[order], np.full(len(starts), np.uint64(0x8422F1D7A6C39B15))
    longer = len(starts) - np.cumsum(np.bincount(capped, minlength=_LONG + 2))  # spans with more than k bytes
    for k in range(_LONG):
        if not (m := longer[k]):
            break
        h[:m] = (h[:m] ^ table[data[at[:m] + k]]) * _MUL
        h[:m] ^= h[:m] >> np.uint64(29)
    out = np.empty_like(h)
    out[order] = h
    fold = np.arange(256, dtype=np.uint8)
    if table is LOWER:
        fold[65:91] += 32
    for i in np.flatnonzero(sizes > _LONG):
        out[i] = xxhash.xxh64_intdigest(fold[data[starts[i] : ends[i]]].tobytes())
    return _splitmix(out + sizes.astype(np.uint64))


def crc_of_id(column: str):
    """crc32 of a document's id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def groups_of(offsets: np.ndarray, most: int):
    """Cuts texts into runs of consecutive ones of about so many bytes; a longer text is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b
