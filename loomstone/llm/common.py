"""What the operators share: reading, staging in the shared folder, batches of bounded size, word hashes.

Documents are rows.  A row is known by its ``doc_id`` and a hash of its text, so
null and repeated ids are fine: rows equal in both get equal results.  Operators
look at the columns they are told to and never at others, so extra columns with
any name do no harm.
"""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as bytes: space and 0x09 to 0x0D.
SPACES = b" \t\n\x0b\x0c\r"
#: Text bytes that one step of an Arrow operator holds at once.
CHUNK_BYTES = 2 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and keep Arrow batches of texts small unless a limit is set."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))) if x)
    if spark.conf.get(BATCH_LIMIT, "64m") in ("64m", "67108864b"):
        spark.conf.set(BATCH_LIMIT, str(CHUNK_BYTES))


def lean(spark: SparkSession) -> None:
    """Let Python workers that live through several operators give memory back when they free it: large blocks are mapped one by one, and Arrow has no pool of its own."""
    spark.sparkContext.environment.update(ARROW_DEFAULT_MEMORY_POOL="system", MALLOC_ARENA_MAX="1", MALLOC_MMAP_THRESHOLD_="1048576", MALLOC_TRIM_THRESHOLD_="1048576")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` long, ``text`` string, ``th`` long, and the columns to keep as _k0, _k1 and so on."""
    ship(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), *(F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(keep or [])))


def kept_schema(d: DataFrame) -> str:
    """The kept columns of ``rows`` as the end of a schema."""
    return "".join(f", {c} {t}" for c, t in d.dtypes if c.startswith("_k"))


def with_kept(batch: pa.RecordBatch, arrays: list, names: list[str]) -> pa.RecordBatch:
    """A batch of new columns followed by the kept ones of the batch they were made from."""
    kept = [c for c in batch.schema.names if c.startswith("_k")]
    return pa.RecordBatch.from_arrays([*arrays, *(batch.column(c) for c in kept)], names=[*names, *kept])


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, a temporary one in local mode, as in tests, and else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="loomstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Tables staged while a scope is open, by scope.
_SCOPES: dict[tuple, list[str]] = {}
_OPEN: list[tuple] = []


@contextlib.contextmanager
def scope(key: tuple):
    """Keeps note of the tables that are staged meanwhile, for ``release``."""
    _OPEN.append(key)
    try:
        yield
    finally:
        _OPEN.pop()


def sweep(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that nothing refers to any more; else they stay until the driver's next collection."""
    for _ in range(2):  # the cleaner sees what a collection has found only at the next
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def release(spark: SparkSession, key: tuple) -> None:
    """Removes the tables staged in a scope whose results have been written elsewhere."""
    for path in _SCOPES.pop(key, []):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def temporary(spark: SparkSession, large: bool = True):
    """What is staged meanwhile goes at the end, but for what ``lasting`` keeps, and shuffle files too where they are large."""
    key = ("temporary", uuid.uuid4().hex)
    with scope(key):
        try:
            yield
        finally:
            release(spark, key)
            if large:
                sweep(spark)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """``staged``, for the scope around the innermost one."""
    inner = _OPEN.pop()
    try:
        return staged(df, name)
    finally:
        _OPEN.append(inner)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _SCOPES.setdefault(_OPEN[-1], []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets_for(spark: SparkSession, total: float, each: float) -> int:
    """How many buckets hold ``total`` items at about ``each`` items, at least the shuffle's partitions."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // each), 1))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of every value; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches, text: str = "text", most: int = CHUNK_BYTES):
    """Slices of record batches whose text column has about ``most`` bytes; a longer text comes alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < n:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


#: Blocks of a sieve and the bytes of each; keys beyond MOST_SIEVED make it useless.
SIEVE_BLOCKS, SIEVE_BYTES, MOST_SIEVED = 128, 1 << 16, 1 << 24


def _sieve_bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in its block, which its high bits name."""
    mask = np.uint64(SIEVE_BYTES * 8 - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(24)) & mask).astype(np.int64)


def _sieve_block(table: pa.Table) -> pa.Table:
    bits = np.zeros(SIEVE_BYTES * 8, dtype=bool)
    h = np.asarray(table.column("h").combine_chunks(), dtype=np.int64).view(np.uint64)
    for at in _sieve_bits(h):
        bits[at] = True
    return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "n": pa.array([len(h)], pa.int64())})


def sieve(keys: DataFrame) -> np.ndarray | None:
    """Bits of a column ``h`` of hashed keys, for ``sieved``: 8 MB whatever their number, None where they are too many to tell anything."""
    by_block = keys.select(F.shiftrightunsigned("h", 57).cast("int").alias("block"), "h").groupBy("block").applyInArrow(_sieve_block, "block int, bits binary, n long")
    out, n = np.zeros((SIEVE_BLOCKS, SIEVE_BYTES), dtype=np.uint8), 0
    for r in by_block.collect():  # a row for each block
        out[r.block] = np.frombuffer(r.bits, dtype=np.uint8)
        n += r.n
    return None if n > MOST_SIEVED else out


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys may be among those of a sieve."""
    h = h.view(np.uint64)
    block = (h >> np.uint64(57)).astype(np.int64)
    keep = np.ones(len(h), dtype=bool)
    for at in _sieve_bits(h):
        keep &= (table[block, at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return keep


def sieved(df: DataFrame, bits: np.ndarray | None) -> DataFrame:
    """Rows of ``df`` whose hashed key ``h`` may be among the keys of the sieve; none that is gets lost."""
    if bits is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        table = shared.value
        for b in batches:
            keep = _among(np.asarray(b.column("h"), dtype=np.int64), table)
            if keep.any():
                yield b.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def unsieved(df: DataFrame, bits: np.ndarray | None, then, schema: str) -> DataFrame:
    """What ``then`` makes of the batches of the other rows, whose keys are certainly none of the sieve's; no rows where there is no sieve."""
    if bits is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        table = shared.value

        def others():
            for b in batches:
                keep = ~_among(np.asarray(b.column("h"), dtype=np.int64), table)
                if keep.any():
                    yield b.filter(pa.array(keep))

        yield from then(others())

    return df.mapInArrow(run, schema)


#: What an operator keeps in a worker between tasks.
_HELD: dict = {}


def held(key, make):
    """``make()``, kept in the worker for the tasks that follow; a worker keeps one such table, of the operator that asked last."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Drops what tasks of other operators have left in the worker."""
    _HELD.clear()


class WordHashes(dict):
    """64-bit hashes of words; keeps the words seen of late, at most ``most`` of them."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` symbols, by doubling: a run of a + b symbols from runs of a and of b."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, power, size = None, 0, h, 1
    with np.errstate(over="ignore"):
        left = k
        while left:
            if left & 1:
                if out is None:
                    out = power
                    done = size
                else:
                    m = len(h) - (done + size) + 1
                    out = mixed(out[:m] * np.uint64(0xD6E8FEB86659FD93) + power[done : done + m], 1)
                    done += size
            left >>= 1
            if left:
                m = len(power) - size
                power = mixed(power[:m] * np.uint64(0xD6E8FEB86659FD93) + power[size : size + m], 2)
                size *= 2
    return out[:n]


def fold(doc_id) -> int:
    """crc32 of an id as text."""
    return zlib.crc32(str(doc_id).encode())
