"""What the operators share: the cluster's scratch folder, views of Arrow text
as bytes, word hashing, and connected components.

Conventions of every operator here: a null text counts as empty; rows are never
identified by position; where a result column has the name of an input column,
the result replaces it. Other columns may have any name: helper columns take names
that the input does not have. A document is a distinct pair of id and text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text worked on at once, so that the numpy temporaries stay small.
SLICE_BYTES = 1 << 20
#: Settings while an intermediate table is written: what the job shuffled is removed when it ends, as nothing
#: reads it again; and Arrow batches are small, as a row may be a long text or a large set.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_hand.isDefined():
        return set_by_hand.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidewire-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return scratch_dir(spark)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def while_writing(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in _WHILE_WRITING}
    for key, value in _WHILE_WRITING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back, which cuts its lineage."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    with while_writing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and that no result still to be computed reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, made longer until no frame has a column of that name in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """With the id, what tells documents apart."""
    return F.xxhash64(text)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
) -> DataFrame:
    """Adds ``fields``, computed from the text column batch by batch, to the columns ``keep``.

    ``make`` runs once in each task and returns the function of a batch of texts.
    """
    made = {f.name for f in fields}
    keep = [c for c in dict.fromkeys(keep) if c not in made]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    picked = [F.col(quoted(c)) for c in keep]
    if text_col in keep and isinstance(df.schema[text_col].dataType, T.StringType):
        place = keep.index(text_col)
    else:
        place = len(keep)
        picked.append(F.col(quoted(text_col)).cast("string").alias(fresh("_text_", df)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(i) for i in range(len(keep))]
                out = work(batch.column(place))
                yield pa.RecordBatch.from_arrays(columns + out, names=[*keep, *(f.name for f in fields)])

    return df.select(*picked).mapInArrow(run, schema)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and the UTF-8 bytes they point into; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * size).astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each, or of a single longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


#: Word characters: digits, A-Z, a-z and everything beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
for _range in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_BYTE[slice(*_range)] = True
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = (_rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_VALUE = _VALUE[np.frombuffer(LOWER, np.uint8)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: Bytes of a run that are hashed eight at a time over all runs; longer ones are hashed whole, one by one.
LONG_RUN = 256
_LEADING = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def run_hashes(data: np.ndarray, inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the runs of bytes marked ``inside``; runs end where a text of offsets ``at`` does."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = at[:-1][at[:-1] < len(inside)]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    lens = np.flatnonzero(last) + 1 - starts
    # eight bytes at a time, from any place on
    eight = np.ndarray((len(data),), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    out = mix64((eight[starts] & _LEADING[np.minimum(lens, 8)]) + lens.astype(np.uint64) * _STEP)
    more, at_byte = np.flatnonzero(lens > 8), 8
    while len(more) and at_byte < LONG_RUN:
        left = np.minimum(lens[more] - at_byte, 8)
        out[more] = mix64(out[more] * _STEP + (eight[starts[more] + at_byte] & _LEADING[left]))
        at_byte += 8
        more = more[lens[more] > at_byte]
    for i in more.tolist():
        out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lens[i]].tobytes()))
    return starts, out


class Words:
    """The words of some texts: starts and ends in the byte buffer, the word range of each text, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base, end = int(offsets[0]), int(offsets[-1])
        self.data = data[base:end]
        at = offsets - base
        inside = WORD_BYTE[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = at[:-1][at[:-1] < len(inside)]
        first[cut] = inside[cut]
        last = inside.copy()
        last[:-1] &= first[1:] | ~inside[1:]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, at)
        self._inside = inside

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        begin = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(begin, lens)
        powers = np.full(int(lens.max()), _STEP)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        value = _VALUE[self.data[self._inside]] * powers[place]
        return mix64(np.add.reduceat(value, begin) + lens.astype(np.uint64))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, normalised and joined by one space."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes().translate(LOWER) for s, e in zip(self.starts[i:j], self.ends[i:j], strict=True))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, positions counted over all texts."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    step = _STEP
    for j in range(n):
        total += words[j : j + m] * step
        step = np.uint64((int(step) * int(_STEP) + 2) & 0xFFFFFFFFFFFFFFFF)
    return mix64(total + np.uint64(n))


def by_key(batches: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that are sorted by the key column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist() if not pa.types.is_integer(batch.column(key).type) else batch.column(key).to_numpy(zero_copy_only=False)
        if isinstance(keys, list):
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        else:
            cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        edges = [0, *cuts, batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held and held[-1].column(key)[-1].as_py() != batch.column(key)[lo].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating
    large-star and small-star steps; every step is a shuffle by node, with partial
    aggregation, so a hub's neighbours are never gathered in one place.

    Every round is written to the shared folder. Stops when a round changes nothing.
    """
    a, b = F.col(quoted(a)), F.col(quoted(b))
    now = materialize(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi is not null and lo is not null and hi != lo").distinct(), "edges"
    )
    mark = None
    for _ in range(rounds):
        # large star: each node points its larger neighbours to the least of its neighbourhood
        both = now.union(now.select("lo", "hi")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("m", "node").alias("m"))
        large = both.join(least, "node").where("other > node").select(F.col("other").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        # small star: each node and its smaller neighbours point to the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        now = materialize(
            small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").union(low.select("hi", "m")).distinct(), "edges"
        )
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
