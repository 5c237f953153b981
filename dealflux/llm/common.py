"""Helpers that several operators share: words, hashes, staged tables, prefix sums."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealflux.session import checkpoint_dir

#: A word is a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
M64 = (1 << 64) - 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    Lineage ends here: a lost executor costs a re-read of files every other one can see. Shuffle files
    behind it serve nobody any more, and Spark is told to delete them when the write has ended.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; ``bytes.split`` cuts at exactly space and 9 to 13."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHashes(dict):
    """64-bit hash of a word, remembered for as many words as fit in bounded memory."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter text is one run of all its words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(n, width)
    out = hashes[: n - k + 1].copy()
    for i in range(1, k):
        out = out * STEP + hashes[i : n - k + 1 + i]
    return mixed(out + np.uint64(k))


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    return np.unique(shingles(hashes, width))


SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes whose words are hashed at once, about; a word is never cut.
HASH_BLOCK = 1 << 18


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, as ``WordHashes`` has them, of the words of all texts one after the other, and how many stand before each text's end.

    Equal words are told by a sum of their bytes with a random weight a place, mixed with their length; each is hashed once.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    lower = b" ".join([*raw, b""]).lower()
    flat = np.frombuffer(lower, np.uint8)
    space = SPACE[flat]
    gaps = np.flatnonzero(space)
    cuts = np.unique(gaps[np.searchsorted(gaps, np.arange(0, len(flat), HASH_BLOCK))]) if len(gaps) else gaps
    weight, hashes, starts, sizes = mixed(np.arange(1, 65, dtype=np.uint64) * STEP), [], [], []
    for a, b in zip([0, *cuts], [*cuts, len(flat)]):
        inside = np.flatnonzero(~space[a:b])
        if not len(inside):
            continue
        first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
        length = np.diff(first, append=len(inside))
        if length.max() > len(weight):
            weight = mixed(np.arange(1, length.max() + 1, dtype=np.uint64) * STEP)
        place = np.arange(len(inside)) - np.repeat(first, length)
        hashes.append(mixed(np.add.reduceat(weight[place] * flat[a:b][inside], first) + length.astype(np.uint64) * STEP))
        starts.append(inside[first] + a)
        sizes.append(length)
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    starts, sizes = np.concatenate(starts), np.concatenate(sizes)
    _, one, alike = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    own = (xxhash.xxh3_64_intdigest(lower[a:b]) for a, b in zip(starts[one].tolist(), (starts + sizes)[one].tolist()))
    return np.fromiter(own, np.uint64, len(one))[alike], np.searchsorted(starts, ends)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, as ``shingles`` makes them."""
    words, ends = word_hashes(texts)
    runs = shingles(words, width) if len(words) >= width else words
    bounds = list(zip([0, *ends.tolist()], ends.tolist()))
    new = np.ones(len(runs) + 1, bool)
    for a, b in bounds:
        runs[a : b - width + 1].sort() if b - a >= width else None
    new[1:-1] = runs[1:] != runs[:-1]
    out = []
    for a, b in bounds:
        if b - a < width:
            out.append(shingles(words[a:b], width))
        else:
            new[a] = True
            out.append(runs[a : b - width + 1][new[a : b - width + 1]])
    return out


def slices(sizes: list[int | None], most: int):
    """Consecutive (start, end) of rows with about ``most`` units each; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def prefix_sums(df: DataFrame, group: str, chunk: str, order: list, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each one, by group, chunk by chunk.

    Chunks follow the order, so a chunk is one window task and only one row per chunk meets in a
    group's window.
    """
    per = df.groupBy(group, chunk).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(group).alias("_g"), F.col(chunk).alias("_c"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(per, df[group].eqNullSafe(per["_g"]) & df[chunk].eqNullSafe(per["_c"]), "left")
        .withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long"))
        .drop("_g", "_c", "_base")
    )
