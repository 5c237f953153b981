"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash space.

Sketches of any two documents are comparable, however unequal in length, and merge by union. A set's least
hashes up to a fixed number are always kept beside the fraction, so that the sketch of a short text is its
whole set. Two sketches are compared over the range of hashes that both cover. A fingerprint is the sketch
as text: the hashes in order, 11 digits of base 64 each.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealflux.llm.common import WordHashes, shingle_set, slices, staged, words

#: One hash in so many is kept.
SCALE = 8
#: So many least hashes of a set are kept, whatever the fraction.
LEAST = 256


def sketch(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Kept hashes of a sorted set: those below the fraction, and the least ones up to LEAST."""
    kept = int(np.searchsorted(hashes, np.uint64((1 << 64) // scale)))
    return hashes[: max(kept, min(LEAST, len(hashes)))]


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Sketch of two documents' joined shingle sets."""
    return sketch(np.union1d(a, b), scale)


def _common(a: np.ndarray, b: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """What two sketches have in the range of hashes that both cover; one of fewer than LEAST is a whole set."""
    ends = [max((1 << 64) // scale - 1, int(s[-1])) for s in (a, b) if len(s) >= LEAST]
    if not ends:
        return a, b
    end = np.uint64(min(ends))
    return a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]


def jaccard(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated likeness; two empty sketches are alike, an empty and another not at all."""
    if not len(a) and not len(b):
        return 1.0
    a, b = _common(a, b, scale)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    a, b = _common(a, b, scale)
    return len(np.intersect1d(a, b, assume_unique=True)) / max(len(a), 1)


def to_text(hashes: np.ndarray) -> str:
    data = np.zeros((len(hashes), 9), np.uint8)
    data[:, :8] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    coded = np.frombuffer(base64.urlsafe_b64encode(data.tobytes()), np.uint8).reshape(-1, 12)
    return coded[:, :11].tobytes().decode()


def from_text(text: str) -> np.ndarray:
    return np.array([int.from_bytes(base64.urlsafe_b64decode(text[i : i + 11] + "="), "big") for i in range(0, len(text), 11)], np.uint64)


def next_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, and the next document's next_id, next_hash, in ascending id order; the first follows the last.

    Only ids, hashes and lengths are sorted, in range partitions that are written down; one row per
    partition tells where the next one begins. Null ids come first, rows of one id stand in order of
    their text's hash, rows repeated wholly are one document.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    ids = docs.select("doc_id", "text_hash", F.length("text").alias("chars")).distinct()
    ids = staged(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ids")
    head = F.struct("doc_id", "text_hash")
    parts = Window.orderBy("part")
    heads = ids.groupBy("part").agg(F.min(head).alias("_head")).select(
        "part",
        F.coalesce(
            F.lead("_head").over(parts),
            F.first("_head").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("_after"),
    )
    inside = F.lead(head).over(Window.partitionBy("part").orderBy(*order))
    rows = ids.withColumn("_in", inside).join(heads, "part").withColumn("_next", F.coalesce("_in", "_after"))
    return rows.select("doc_id", "text_hash", "chars", F.col("_next.doc_id").alias("next_id"), F.col("_next.text_hash").alias("next_hash"))


def _packed(texts: DataFrame) -> DataFrame:
    """Texts as zstandard frames: they cross the network once and stand in shuffle files for both joins."""

    def run(batches):
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for a, b in slices(pa.compute.binary_length(batch.column("text")).to_pylist(), 4_000_000):
                part = batch.slice(a, b - a)
                packed = [coder.compress(t.encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), part.column("key"), pa.array(packed, pa.binary())], names=["doc_id", "text_hash", "key", "packed"])

    return texts.select("doc_id", "text_hash", "key", "text").mapInArrow(run, "doc_id long, text_hash long, key long, packed binary")


def _texts(packed: list[bytes]) -> list[str]:
    coder = zstandard.ZstdDecompressor()
    return [coder.decompress(p).decode("utf-8", "surrogatepass") for p in packed]


def _beginnings(rows: DataFrame, scale: int) -> DataFrame:
    """What the document before needs of a text: all of it, packed, or if that is shorter ``taken``, its first ``k`` characters, and ``next_sketch``."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for a, b in slices(pa.compute.binary_length(batch.column("packed")).to_pylist(), 1_000_000):
                part = batch.slice(a, b - a)
                packed, taken, got = part.column("packed").to_pylist(), [], []
                for i, (t, k) in enumerate(zip(_texts(packed), part.column("k").to_pylist())):
                    if len(packed[i]) > 8 * LEAST:
                        packed[i] = None
                    taken.append(None if packed[i] else t[:k])
                    got.append(None if packed[i] else sketch(shingle_set(cache.of(words(t))), scale).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("to"), part.column("to_hash"), pa.array(packed, pa.binary()), part.column("k"), pa.array(taken, pa.string()), pa.array(got, pa.binary())],
                    names=["to", "to_hash", "next_packed", "k", "taken", "next_sketch"],
                )

    return rows.mapInArrow(run, "to long, to_hash long, next_packed binary, k int, taken string, next_sketch binary")


def edited_likeness(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited text: the last floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next document. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text is an empty one, whose fingerprint is the empty string and whose likeness is 1
    to an empty and 0 to any other text. Other columns of the input are ignored. The next document's
    sketch and the few characters an edit takes travel to the document; no window holds texts.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    follow = next_rows(texts)
    # Both joins are on (key, text_hash) and read the same columns, so texts are dealt out once.
    texts = _packed(texts.withColumn("key", F.xxhash64("doc_id", "text_hash")))
    need = follow.select(
        F.xxhash64("doc_id", "text_hash").alias("to"),
        F.col("text_hash").alias("to_hash"),
        F.floor(F.col("chars") / 4).cast("int").alias("k"),
        F.xxhash64("next_id", "next_hash").alias("key"),
        F.col("next_hash").alias("text_hash"),
    )
    given = texts.join(need, ["key", "text_hash"]).select("doc_id", "packed", "to", "to_hash", "k")
    given = _beginnings(given, scale).withColumnsRenamed({"to": "key", "to_hash": "text_hash"}).dropDuplicates(["key", "text_hash"])
    rows = texts.join(given, ["key", "text_hash"]).select("doc_id", "packed", "k", "taken", "next_sketch", "next_packed")

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for a, b in slices(pa.compute.binary_length(batch.column("packed")).to_pylist(), 1_000_000):
                part = batch.slice(a, b - a).to_pydict()
                out = {c: [] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
                for text, k, taken, after, whole in zip(_texts(part["packed"]), part["k"], part["taken"], part["next_sketch"], part["next_packed"]):
                    if whole:
                        follower = _texts([whole])[0]
                        taken, other = follower[:k], sketch(shingle_set(cache.of(words(follower))), scale)
                    else:
                        other = np.frombuffer(after, np.uint64)
                    edited = text[: len(text) - k] + taken
                    mine = sketch(shingle_set(cache.of(words(text))), scale)
                    changed = sketch(shingle_set(cache.of(words(edited))), scale)
                    out["n_chars"].append(len(text))
                    out["edited_sha256"].append(hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest())
                    out["fingerprint"].append(to_text(mine))
                    out["edited_fingerprint"].append(to_text(changed))
                    out["near_edited"].append(jaccard(mine, changed, scale))
                    out["near_next"].append(jaccard(mine, other, scale))
                yield pa.RecordBatch.from_arrays(
                    [batch.slice(a, b - a).column("doc_id"), pa.array(out["n_chars"], pa.int64()), *[pa.array(out[c], pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[pa.array(out[c], pa.float64()) for c in ("near_edited", "near_next")]],
                    names=["doc_id", *out],
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema)
