"""Token ids in Parquet: list columns with delta encoding, small pages and row groups, in id order.

Ids are kept as one list per document beside narrow metadata columns (doc_id, n_tokens, shard, lang,
source, chars). Metadata uses dictionaries, ids and counts the delta encodings of version 2 pages; rows are
sorted, so the page index lets a reader fetch the pages of an id range, or metadata without any token.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dealflux.llm.common import prefix_sums, staged

#: Rows of a page, bytes of a page and of a row group.
FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#tokens.list.element": "false",
    "compression": "zstd",
}
#: Characters of text in one file, about: the range partitions follow from it.
FILE_CHARS = 24_000_000
_PIECE = regex.compile(public_tokenizers.PATTERN)


def _cuts(text: str) -> list[str]:
    """The text cut before each space; a text with the cutting mark itself is one cut that nobody knows."""
    return ["\0"] if "\0" in text else text.replace(" ", "\0 ").split("\0")


class PieceIds:
    """Token ids of pieces that the tokenizer's own pre-splitter never joins.

    Texts are cut before each space. Unless white space follows, a piece begins there; a text with a space
    before white space or at its end goes to the tokenizer whole. A cut that is new is split into the
    pre-splitter's pieces, and pieces that are new are encoded. Ids are remembered as little-endian 32-bit
    bytes in two generations of bounded size, so that frequent cuts stay.
    """

    def __init__(self, path: str, end: int, limit: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.end = np.array([end], "<u4").tobytes()
        self.limit = limit
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of each id: its byte-level form has a character a byte
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, missing: set[str]) -> None:
        """Ids of cuts; none for those that can't stand alone."""
        known, new, composed = self.old, set(), []
        for cut in missing:
            if (ids := known.get(cut)) is not None:
                self.young[cut] = ids
            elif cut[1:].isalpha() and (cut[0] == " " or cut[0].isalpha()):
                new.add(cut)
            elif cut not in (" ", "\0") and not (cut[0] == " " and cut[1].isspace()):
                # A word with one mark behind it needs no pattern.
                plain = cut[-1] in ".,;:!?" and cut[1:-1].isalpha() and (cut[0] == " " or cut[0].isalpha())
                pieces = (cut[:-1], cut[-1]) if plain else _PIECE.findall(cut)
                composed.append((cut, pieces))
                for p in pieces:
                    if p not in self.young:
                        if (ids := known.get(p)) is not None:
                            self.young[p] = ids
                        else:
                            new.add(p)
        for lead in (" ", "\n"):
            words = [p for p in new if (p[0] == " ") == (lead == " ") and p.removeprefix(" ").isalpha()]
            new.difference_update(words)
            for i in range(0, len(words), 5000):
                self._encode_words(words[i : i + 5000], "" if lead == " " else lead)
        rest = list(new)
        for i in range(0, len(rest), 5000):
            for piece, got in zip(rest[i : i + 5000], self.tokenizer.encode_batch_fast(rest[i : i + 5000], add_special_tokens=False)):
                self.young[piece] = array("I", got.ids).tobytes()
        for cut, pieces in composed:
            self.young[cut] = b"".join(map(self.young.__getitem__, pieces))

    def _encode_words(self, words: list[str], lead: str) -> None:
        """Ids of words in one call: each begins a piece by its space, or after a line end that is a piece."""
        text = "".join([lead + w for w in words])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        lengths = map(len, words) if text.isascii() else (len(w.encode("utf-8", "surrogatepass")) for w in words)
        own = np.fromiter(lengths, np.int64, len(words)) + len(lead)
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(own)) + 1
        data, at = ids.tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist()):
            self.young[w] = data[at + 4 * len(lead) : end]
            at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as bytes, the end id last."""
        get = self.young.get
        cuts = [_cuts(text) if text else [] for text in texts]
        found = [[*map(get, c)] for c in cuts]
        short = [i for i, f in enumerate(found) if None in f]
        missing: set[str] = set()
        for i in short:
            missing.update(c for c, f in zip(cuts[i], found[i]) if f is None and c)
        self._learn(missing)
        for i in short:
            if cuts[i][0] == "":
                cuts[i] = cuts[i][1:]
            found[i] = [*map(get, cuts[i])]
            if None in found[i]:
                found[i] = [array("I", self.tokenizer.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids).tobytes()]
        out = [b"".join(f) + self.end for f in found]
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, end: int) -> PieceIds:
    return PieceIds(path, end)


def encode(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """``docs`` with ``tokens`` (list of int ids, ``end`` last) and ``n_tokens`` in place of ``text``.

    A null text is an empty one and has the end id alone. Nulls and repeats in other columns pass through.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("text", "tokens", "n_tokens")]
    rest = docs.select(*[f"`{f.name}`" for f in kept], "text")
    schema = rest.select(*[f"`{f.name}`" for f in kept], F.lit(None).cast("array<int>").alias("tokens"), F.lit(0).cast("int").alias("n_tokens")).schema

    def run(batches):
        coder = _encoder(path, end)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = coder.encode(part.column("text").to_pylist())
                counts = np.array([len(x) // 4 for x in got], np.int64)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(got))])
                lists = pa.ListArray.from_arrays(pa.array(ends), ids)
                columns = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(counts.astype(np.int32))], names=[f.name for f in kept] + ["tokens", "n_tokens"])

    return rest.mapInArrow(run, schema)


def write(docs: DataFrame, folder: str, path: str, end: int = 0, file_chars: int = FILE_CHARS) -> None:
    """Encode ``docs`` (doc_id, text and more) into ``folder`` in ascending doc_id order, nulls first.

    Rows are range-partitioned by id on their way to the encoder, so texts cross the network once and
    each file holds one range; ``shard`` numbers the ranges in order.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ordered = docs.repartitionByRange(max(1, -(-chars // file_chars)), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.withColumn("shard", F.spark_partition_id()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    encode(ordered, path, end).write.options(**FORMAT).mode("errorifexists").parquet(folder)


def read(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The stored rows; with bounds, only files, row groups and pages that can hold ids in between."""
    df = spark.read.parquet(folder)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    if last is not None:
        df = df.where(F.col("doc_id") <= last)
    return df


def checksums(stored: DataFrame) -> DataFrame:
    """doc_id, shard, n_tokens (from the list itself) and ids_crc32 of stored rows."""

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            ends = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("shard"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "n_tokens", "ids_crc32"],
            )

    return stored.select("doc_id", "shard", "tokens").mapInArrow(run, "doc_id long, shard int, n_tokens long, ids_crc32 long")


def positions(sums: DataFrame) -> DataFrame:
    """``start``: ids of all documents before each one, by shard and id; ties in order of their checksum."""
    keyed = staged(sums.withColumn("_all", F.lit(0)), "sums")
    order = [F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens"]
    return prefix_sums(keyed, "_all", "shard", order, "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)
