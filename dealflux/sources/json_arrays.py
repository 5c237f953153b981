"""Large JSON arrays as splittable sources.

A file that is one array, on one line or many, is read as text cut at closing braces, which Spark splits
like any text file. Whether a brace stands inside a string, and how deep it stands, depends on all that
comes before it, so one pass sums up each split for both cases (it begins inside a string or outside),
a window over splits finds how each begins, and a second pass cuts out whole objects. Objects that
straddle splits meet as pieces, at most two a split. No text is shuffled but those pieces.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflux.session import cut

ESCAPE = re.compile(r"\\.", re.DOTALL)
#: All that may stand before an element's opening brace: brackets, commas, numbers, whole strings.
BEFORE = re.compile(r'(?:[^{"]|"(?:\\.|[^"\\])*")*', re.DOTALL)
SPLITS = pa.schema([("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("quotes", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64())])
PIECES = pa.schema([("file", pa.string()), ("at", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])
END, WHOLE, START = 0, 1, 2
#: Splits whose beginnings are broadcast, some 100 bytes each; more are dealt out with the text.
MOST_SPLITS = 200_000


def _braces(fragment: str) -> tuple[int, int, int]:
    """Quotes of a fragment, odd or even, and its opening braces outside strings if it begins outside one, if inside."""
    parts = ESCAPE.sub("", fragment).split('"')
    return (len(parts) - 1) & 1, sum(p.count("{") for p in parts[::2]), sum(p.count("{") for p in parts[1::2])


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def _summed(batches):
    """Per split: its bytes with a brace behind every fragment, whether it turns inside into outside, the change of depth for either beginning."""
    held, sums, rows = None, [0, 0, 0, 0], []
    for file, at, whole, text, size in _rows(batches):
        if (file, at, whole) != held:
            if held:
                rows.append((*held, *sums))
            held, sums = (file, at, whole), [0, 0, 0, 0]
        quotes, even, odd = _braces(text)
        turned, ends = sums[1], sums[1] ^ quotes
        sums = [sums[0] + size + 1, ends, sums[2] + (odd if turned else even) - (1 - ends), sums[3] + (even if turned else odd) - ends]
    if held:
        rows.append((*held, *sums))
    yield _batch(rows, SPLITS)


class _Split:
    """Objects of one split, the end of one that began before it, and the start of one that goes on after it."""

    def __init__(self, file: str, at: int, inside: int, depth: int, unclosed: bool):
        self.key, self.state, self.level, self.unclosed = (file, at), inside, depth, unclosed
        self.parts, self.head, self.waiting = [], depth > 0 or inside > 0, None

    def add(self, fragment: str, closed: bool = True) -> tuple | None:
        quotes, even, odd = _braces(fragment)
        self.level += odd if self.state else even
        self.state ^= quotes
        self.parts.append(fragment + "}" if closed else fragment)
        if closed and not self.state:
            self.level -= 1
            if not self.level:
                piece = (*self.key, END if self.head else WHOLE, "".join(self.parts))
                self.parts, self.head = [], False
                return piece
        return None

    def last(self) -> list[tuple]:
        """What is left at the split's end; only there a fragment may have no brace behind it."""
        done = [self.add(self.waiting, not self.unclosed)]
        if self.parts and (self.head or self.state or any("{" in p for p in self.parts)):
            done.append((*self.key, START, "".join(self.parts)))
        return [d for d in done if d]


def _cut(batches):
    split, rows = None, []
    for file, at, text, inside, depth, unclosed in _rows(batches):
        if split is None or split.key != (file, at):
            if split:
                rows += split.last()
            split = _Split(file, at, inside, depth, unclosed)
        elif piece := split.add(split.waiting):
            rows.append(piece)
        split.waiting = text
        if len(rows) >= 1000:
            yield _batch(rows, PIECES)
            rows = []
    yield _batch(rows + (split.last() if split else []), PIECES)


def _trimmed(batches):
    for batch in batches:
        texts = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([t[BEFORE.match(t).end() :] for t in texts], pa.string())], names=["value"])


def objects(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value): the text of every object that is an element of the arrays in ``path``, one array a file.

    Objects may hold any nesting, strings with braces, quotes and escapes, and line breaks, and may be
    longer than a split; files of one object a line are read too. Elements that are not objects give no
    row. A file cut off within an object gives the unfinished text, which no parser takes for an object.
    Compressed files are one split each.
    """
    text = spark.read.option("lineSep", "}").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.col("_metadata.file_size").alias("size"))
    splits = rows.select("file", "at", "size", "value", F.octet_length("value").alias("bytes")).mapInArrow(_summed, "file string, at long, size long, bytes long, quotes int, outside long, inside long")
    whole = Window.partitionBy("file")
    before = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.withColumn("_in", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    begins = begins.withColumn("_deeper", F.when(F.col("_in") == 1, F.col("inside")).otherwise(F.col("outside")))
    begins = begins.withColumn("depth", F.coalesce(F.sum("_deeper").over(before), F.lit(0)))
    begins = begins.withColumn("_total", F.sum("bytes").over(whole)).withColumn("_last", F.col("at") == F.max("at").over(whole))
    begins = cut(begins.select("file", "at", F.col("_in").cast("int").alias("inside"), "depth", (F.col("_last") & (F.col("_total") > F.col("size"))).alias("unclosed")))
    rows = rows.drop("size")
    if begins.count() <= MOST_SPLITS:
        rows = rows.join(F.broadcast(begins), ["file", "at"])
    else:
        rows = rows.withColumn("_row", F.monotonically_increasing_id()).join(begins, ["file", "at"]).sortWithinPartitions("file", "at", "_row").drop("_row")
    pieces = rows.select("file", "at", "value", "inside", "depth", "unclosed").mapInArrow(_cut, "file string, at long, kind int, text string")
    ends = F.coalesce(F.sum((F.col("kind") == END).cast("int")).over(Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = pieces.where(F.col("kind") != WHOLE).withColumn("_object", ends)
    split = split.groupBy("file", "_object").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "text"))).alias("_p"))
    joined = F.array_join("_p.text", "")
    done = pieces.where(F.col("kind") == WHOLE).select("text").unionByName(split.select(joined.alias("text")))
    return done.mapInArrow(_trimmed, "value string").where("value <> ''")


def read_json_array(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of JSON arrays of objects, however they are laid out; text that is no object fails the read."""
    df = objects(spark, path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_o")).select("_o.*")
    return df.select(*[f"`{c}`" for c in columns]) if columns else df
