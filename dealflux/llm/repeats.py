"""Exact repeats of byte strings: threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every window of the minimum length belongs to the least hash of the shorter strings in it, so equal
windows belong to the same hash. Runs of windows with one hash are counted by their bytes' fingerprint;
only runs whose hash stands over different bytes need a look inside. Those meet by hash, and a block of
whole hashes becomes one text whose transform is searched breadth-first: intervals of strings of rising
length are extended backwards, and each extension fixes the common prefix of two neighbouring suffixes.
The search begins at the longest length that sorting the suffixes has already told apart and ends at the
minimum length; neighbours it has not parted by then share a repeat. Runs that share nothing nearly as
long around their hash's string with any other stay out of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflux.llm.common import M64, mixed, slices, staged

MIN_BYTES = 400
#: Length of the strings whose least hash names a window.
GRAM = 64
#: Windows of one run, and bytes of a text handled at a time.
RUN_WINDOWS, SEGMENT = 1024, 1 << 20
#: Bytes of a block whose transform is built at once.
BLOCK_BYTES = 1 << 20
#: Distinct runs of one hash that may meet in a block; windows of larger hashes are counted one by one.
HOT_RUNS = 2048
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def rolled(data: np.ndarray, size: int, h: np.ndarray | None = None, done: int = 1) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, a power of two; from those of ``done`` bytes, if given."""
    h, power = _BYTE[data] if h is None else h, pow(0x9E3779B97F4A7C15, done, 1 << 64)
    while done < size:
        h = h[:-done] * np.uint64(power) + h[done:]
        power, done = power * power & M64, done * 2
    return h


def window_keys(data: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``least`` bytes the least hash of its ``gram``-byte strings; the hashes themselves."""
    h = mixed(rolled(data, gram))
    return _sliding_min(h, least - gram + 1), h


def _runs(batch, least: int, gram: int):
    """(row, start, windows, key, again, bytes) of all runs of windows with one key.

    ``again``: the key's string stands more than once in the run, which may then repeat itself.
    """
    column = batch.column("text")
    texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]
    for a, b in slices([len(t) for t in texts], SEGMENT):
        joined = b"".join(texts[a:b])
        base = np.cumsum([0, *map(len, texts[a:b])])
        # A longer text is cut into segments that share all but one byte of a window.
        for at in range(0, max(1, len(joined) - least + 1), SEGMENT):
            piece = joined[at : at + SEGMENT + least - 1]
            if len(piece) < least:
                continue
            keys, grams = window_keys(np.frombuffer(piece, np.uint8), least, gram)
            row = np.searchsorted(base, np.arange(at, at + len(keys)), "right") - 1
            inside = np.arange(at, at + len(keys)) + least <= base[row + 1]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])]
            cut = np.flatnonzero(new)
            ends = np.r_[cut[1:], len(keys)]
            ok = inside[cut]
            for s, e, k, r in zip(cut[ok].tolist(), ends[ok].tolist(), keys[cut[ok]].view(np.int64).tolist(), row[cut[ok]].tolist()):
                again = np.count_nonzero(grams[s : e + least - gram] == keys[s]) > 1
                for x in range(s, e, RUN_WINDOWS):
                    y = min(e, x + RUN_WINDOWS)
                    yield a + r, at + x - int(base[r]), y - x, k, again, piece[x : y + least - 1]


def _run_rows(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """(key, print, text_id, start, windows, again) of every run of every text."""

    def run(batches):
        for batch in batches:
            ids = batch.column("text_id").to_pylist()
            out = [], [], [], [], [], []
            for row, start, n, key, again, data in _runs(batch, least, gram):
                for column, value in zip(out, (key, xxhash.xxh3_128_digest(data), ids[row], start, n, again)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.bool_())],
                names=["key", "print", "text_id", "start", "windows", "again"],
            )

    return texts.mapInArrow(run, "key long, print binary, text_id binary, start long, windows long, again boolean")


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Suffixes in order of their first ``depth`` symbols or more, by doubling ranks.

    Besides, the greatest number of symbols below ``depth`` that a sort has seen, and the rows at which these change.
    """
    n = len(text)
    padded = np.r_[text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)]
    key = np.zeros(n, np.uint64)
    for i in range(7):  # 9 bits a symbol
        key = (key << np.uint64(9)) | padded[i : i + n]
    size, known, starts = 7, 0, np.arange(n) == 0
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        if size >= depth:
            return order, known, starts
        known, starts = size, new
        if new.all():
            return order, known, starts
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new) - 1
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - size)] = rank[size:] + np.uint64(1)
        key = rank * np.uint64(n + 1) + ahead
        size *= 2


def unparted(text: np.ndarray, least: int) -> np.ndarray:
    """For each position whether its first ``least`` symbols also start elsewhere, up to separators.

    ``text`` holds symbols up to 257: bytes plus 2, separators 1, and the end 0, which stands last and
    nowhere else. A position with a separator among its first ``least`` symbols may come out either way.
    """
    n = len(text)
    order, known, first_rows = suffix_order(text, least)
    before = text[order - 1].astype(np.int64)  # the transform; the end precedes the first suffix
    # Rows of a symbol in order: LF of an interval's ends is a search among them.
    rows = np.sort(before * (n + 1) + np.arange(n))
    starts = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
    symbols = before[starts]
    in_run = np.cumsum(np.r_[0, (before[1:] != before[:-1]).astype(np.int64)])
    parted = np.r_[first_rows, True]  # a common prefix shorter than the intervals' strings ends before this row
    low = np.flatnonzero(first_rows)
    high = np.r_[low[1:], n]
    for _ in range(least - known):
        if not len(low):
            break
        first = in_run[low]
        count = in_run[high - 1] - first + 1
        which = np.repeat(np.arange(len(low)), count)
        at = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        pair = np.unique(which * 512 + symbols[at]) if (count > 1).any() else which * 512 + symbols[at]
        which, symbol = pair >> 9, pair & 511
        new_low = np.searchsorted(rows, symbol * (n + 1) + low[which])
        new_high = np.searchsorted(rows, symbol * (n + 1) + high[which])
        fresh = ~parted[new_high]
        low, high = new_low[fresh], new_high[fresh]
        parted[high] = True
    out = np.empty(n, bool)
    out[order] = ~(parted[:-1] & parted[1:])
    return out


def sharing(keys: list[int], parts: list[bytes], least: int, gram: int) -> np.ndarray:
    """For each run whether it may share a window of ``least`` bytes with another of its key, or with itself.

    Equal windows hold their key's string at one offset. So one of the strings of ``least - step`` bytes that begin
    at a multiple of ``step`` before the key's string lies in both; their hashes are compared.
    """
    step = max(1, least // 8)
    length = least - step
    size = 1 << (length.bit_length() - 1)
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(parts), np.uint8)
    row = np.repeat(np.arange(len(parts)), lengths)
    grams = rolled(data, gram)
    long = rolled(data, size, grams, gram) if size >= gram else rolled(data, size)
    long = mixed(long[: len(data) - length + 1] * np.uint64(0x9E3779B97F4A7C15) + long[length - size :])
    own = np.array(keys, np.int64).view(np.uint64)
    at = np.flatnonzero(mixed(grams) == own[row[: len(grams)]])
    at = at[at + gram <= ends[row[at]]]
    code, who = [], []
    for j in range(0, least - gram + 1, step):
        r = row[at]
        ok = (at - j >= ends[r] - lengths[r]) & (at - j + length <= ends[r])
        code.append(mixed(long[at[ok] - j] + own[r[ok]] * np.uint64(2 * j + 1)))
        who.append(r[ok])
    code, who = np.concatenate(code), np.concatenate(who)
    _, place, count = np.unique(code, return_inverse=True, return_counts=True)
    out = np.zeros(len(parts), bool)
    out[who[count[place] > 1]] = True
    return out


def _block_repeats(parts: list[bytes], least: int) -> list[np.ndarray]:
    """For each string which of its windows stand twice or more among all."""
    text = np.concatenate([x for p in parts for x in (np.frombuffer(p, np.uint8).astype(np.uint16) + 2, [1])] + [[0]]).astype(np.uint16)
    twice = unparted(text, least)
    out, at = [], 0
    for p in parts:
        out.append(twice[at : at + len(p) - least + 1])
        at += len(p) + 1
    return out


def _spans(flags: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of set flags, flattened."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge.astype(np.int32)


def _resolve(runs: DataFrame, least: int, gram: int) -> DataFrame:
    """(key, print, spans) for the distinct runs (key, print, data), keys sorted within partitions."""

    def blocks(batches):
        rows, size, held_key = [], 0, None
        for batch in batches:
            for key, fingerprint, data in zip(batch.column("key").to_pylist(), batch.column("print").to_pylist(), batch.column("data").to_pylist()):
                if size >= BLOCK_BYTES and key != held_key:
                    yield rows
                    rows, size = [], 0
                if rows and rows[-1][:2] == (key, fingerprint):
                    continue
                rows.append((key, fingerprint, data))
                size += len(data)
                held_key = key
        if rows:
            yield rows

    def run(batches):
        for rows in blocks(batches):
            near = sharing([r[0] for r in rows], [r[2] for r in rows], least, gram)
            rows = [r for r, x in zip(rows, near) if x]
            if not rows:
                continue
            found = [_spans(f) for f in _block_repeats([r[2] for r in rows], least)]
            kept = [(r, s) for r, s in zip(rows, found) if len(s)]
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r, _ in kept], pa.int64()), pa.array([r[1] for r, _ in kept], pa.binary()), pa.array([s.tolist() for _, s in kept], pa.list_(pa.int32()))],
                    names=["key", "print", "spans"],
                )

    return runs.mapInArrow(run, "key long, print binary, spans array<int>")


def _resolve_hot(runs: DataFrame, least: int) -> DataFrame:
    """As ``_resolve`` for hashes over very many distinct runs: each window's fingerprint is counted in Spark."""

    def windows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                prints, at, own = [], [], []
                for fingerprint, data in zip(part.column("print").to_pylist(), part.column("data").to_pylist()):
                    view = memoryview(data)
                    n = len(data) - least + 1
                    own += [xxhash.xxh3_128_digest(view[j : j + least]) for j in range(n)]
                    at += range(n)
                    prints += [fingerprint] * n
                keys = np.repeat(part.column("key").to_numpy(), [len(d) - least + 1 for d in part.column("data").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints, pa.binary()), pa.array(at, pa.int32()), pa.array(own, pa.binary())], names=["key", "print", "at", "window"])

    one = runs.mapInArrow(windows, "key long, print binary, at int, window binary")
    twice = one.groupBy("window").agg(F.count("*").alias("_n")).where("_n > 1").select("window")
    found = one.join(twice, "window").groupBy("key", "print").agg(F.sort_array(F.collect_list("at")).alias("_at"))
    return found.select("key", "print", F.flatten(F.transform("_at", lambda x: F.array(x, x + 1))).alias("spans"))


def find(docs: DataFrame, least: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """(text_id, spans): for each distinct text with repeats the byte ranges they cover, merged, flattened.

    ``docs`` has text_id (md5 of the text) and text.
    """
    occurrences = staged(
        _run_rows(docs, least, gram).groupBy("key", "print", "text_id", "start", "windows", "again").agg(F.count("*").alias("copies")),
        "runs",
    )
    again = F.max("again").alias("_again")
    keys = occurrences.groupBy("key").agg(F.sum("copies").alias("_all"), F.min("print").alias("_lo"), F.max("print").alias("_hi"), again)
    keys = keys.where("_all > 1 or _again").select("key", ((F.col("_lo") < F.col("_hi")) | F.col("_again")).alias("varied"))
    seen = occurrences.join(keys, "key")
    # A run that stands twice as a whole is all repeat; only varied hashes have runs to compare.
    whole = seen.groupBy("key", "print").agg(F.sum("copies").alias("_n"), F.max("varied").alias("varied"), F.min(F.struct("text_id", "start", "windows")).alias("_at"))
    whole = staged(whole.select("key", "print", "_n", "varied", "_at.text_id", "_at.start", "_at.windows"), "prints")
    varied = whole.where("varied")
    counted = varied.groupBy("key").agg((F.count("*") > HOT_RUNS).alias("hot"))
    wanted = varied.join(counted, "key").select("text_id", F.struct("key", "print", "start", "windows", "hot").alias("_run"))
    wanted = wanted.groupBy("text_id").agg(F.collect_list("_run").alias("wanted"))

    def cut(batches):
        for batch in batches:
            for i, j in slices(pa.compute.binary_length(batch.column("text")).to_pylist(), 4 * SEGMENT):
                part = batch.slice(i, j - i)
                key, fingerprint, data, hot = [], [], [], []
                for text, runs in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                    own = text.encode("utf-8", "surrogatepass")
                    for r in runs:
                        key.append(r["key"])
                        fingerprint.append(r["print"])
                        hot.append(r["hot"])
                        data.append(own[r["start"] : r["start"] + r["windows"] + least - 1])
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fingerprint, pa.binary()), pa.array(data, pa.binary()), pa.array(hot, pa.bool_())], names=["key", "print", "data", "hot"])

    one = docs.join(wanted, "text_id").select("text", "wanted")
    strings = staged(one.mapInArrow(cut, "key long, print binary, data binary, hot boolean"), "strings")
    usual = strings.where("not hot").drop("hot").repartition("key").sortWithinPartitions("key", "print")
    large = strings.where("hot").drop("hot").dropDuplicates(["key", "print"])
    inner = _resolve(usual, least, gram).unionByName(_resolve_hot(large, least))
    every = whole.where("_n > 1").select("key", "print", F.array(F.lit(0), F.col("windows").cast("int")).alias("spans"))
    found = every.unionByName(inner.join(every.select("key", "print"), ["key", "print"], "left_anti"))
    placed = seen.join(found, ["key", "print"]).select("text_id", "start", "spans")
    return placed.groupBy("text_id").agg(F.collect_list(F.struct("start", "spans")).alias("found"))


def removed(docs: DataFrame, least: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``kept`` (binary: the bytes outside repeats), n_bytes, n_removed, n_spans.

    ``text`` becomes what ``kept`` reads as; bytes of a character that a repeat cut into are left out of it.

    A byte goes when a string of ``least`` bytes that covers it also starts elsewhere, in the same text or
    another row's; matches never cross rows. A null text is an empty one. Rows repeated wholly repeat each
    other's bytes. Input columns of the four names are replaced, all others pass through.
    """
    made = ["kept", "n_bytes", "n_removed", "n_spans"]
    rows = docs.drop(*made, "text_id").withColumn("text_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    texts = rows.select("text_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find(texts, least, gram)
    kept = [f.name for f in docs.schema.fields if f.name not in (*made, "text_id")]
    both = rows.join(found, "text_id", "left").select(*[f"`{c}`" for c in kept], "found")
    schema = both.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else f"`{c}`" for c in kept], F.lit(b"").alias("kept"), *[F.lit(0).cast("long").alias(c) for c in made[1:]]).schema

    def run(batches):
        for batch in batches:
            for i, j in slices(pa.compute.binary_length(batch.column("text")).to_pylist(), 4 * SEGMENT):
                part = batch.slice(i, j - i)
                out = [], [], [], []
                for text, repeats in zip(part.column("text").to_pylist(), part.column("found").to_pylist()):
                    for column, value in zip(out, _cut(b"" if text is None else text.encode("utf-8", "surrogatepass"), repeats or [], least)):
                        column.append(value)
                text = pa.array([b.decode("utf-8", "ignore") for b in out[0]], pa.string())
                yield pa.RecordBatch.from_arrays([*[text if c == "text" else part.column(c) for c in kept], pa.array(out[0], pa.binary()), *[pa.array(x, pa.int64()) for x in out[1:]]], names=kept + made)

    return both.mapInArrow(run, schema)


def _cut(data: bytes, repeats: list[dict], least: int) -> tuple[bytes, int, int, int]:
    """Bytes outside the repeats; all, removed, spans."""
    if not repeats:
        return data, len(data), 0, 0
    change = np.zeros(len(data) + 1, np.int32)
    for r in repeats:
        spans = np.asarray(r["spans"]) + r["start"]
        np.add.at(change, spans[::2], 1)
        np.add.at(change, spans[1::2] + least - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), len(data), int(gone.sum()), len(edges) // 2
