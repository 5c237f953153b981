"""Language model scoring by a backoff automaton, sliced to the blocks of texts that it reads.

States are word histories shorter than the order, the empty one the root. A known n-gram is an arc of its
history's state, weighted with the log10 of

    P(w | h) = (c(h w) + mu P(w | h')) / (c(h) + mu),    P(w | root) = (c(w) + a) / (N + a (V + 1)),

h' being h without its first word; a failure arc leads from h to h' and weighs log10(mu / (c(h) + mu)).
Probabilities of each state sum to 1 over the known words and one unknown word.

Texts go to blocks of bounded size by a hash. A block names the n-grams it holds, each once, with the
times they occur in training texts; counts are summed by n-gram hash and go back to the blocks that named
them, in the order of the names. So a block's automaton holds what its texts can reach, whatever the size
of the corpus' vocabulary, and the texts of a block are read by it in one traversal from left to right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflux.llm.common import STEP, WordHashes, mixed, slices, staged, words

ORDER = 2
MU = 16.0
ADD = 0.1
#: Characters of the texts in a block, and of those whose n-grams' counts meet in one task, about.
BLOCK_CHARS = 10_000_000
BUCKET_CHARS = 6_000_000
#: The end of a text, which is a token, and the start, which only stands in histories.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\x20end", b"\x20start"))


def _tokens(texts: list[str | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each one ended, and where each text ends."""
    parts, ends, total = [], [], 0
    for i, j in slices([len(t or "") for t in texts], 1_000_000):
        for text in texts[i:j]:
            w = words(text)
            parts += [cache.of(w), [END]]
            total += len(w) + 1
            ends.append(total)
    return np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64), np.array(ends, np.int64)


def _runs(tokens: np.ndarray, ends: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes at each token: its 1- to ``order``-grams, and the histories of 1 to ``order`` - 1 words before it."""
    place = np.arange(len(tokens)) - np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends]))
    grams, histories, history = [tokens], [], np.zeros(len(tokens), np.uint64)
    for k in range(1, order):
        before = np.r_[np.full(min(k, len(tokens)), START), tokens[:-k]]
        history = mixed(history * STEP + np.where(place >= k, before, START) + np.uint64(k))
        histories.append(history)
        grams.append(mixed(history + tokens * STEP))
    return grams, histories


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash space, so that sorted names of a bucket stand together."""
    return ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack_names(names: np.ndarray) -> bytes:
    """Sorted hashes as 48-bit gaps where all are small enough, else as they are."""
    gaps = np.diff(names, prepend=names[:1])
    if len(names) > 8 and int(gaps.max()) < 1 << 48:
        return b"\6" + names[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\0" + names.tobytes()


def _unpack_names(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(data, np.uint64, offset=1)
    gaps = np.zeros(((len(data) - 9) // 6, 8), np.uint8)
    gaps[:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    return np.frombuffer(data, np.uint64, 1, 1) + np.cumsum(gaps.view(np.uint64).ravel())


def _pack_counts(counts: np.ndarray) -> bytes:
    """One byte a count where all are small, else eight."""
    if not len(counts) or counts.max() < 256:
        return b"\1" + counts.astype(np.uint8).tobytes()
    small = np.minimum(counts, 255).astype(np.uint8)
    return b"\2" + small.tobytes() + counts[small == 255].astype("<i8").tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    small = np.frombuffer(data, np.uint8, n, 1).astype(np.int64)
    if data[:1] == b"\2":
        small[small == 255] = np.frombuffer(data, "<i8", offset=1 + n)
    return small


def _named(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(kind, bucket, block, names, counts): a block's n-gram and history hashes and their counts in training.

    Kinds 0 to ``order`` - 1 are n-grams by length, those after are histories.
    """

    def run(key, rows):
        tokens, ends = _tokens(rows.column("text").to_pylist(), WordHashes())
        learnt = np.repeat(rows.column("learn").to_numpy().astype(float), np.diff(np.r_[0, ends]))
        out = [], [], [], []
        grams, histories = _runs(tokens, ends, order)
        for kind, h in enumerate([*grams, *histories]):
            names, where = np.unique(h, return_inverse=True)
            counts = np.bincount(where, weights=learnt, minlength=len(names)).astype(np.int64)
            bucket = _bucket(names, buckets)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(names) else np.zeros(0, int)
            for a, b in zip(cut.tolist(), np.r_[cut[1:], len(names)].tolist()):
                for column, value in zip(out, (kind, int(bucket[a]), _pack_names(names[a:b]), _pack_counts(counts[a:b]))):
                    column.append(value)
        return pa.table(
            [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array([key[0].as_py()] * len(out[0]), pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
            names=["kind", "bucket", "block", "names", "counts"],
        )

    return blocks.groupBy("block").applyInArrow(run, "kind int, bucket long, block long, names binary, counts binary")


def _summed(named: DataFrame) -> DataFrame:
    """(block, kind, bucket, counts): for each block the sums over all blocks, in the order of its names.

    ``known`` and ``times`` hold, once for each bucket, how many different names training has and how often.
    """

    def run(key, rows):
        names = [_unpack_names(x) for x in rows.column("names").to_pylist()]
        given = [_unpack_counts(c, len(n)) for c, n in zip(rows.column("counts").to_pylist(), names)]
        distinct, where = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(given), minlength=len(distinct)).astype(np.int64)
        cut = np.cumsum([0, *map(len, names)])
        back = [_pack_counts(total[where[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
        once = np.zeros((2, len(names)), np.int64)
        once[:, 0] = np.count_nonzero(total), total.sum()
        return pa.table(
            [rows.column("block"), rows.column("kind"), rows.column("bucket"), pa.array(back, pa.binary()), pa.array(once[0]), pa.array(once[1])],
            names=["block", "kind", "bucket", "counts", "known", "times"],
        )

    return named.groupBy("kind", "bucket").applyInArrow(run, "block long, kind int, bucket long, counts binary, known long, times long")


class Automaton:
    """States, arcs and failure arcs that the texts of a block reach; state 0 is the root."""

    def __init__(self, tokens: np.ndarray, ends: np.ndarray, order: int, counted, total: int, vocabulary: int, mu: float):
        grams, histories = _runs(tokens, ends, order)
        self.names, self.word = np.unique(tokens, return_inverse=True)
        self.count = counted(0, self.names)
        p = (self.count[self.word] + ADD) / (total + ADD * (vocabulary + 1))
        self.root_weight = np.log10((self.count + ADD) / (total + ADD * (vocabulary + 1)))
        self.width = len(self.names)
        # State of each length before each token, -1 where training doesn't have it, and the longest known one.
        state, first, made = [np.zeros(len(tokens), np.int64)], [np.zeros(len(tokens), np.int64)], 1
        fail_weight, fail_target, keys, weights, sources = [np.zeros(1)], [np.zeros(1, np.int64)], [], [], []
        for k in range(1, order):
            names, at, where = np.unique(histories[k - 1], return_index=True, return_inverse=True)
            seen = counted(order + k - 1, names)
            number = np.where(seen > 0, made + np.cumsum(seen > 0) - 1, -1)
            made += int((seen > 0).sum())
            fail_weight.append(np.log10(mu / (seen[seen > 0] + mu)))
            fail_target.append(first[k - 1][at[seen > 0]])
            mine = number[where]
            state.append(mine)
            first.append(np.where(mine >= 0, mine, first[k - 1]))
            names, at, inverse = np.unique(grams[k], return_index=True, return_inverse=True)
            times = counted(k, names)
            p = np.where(mine >= 0, (times[inverse] + mu * p) / (seen[where] + mu), p)
            at = at[times > 0]
            keys.append(mine[at] * self.width + self.word[at])
            weights.append(np.log10(p[at]))
            sources.append((k, at))
        self.fail_weight, self.fail_target = np.concatenate(fail_weight), np.concatenate(fail_target)
        self.start = first[-1]
        after = [np.r_[f[1:], 0] for f in first]
        self.root_target = np.zeros(self.width, np.int64)
        self.root_target[self.word] = after[min(1, order - 1)]
        is_end = self.names == END
        self.root_target[is_end] = 0
        targets = [np.where(is_end[self.word[at]], 0, after[min(k + 1, order - 1)][at]) for k, at in sources]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        sort = np.argsort(key)
        self.arc_key = key[sort]
        self.arc_weight = (np.concatenate(weights) if weights else np.zeros(0))[sort]
        self.arc_target = (np.concatenate(targets) if targets else np.zeros(0, np.int64))[sort]

    def read(self, ends: np.ndarray) -> np.ndarray:
        """Sum of weights of each text: all texts are read side by side, one token further at each step."""
        begin = np.r_[0, ends[:-1]]
        length = ends - begin
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        state, score = self.start[begin], np.zeros(len(ends))
        rising = length[::-1]
        for step in range(int(length[0]) if len(length) else 0):
            n = len(length) - int(np.searchsorted(rising, step, "right"))
            word = self.word[begin[:n] + step]
            left = np.arange(n)
            while len(left):
                s, w = state[left], word[left]
                root = s == 0
                score[left[root]] += self.root_weight[w[root]]
                state[left[root]] = self.root_target[w[root]]
                left, s, w = left[~root], s[~root], w[~root]
                if not len(left):
                    break
                key = s * self.width + w
                at = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
                found = self.arc_key[at] == key
                score[left[found]] += self.arc_weight[at[found]]
                state[left[found]] = self.arc_target[at[found]]
                lost = left[~found]
                score[lost] += self.fail_weight[s[~found]]
                state[lost] = self.fail_target[s[~found]]
                left = lost
        out = np.empty(len(ends))
        out[order] = score
        return out


def score(docs: DataFrame, learn: Column, order: int = ORDER, mu: float = MU) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    ``learn`` tells the rows that the model learns from (null: not). Tokens are words with A-Z lower-cased,
    then one end; a null or empty text is an end alone. ``base_score`` sums log10 unigram probabilities,
    ``score`` those of the automaton. Rows repeated count as often as they stand. Without any training
    row every token is unknown. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count, buckets = max(1, -(-chars // BLOCK_CHARS)), max(1, -(-chars // BUCKET_CHARS))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)))
    sums = staged(_summed(_named(blocks, order, buckets)), "counts")
    got = sums.where("kind = 0").agg(F.sum("known"), F.sum("times")).first()
    vocabulary, total = (got[0] or 0), (got[1] or 0)

    def run(texts, counts):
        tokens, ends = _tokens(texts.column("text").to_pylist(), WordHashes())
        kinds, ids = counts.column("kind").to_numpy(), counts.column("bucket").to_numpy()
        place = np.lexsort((ids, kinds))
        packs = counts.column("counts").to_pylist()

        def counted(kind: int, names: np.ndarray) -> np.ndarray:
            bucket = _bucket(names, buckets)
            sizes = np.unique(bucket, return_counts=True)[1]
            mine = [packs[i] for i in place if kinds[i] == kind]
            return np.concatenate([_unpack_counts(x, n) for x, n in zip(mine, sizes.tolist(), strict=True)]).astype(np.int64)

        machine = Automaton(tokens, ends, order, counted, total, vocabulary, mu)
        known = np.r_[0, np.cumsum(machine.count[machine.word] > 0)]
        base = machine.root_weight[machine.word]
        begin = np.r_[0, ends[:-1]]
        return pa.table(
            [
                texts.column("doc_id"), texts.column("learn"), pa.array(ends - begin), pa.array(known[ends] - known[begin]),
                pa.array(np.full(len(ends), total, np.int64)), pa.array(np.add.reduceat(base, begin)), pa.array(machine.read(ends)),
            ],
            names=["doc_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    back = sums.select("block", "kind", "bucket", "counts")
    schema = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)
