"""Exact Jaccard join of word shingle sets over count vectors in R-trees.

A set becomes a point: shingles are hashed into groups and the point's coordinates are the group counts.
Two sets share at most the sum of the smaller coordinates, so a pair, or a pair of R-tree boxes, whose
bound misses what the threshold asks for is dropped unseen; what survives is verified on the sets. A set
of more shingles than groups has a second point with about a group a shingle, for the pairs that trees leave.

Where points meet follows from the threshold alone: a set's own least hashes, one more than the shingles
it may lack, and any two linked sets share one of them. All sets that have a hash meet its hub, the least of
them. Members are first joined with their hubs; R-trees then look among a hub's members for pairs that this
left in different components. A hub with many more such pairs than members names a spanning forest of them first,
and what its links leave in different components afterwards. So a large group of copies costs a few pairs per
member, and no link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflux.llm.common import mixed, shingle_sets, slices, staged
from dealflux.llm.components import ONE_TASK, components
from dealflux.llm.group_joins import mark_members

#: Shingle groups: the dimensions of a point; their sums over COARSE of them are bounded first.
GROUPS, COARSE = 128, 32
#: Most groups of the finer vector that a set of more than GROUPS shingles has besides.
MOST_GROUPS = 1 << 16
#: Jaccard threshold in percent.
PERCENT = 80
#: Points of a leaf, children of an inner node.
LEAF, FANOUT = 16, 8
#: Members of one hub that meet in one task; more are cut into blocks, and pairs of blocks meet.
BLOCK_POINTS = 4096
#: Texts of a group of candidate pairs in a block; a text goes to the pairs of blocks in which it has a pair.
BLOCK_TEXTS = 512
#: A hub with more candidate pairs than this for each member names a spanning forest of them, in this many turns; then all that are left.
DENSE, FOREST_TURNS = 4, 2


def prefix_length(n: int, percent: int) -> int:
    """So many of a set's least hashes: any set linked with it has one of them among its own."""
    return n - -(-n * percent // 100) + 1


def enough(shared: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether ``shared`` of sets with ``sizes`` shingles together can reach the threshold."""
    return (100 + percent) * shared.astype(np.int64) >= percent * sizes.astype(np.int64)


def fine_counts(h: np.ndarray) -> bytes | None:
    """Counts by as many groups as there are shingles, or a power of two above, as a zstandard frame.

    None where that is no more than GROUPS, or a count passes a byte: the bound then says nothing.
    """
    groups = min(1 << max(len(h) - 1, 0).bit_length(), MOST_GROUPS)
    if groups <= GROUPS:
        return None
    counts = np.bincount((h & np.uint64(groups - 1)).astype(np.intp), minlength=groups)
    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.uint8).tobytes()) if counts.max() < 256 else None


def fine_bound(a: bytes, b: bytes) -> int:
    """Shingles that two sets can share by their finer vectors; the longer one is folded to the shorter's groups."""
    short, long = (np.frombuffer(x, np.uint8) for x in sorted((a, b), key=len))
    if len(long) > len(short):
        long = long.reshape(-1, len(short)).sum(axis=0, dtype=np.uint32)
    return int(np.minimum(short, long).sum(dtype=np.int64))


def counts(h: np.ndarray) -> bytes:
    """Counts by GROUPS groups as a zstandard frame, a byte each if they fit, else four."""
    n = np.bincount((h & np.uint64(GROUPS - 1)).astype(np.intp), minlength=GROUPS)
    return zstandard.ZstdCompressor(level=1).compress(n.astype("u1" if n.max() < 256 else "<u4").tobytes())


def unpacked(vec: list[bytes | None], fine: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Count vectors, and finer ones as bytes or None; where there is a finer vector it folds to the other one."""
    unpack = zstandard.ZstdDecompressor().decompress
    fine = [x and unpack(x) for x in fine]
    out = np.zeros((len(vec), GROUPS), "<u4")
    for i, (v, f) in enumerate(zip(vec, fine)):
        if f:
            out[i] = np.frombuffer(f, np.uint8).reshape(-1, GROUPS).sum(axis=0, dtype=np.uint32)
        else:
            raw = unpack(v)
            out[i] = np.frombuffer(raw, np.uint8 if len(raw) == GROUPS else "<u4")
    return out, np.array([*fine, None], object)[:-1]


def _features(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, node (hash of the set), sig (least hashes), vec or fine (group counts)."""

    def run(batches):
        for batch in batches:
            for a, b in slices(pa.compute.binary_length(batch.column("text")).to_pylist(), 2_000_000):
                part = batch.slice(a, b - a)
                n, node, sig, vec, fine, ends = [], [], [], [], [], [0]
                for h in shingle_sets(part.column("text").to_pylist(), width):
                    n.append(len(h))
                    node.append(int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "big", signed=True))
                    least = h[: prefix_length(len(h), percent)] if len(h) else h
                    sig.append(least.view(np.int64))
                    ends.append(ends[-1] + len(least))
                    fine.append(fine_counts(h))
                    vec.append(None if fine[-1] else counts(h))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sig) if sig else [], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), lists, pa.array(vec, pa.binary()), pa.array(fine, pa.binary())],
                    names=["doc_id", "text_hash", "n", "node", "sig", "vec", "fine"],
                )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, node long, sig array<long>, vec binary, fine binary")


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64)


def near_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of so many shingles can reach the threshold at all."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def coarse(vec: np.ndarray) -> np.ndarray:
    return vec.reshape(len(vec), COARSE, -1).sum(axis=2, dtype=vec.dtype)


def passing(x: np.ndarray, y: np.ndarray, rows: dict[str, np.ndarray], percent: int, step: int = 100_000):
    """Those of the pairs (x, y) in different components whose sizes and bounds reach the threshold."""
    kept = [], []
    for i in range(0, len(x), step):
        a, b = x[i : i + step], y[i : i + step]
        ok = (rows["label"][a] != rows["label"][b]) & near_sizes(rows["n"][a], rows["n"][b], percent)
        for of in ("coarse", "vec"):
            a, b = a[ok], b[ok]
            ok = enough(_bound(rows[of][a], rows[of][b]), rows["n"][a] + rows["n"][b], percent)
        kept[0].append(a[ok])
        kept[1].append(b[ok])
    return tuple(np.concatenate(k) if k else np.zeros(0, int) for k in kept)


class RTree:
    """Bulk-loaded R-tree over count vectors; a box keeps its greatest coordinates, its sizes' range and its component, if one."""

    def __init__(self, rows: dict[str, np.ndarray]):
        # Sort, tile: slabs of like size, inside a slab by component.
        n = rows["n"]
        order = np.argsort(n, kind="stable")
        slab = max(LEAF, int(np.sqrt(len(n) * LEAF)))
        self.order = np.concatenate([s[np.argsort(rows["label"][s], kind="stable")] for s in (order[i : i + slab] for i in range(0, len(n), slab))])
        self.rows = {c: rows[c][self.order] for c in ("vec", "coarse", "n", "label")}
        high, low, most, first, last, fan = self.rows["vec"], self.rows["n"], self.rows["n"], self.rows["label"], self.rows["label"], LEAF
        self.levels = []
        while True:
            cut = np.arange(0, len(low), fan)
            high, low, most = np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(most, cut)
            first, last = np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)
            self.levels.append((high, low, most, first, last))
            if len(low) <= FANOUT:
                break
            fan = FANOUT

    def _open(self, level: int, q: np.ndarray, node: np.ndarray, percent: int) -> np.ndarray:
        """Whether leaf ``q`` and box ``node`` can hold a pair: sizes, components, then the bound."""
        high, low, most, first, last = self.levels[level]
        qhigh, qlow, qmost, qfirst, qlast = self.levels[0]
        ok = (100 * most[node] >= percent * qlow[q]) & (100 * qmost[q] >= percent * low[node])
        ok &= ~((qfirst[q] == qlast[q]) & (first[node] == last[node]) & (qfirst[q] == first[node]))
        ok[ok] = enough(_bound(qhigh[q[ok]], high[node[ok]]), qlow[q[ok]] + low[node[ok]], percent)
        return ok

    def pairs(self, percent: int, step: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in the caller's order) of all pairs in different components whose bound reaches the threshold."""
        leaves, top = len(self.levels[0][1]), len(self.levels[-1][1])
        q, node = np.repeat(np.arange(leaves), top), np.tile(np.arange(top), leaves)
        for level in range(len(self.levels) - 1, -1, -1):
            ok = np.concatenate([self._open(level, q[i : i + step], node[i : i + step], percent) for i in range(0, len(q), step)] or [np.zeros(0, bool)])
            q, node = q[ok], node[ok]
            if level:
                q, node = _expand(q, node, FANOUT, len(self.levels[level - 1][1]))
        q, node = q[q <= node], node[q <= node]
        found = []
        for i in range(0, len(q), 512):
            a, b = _expand(node[i : i + 512], q[i : i + 512], LEAF, len(self.order))
            b, a = _expand(b, a, LEAF, len(self.order))
            found.append(passing(a[a > b], b[a > b], self.rows, percent))
        return tuple(self.order[np.concatenate([f[k] for f in found])] if found else np.zeros(0, int) for k in (0, 1))


def _expand(keep: np.ndarray, parent: np.ndarray, fan: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (keep, parent) with every child of parent that exists."""
    child = parent[:, None] * fan + np.arange(fan)
    inside = child < end
    return np.repeat(keep, inside.sum(axis=1)), child[inside]


def _small(starts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(m, 1)
    return (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()


def _finer(x: np.ndarray, y: np.ndarray, rows: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (x, y) that the finer vectors leave."""
    fine, n = rows["fine"], rows["n"]
    ok = [fine[a] is None or fine[b] is None or (100 + percent) * fine_bound(fine[a], fine[b]) >= percent * int(n[a] + n[b]) for a, b in zip(x.tolist(), y.tolist())]
    ok = np.array(ok, bool)
    return x[ok], y[ok]


def spanning(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Positions of those of the pairs (x, y), in their order, that join what the components and the pairs before them have not."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    kept = []
    for k, (a, b) in enumerate(zip(label[x].tolist(), label[y].tolist())):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            kept.append(k)
    return np.array(kept, int)


def _thinned(a: np.ndarray, b: np.ndarray, rows: dict[str, np.ndarray], turn: int) -> np.ndarray:
    """A spanning forest of the pairs: of the likeliest ones in the first turn, of any in the next."""
    if turn:
        order = np.argsort(mixed((rows["node"][a] ^ rows["node"][b]).view(np.uint64)))
    else:
        share = np.concatenate([_bound(rows["vec"][a[i : i + 100_000]], rows["vec"][b[i : i + 100_000]]) for i in range(0, len(a), 100_000)])
        order = np.argsort(-share / (rows["n"][a] + rows["n"][b]), kind="stable")
    return order[spanning(a[order], b[order], rows["label"])]


def _hub_pairs(rows: dict[str, np.ndarray], percent: int, turn: int = FOREST_TURNS):
    """Pairs (a, b, hub, cell) of nodes in different components whose bound reaches the threshold, once each; and the hubs that have more.

    Texts of a hub's pairs meet in a cell for each pair of blocks of them that has a pair. A leaf's worth of members needs no tree: such hubs' pairs are bounded together. Before the last turn a dense hub
    gives a spanning forest of its pairs.
    """
    cut = np.flatnonzero(np.r_[True, (rows["hub"][1:] != rows["hub"][:-1]) | (rows["cell"][1:] != rows["cell"][:-1])])
    sizes = np.diff(np.r_[cut, len(rows["hub"])])
    if rows["vec"].max(initial=0) < 1 << 16 and rows["n"].max(initial=0) < 1 << 16:
        rows["vec"] = rows["vec"].astype(np.uint16)
    rows["coarse"] = coarse(rows["vec"])
    found, more = [], []
    for m in np.unique(sizes):
        starts = cut[sizes == m]
        if m <= LEAF:
            a, b = _finer(*passing(*_small(starts, int(m)), rows, percent), rows, percent)
            found.append((a, b, rows["cell"][a] << 32))
        else:
            for s in starts:
                a, b = RTree({c: rows[c][s : s + m] for c in ("vec", "coarse", "n", "label")}).pairs(percent)
                a, b = _finer(a + s, b + s, rows, percent)
                if turn < FOREST_TURNS and len(a) > DENSE * m:
                    more.append(rows["hub"][s])
                    some = _thinned(a, b, rows, turn)
                    a, b = a[some], b[some]
                block = (np.unique(np.concatenate([a, b]), return_inverse=True)[1] // BLOCK_TEXTS).reshape(2, -1)
                found.append((a, b, (rows["cell"][a] << 32) + (block.min(axis=0) << 16) + block.max(axis=0)))
    node, hub = rows["node"], rows["hub"]
    both = [np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), hub[a], cell], 1) for a, b, cell in found]
    both = np.concatenate([np.zeros((0, 4), np.int64), *both])
    both = both[np.unique(both[:, :2], axis=0, return_index=True)[1]]
    return both, np.unique(np.array(more, np.int64))


def _tree_join(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b, null, (group, cell)) pairs from rows (hub, cell, node, label, n, vec, fine) sorted by hub and cell; (null, null, hub, null) of a hub that has more."""

    def run(batches):
        held = None
        names = ["hub", "cell", "node", "label", "n"]
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            new["vec"], new["fine"] = unpacked(batch.column("vec").to_pylist(), batch.column("fine").to_pylist())
            if held is not None:
                new = {c: np.concatenate([held[c], new[c]]) for c in new}
            last = np.flatnonzero((new["hub"] != new["hub"][-1]) | (new["cell"] != new["cell"][-1]))
            end = last[-1] + 1 if len(last) else 0
            held = {c: v[end:] for c, v in new.items()}
            if end:
                yield emit({c: v[:end] for c, v in new.items()})
        if held is not None and len(held["hub"]):
            yield emit(held)

    def emit(rows):
        pairs, more = _hub_pairs(rows, percent, turn)
        a, b, hub, cell = (pa.concat_arrays([pa.array(pairs[:, i]), pa.nulls(len(more), pa.int64())]) for i in range(4))
        return pa.RecordBatch.from_arrays([a, b, pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(more)]), hub, cell], names=["a", "b", "more", "hub", "cell"])

    found = rows.mapInArrow(run, "a long, b long, more long, hub long, cell long")
    return found.groupBy("a", "b", "more").agg(F.min(F.struct("hub", "cell")).alias("at"))


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose bound reaches the threshold."""

    def run(batches):
        for batch in batches:
            a, b = (unpacked(batch.column(v).to_pylist(), batch.column(f).to_pylist())[0] for v, f in (("vec", "fine"), ("_vec", "_fine")))
            ok = enough(_bound(a, b), batch.column("n").to_numpy() + batch.column("_n").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    one = points.select(F.col("node").alias("a"), "n", "vec", "fine")
    two = points.select(F.col("node").alias("b"), F.col("n").alias("_n"), F.col("vec").alias("_vec"), F.col("fine").alias("_fine"))
    near = (100 * F.least("n", "_n") >= percent * F.greatest("n", "_n"))
    close = pairs.join(one, "a").join(two, "b").where(near)
    return staged(close.select("a", "b", "n", "_n", "vec", "fine", "_vec", "_fine").mapInArrow(run, "a long, b long"), "close")


def _by_hub(close: DataFrame) -> DataFrame:
    """(group, cell, a, b) of pairs (a, hub b): a hub's text goes once to each block of its members."""
    size = close.groupBy(F.col("b").alias("_hub")).agg(F.ceil(F.count("*") / BLOCK_TEXTS).alias("_blocks"))
    cell = F.pmod(F.xxhash64("a"), F.col("_blocks"))
    return close.join(size, F.col("b") == F.col("_hub")).select(F.col("b").alias("group"), cell.alias("cell"), "a", "b")


def _verify(between: DataFrame, points: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of pairs (group, cell, a, b) whose sets reach the threshold; a text goes once to each cell it has a pair in."""

    def linked(texts, between):
        nodes, text, sets = texts.column("node").to_pylist(), texts.column("text").to_pylist(), []
        for i, j in slices([len(t) for t in text], 2_000_000):
            sets += shingle_sets(text[i:j], width)
        sets = dict(zip(nodes, sets))
        found = [], []
        for x, y in zip(between.column("a").to_pylist(), between.column("b").to_pylist()):
            left, right = sets[x], sets[y]
            both = len(np.intersect1d(left, right, assume_unique=True))
            if 100 * both >= percent * (len(left) + len(right) - both):
                found[0].append(x)
                found[1].append(y)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    between = staged(between, "groups")
    ends = between.select("group", "cell", F.col("a").alias("node")).unionByName(between.select("group", "cell", F.col("b").alias("node"))).distinct()
    wanted = points.join(ends.select("node").distinct(), "node").select("node", F.xxhash64("doc_id", "text_hash").alias("_key"), "text_hash")
    keyed = mark_members(rows.withColumn("_key", F.xxhash64("doc_id", "text_hash")), wanted.select("_key").distinct(), ["_key"], "_wanted").where("_wanted")
    own = staged(keyed.join(wanted, ["_key", "text_hash"]).select("node", "text"), "texts").dropDuplicates(["node"])
    texts = ends.join(own, "node").select(F.col("group").alias("_group"), F.col("cell").alias("_cell"), "node", "text")
    return texts.groupBy("_group", "_cell").cogroup(between.groupBy("group", "cell")).applyInArrow(linked, "a long, b long").distinct()


def _split_hubs(members: DataFrame, label: DataFrame, points: DataFrame) -> DataFrame:
    """hub, cell, node, label, n, vec, fine of the (hub, node) whose hub's members are in more than one component, sorted by hub and cell.

    Blocks of a hub's members meet pair by pair: block i stands in the cells (i, j) and (j, i) of all j.
    """
    known = members.join(label, "node", "left").select("hub", "node", F.coalesce("label", "node").alias("label"))
    split = known.groupBy("hub").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count("*").alias("_rows"))
    # A hub and its only member have been tried.
    split = split.where("_lo < _hi and _rows > 2")
    blocks = F.ceil(F.col("_rows") / BLOCK_POINTS).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda j: F.least(j, F.col("_mine")).cast("long") * F.col("_blocks") + F.greatest(j, F.col("_mine")),
    )
    left = (
        known.join(split, "hub")
        .withColumn("_blocks", blocks)
        .withColumn("_mine", mine)
        .select("hub", "node", "label", F.explode(cells).alias("cell"))
        .join(points.select("node", "n", "vec", "fine"), "node")
    )
    return left.repartition("hub", "cell").sortWithinPartitions("hub", "cell").select("hub", "cell", "node", "label", "n", "vec", "fine")


def join(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text); other columns are ignored.

    Sets are the distinct ``width``-word shingles, or the whole sequence of a shorter text; a null, empty
    or wordless text has none and links with nothing. Two rows link when 100 * intersection >= percent *
    union. Rows of equal sets are one node; rows repeated wholly, or with one id, are rows of their own.
    component_id is the least id of the component, null only if all its ids are; an unlinked row's is its own.
    Only components are returned: pairs inside a known one are not searched, so links are neither listed nor counted.
    text_hash and component (null without shingles) tell rows and components apart whatever their ids.
    """
    rows = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    feats = staged(_features(rows, width, percent), "features")
    some = feats.where("n > 0")
    points = some.groupBy("node").agg(F.min("n").alias("n"), F.min("vec").alias("vec"), F.min("fine").alias("fine"), F.min(F.struct("doc_id", "text_hash")).alias("first"))
    points = staged(points.select("node", "n", "vec", "fine", "first.doc_id", "first.text_hash"), "points")
    postings = some.select(F.explode("sig").alias("sig"), "node")
    hubs = postings.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("_top"), (F.count("*") > 2).alias("many"))
    hubs = staged(hubs.where("hub < _top").drop("_top"), "hubs")
    # Most hashes are one set's alone: their postings stay where they are.
    shared = mark_members(postings, hubs.select("sig"), ["sig"], "_shared").where("_shared")
    meets = shared.join(hubs, "sig").where("node != hub")
    star = staged(meets.groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.max("many").alias("many")), "star")
    close = _bounded(star.select("a", "b"), points, percent)
    links = staged(_verify(_by_hub(close), points, rows, width, percent), "links")

    # A hash of two sets has no pair besides that with its hub: both stand in a tree only for a hash of more.
    some_more = star.where("many")
    members = some_more.select(F.col("b").alias("hub"), F.col("a").alias("node"))
    members = members.unionByName(some_more.select(F.col("b").alias("hub"), F.col("b").alias("node")).distinct())
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for turn in range(FOREST_TURNS + 1):
        label = staged(components(links, "a", "b", ONE_TASK), "label")
        found = staged(_tree_join(_split_hubs(members, label, points), percent, turn), "pairs")
        more = found.where("more is null").select("a", "b", F.col("at.hub").alias("group"), "at.cell").join(tried, ["a", "b"], "left_anti")
        links = staged(links.unionByName(_verify(more.select("group", "cell", "a", "b"), points, rows, width, percent)), "links")
        # Hubs that have named all their pairs are done.
        dense = found.where("more is not null").select(F.col("more").alias("hub")).distinct()
        if turn == FOREST_TURNS or dense.isEmpty():
            break
        members, tried = members.join(dense, "hub"), tried.unionByName(more.select("a", "b"))
    label = staged(components(links, "a", "b", ONE_TASK), "label")

    member = some.select("doc_id", "node").join(label, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    named = member.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    owner = label.select("node", "label")
    out = feats.select("doc_id", "text_hash", "n", "node").join(owner, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return (
        out.join(named, "label", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            "text_hash",
            F.when(F.col("n") > 0, F.col("label")).alias("component"),
        )
    )


def one_each(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one of each component: that of the least id, null ids last.

    Rows without shingles all stay, once each.
    """
    found = staged(join(docs, width, percent), "found")
    rank = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "text_hash")
    first = found.where("component is not null").groupBy("component").agg(F.min(rank).alias("_first")).select("_first.doc_id", "_first.text_hash")
    stay = first.unionByName(found.where("component is null").select("doc_id", "text_hash")).distinct()
    stay = stay.select(F.col("doc_id").alias("_id"), F.coalesce("text_hash", F.lit(0)).alias("_hash"))
    rows = docs.withColumn("_own", F.coalesce(F.xxhash64("text"), F.lit(0)))
    rows = rows.join(stay, rows["doc_id"].eqNullSafe(stay["_id"]) & (rows["_own"] == stay["_hash"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "_own"]).select(*docs.columns)
