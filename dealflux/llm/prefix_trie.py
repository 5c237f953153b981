"""Prefix trie of conversations by van Emde Boas recursion on its depth.

Sequences are cut at half their depth, again and again down to blocks of ``HEIGHT`` turns. On the way
up, digests of halves make digests of wholes; on the way down every cut prefix gets its name from the
name of the part above it and the digest of the half before it, for all tries of a level at once. A
name stands for one sequence of turns, so upper tries and lower forests are the same small problem:
blocks of a few turns below a named prefix. Totals are then grafted upward: what the tries below a
cut hold is added to the node at the cut, from the coarsest cut to the finest.

No conversation or node is ever gathered in one task: rows move in blocks of ``HEIGHT`` turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflux.llm.common import staged, word_count
from dealflux.llm.group_joins import join_counted

HEIGHT = 8
#: Characters of ids that are joined before they are handed on to be hashed.
JOINED = 1 << 16
ROOT = b""


def digest(*parts: Column) -> Column:
    """128 bits that name a concatenation of binary columns."""
    return F.unhex(F.md5(F.concat(*parts)))


def sequences(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, shape) of rebuilt conversations.

    ``turns`` has a row per rebuilt turn: conv, i from 0, key, words, length. ``shape`` has a row per
    conversation: conv, length. Turns go by ``turn``, null first, ties by the digest of role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        word_count(text).alias("words"),
    )
    # Texts are read once, before ranges are sampled. Ranges over the whole order cut long conversations, and
    # the stored number of a range orders them.
    order = [F.col("turn").asc_nulls_first(), F.col("key")]
    rows = staged(rows, "keys")
    rows = staged(rows.repartitionByRange("conv", *order).withColumn("chunk", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv", "chunk").agg(F.count("*").alias("_n"))
    chunks = chunks.withColumn("base", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(Window.partitionBy("conv")))
    chunks = staged(chunks, "chunks")

    own = chunks.where("base = 0").select("conv", "n", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(4)).alias("h"), (F.col("conv") - F.col("conv") % 20).alias("donor"))
    donors = own.where("conv = donor").select("donor", F.col("n").alias("_has"))
    shape = own.join(donors, "donor", "left").withColumn("given", F.least("h", F.coalesce("_has", F.lit(0))))
    shape = staged(shape.withColumn("length", F.col("given") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "shape")

    chunks = chunks.join(shape.select("conv", "h", "given", "length"), "conv")
    placed = rows.join(chunks.select("conv", "chunk", "base", "h", "given", "length"), ["conv", "chunk"])
    placed = placed.withColumn("at", F.col("base") + F.row_number().over(Window.partitionBy("conv", "chunk").orderBy(*order)) - 1)
    placed = staged(placed.select("conv", "at", "key", "words", "h", "given", "length"), "placed")
    kept = placed.where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("given")).alias("i"), "key", "words", "length")
    heads = placed.where("conv % 20 = 0 and at < 3").select(F.col("conv").alias("donor"), F.col("at").alias("i"), "key", "words")
    lent = heads.join(shape.select("conv", "donor", "given", F.col("length")), "donor").where("i < given").select("conv", "i", "key", "words", "length")
    return kept.unionByName(lent), shape.select("conv", "length")


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv, q, keys, words, length): the q-th ``HEIGHT`` turns of a conversation."""
    part = F.sort_array(F.collect_list(F.struct("i", "key", "words")))
    rows = turns.groupBy("conv", F.floor(F.col("i") / HEIGHT).alias("q"), "length").agg(part.alias("_t"))
    return staged(rows.select("conv", "q", F.col("_t.key").alias("keys"), F.col("_t.words").alias("words"), "length"), "blocks")


def _contexts(blocks: DataFrame, shape: DataFrame, levels: int) -> DataFrame:
    """(conv, j, name, chain): name of the first j blocks' turns; chain holds, from the coarsest level to the finest, the prefix each level cuts before block j."""
    whole = blocks.where(F.size("keys") == HEIGHT).select("conv", F.col("q").alias("j"), digest(F.array_join(F.transform("keys", F.hex), "")).alias("half"))
    halves = []
    for level in range(levels):
        halves.append(whole := staged(whole, f"halves{level}"))
        pair = whole.groupBy("conv", F.floor(F.col("j") / 2).alias("j")).agg(
            F.max(F.when(F.col("j") % 2 == 0, F.col("half"))).alias("_a"), F.max(F.when(F.col("j") % 2 == 1, F.col("half"))).alias("_b"),
        )
        whole = pair.where("_a is not null and _b is not null").select("conv", "j", digest(F.col("_a"), F.col("_b")).alias("half"))
    names = shape.select("conv", F.lit(0).cast("long").alias("j"), F.lit(ROOT).alias("name"), F.array(F.lit(ROOT)).alias("chain"))
    for half in reversed(halves):
        half = half.select("conv", (F.col("j") / 2).cast("long").alias("j"), "half", (F.col("j") % 2).alias("_odd")).where("_odd = 0").drop("_odd")
        both = names.join(half, ["conv", "j"], "left")
        upper = F.struct((F.col("j") * 2).alias("j"), F.col("name").alias("name"))
        lower = F.struct((F.col("j") * 2 + 1).alias("j"), digest(F.col("name"), F.col("half")).alias("name"))
        both = both.select("conv", "chain", F.explode(F.when(F.col("half").isNull(), F.array(upper)).otherwise(F.array(upper, lower))).alias("_s"))
        names = both.select("conv", F.col("_s.j").alias("j"), F.col("_s.name").alias("name"), F.concat("chain", F.array("_s.name")).alias("chain"))
    return staged(names, "contexts")


def _named(blocks: DataFrame, contexts: DataFrame) -> DataFrame:
    """``blocks`` with names: the prefix before the block, then the prefix ending at each of its turns."""
    step = F.aggregate(
        "keys", F.array("name"),
        lambda names, key: F.concat(names, F.array(digest(F.element_at(names, -1), key))),
    )
    after = contexts.select("conv", (F.col("j") - 1).alias("q"), F.col("name").alias("_after"))
    rows = blocks.join(contexts.select("conv", F.col("j").alias("q"), "name"), ["conv", "q"]).join(after, ["conv", "q"], "left")
    names = F.when(F.col("_after").isNull(), step).otherwise(F.concat(F.slice(step, 1, HEIGHT), F.array("_after")))
    return staged(rows.select("conv", "q", names.alias("names"), "words", "length"), "named")


def _nodes(named: DataFrame) -> DataFrame:
    """A row per node below the root: its name, parent, the line of names from its block's top to itself, members."""
    rows = named.select("conv", "q", "names", F.posexplode("words").alias("r", "words")).withColumn("r", F.col("r") + 1)
    rows = rows.select(
        "conv", F.element_at("names", F.col("r") + 1).alias("name"), F.element_at("names", F.col("r")).alias("parent"), F.element_at("names", 1).alias("context"),
        F.slice("names", F.lit(2), F.col("r")).alias("line"), (F.col("q") * HEIGHT + F.col("r")).alias("depth"), "words",
    )
    return rows.groupBy("name", "parent", "context", "line", "depth", "words").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"))


def _grafts(tries: DataFrame, cuts: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(tries, grafts): what lies below each cut, added to the node at the cut and to the trie that holds it."""
    added = []
    for level in reversed(range(levels)):
        lower = tries.where(F.shiftright("q", level) % 2 == 1)
        below = lower.groupBy(F.element_at("chain", levels - level + 1).alias("name")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        graft = staged(below.join(cuts, "name"), "grafts")
        added.append(graft.select("name", "leaves", "saved"))
        more = graft.groupBy("context").agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        tries = tries.join(more, "context", "left").select(
            "context", "q", "chain", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"),
        )
        tries = staged(tries, "tries")
    total = added[0] if added else None
    for graft in added[1:]:
        total = total.unionByName(graft)
    return tries, total


def _joined(batches):
    """Ids of a name joined by commas, in pieces, from rows sorted by name and id."""
    held, first, parts, size, rows = None, None, [], 0, []
    for batch in batches:
        for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if parts and (name != held or size >= JOINED):
                rows.append((held, first, ",".join(parts)))
                parts = []
            if not parts:
                held, first, size = name, conv, 0
            parts.append(str(conv))
            size += len(parts[-1]) + 1
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "first", "ids"), r, strict=True)) for r in rows], schema=_PIECES)
        rows = []
    if parts:
        yield pa.RecordBatch.from_pylist([{"name": held, "first": first, "ids": ",".join(parts)}], schema=_PIECES)


def _hashed(batches):
    """SHA-256 of each name's pieces joined by commas, fed piece by piece."""
    held, state = None, None
    for batch in batches:
        rows = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is not None and name == held:
                state.update(b"," + ids.encode())
            else:
                if state is not None:
                    rows.append((held, state.hexdigest()))
                held, state = name, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pylist([{"name": n, "ends_sha256": h} for n, h in rows], schema=_HASHES)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"name": held, "ends_sha256": state.hexdigest()}], schema=_HASHES)


_PIECES = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_HASHES = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])


def _ends(named: DataFrame, shape: DataFrame) -> DataFrame:
    """(name, ends_sha256) of nodes at which conversations end.

    One string a node has to be hashed from its start; ids meet in pieces of ``JOINED`` characters that
    are made where sorted ranges of (node, id) lie, so a node's task reads pieces, not ids.
    """
    last = named.where(F.col("q") * HEIGHT + F.size("words") == F.col("length")).select(F.element_at("names", -1).alias("name"), "conv")
    ends = staged(last.unionByName(shape.where("length = 0").select(F.lit(ROOT).alias("name"), "conv")), "ends")
    pieces = ends.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").mapInArrow(_joined, "name binary, first long, ids string")
    return pieces.repartition("name").sortWithinPartitions("name", "first").select("name", "ids").mapInArrow(_hashed, "name binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of rebuilt conversations.

    Columns, all long but the last: conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Null roles and texts are empty; turns go by
    ``turn``, null first. Turns tied in ``turn``, repeated rows among them, all count and go by the MD5 of
    role and text, so the order is the same in every run. Rows without a conv_id belong to no
    conversation and are not read. A conversation may lose all its turns and is then a member of the
    root alone. An empty table has no root and gives no rows. Other columns are ignored. Equal 128-bit
    digests count as equal turns.
    """
    turns, shape = sequences(conversations)
    longest = shape.agg(F.max("length")).first()[0] or 0
    levels = (longest // HEIGHT).bit_length()
    blocks = _blocks(turns)
    contexts = _contexts(blocks, shape, levels)
    named = _named(blocks, contexts)
    nodes = staged(_nodes(named), "nodes")
    kids = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    own = staged(
        nodes.join(kids, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaves", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("words")),
        "own",
    )
    sums = own.groupBy("context").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    tries = contexts.groupBy(F.col("name").alias("context"), F.col("j").alias("q"), "chain").agg(F.lit(1).alias("_one")).drop("_one").join(sums, "context")
    tries, grafts = _grafts(staged(tries, "tries"), own.where(F.col("depth") % HEIGHT == 0).select("name", "context"), levels)

    value = own.select("name", "line", "leaves", "saved")
    if grafts is not None:
        more = grafts.groupBy("name").agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        value = value.join(more, "name", "left").select("line", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"))
    totals = value.select(F.explode("line").alias("name"), "leaves", "saved").groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    top = tries.where("q = 0").select(F.col("context").alias("name"), "leaves", "saved")
    root = (
        shape.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").withColumn("name", F.lit(ROOT))
        .join(kids.where(F.col("name") == ROOT), "name", "left").join(top, "name", "left")
        .select(
            "name", "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        )
    )
    ids = own.select("name", "conv_id").unionByName(root.select("name", "conv_id"))
    parents = staged(kids.join(ids, "name").select(F.col("name").alias("parent"), F.col("n_children").alias("_kids"), F.col("conv_id").alias("parent_conv_id")), "parents")
    rows = join_counted(own.join(totals, "name"), parents, ["parent"], "_kids", own.count())
    rows = rows.select(*root.columns).unionByName(root)
    return rows.join(_ends(named, shape), "name", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


ORACLE = r"""
WITH own AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT DISTINCT c, c - c % 20 AS donor,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295) % 4 AS h
    FROM own),
rebuilt AS (
    SELECT convs.c, 0 AS part, own.pos, own.role, own.text FROM convs JOIN own ON own.c = convs.donor AND own.pos < convs.h
    UNION ALL SELECT convs.c, 1, own.pos, own.role, own.text FROM convs JOIN own ON own.c = convs.c AND own.pos >= convs.h),
lists AS (SELECT c, list({'r': role, 't': text} ORDER BY part, pos) AS s FROM rebuilt GROUP BY c),
filled AS (SELECT convs.c, coalesce(s, []) AS s FROM convs LEFT JOIN lists USING (c)),
prefixes AS (SELECT c, d, s[:d] AS p, s[d].t AS t, d = len(s) AS last FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM filled)),
nodes AS (
    SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(t) AS t,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
    FROM prefixes GROUP BY p, d),
kids AS (SELECT p[:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children,
           CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) END AS saved
    FROM nodes LEFT JOIN kids USING (p, d)),
up AS (SELECT p[:a] AS p, a AS d, (n_children = 0)::INT AS leaf, saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM valued)),
totals AS (SELECT p, d, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY p, d)
SELECT v.conv_id, v.d::BIGINT AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM valued v JOIN totals USING (p, d) LEFT JOIN nodes o ON v.d > 0 AND o.d = v.d - 1 AND o.p = v.p[:v.d - 1]
"""
