"""Near neighbours of rows in all directions, without pairing rows of a cell or class.

Each table is a hash of the rotated and shifted features, bits of all directions interleaved, and kept
in hash order: cells of any fineness are ranges of it. A row probes the cells before and behind its own,
nearest first, until it has met ``probes`` rows on either side, so dense cells and repeated rows cost no
more than others. Candidates of all tables are ranked by their true distance.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from dealflux.plans.ordered import neighbours
from dealflux.session import cut

#: Features are hashed inside this many units around zero, and rows of a range of the hash order.
SPREAD = 16.0
RANGE_ROWS = 20_000
PROBES = 10
#: Tables beyond one for each feature; neighbours in more directions need more of them.
MORE_TABLES = 4


def hashes(x: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """Hash of every row in every table: features in a random rotation, moved by a random step, bits interleaved, highest first."""
    d = x.shape[1]
    bits = max(1, 62 // d)
    out = np.zeros((len(x), tables), np.int64)
    for t in range(tables):
        draw = np.random.default_rng((seed, t))
        turn = np.linalg.qr(draw.normal(size=(d, d)))[0] if t else np.eye(d)
        step = draw.uniform(0, SPREAD, d) if t else np.zeros(d)
        cell = np.clip((x @ turn.T + step + SPREAD) / (4 * SPREAD) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
        for b in reversed(range(bits)):
            for j in range(min(d, 62)):
                out[:, t] = out[:, t] << 1 | (cell[:, j] >> b) & 1
    return out


def nearest(df: DataFrame, key: str, features: Sequence[str], k: int, *, payload: Sequence[str] = (), tables: int | None = None, probes: int = PROBES, seed: int = 42) -> DataFrame:
    """key and ``near``: up to ``k`` near rows as (distance, key, payload), nearest first, never the row itself.

    ``features`` should be of like scale, around zero; ``key`` tells rows apart. Rows that lack a feature
    are left out. One feature needs one table and is exact, d features take d + ``MORE_TABLES``. Work is ``tables`` x ``probes`` candidates a row, however rows crowd.
    """
    rows = df.select(F.col(key).alias("_k"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), F.struct(*[F.col(c) for c in payload] or [F.lit(None).alias("none")]).alias("_p"))
    rows = cut(rows.where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v))))
    tables = tables or (1 if len(features) == 1 else MORE_TABLES + len(features))
    ranges = max(1, -(-rows.count() * tables // RANGE_ROWS))

    @pandas_udf("array<long>")
    def hashed(x: pd.Series) -> pd.Series:
        return pd.Series(list(hashes(np.stack(x.to_numpy()), tables, seed)))

    placed = rows.select("*", F.posexplode(hashed("_x")).alias("_table", "_h"))
    placed = cut(placed.repartitionByRange(ranges, "_table", "_h", "_k").withColumn("_range", F.spark_partition_id()))
    ahead = neighbours(placed, ["_table"], ["_h", "_k"], ["_k", "_x", "_p"], n=probes, chunk=F.col("_range"), out="_n")
    pairs = ahead.select(F.struct("_k", "_x", "_p").alias("a"), F.explode("_n").alias("b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    square = F.aggregate(F.zip_with("a._x", "b._x", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    found = both.select(F.col("a._k").alias(key), F.struct(F.sqrt(square).alias("distance"), F.col("b._k").alias("key"), F.col("b._p").alias("payload")).alias("_c"))
    # At most two probes a table and side.
    return found.groupBy(key).agg(F.slice(F.array_sort(F.collect_set("_c")), 1, k).alias("near"))
