"""Quality classifier by compression: which labelled class's dictionary makes a text smaller.

Two zstandard dictionaries are built from a bounded sample of good and of bad labelled texts. A text
is compressed whole with either; the size difference over the size sum, with the plain compression
ratio beside it, goes through a logistic curve fitted on labelled texts that built no dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Labelled rows of each class that a fit may take, and the longest text (code points) among them.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 112_640
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the newest sample bytes as they are when there are too few to train on."""
    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-size:]


@lru_cache(maxsize=4)
def _coders(good: bytes, bad: bytes):
    made = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False)]
    for content in (good, bad):
        if content:
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        else:
            made.append(made[0])
    return made


def _inputs(good: bytes, bad: bytes, texts) -> np.ndarray:
    plain, with_good, with_bad = _coders(good, bad)
    rows = np.ones((len(texts), 5))
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        g, b, n = len(with_good.compress(data)), len(with_bad.compress(data)), len(plain.compress(data))
        ratio = n / (len(data) + 16)
        diff = (b - g) / (b + g)
        rows[i, 1:] = diff, ratio, diff * ratio, np.log2(len(data) + 1) / 16
    return rows


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic fit over the bounded sample, classes weighed alike."""
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (y - p)) - ridge * 1e-2 * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Model from ``labels`` (doc_id, quality 0 or 1) and the texts of ``docs``.

    At most ``rows`` texts of each class, those with the least id hash, reach the driver; of them
    half build the dictionaries and half the curve. Ids with contradicting or null labels are left
    out. Without labels of both classes every text scores by the curve's middle.
    """
    agreed = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_q"), F.max("quality").alias("_max"))
        .where("_q = _max")
        .select(F.col("doc_id").alias("_id"), "_q")
    )
    usable = docs.where(F.col("text").isNotNull() & (F.length("text") <= chars)).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    known = agreed.join(usable.select("_id").distinct(), "_id", "left_semi")
    # A bounded top list of ids for each class; texts are read for those ids alone.
    least = [known.where(F.col("_q") == q).orderBy(F.xxhash64("_id"), "_id").limit(rows) for q in (0, 1)]
    sample = usable.join(F.broadcast(least[0].unionByName(least[1])), "_id").groupBy("_id", "_q").agg(F.min("_text").alias("_text"))
    texts = {q: [] for q in (0, 1)}
    for row in sorted(sample.collect(), key=lambda r: r["_id"]):
        texts[row["_q"]].append(row["_text"].encode("utf-8", "surrogatepass"))
    got = [(i, q, t) for q, listed in texts.items() for i, t in enumerate(listed)]
    side = {q: [t for i, k, t in got if k == q and i % 2 == 0] for q in (0, 1)}
    good, bad = _dictionary(side[1]), _dictionary(side[0])
    held = [(q, t.decode("utf-8", "surrogatepass")) for i, q, t in got if i % 2 == 1]
    y = np.array([q for q, _ in held], float)
    if len(set(y)) < 2:
        return Model(good, bad, (0.0, 0.0, 0.0, 0.0, 0.0))
    return Model(good, bad, tuple(_logistic(_inputs(good, bad, [t for _, t in held]), y)))


def score(text: Column, model: Model) -> Column:
    """Likelihood, 0 to 1, that the text is of the good class; a null text scores as an empty one."""
    good, bad, weights = model.good, model.bad, np.array(model.weights)

    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        z = _inputs(good, bad, texts.tolist()) @ weights
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return scored(text)
