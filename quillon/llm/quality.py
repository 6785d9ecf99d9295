"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Each byte has a learned embedding; learned
filters pass over windows of several bytes, and their rectified outputs are max-pooled in each chunk.  The chunks'
pooled outputs are averaged over the document and combined by a logistic unit into one probability.  One input of a
window is not a byte: whether its bytes repeat those a short way before, which windows of a few bytes cannot see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import crc_fold, table

SEED = 42
#: Bytes in a chunk, from one chunk's start to the next, in a window, and from one window to the next.
CHUNK, STEP, WINDOW, STRIDE = 512, 448, 8, 4
EMBED, FILTERS = 8, 16
#: Lags at which a window may repeat earlier bytes.
LAGS = range(2, 21)
#: Labelled rows that the network is fitted on, at most, and bytes of their texts together.  Each text is taken whole.
TRAIN_DOCS, TRAIN_BYTES = 4_000, 24 << 20
UPDATES, BATCH, RATE = 250, 64, 0.01


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def chunks(raw: bytes) -> np.ndarray:
    """Overlapping chunks that cover all bytes, the last one padded with zeros; one chunk of zeros for no bytes."""
    n = max(1, -(-(len(raw) - CHUNK + STEP) // STEP)) if len(raw) > CHUNK else 1
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def repeats(x: np.ndarray) -> np.ndarray:
    """For each window of each chunk: whether its bytes equal those some lag before, zeros apart."""
    eight = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(x), WINDOW, axis=1)
    words = np.ascontiguousarray(eight).view(np.uint64)[..., 0]
    ends = np.arange(0, CHUNK - WINDOW + 1, STRIDE)
    here, out = words[:, ends], np.zeros((len(x), len(ends)), bool)
    for lag in LAGS:
        ok = ends >= lag
        out[:, ok] |= here[:, ok] == words[:, ends[ok] - lag]
    return out & (here != 0)


def windows(net: Net, x: np.ndarray) -> np.ndarray:
    """Window inputs, (chunks, windows, WINDOW * EMBED + 1)."""
    e = net.embed[x].reshape(len(x), -1)
    w = np.lib.stride_tricks.sliding_window_view(e, WINDOW * EMBED, axis=1)[:, :: STRIDE * EMBED]
    return np.concatenate([w, repeats(x)[..., None].astype(np.float32)], axis=2)


def pooled(net: Net, x: np.ndarray) -> np.ndarray:
    """Each chunk's largest rectified output of each filter."""
    w = windows(net, x)
    return np.maximum((w.reshape(-1, w.shape[2]) @ net.filters + net.bias).reshape(len(x), -1, FILTERS).max(1), 0)


def probability(net: Net, raw: bytes) -> float:
    """The network's output for a whole text, a bounded number of chunks at a time."""
    x = chunks(raw)
    total = sum(pooled(net, x[at : at + 128]).sum(0, dtype=np.float64) for at in range(0, len(x), 128))
    return float(1 / (1 + np.exp(-np.clip(total / len(x) @ net.out + net.out_bias, -30, 30))))


def fit(x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> Net:
    """Fit by Adam on chunks x of documents doc (sorted, from 0) with labels y.  Without both labels the output is their smoothed share."""
    rng = np.random.default_rng(SEED)
    share = (y.sum() + 1) / (len(y) + 2)
    net = Net(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 0.2, (WINDOW * EMBED + 1, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), float(np.log(share / (1 - share))),
    )
    if len(set(y.tolist())) < 2:
        return net
    net.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
    net.out_bias = 0.0
    first = np.searchsorted(doc, np.arange(len(y) + 1))
    params = [net.embed, net.filters, net.bias, net.out, np.array([net.out_bias], np.float32)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    epochs = max(1, round(UPDATES / max(1, len(y) // BATCH)))
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in some])
            of = np.repeat(np.arange(len(some)), [first[d + 1] - first[d] for d in some])
            b, n = x[rows], np.bincount(of)
            w = windows(net, b)
            z = (w.reshape(-1, w.shape[2]) @ net.filters + net.bias).reshape(len(b), -1, FILTERS)
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0]
            act = np.maximum(top, 0)
            mean = np.zeros((len(some), FILTERS), np.float32)
            np.add.at(mean, of, act)
            mean /= n[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ net.out + params[4][0], -30, 30)))
            g = ((p - y[some]) * balance[some] / len(some)).astype(np.float32)
            down = (g[:, None] * net.out / n[:, None])[of] * (top > 0)
            picked = np.take_along_axis(w, at[:, :, None], 1)  # the winning windows, (chunks, FILTERS, inputs)
            to_filters = np.einsum("cfi,cf->if", picked, down)
            to_embed = np.zeros_like(net.embed)
            byte = b[np.arange(len(b))[:, None, None], at[:, :, None] * STRIDE + np.arange(WINDOW)]
            back = down[:, :, None, None] * net.filters[:-1].T.reshape(1, FILTERS, WINDOW, EMBED)
            np.add.at(to_embed, byte.ravel(), back.reshape(-1, EMBED))
            grads = [to_embed, to_filters, down.sum(0), mean.T @ g, np.array([g.sum()], np.float32)]
            t += 1
            rate = RATE * (1 - epoch / (epochs + 1))
            for k, gk in enumerate(grads):
                m[k] += 0.1 * (gk - m[k])
                v[k] += 0.01 * (gk * gk - v[k])
                params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    net.out_bias = float(params[4][0])
    return net


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_out: int) -> Net:
    """Fit on at most TRAIN_DOCS labelled rows outside the held-out fold, with at most TRAIN_BYTES of texts.

    They are chosen by a hash of their ids, and all of each text is learned from; a text that alone is larger is not
    chosen.  Of several labels for an id the smallest counts.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_fold(F.col(id_col), folds) != held_out)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = rows.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sized = texts.groupBy("id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).orderBy(F.xxhash64("id"), "id").collect()
    fits, total = [], 0
    for r in sized:
        if total + r["n"] <= TRAIN_BYTES:
            fits.append(r["id"])
            total += r["n"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, y, text in zip(b["id"], b["y"], b["text"]):
                x = chunks((text or "").encode("utf-8", "surrogatepass"))
                out += [(str(name), y, k, r.tobytes()) for k, r in enumerate(x)]
            yield pd.DataFrame(out, columns=["id", "y", "k", "x"])

    some = docs.sparkSession.createDataFrame([(x,) for x in fits], rows.select("id").schema)
    got = texts.join(F.broadcast(some), "id").mapInPandas(cut, "id string, y int, k int, x binary").toPandas().sort_values(["id", "k", "x"], ignore_index=True)
    doc, ids = pd.factorize(got["id"])
    y = got.groupby(doc)["y"].first().to_numpy(float) if len(got) else np.zeros(0)
    x = np.array([np.frombuffer(r, np.uint8) for r in got["x"]]).reshape(-1, CHUNK)
    return fit(x, doc, y)


def score_quality(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on); null texts count as empty.

    The score depends on the text alone; all rows and columns pass through, columns of the two names are replaced.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([probability(net, (t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=float)

    return docs.withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out: int = 1) -> DataFrame:
    """docs with held_out, score and predicted, by a network fitted on the labelled rows outside the held-out fold.

    A null id is not held out.  Rows of labels with other labels than 0 and 1 or null ids are not used; of several for
    an id the smallest counts.  Rows of docs with one id are learned from together.  Without labels every score is one
    half.
    """
    net = fit_on(docs, labels, id_col, text_col, label_col, folds, held_out)
    return score_quality(docs, net, text_col).withColumn("held_out", F.coalesce(crc_fold(F.col(id_col), folds) == held_out, F.lit(False)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that the classifier rejects; the columns stay as they are."""
    net = fit_on(docs, labels, id_col, text_col, "quality", 3, 1)
    whole = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    return score_quality(whole, net, "_text").where("predicted = 1").select("_row.*")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
