"""Document quality from bytes: a small convolutional network in numpy.

Each filter is a table of weights by place in a window of bytes and by byte. Windows start at every `STRIDE`-th byte of the
UTF-8 text. They fall into chunks, whose texts overlap by the window less its stride, and the chunks cover the whole text.
A chunk's feature is the largest response of a filter in it, cut at zero; a document has the mean and the largest of its
chunks, and one logistic unit turns those into a probability. A null or empty text has no windows and gets the score of
the bias, which is trained with the rest. Repeated documents are separate rows of the result, and count once in training, as repeated labels do. An
empty table of documents, or of labels, gives an untrained network, and an empty table an empty result. Ties in training go by hash, then label.
Texts of any length are scored whole, about a megabyte at a time or one text; input columns named as result columns are replaced.

Only the text is seen: labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, STRIDE, CHUNK, FILTERS = 8, 2, 128, 16
RESULT = ("held_out", "score", "predicted")


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Windows:
    """The windows of some texts in one buffer: places, chunks and documents as starts within the level below."""

    def __init__(self, texts: list[bytes]):
        n = np.array([len(t) for t in texts], dtype=np.int64)
        self.used = np.flatnonzero(n)
        n = n[self.used]
        padded = -(-n // STRIDE) * STRIDE + WINDOW
        self.buffer = np.frombuffer(b"".join(t.ljust(p, b"\0") for t, p in zip((texts[i] for i in self.used), padded)), dtype=np.uint8)
        places = -(-n // STRIDE)
        chunks = -(-places // CHUNK)
        first = np.cumsum(padded) // STRIDE - padded // STRIDE
        self.docs = np.cumsum(chunks) - chunks
        self.of_doc = np.repeat(np.arange(len(n)), chunks)
        inner = np.arange(int(chunks.sum())) - self.docs[self.of_doc] if len(n) else np.zeros(0, dtype=np.int64)
        start = first[self.of_doc] + inner * CHUNK
        # chunk, then the rest up to the next one, which only the last chunk of a text has
        self.ends = np.minimum(start + CHUNK, (first + places)[self.of_doc])
        self.cuts = np.column_stack([start, self.ends]).ravel()
        self.start, self.size = start, chunks

    def responses(self, tables: np.ndarray) -> np.ndarray:
        m = len(self.buffer) // STRIDE - (WINDOW - 1) // STRIDE
        out = tables[0][self.buffer[: m * STRIDE : STRIDE]]
        for k in range(1, WINDOW):
            out += tables[k].take(self.buffer[k : k + m * STRIDE : STRIDE][:m], axis=0)
        return out

    def pooled(self, responses: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each chunk, zero at least."""
        cuts = self.cuts
        # where a chunk meets the next one, the rest between them is empty, and reduceat gives a value that is left out
        return np.maximum(np.maximum.reduceat(responses, np.minimum(cuts, len(responses) - 1), axis=0)[::2], 0)

    def features(self, pooled: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(pooled, self.docs, axis=0) / self.size[:, None]
        return np.concatenate([mean, np.maximum.reduceat(pooled, self.docs, axis=0)], axis=1)


class Network:
    """Weights, and training by Adam on the log loss."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.tables = (0.25 * r.standard_normal((WINDOW, 256, FILTERS))).astype(np.float32)
        self.out = np.zeros(2 * FILTERS + 1)
        self.out[:-1] = 0.1 * r.standard_normal(2 * FILTERS)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logit = np.full(len(texts), self.out[-1])
        w = Windows(texts)
        if len(w.used):
            logit[w.used] += w.features(w.pooled(w.responses(self.tables))) @ self.out[:-1]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 48, rate: float = 0.01, shrink: float = 1e-4, seed: int = 2) -> Network:
        r = np.random.default_rng(seed)
        params = [self.tables, self.out]
        memory = [[np.zeros(p.shape, dtype=np.float64), np.zeros(p.shape, dtype=np.float64)] for p in params]
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for b in range(0, len(order), batch):
                pick = order[b : b + batch]
                t += 1
                for p, g, (m, v) in zip(params, self._grads([texts[i] for i in pick], labels[pick], shrink), memory):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(p.dtype)
        return self

    def _grads(self, texts: list[bytes], y: np.ndarray, shrink: float) -> tuple[np.ndarray, np.ndarray]:
        w = Windows(texts)
        tables, out = shrink * self.tables, shrink * self.out
        logit = np.full(len(texts), self.out[-1])
        if not len(w.used):
            out[-1] += (1 / (1 + np.exp(-logit)) - y).mean()
            return tables, out
        responses = w.responses(self.tables)
        pooled = w.pooled(responses)
        x = w.features(pooled)
        logit[w.used] += x @ self.out[:-1]
        d = (1 / (1 + np.exp(-logit)) - y) / len(y)
        out[-1] += d.sum()
        out[:-1] += d[w.used] @ x
        # back through the mean and the largest of the chunks, then through the largest of the windows
        to = d[w.used][:, None] * self.out[:FILTERS] / w.size[:, None]
        back = to[w.of_doc]
        top = pooled == np.maximum.reduceat(pooled, w.docs, axis=0)[w.of_doc]
        share = np.add.reduceat(top.astype(np.float64), w.docs, axis=0)
        back = (back + top * (d[w.used][:, None] * self.out[FILTERS:-1] / share)[w.of_doc]) * (pooled > 0)
        chunk = np.repeat(np.arange(len(w.start)), w.ends - w.start)
        place = np.arange(len(chunk)) - np.repeat(np.cumsum(w.ends - w.start) - (w.ends - w.start), w.ends - w.start) + w.start[chunk]
        hit, f = np.nonzero(responses[place] == pooled[chunk])
        key = chunk[hit] * FILTERS + f
        value = back[chunk[hit], f] / np.bincount(key, minlength=len(w.start) * FILTERS)[key]
        live = value != 0
        at, f, value = place[hit[live]] * STRIDE, f[live], value[live]
        for k in range(WINDOW):
            tables[k] += np.bincount(w.buffer[at + k].astype(np.int64) * FILTERS + f, weights=value, minlength=256 * FILTERS).reshape(256, FILTERS)
        return tables, out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 2500, max_bytes: int = 20_000) -> Network:
    """Fit on a bounded sample: at most `max_rows` pairs of a doc_id and its label outside the held-out fold, in hash order, each with one text of
    at most `max_bytes`: of several texts of a doc_id the first by hash. Without such rows the network is as it starts."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    pairs = known.select("doc_id", F.col("quality").cast("int").alias("_y")).distinct()
    picked = pairs.orderBy(F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string"))), "_y").limit(max_rows)
    # broadcast: max_rows rows of two numbers; to the driver: a row for each of them, of max_bytes at most
    text = F.col("__text")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).where(F.octet_length(text) <= max_bytes).join(F.broadcast(picked), "doc_id")
    rows = found.groupBy("doc_id", "_y").agg(F.min(F.struct(F.md5(text), text.alias("t")))["t"].alias("__text")).toPandas()
    rows = rows.sort_values(["doc_id", "_y", "__text"], kind="stable")
    texts = [t.encode("utf-8", "replace") for t in rows["__text"]]
    return Network().fit(texts, rows["_y"].to_numpy(dtype=np.float64)) if len(rows) else Network()


def score_quality(docs: DataFrame, network: Network, threshold: float = 0.7, bulk: int = 1_000_000) -> DataFrame:
    """docs with held_out, score and predicted; input columns of those names are replaced."""
    docs = common.without(docs, *RESULT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in b["__text"]]
            out, start, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= bulk or i == len(texts) - 1:
                    out.append(network.scores(texts[start : i + 1]))
                    start, size = i + 1, 0
            yield b.drop(columns="__text").assign(score=np.concatenate(out) if out else np.zeros(0))

    d = docs.withColumn("__text", F.col("text"))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    scored = common.in_batches(d).mapInPandas(run, f"{schema}, score double")
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    network = train(docs, common.table(spark, sf_dir, "labels"))
    slim = docs.select("doc_id", F.col("text"))
    return score_quality(slim, network).select("doc_id", "held_out", "score", "predicted")
