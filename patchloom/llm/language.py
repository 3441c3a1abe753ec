"""Language identification by a byte convolutional network, trained in numpy and applied to fixed-length windows.

Filters of several widths slide over the bytes of a window; each filter's largest response over the window (max
pooling, then ReLU) feeds a softmax layer. A filter of width w over byte embeddings is a sum of w table lookups, so the
trained network is kept as such tables. Every byte of a text lies in a window: texts are cut into windows of equal
length, the last one aligned to the end, and the windows' log probabilities are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.llm.common import crc_remainder, free_name, lean_worker

WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
EMBEDDING = 8
LENGTH = 256  # bytes in a window
UNDETERMINED = "und"
SAMPLE_ROWS = 600  # labelled documents of each language that training takes at most
SAMPLE_WINDOWS = 4  # windows of each of them, evenly spread over the whole text


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def windows_of(raw: bytes, length: int = LENGTH) -> np.ndarray:
    """Rows of length bytes that cover raw; one row filled up with spaces when raw is shorter."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) <= length:
        return np.concatenate([data, np.full(length - len(data), 32, np.uint8)])[None]
    whole = len(data) // length
    rows = data[: whole * length].reshape(whole, length)
    return rows if whole * length == len(data) else np.concatenate([rows, data[None, -length:]])


class ByteNetwork:
    """Embedding, filters of several widths, max pooling, softmax; trained by Adam on the cross entropy."""

    def __init__(self, classes: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = [rng.normal(0, 0.4, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.weights = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.offset = np.zeros(len(classes), np.float32)

    def tables(self) -> list[np.ndarray]:
        """For each width an array (width, 256, filters) of what each byte adds at each place."""
        return [np.einsum("be,wef->wbf", self.embedding, f) for f in self.filters]

    @staticmethod
    def _pool(tables: list[np.ndarray], windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pooled, where = [], []
        for table in tables:
            w = len(table)
            n = windows.shape[1] - w + 1
            response = table[0][windows[:, :n]]
            for j in range(1, w):
                response += table[j][windows[:, j : j + n]]
            best = response.argmax(1)
            pooled.append(np.take_along_axis(response, best[:, None], 1)[:, 0])
            where.append(best)
        return np.concatenate(pooled, 1), where

    def log_probabilities(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        pooled = np.concatenate([self._largest(t, windows) for t in tables], 1)
        logits = np.maximum(pooled + self.bias, 0) @ self.weights + self.offset
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    @staticmethod
    def _largest(table: np.ndarray, windows: np.ndarray) -> np.ndarray:
        n = windows.shape[1] - len(table) + 1
        response = table[0].take(windows[:, :n], axis=0)
        for j in range(1, len(table)):
            response += table[j].take(windows[:, j : j + n], axis=0)
        return response.max(1)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 0) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        parameters = [self.embedding, *self.filters, self.bias, self.weights, self.offset]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for low in range(0, len(order), batch):
                rows = order[low : low + batch]
                x, y = windows[rows], labels[rows]
                pooled, where = self._pool(self.tables(), x)
                active = pooled + self.bias
                hidden = np.maximum(active, 0)
                logits = hidden @ self.weights + self.offset
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                down = (p @ self.weights.T) * (active > 0)
                d_embedding = np.zeros_like(self.embedding)
                d_filters = []
                for k, (w, best) in enumerate(zip(WIDTHS, where, strict=True)):
                    own = down[:, k * FILTERS : (k + 1) * FILTERS]
                    d = np.zeros_like(self.filters[k])
                    for j in range(w):
                        bytes_ = np.take_along_axis(x, best + j, 1)  # (rows, filters)
                        d[j] = np.einsum("rfe,rf->ef", self.embedding[bytes_], own)
                        np.add.at(d_embedding, bytes_, own[:, :, None] * self.filters[k][j].T[None])
                    d_filters.append(d)
                gradients = [d_embedding, *d_filters, down.sum(0), hidden.T @ p, p.sum(0)]
                step += 1
                now = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for value, g, (m, v) in zip(parameters, gradients, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    value -= now * m / (np.sqrt(v) + 1e-8)
        return self


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, windows: int = SAMPLE_WINDOWS) -> ByteNetwork | None:
    """A network from text and non-null lang of docs, or None when no labelled row has a letter.

    It takes at most rows documents of each language, those of the smallest hash of doc_id and text, and at most windows
    windows of each, spread over its whole text: the bound is on the sample, not on what is labelled.
    """
    known = docs.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("doc_id", "lang", "text")
    raw = F.encode("text", "UTF-8")
    size = F.octet_length("text")
    steps = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.greatest(size - LENGTH, F.lit(0)) * i / max(1, windows - 1))
    cuts = F.array_distinct(F.transform(steps, lambda s: F.substring(raw, s.cast("int") + 1, F.lit(LENGTH))))
    ranked = known.select("lang", cuts.alias("cuts"), F.xxhash64("doc_id", "text").alias("h"), "doc_id")
    chosen = ranked.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("n") <= rows)
    sample = chosen.select("lang", "h", "cuts").orderBy("lang", "h").collect()
    if not sample:
        return None
    classes = sorted({r.lang for r in sample})
    pairs = [(windows_of(bytes(c))[0], classes.index(r.lang)) for r in sample for c in r.cuts]
    return ByteNetwork(classes).fit(np.stack([w for w, _ in pairs]), np.array([k for _, k in pairs]))


def predict(docs: DataFrame, network: ByteNetwork | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns with lang_pred and score (its probability, 0 to 1), or with other names for these.

    Null texts, and texts without a letter, are `und` with score 0; so is every row without a network. All rows are
    kept, repeated ones included; columns of docs that have one of the two names are replaced. A tie goes to the first
    language in order.
    """

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def scored(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        lean_worker()
        tables = network.tables()
        out = []
        for low in range(0, len(texts), 64):
            some = zip(texts.iloc[low : low + 64], letters.iloc[low : low + 64], strict=True)
            cut = [windows_of(t.encode()) if ok else np.zeros((0, LENGTH), np.uint8) for t, ok in some]
            rows = np.concatenate(cut)
            logs = [network.log_probabilities(rows[i : i + 64], tables) for i in range(0, len(rows), 64)]
            logs = np.concatenate(logs) if logs else np.zeros((0, len(network.classes)))
            at = 0
            for c in cut:
                if not len(c):
                    out.append((UNDETERMINED, 0.0))
                    continue
                mean = logs[at : at + len(c)].mean(0)
                at += len(c)
                p = np.exp(mean - mean.max())
                best = int(p.argmax())
                out.append((network.classes[best], float(p[best] / p.sum())))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    rest, (lang, score) = docs.drop(*names), names
    if network is None:
        return rest.withColumns({lang: F.lit(UNDETERMINED), score: F.lit(0.0)})
    both = free_name(rest, "found")
    found = rest.withColumn(both, scored(F.col(text), has_letter(F.col(text))))
    return found.withColumns({lang: F.col(f"{both}.lang_pred"), score: F.col(f"{both}.score")}).drop(both)


def identify(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """docs' doc_id with held_out (crc32 of doc_id modulo folds is fold), lang_pred and score; learns from the other folds."""
    held = crc_remainder(F.col("doc_id"), folds) == fold
    network = train(docs.filter(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), network).select("doc_id", "held_out", "lang_pred", "score")
