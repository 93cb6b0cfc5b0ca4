"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded, filters of ``WIDTH`` bytes run over them with a stride, and each chunk of ``CHUNK``
bytes (chunks overlap by half and cover the whole document) keeps the maximum of each filter. A document's chunks are
combined by maximum, mean and minimum, and a hidden layer makes one probability of them. Repetition shows in these
numbers, too: a chunk of a repeated phrase lights up few filters, and the chunks of a repeated page are all alike.

The network is fitted on the driver with Adam on a bounded sample of labelled rows (``SAMPLE_DOCS`` of each class). It
learns from whole texts; of one of more than ``TRAIN_CHARS`` characters, which bounds the driver's memory, it learns from
``TRAIN_PARTS`` passages that lie evenly over all of it. Scoring reads whole texts and is map-only over Arrow batches.

Defined results: a null text counts as empty, and an empty text has a score like any other; if the labels have one
class only, every score is that class; without any label every score is 1 (nothing speaks against a text); rows are
judged one by one; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.sampling import id_crc, sample_by_class

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 4, 48, 32
HALF = 256
CHUNK = 2 * HALF
SAMPLE_DOCS = 2000
TRAIN_CHARS = 200_000
TRAIN_PARTS = 20
EPOCHS, BATCH, RATE = 14, 48, 4e-3
THRESHOLD = 0.7
#: Texts are scored in pieces of so many bytes at most, so memory doesn't grow with a text.
PIECE = 1 << 19


def _padded(raw: np.ndarray) -> np.ndarray:
    """Whole half-chunks and the bytes that the last filter reads beyond them."""
    halves = max(2, -(-len(raw) // HALF))
    out = np.zeros(halves * HALF, np.uint8)
    out[: len(raw)] = raw
    return out


class ByteNetwork:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.weights = {
            "embed": normal(256, EMBED, scale=0.5),
            "conv": normal(WIDTH * EMBED, FILTERS, scale=(2 / (WIDTH * EMBED)) ** 0.5),
            "conv_bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(3 * FILTERS, HIDDEN, scale=(2 / (3 * FILTERS)) ** 0.5),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, scale=(1 / HIDDEN) ** 0.5),
            "out_bias": np.zeros(1, np.float32),
        }
        self.shift, self.scale = np.zeros(3 * FILTERS, np.float32), np.ones(3 * FILTERS, np.float32)
        self.prior = 0.0
        self.constant: float | None = None

    @staticmethod
    def _places(codes: np.ndarray) -> np.ndarray:
        """The bytes of each filter place; the last ones of ``codes`` are read as if zeros followed."""
        parts = np.concatenate((codes, np.zeros(WIDTH - STRIDE, np.uint8))).reshape(-1, STRIDE)
        return np.concatenate([parts[i : len(parts) - WIDTH // STRIDE + 1 + i] for i in range(WIDTH // STRIDE)], axis=1)

    def _half_maxima(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        windows = self.weights["embed"][places].reshape(len(places), WIDTH * EMBED)
        active = windows @ self.weights["conv"]
        grouped = active.reshape(-1, HALF // STRIDE, FILTERS)
        where = grouped.argmax(axis=1)
        best = np.take_along_axis(grouped, where[:, None, :], 1)[:, 0] + self.weights["conv_bias"]
        return np.maximum(best, 0), where, windows

    def features(self, raw: np.ndarray) -> np.ndarray:
        """Maximum, mean and minimum over a document's chunks, read piece by piece."""
        codes = _padded(raw)
        last: np.ndarray | None = None
        top, low, total, n = None, None, np.zeros(FILTERS), 0
        for at in range(0, len(codes), PIECE):
            piece = codes[at : at + PIECE + WIDTH - STRIDE]
            own = len(codes[at : at + PIECE])
            tail = np.concatenate((piece, np.zeros(own + WIDTH - STRIDE - len(piece), np.uint8)))
            parts = self.weights["embed"][tail].reshape(-1, STRIDE * EMBED)
            windows = np.concatenate([parts[i : len(parts) - WIDTH // STRIDE + 1 + i] for i in range(WIDTH // STRIDE)], axis=1)
            half = (windows @ self.weights["conv"]).reshape(-1, HALF // STRIDE, FILTERS).max(axis=1) + self.weights["conv_bias"]
            half = np.maximum(half, 0)
            joined = half if last is None else np.concatenate((last[None], half))
            last = half[-1]
            if len(joined) < 2:
                continue
            chunks = np.maximum(joined[:-1], joined[1:])
            top = chunks.max(axis=0) if top is None else np.maximum(top, chunks.max(axis=0))
            low = chunks.min(axis=0) if low is None else np.minimum(low, chunks.min(axis=0))
            total += chunks.sum(axis=0, dtype=np.float64)
            n += len(chunks)
        return np.concatenate((top, total / n, low)).astype(np.float32)

    def _logits(self, features: np.ndarray) -> np.ndarray:
        w = self.weights
        hidden = np.maximum((features - self.shift) * self.scale @ w["hidden"] + w["hidden_bias"], 0)
        return hidden @ w["out"] + w["out_bias"][0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.empty(0)
        rows = np.stack([self.features(np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)) for t in texts])
        z = np.clip(self._logits(rows).astype(np.float64) + self.prior, -30, 30)
        return 1 / (1 + np.exp(-z))

    def fit(self, texts: list[str], labels: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> None:
        """Log loss, mini-batches, Adam with a falling rate."""
        rng = np.random.default_rng(seed)
        raws = [_padded(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for t in texts]
        first = np.stack([self.features(r) for r in raws[:256]])
        self.shift, self.scale = first.mean(axis=0), 1 / (first.std(axis=0) + 0.1)
        w = self.weights
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        step, steps = 0, epochs * -(-len(raws) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(raws))
            for at in range(0, len(order), BATCH):
                grads = self._gradients([raws[i] for i in order[at : at + BATCH]], labels[order[at : at + BATCH]].astype(np.float32))
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for k, g in grads.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)

    def _gradients(self, raws: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        places = np.concatenate([self._places(r) for r in raws])
        halves = np.array([len(r) // HALF for r in raws])
        half, where, windows = self._half_maxima(places)
        start = np.concatenate(([0], np.cumsum(halves)[:-1]))
        # chunk c of a document joins its halves c and c + 1
        inside = np.ones(len(half), bool)
        inside[start + halves - 1] = False
        left = np.flatnonzero(inside)
        chunk = np.maximum(half[left], half[left + 1])
        from_left = half[left] >= half[left + 1]
        counts = halves - 1
        begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
        doc = np.repeat(np.arange(len(raws)), counts)
        top, low = np.maximum.reduceat(chunk, begin), np.minimum.reduceat(chunk, begin)
        mean = np.add.reduceat(chunk, begin) / counts[:, None]
        x = (np.concatenate((top, mean, low), axis=1) - self.shift) * self.scale
        pre = x @ w["hidden"] + w["hidden_bias"]
        hidden = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_bias"][0], -30, 30)))
        d = ((p - labels) / len(labels)).astype(np.float32)
        g_hidden = np.outer(d, w["out"]) * (pre > 0)
        g_x = g_hidden @ w["hidden"].T * self.scale
        g_top, g_mean, g_low = g_x[:, :FILTERS], g_x[:, FILTERS : 2 * FILTERS], g_x[:, 2 * FILTERS :]
        at_top, at_low = chunk >= top[doc], chunk <= low[doc]
        g_chunk = (g_mean / counts[:, None])[doc]
        g_chunk += at_top * (g_top / np.maximum(np.add.reduceat(at_top, begin, dtype=np.float32), 1))[doc]
        g_chunk += at_low * (g_low / np.maximum(np.add.reduceat(at_low, begin, dtype=np.float32), 1))[doc]
        g_half = np.zeros_like(half)
        g_half[left] += g_chunk * from_left
        g_half[left + 1] += g_chunk * ~from_left
        g_half *= half > 0
        g_conv = np.zeros_like(w["conv"])
        place = where + (np.arange(len(half)) * (HALF // STRIDE))[:, None]
        g_embed = np.zeros_like(w["embed"])
        for f in range(FILTERS):
            rows = place[:, f]
            g_conv[:, f] = windows[rows].T @ g_half[:, f]
        g_tokens = (g_half[:, :, None] * w["conv"].T[None].reshape(1, FILTERS, WIDTH * EMBED)).reshape(len(half), FILTERS, WIDTH, EMBED)
        bytes_at = places[place]
        for e in range(EMBED):
            g_embed[:, e] = np.bincount(bytes_at.ravel(), g_tokens[:, :, :, e].ravel(), minlength=256)
        g_embed[0] = 0  # padding
        return {
            "embed": g_embed, "conv": g_conv, "conv_bias": g_half.sum(axis=0), "hidden": x.T @ g_hidden, "hidden_bias": g_hidden.sum(axis=0),
            "out": hidden.T @ d, "out_bias": np.array([d.sum()], np.float32),
        }


def _learnable(text: Column) -> Column:
    """A text of up to ``TRAIN_CHARS`` characters, or as many of a longer one in passages from its start to its end."""
    part = TRAIN_CHARS // TRAIN_PARTS
    gap = (F.char_length(text) - part) / (TRAIN_PARTS - 1)
    parts = [F.substring(text, F.floor(gap * k).cast("int") + 1, F.lit(part)) for k in range(TRAIN_PARTS)]
    return F.when(F.char_length(text) <= TRAIN_CHARS, text).otherwise(F.concat(*parts))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> ByteNetwork:
    """A network of ``docs (doc_id, text)`` and ``labels (doc_id, label)``; a document with several labels counts as 1 if any is.

    ``sample_docs`` bounds the rows of each class that are learned from; the sample is drawn from the narrow label table
    before any text is read.
    """
    marked = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("label"))
    counts = {int(k): n for k, n in marked.groupBy("label").agg(F.count(F.lit(1))).collect()}
    model = ByteNetwork()
    chosen = sample_by_class(marked, "label", "doc_id", sample_docs).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select("doc_id", _learnable(F.coalesce("text", F.lit(""))).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", "text"])  # bounded: two classes of sample_docs
    seen = set(rows["label"])
    if seen != {0, 1}:
        model.constant = 0.0 if seen == {0} else 1.0
        return model
    own = rows["label"].to_numpy()
    model.fit(rows["text"].tolist(), own)
    # back from the sample's shares of the classes to those of the labels
    model.prior = float(np.log(counts[1] / counts[0]) - np.log(own.sum() / (len(own) - own.sum())))
    return model


def score(docs: DataFrame, model: ByteNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1: good)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(at).to_pylist())
            out = [*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "score", "predicted"])

    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2) -> ByteNetwork:
    """Learn from the labels outside the held-out fold, by crc32 of the id as text."""
    return fit(docs, labels.filter(F.pmod(id_crc("doc_id"), F.lit(folds)) != held_fold))
