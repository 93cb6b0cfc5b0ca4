"""Language identification by interpolated Kneser-Ney character models.

Fitting counts character n-grams of a bounded sample of labelled documents (``SAMPLE_DOCS`` of each language, whole
texts) as a Spark job: tasks count the n-grams of their texts, a partial aggregate adds them up, and the table of
different n-grams (its size is bounded by the sample) goes to the driver. There it becomes, for each order, one sorted
array of n-gram hashes with the interpolated log-probability of the n-gram in every language, and one of contexts with
the weight of the shorter model. Prediction is map-only: a binary search for each character of the whole text, and the
language with the lowest cross-entropy per character.

A second sample of the learning rows calibrates: the temperature of the softmax over cross-entropies that gives
``score``, and for each language the highest cross-entropy that is still ``accepted``.

Defined results: a text that is null or has no letter is ``und`` with score 0 and not accepted; ties go to the language
first by code point; without any row to learn from, every text is ``und``; rows are judged one by one; other columns of
the input are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.sampling import id_crc, sample_by_class

ORDER = 4
SAMPLE_DOCS = 400
CALIBRATION_DOCS = 150
#: Share of right texts that a language accepts.
ACCEPT = 0.995
UNKNOWN = "und"
_SPACE = 32
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _letters:
        codes = np.full(0x110000, _SPACE, np.uint32)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000 or unicodedata.category(ch := chr(c))[0] != "L":
                continue
            low = ch.lower()
            codes[c] = ord(low) if len(low) == 1 else c
        _letters.append(codes)
    return _letters[0]


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-case letters, with single spaces for all else and ``ORDER - 1`` spaces in front.

    Empty if the text has no letter.
    """
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letter_table()[raw]
    letter = codes != _SPACE
    if not letter.any():
        return np.empty(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = codes[keep]
    if codes[0] == _SPACE:
        codes = codes[1:]
    if codes[-1] != _SPACE:
        codes = np.append(codes, np.uint32(_SPACE))
    return np.concatenate((np.full(ORDER - 1, _SPACE, np.uint32), codes))


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given as one array of code points for each place."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for column, m in zip(columns, _MULTIPLIERS, strict=False):
        h = (h ^ column.astype(np.uint64)) * m
        h ^= h >> np.uint64(29)
    return h


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
    return at, (table[at] == wanted) if len(table) else np.zeros(len(wanted), bool)


class KneserNey:
    """Models of several languages. ``grams[k]`` and ``contexts[k]`` are sorted hash arrays of order k with one column
    of logarithms for each language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``counts``: for each language, different n-grams of the highest order (rows of code points) and how often they occur."""
        self.languages = sorted(counts)
        letters = len(np.unique(np.concatenate([g.ravel() for g, _ in counts.values()]))) + 1
        levels = {lang: self._levels(*counts[lang], letters) for lang in self.languages}
        # A letter that no language has: what each model of single letters leaves to the uniform one.
        self.floor = np.log([self._weight(levels[lang], 1, np.empty((1, 0), np.uint32))[0] / letters for lang in self.languages]).astype(np.float32)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, ORDER + 1):
            every = np.unique(np.concatenate([levels[lang][k]["grams"] for lang in self.languages]), axis=0)
            contexts = np.unique(every[:, : k - 1], axis=0) if k > 1 else np.empty((1, 0), np.uint32)
            weights = np.stack([self._weight(levels[lang], k, contexts) for lang in self.languages], axis=1)
            chances = np.stack([self._chance(levels[lang], k, every, letters) for lang in self.languages], axis=1)
            self.grams[k] = self._sorted(every, np.log(chances))
            if k > 1:
                self.contexts[k] = self._sorted(contexts, np.log(weights))
        self.temperature, self.limits = 1.0, np.full(len(self.languages), np.inf)

    @staticmethod
    def _sorted(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = _hash(list(rows.T))
        order = np.argsort(hashes)
        return hashes[order], values[order].astype(np.float32)

    @staticmethod
    def _levels(grams: np.ndarray, counts: np.ndarray, letters: int) -> dict[int, dict]:
        """For each order the n-grams, their (continuation) counts, and of each context the total and the number of followers."""
        levels = {}
        for k in range(ORDER, 0, -1):
            once, twice = max(1, int((counts == 1).sum())), max(1, int((counts == 2).sum()))
            hashes = _hash(list(grams.T))
            order = np.argsort(hashes)
            context, inverse = np.unique(_hash(list(grams[:, :-1].T)) if k > 1 else np.zeros(len(grams), np.uint64), return_inverse=True)
            levels[k] = {
                "grams": grams, "hash": hashes[order], "count": counts[order].astype(float), "discount": once / (once + 2 * twice),
                "context": context, "total": np.bincount(inverse, counts), "followers": np.bincount(inverse).astype(float),
            }
            if k > 1:  # how many different letters stand before each shorter n-gram
                grams, counts = np.unique(grams[:, 1:], axis=0, return_counts=True)
        return levels

    @staticmethod
    def _weight(levels: dict[int, dict], k: int, contexts: np.ndarray) -> np.ndarray:
        """What the model of order k leaves to the shorter one after each context; all, if it doesn't know the context."""
        own = levels[k]
        at, known = _find(own["context"], _hash(list(contexts.T)) if k > 1 else np.zeros(len(contexts), np.uint64))
        return np.where(known, own["discount"] * own["followers"][at] / own["total"][at], 1.0)

    def _chance(self, levels: dict[int, dict], k: int, grams: np.ndarray, letters: int) -> np.ndarray:
        shorter = np.full(len(grams), 1.0 / letters) if k == 1 else self._chance(levels, k - 1, grams[:, 1:], letters)
        own = levels[k]
        at, there = _find(own["hash"], _hash(list(grams.T)))
        place, known = _find(own["context"], _hash(list(grams[:, :-1].T)) if k > 1 else np.zeros(len(grams), np.uint64))
        direct = np.where(there & known, np.maximum(own["count"][at] - own["discount"], 0.0) / own["total"][place], 0.0)
        return direct + self._weight(levels, k, grams[:, :-1]) * shorter

    def log_chances(self, codes: np.ndarray) -> np.ndarray:
        """For each letter after the leading spaces, the natural logarithm of its probability in each language."""
        n = len(codes) - ORDER + 1
        columns = [codes[i : i + n] for i in range(ORDER)]
        total = np.zeros((n, len(self.languages)), np.float32)
        left = np.arange(n)
        for k in range(ORDER, 0, -1):
            own = [c[left] for c in columns[ORDER - k :]]
            hashes, values = self.grams[k]
            at, found = _find(hashes, _hash(own))
            total[left[found]] += values[at[found]]
            left, own = left[~found], [c[~found] for c in own]
            if not len(left):
                return total
            if k > 1:
                hashes, values = self.contexts[k]
                at, found = _find(hashes, _hash(own[:-1]))
                total[left[found]] += values[at[found]]
        total[left] += self.floor
        return total

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character in each language, and whether the text has letters. Long texts are read in pieces."""
        out, has = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        codes = [letters_of(t) for t in texts]
        lengths = np.array([max(0, len(c) - ORDER + 1) for c in codes])
        has = lengths > 0
        batch: list[int] = []
        size = 0
        for i in [*np.flatnonzero(has), -1]:
            if batch and (i < 0 or size + lengths[i] > 1 << 17):
                if len(batch) == 1:
                    c = codes[batch[0]]
                    pieces = range(0, len(c) - ORDER + 1, 1 << 17)
                    out[batch[0]] = sum(self.log_chances(c[a : a + (1 << 17) + ORDER - 1]).sum(axis=0, dtype=np.float64) for a in pieces)
                else:
                    # n-grams that span two texts are scored too and dropped from the sums
                    logs = self.log_chances(np.concatenate([codes[j] for j in batch]))
                    at = 0
                    starts = []
                    for j in batch:
                        starts += [at, at + lengths[j]]
                        at += len(codes[j])
                    out[batch] = np.add.reduceat(logs.astype(np.float64), starts if starts[-1] < len(logs) else starts[:-1], axis=0)[::2]
                batch, size = [], 0
            if i >= 0:
                batch.append(i)
                size += lengths[i]
        return -out / np.maximum(lengths, 1)[:, None], has

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Set the temperature by likelihood and each language's limit by the ``ACCEPT`` quantile."""
        entropy, has = self.cross_entropies(texts)
        right = np.array([self.languages.index(x) if x in self.languages else -1 for x in langs])
        entropy, right = entropy[has & (right >= 0)], right[has & (right >= 0)]
        if not len(right):
            return
        rows = np.arange(len(right))

        def loss(t: float) -> float:
            z = -entropy * t
            z -= z.max(axis=1, keepdims=True)
            return float(-(z[rows, right] - np.log(np.exp(z).sum(axis=1))).mean())

        self.temperature = min((2.0**i for i in range(-2, 7)), key=loss)
        own = entropy[rows, right]
        for k in range(len(self.languages)):
            if (right == k).sum() >= 20:
                self.limits[k] = np.quantile(own[right == k], ACCEPT) * 1.1

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        entropy, has = self.cross_entropies(texts)
        best = entropy.argmin(axis=1)
        rows = np.arange(len(texts))
        z = -entropy * self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        score = np.where(has, z[rows, best] / z.sum(axis=1), 0.0)
        own = entropy[rows, best]
        names = np.array(self.languages, object)[best]
        names[~has] = UNKNOWN
        return pd.DataFrame({"lang_pred": names, "score": score, "cross_entropy": np.where(has, own, np.nan), "accepted": has & (own <= self.limits[best])})


def count_grams(rows: DataFrame) -> DataFrame:
    """``lang, gram, n`` of the texts of ``rows (lang, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                grams, counts = [], []
                for text in texts:
                    codes = letters_of(text)
                    if len(codes):
                        windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
                        own, n = np.unique(windows, axis=0, return_counts=True)
                        grams.append(own)
                        counts.append(n)
                if grams:
                    own, inverse = np.unique(np.concatenate(grams), axis=0, return_inverse=True)
                    strings = [bytes(g).decode("utf-32-le", "surrogatepass") for g in np.ascontiguousarray(own)]
                    yield pd.DataFrame({"lang": lang, "gram": strings, "n": np.bincount(inverse.ravel(), np.concatenate(counts)).astype(np.int64)})

    return rows.select("lang", "text").mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> KneserNey | None:
    """A model of ``labelled (doc_id, lang, text)``; None without rows. ``sample_docs`` bounds what is learned from."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    part = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(4)) == 0
    counted = count_grams(sample_by_class(rows.filter(~part), "lang", "doc_id", sample_docs)).toPandas()
    if not len(counted):
        return None
    counts = {}
    for lang, own in counted.sort_values(["lang", "gram"]).groupby("lang"):
        grams = np.frombuffer("".join(own["gram"]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
        counts[lang] = grams, own["n"].to_numpy()
    model = KneserNey(counts)
    held = sample_by_class(rows.filter(part), "lang", "doc_id", calibration_docs, seed=2).select("lang", "text").toPandas()
    if len(held):
        model.calibrate(held["text"].tolist(), held["lang"].tolist())
    return model


def identify(docs: DataFrame, model: KneserNey | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, accepted`` of each row of ``docs``."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return slim.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = shared.value.predict(batch.column(1).to_pylist())
            columns = [batch.column(0), *(pa.array(out[c], t, from_pandas=True) for c, t in (("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("accepted", pa.bool_())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "cross_entropy", "accepted"])

    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean")


def learn_and_identify(docs: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """Learn from the documents outside the held-out fold (by crc32 of the id as text) and predict all of them."""
    learn = F.pmod(id_crc("doc_id"), F.lit(folds)) != held_fold
    model = fit(docs.filter(learn).select("doc_id", "lang", "text"))
    held = F.coalesce(F.pmod(id_crc("doc_id"), F.lit(folds)) == held_fold, F.lit(False))
    return identify(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted")
