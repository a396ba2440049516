"""Languages of texts and of the segments of mixed texts.

A sparse multinomial logistic regression on TF-IDF weighted, hashed character
n-grams, trained with follow-the-regularised-leader and an elastic net, with its
temperature calibrated on sentences kept out of training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.sampling import bounded_sample
from tesserine.llm.shingles import mix
from tesserine.llm.visual import plain_look

# The languages told apart.
LANGUAGES = ("en", "fr", "ar", "es", "de")
#: Hashed n-gram features.
DIMENSIONS = 1 << 16
#: Texts whose n-grams are held at a time.
TEXTS = 256
#: Longest character n-gram.
LONGEST = 4
#: Labelled texts per language that the model is fitted on, at most.
SAMPLE = 800
#: Characters of such a text that are used.
SAMPLE_CHARS = 4_000
#: Letters of a sentence that the model is fitted on, at most.
SENTENCE_CHARS = 600
#: Sentences per language that the model is fitted on, at most.
SENTENCES = 1_500
#: Letters below which a sentence goes with its neighbour.
SHORT = 12
#: Confidence below which a sentence goes with its neighbour.
UNSURE = 0.6
_END = re.compile(r"(?<=[.!?؟])(?:[\"'»”)\]]*)\s+")
_ABBREVIATION = re.compile(r"(?:^|[\s(«])(?:[A-Za-zÀ-ÿ]|Dr|Dra|Mr|Mrs|Ms|Mme|M|Sr|Sra|St|Prof|env|ex|etc|approx|ca|bzw|usw|vs|No|Nr|art|fig|p|z\. ?B|p\. ?ex)\.$", re.I)


_PAIRED = (("«", "»"), ("“", "”"), ("(", ")"))


def sentences(text: str) -> list[str]:
    """Whole sentences; a break inside quotes or brackets, after an abbreviation or at a bare line end is none.

    A quote or bracket that is never closed holds nothing together.
    """
    parts = _END.split(" ".join(text.split()))
    out: list[str] = []
    held: list[str] = []
    depth = [0, 0, 0]
    closers = [[0] * (len(parts) + 1) for _ in _PAIRED]  # that follow
    for k, (_, close) in enumerate(_PAIRED):
        for i in range(len(parts) - 1, -1, -1):
            closers[k][i] = closers[k][i + 1] + parts[i].count(close)
    for i, part in enumerate(parts):
        held.append(part)
        for k, (open_, close) in enumerate(_PAIRED):
            depth[k] = max(0, depth[k] + part.count(open_) - part.count(close))
        if any(d and closers[k][i + 1] for k, d in enumerate(depth)) or _ABBREVIATION.search(part):
            continue
        out.append(" ".join(held))
        held, depth = [], [0, 0, 0]
    return [*out, " ".join(held)] if held else out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the n-grams of every text, texts in order; case and digits do not matter."""
    plain = [" " + re.sub(r"\d+", "0", plain_look(t).casefold()) + " " for t in texts]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    a = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(plain)), sizes)
    keys = [np.empty(0, np.int64)]
    h = np.zeros(len(a), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(a) - n + 1
        if m <= 0:
            break
        h = mix(h[:m] * np.uint64(0x100000001B3) + a[n - 1 :] + np.uint64(n))
        ok = owner[:m] == owner[n - 1 :]
        keys.append(owner[:m][ok] * DIMENSIONS + (h[ok] % np.uint64(DIMENSIONS)).astype(np.int64))
    key = np.concatenate(keys)
    key.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[first] // DIMENSIONS, key[first] % DIMENSIONS, np.diff(np.append(first, len(key)))


class LanguageModel:
    """Weights, inverse document frequencies and temperature."""

    def __init__(self, idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0):
        self.idf, self.weights, self.temperature = idf.astype(np.float32), weights.astype(np.float32), temperature
        self.used = self.weights.any(axis=1)

    def logits(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([self._logits(texts[i : i + TEXTS]) for i in range(0, len(texts), TEXTS)] or [np.empty((0, len(LANGUAGES)))])

    def _logits(self, texts: list[str]) -> np.ndarray:
        text, feature, count = features(texts)
        v = count * self.idf[feature]
        norm = np.sqrt(np.bincount(text, v * v, len(texts)))
        at = np.flatnonzero(self.used[feature])  # most weights are zero
        text, rows = text[at], self.weights[feature[at]] * v[at, None]
        out = np.zeros((len(texts), len(LANGUAGES)))
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(text)), bool), text[1:] != text[:-1]]))
        if len(first):
            out[text[first]] = np.add.reduceat(rows, first, axis=0)
        return out / np.maximum(norm, 1e-9)[:, None]

    def chances(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty((0, len(LANGUAGES)))
        return _softmax(self.logits(texts) / self.temperature)

    def segments(self, text: str) -> list[tuple[str, str, float]]:
        """(segment, language, confidence): neighbouring sentences of one language together.

        A sentence too short or too unsure to tell goes with the one before it, or,
        where there is none, with the one after it. A blank text has no segment.
        """
        parts = sentences(text)
        return self.grouped(parts, self.chances(parts))

    @staticmethod
    def grouped(parts: list[str], chances: np.ndarray) -> list[tuple[str, str, float]]:
        sure = [sum(c.isalpha() for c in p) >= SHORT and chances[i].max() >= UNSURE for i, p in enumerate(parts)]
        if parts and not any(sure):
            total = chances.mean(axis=0)
            return [(" ".join(parts), LANGUAGES[int(total.argmax())], float(total.max()))]
        best = chances.argmax(axis=1) if parts else []
        out: list[list] = []
        waiting: list[str] = []
        for i, p in enumerate(parts):
            if not sure[i]:
                if out:
                    out[-1][0].append(p)
                else:
                    waiting.append(p)
                continue
            if out and out[-1][1] == best[i]:
                out[-1][0].append(p)
                out[-1][2].append(chances[i, best[i]])
            else:
                out.append([[*waiting, p], int(best[i]), [chances[i, best[i]]]])
                waiting = []
        return [(" ".join(s), LANGUAGES[k], float(np.mean(c))) for s, k, c in out]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: np.ndarray, n_classes: int, epochs: int = 3, alpha: float = 1.5, beta: float = 1.0, l1: float = 0.2, l2: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(idf, weights) by per-coordinate FTRL-proximal with elastic-net penalties."""
    text, feature, count = features(texts)
    idf = np.log((1 + len(texts)) / (1 + np.bincount(feature, minlength=DIMENSIONS))) + 1
    starts = np.searchsorted(text, np.arange(len(texts) + 1))
    z, n = np.zeros((DIMENSIONS, n_classes)), np.zeros((DIMENSIONS, n_classes))
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(len(texts)):
        f, v = feature[starts[i] : starts[i + 1]], count[starts[i] : starts[i + 1]]
        v = v * idf[f]
        rows.append((f, v / max(np.sqrt((v * v).sum()), 1e-9)))
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            f, v = rows[i]
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2))
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha
            z[f] = zf + g - sigma * w
            n[f] = nf + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return idf, w


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    while b - a > 1e-3:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(texts: dict[str, list[str]]) -> LanguageModel:
    """Fit on labelled texts whose labels may be partly wrong.

    Their sentences take the label; a first model finds those it contradicts, and
    the second is trained without them. A fifth of the sentences is kept for the
    calibration.
    """
    rows, labels = [], []
    for k, lang in enumerate(LANGUAGES):
        own = sorted({s for t in texts.get(lang, []) for s in sentences(t) if sum(c.isalpha() for c in s) >= 2 * SHORT and len(s) < SENTENCE_CHARS}, key=lambda s: hash_of(s))
        rows += own[:SENTENCES]
        labels += [k] * len(own[:SENTENCES])
    labels = np.array(labels, np.int64)
    held = np.array([hash_of(s) % 5 == 0 for s in rows], bool)
    keep = ~held
    model = LanguageModel(np.ones(DIMENSIONS), np.zeros((DIMENSIONS, len(LANGUAGES))))
    for epochs in (1, 3):
        at = np.flatnonzero(keep)
        model = LanguageModel(*train([rows[i] for i in at], labels[at], len(LANGUAGES), epochs))
        p = model.chances(rows)
        doubtful = (p.argmax(axis=1) != labels) & (p.max(axis=1) > 0.6)
        keep = ~held & ~doubtful
    check = np.flatnonzero(held & ~doubtful)
    model.temperature = calibrate(model.logits([rows[i] for i in check]), labels[check])
    return model


def hash_of(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode("utf-8", "replace"))


def fit_table(df: DataFrame, text: str, label: str) -> LanguageModel:
    """Fit on about SAMPLE texts of each label, the first SAMPLE_CHARS characters of each."""
    code = F.lower(F.regexp_extract(F.trim(F.col(label)), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))
    rows = df.select(F.substring(F.col(text), 1, SAMPLE_CHARS).alias("t"), code.alias("lang")).where(F.col("t").isNotNull() & F.col("lang").isin(*LANGUAGES))
    return fit({k: [r.t for r in kept] for k, kept in bounded_sample(rows, ["t"], SAMPLE, "lang").items()})


def label_segments(spark: SparkSession, df: DataFrame, keep: list[str], text: str, model: LanguageModel) -> DataFrame:
    """``keep`` columns, ``segment``, ``lang``, ``confidence``: every segment of every text of ``df``, in order.

    NULL and blank texts, and texts without a letter, give no row. Texts of any
    length are read whole; repeated rows give repeated segments.
    """
    shared = spark.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                split = [sentences(t) if t and any(map(str.isalpha, t)) else [] for t in batch.column("text").to_pylist()]
                chances = m.chances([s for parts in split for s in parts])
                owner, out, first = [], [], 0
                for i, parts in enumerate(split):
                    found = m.grouped(parts, chances[first : first + len(parts)])
                    first += len(parts)
                    owner += [i] * len(found)
                    out += found
                at_rows = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n).take(at_rows) for n in names], *[pa.array([o[k] for o in out], kind) for k, kind in ((0, pa.string()), (1, pa.string()), (2, pa.float64()))]],
                    [*names, "segment", "lang", "confidence"],
                )

    schema = source.select(*names).schema.add("segment", "string").add("lang", "string").add("confidence", "double")
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "segment", "lang", "confidence")
