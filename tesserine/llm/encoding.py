"""Texts read with a wrong character encoding: detection and restoration by a hidden Markov model.

The model has one clean state and one state for each pair of a true encoding and
the one the bytes were read with. A state emits a character given the two before
it; the clean state's counts come from all sound texts, those of the others from
the same texts after the state's damage. The best path labels every character,
and each labelled span gets its state's inverse transform.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.llm.sampling import tagged
from tesserine.llm.shingles import unique
from tesserine.llm.visual import plain_look

#: Texts that the counts of each table are scaled down to, so that each weighs alike beside BACKOFF and the others.
WEIGHT = 1_200
#: Scaled count from which on sound texts are said to hold something; what a few damaged texts among many seem to hold stays below it.
HELD = 1.0
#: Logarithm of the chance to enter a damaged state, or to leave one.
SWITCH = -9.0
#: Weight of the shorter context in the emissions.
BACKOFF = 2.0
#: Contexts whose emissions a worker remembers.
REMEMBERED = 1 << 19
#: Characters that are labelled or counted side by side; a longer text is taken alone.
CHARS = 1 << 17


def _read(data: bytes, encoding: str) -> str:
    """Bytes as ``encoding`` shows them; bytes it lacks become the control characters of the same number."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


class Pair:
    """Damage by reading ``true`` bytes as ``read``, ``times`` times over."""

    def __init__(self, true: str, read: str, times: int = 1):
        self.true, self.read, self.times = true, read, times
        self.name = f"{true}>{read}" + f"*{times}" * (times > 1)
        self.lossy = read in ("utf-8", "ascii")
        shown = None if self.lossy else [_read(bytes([b]), read) for b in range(256)]
        self.shown = shown and dict(enumerate(shown))
        self.byte = shown and {c: b for b, c in reversed(list(enumerate(shown)))}

    def damage(self, text: str) -> str:
        for _ in range(self.times):
            if self.read == "ascii":
                text = text.encode("ascii", "replace").decode()
            elif self.lossy:
                text = text.encode(self.true, "ignore").decode("utf-8", "replace")
            else:
                text = text.encode(self.true, "ignore").decode("latin-1").translate(self.shown)
        return text

    def restore(self, span: str) -> str | None:
        """The original of a damaged span, or None where it is lost."""
        if self.lossy:
            return None
        for _ in range(self.times):
            try:
                span = bytes(self.byte[c] for c in span).decode(self.true)
            except (KeyError, UnicodeDecodeError):
                return None
        return span


# The pairs of encodings that the states stand for.
PAIRS = [
    Pair("utf-8", "latin-1"), Pair("utf-8", "cp1252"), Pair("utf-8", "mac_roman"), Pair("utf-8", "cp437"), Pair("utf-8", "cp850"),
    Pair("utf-8", "cp1252", 2), Pair("utf-8", "latin-1", 2), Pair("utf-8", "cp1256"), Pair("cp1256", "cp1252"), Pair("iso8859_6", "latin-1"),
    Pair("cp1252", "utf-8"), Pair("cp1256", "utf-8"), Pair("utf-8", "ascii"),
]
_DOUBTFUL = re.compile("[\x80-\x9f�]|\\?\\?|\\w\\?\\w|\\? [a-zà-ÿ]|(?:^|\\s)\\?\\w")
# Signs that sound texts may hold though the counted ones lack them.
TYPOGRAPHIC = frozenset("«»“”‘’„‚–—…•·€£¥§©®™°±×÷½¼¾¹²³µªº¿¡")
#: A question mark that ends no question.
_LOST = re.compile(r"\w\?\w|\?\?|\?\s+[a-zà-ÿ]|(?:^|[\s(«])\?\w")
_RUN = re.compile("[^\x00-\x7f]{2,}")
_HIGH = re.compile("[\xa0-\xff]")
_ARABIC = re.compile("[\u0600-\u06ff]+")


def looks_sound(text: str) -> bool:
    """A strict test for the counted texts only: no run of the text could be damaged UTF-8 or a damaged one-byte script."""
    if text.isascii():
        return "?" not in text or not _DOUBTFUL.search(text)
    if _DOUBTFUL.search(text):
        return False
    high = sum(map(str.isalpha, _HIGH.findall(text)))
    if high and high > 0.25 * sum(map(str.isalpha, text)):
        return False
    return all(map(_sound_run, _RUN.findall(text)))


@functools.lru_cache(1 << 16)
def _sound_run(run: str) -> bool:
    if _ARABIC.fullmatch(run):
        return True
    for pair in PAIRS:
        if pair.true == "utf-8" and not pair.lossy and pair.times == 1:
            for i in range(len(run) - 1):
                if pair.restore(run[i : i + 2]) is not None:
                    return False
    return True


# A trigram is a number: three times 21 bits.
_LOW, _LOW2 = (1 << 21) - 1, (1 << 42) - 1
#: Pairs whose damage drops characters or hangs on their neighbours: counted on the damaged texts, the others follow from the trigrams of the sound ones.
_COUNTED = [k for k, p in enumerate(PAIRS) if p.true != "utf-8"]

Table = tuple[np.ndarray, np.ndarray]


def _summed(keys: np.ndarray, counts: np.ndarray) -> Table:
    """The distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _value(table: Table, keys: np.ndarray) -> np.ndarray:
    """The counts of keys, 0 for those that are not in the table."""
    held, counts = table
    if not len(held):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return np.where(held[at] == keys, counts[at], 0)


def _trigrams(texts: list[str], damage: Callable[[str], str] | None) -> np.ndarray:
    """The sorted trigrams of texts between line feeds, after a damage."""
    between = next((c for c in map(chr, range(128)) if not any(c in t for t in texts)), None) if len(texts) > 1 else ""
    if between is None:
        half = len(texts) // 2
        return np.sort(np.concatenate([_trigrams(texts[:half], damage), _trigrams(texts[half:], damage)]))
    joined = between.join([f"\n\n{t}\n" for t in texts])
    chars = np.frombuffer((damage(joined) if damage else joined).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    grams = chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]
    if between:
        own = chars != ord(between)
        grams = grams[own[:-2] & own[1:-1] & own[2:]]
    return np.sort(grams)


class TrigramCounts:
    """Trigrams of sound texts: of those in ASCII, which no pair damages; of the others; and of these after the damage of each pair in _COUNTED."""

    STREAMS = 2 + len(_COUNTED)

    def __init__(self):
        self.parts: list[list[Table]] = [[] for _ in range(self.STREAMS)]
        self.size = [0] * self.STREAMS

    def add(self, texts: list[str]) -> None:
        some: list[str] = []
        size = 0
        for t in texts:
            if looks_sound(t):
                some.append(t)
                size += len(t)
                if size >= CHARS:
                    self._add(some)
                    some, size = [], 0
        self._add(some)

    def _add(self, texts: list[str]) -> None:
        plain = [t for t in texts if t.isascii()]
        other = [t for t in texts if not t.isascii()]
        for k, (some, damage) in enumerate([(plain, None), (other, None), *((other, PAIRS[p].damage) for p in _COUNTED)]):
            if some:
                grams = _trigrams(some, damage)
                at = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
                self.parts[k].append((grams[at], np.diff(np.append(at, len(grams)))))
                self.size[k] += len(at)
                if self.size[k] > 1 << 20 and len(self.parts[k]) > 1:
                    merged = self.tables([k])[0]
                    self.parts[k] = [merged]
                    self.size[k] = 0

    def tables(self, streams: list[int] | None = None) -> list[Table]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return [_summed(*(np.concatenate(x) for x in zip(*(self.parts[k] or [none])))) for k in streams or range(self.STREAMS)]


def _after(table: Table, pair: Pair) -> Table:
    """The trigrams after a damage that turns each character into one or more, whatever stands beside it."""
    grams, counts = table
    chars = np.unique(np.concatenate([grams >> 42, grams >> 21 & _LOW, grams & _LOW]))
    turned = [[ord(c) for c in pair.damage(chr(c))] for c in chars.tolist()]
    size = np.array([len(t) for t in turned], np.int64)
    most = int(size.max(initial=1))
    into = np.array([t + [0] * (most - len(t)) for t in turned], np.int64).reshape(-1, most)
    a, b, c = (np.searchsorted(chars, x) for x in (grams >> 42, grams >> 21 & _LOW, grams & _LOW))
    last = into[b, size[b] - 1]
    second = np.where(size[b] > 1, into[b, size[b] - 2], into[a, size[a] - 1])
    keys, values = [], []
    for k in range(most):
        on = size[c] > k
        keys.append((second << 42 | last << 21 | into[c, k])[on])
        values.append(counts[on])
        second, last = last, into[c, k]
    return _summed(np.concatenate(keys), np.concatenate(values))


class State:
    """What a state emits: counts of trigrams, bigrams and characters, and of their contexts."""

    def __init__(self, three: Table):
        keys, counts = three
        self.three = three
        self.two = _summed(keys & _LOW2, counts)
        self.one = _summed(keys & _LOW, counts)
        self.context = _summed(keys >> 21, counts)
        self.before = _summed(self.two[0] >> 21, self.two[1])
        self.total = float(counts.sum())

    def emissions(self, grams: np.ndarray) -> np.ndarray:
        p = (_value(self.one, grams & _LOW) + 1e-2) / (self.total + 1e4)
        p = (_value(self.two, grams & _LOW2) + BACKOFF * p) / (_value(self.before, grams >> 21 & _LOW) + BACKOFF)
        return np.log((_value(self.three, grams) + BACKOFF * p) / (_value(self.context, grams >> 21) + BACKOFF))

    def characters(self, least: float) -> frozenset[str]:
        return frozenset(map(chr, self.one[0][self.one[1] >= least].tolist()))


class EncodingModel:
    """The clean state and those of the pairs; picklable and of a size set by the distinct trigrams."""

    def __init__(self, texts: list[str] = (), tables: list[Table] | None = None):
        if tables is None:
            counts = TrigramCounts()
            counts.add(list(texts))
            tables = counts.tables()
        plain, other, *counted = ((k, np.asarray(n, float)) for k, n in tables)
        damaged = dict(zip(_COUNTED, counted))
        own = [other, *(damaged[k] if k in damaged else _after(other, p) for k, p in enumerate(PAIRS))]
        self.states = [State(_summed(np.concatenate([plain[0], k]), np.concatenate([plain[1], n]))) for k, n in own]
        self.sound = self.states[0].characters(HELD)
        self.made = [s.characters(0.0) for s in self.states[1:]]


class Labeller:
    """Viterbi decoding with a model, many texts side by side; remembers emissions."""

    def __init__(self, model: EncodingModel):
        self.states, self.sound, self.made = model.states, model.sound, model.made
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.emission, self.gain = np.empty((1 << 10, len(self.states))), np.empty(1 << 10)

    def emissions(self, grams: np.ndarray) -> np.ndarray:
        """Log chances of characters after two others, by state; the clean one first."""
        e = np.stack([s.emissions(grams) for s in self.states], axis=1)
        # what sound texts hold speaks for no damage, however common the state makes it
        return np.where((_value(self.states[0].three, grams) >= HELD)[:, None], np.minimum(e, e[:, :1]), e)

    def _places(self, grams: np.ndarray) -> np.ndarray:
        """Where the emissions of each of these distinct numbered trigrams stand."""
        if len(self.place) + len(grams) > REMEMBERED:
            self._forget()
        while len(self.place) + len(grams) > len(self.gain):
            self.emission, self.gain = np.concatenate([self.emission, np.empty_like(self.emission)]), np.concatenate([self.gain, np.empty_like(self.gain)])
        fresh = [g for g in grams.tolist() if g not in self.place]
        if fresh:
            at = len(self.place)
            self.place.update(zip(fresh, range(at, at + len(fresh))))
            e = self.emission[at : at + len(fresh)] = self.emissions(np.array(fresh, np.int64))
            self.gain[at : at + len(fresh)] = np.maximum(0.0, e[:, 1:].max(axis=1) - e[:, 0])
        return np.fromiter(map(self.place.__getitem__, grams.tolist()), np.int64, len(grams))

    def paths(self, texts: list[str]) -> list[np.ndarray | None]:
        """The best path of each text; None for one that is clean throughout."""
        out: list[np.ndarray | None] = []
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= CHARS:
                out += self._paths(held)
                held, size = [], 0
        return out + self._paths(held)

    def _paths(self, texts: list[str]) -> list[np.ndarray | None]:
        if not texts:
            return []
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        chars = np.frombuffer("".join(f"\n\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        inner = np.ones(len(chars), bool)
        start = np.cumsum(size + 2) - size - 2
        inner[start] = inner[start + 1] = False
        gram = (np.append([0, 0], chars[:-2]) << 42 | np.append([0], chars[:-1]) << 21 | chars)[inner]
        grams = unique(gram)
        place = self._places(grams)[np.searchsorted(grams, gram)]
        first = np.cumsum(size) - size
        # no path through a damaged state can win back what entering it costs unless the gains add up to that
        doubtful = np.flatnonzero(np.add.reduceat(self.gain[place], first) > -SWITCH)
        out: list[np.ndarray | None] = [None] * len(texts)
        doubtful = doubtful[np.argsort(size[doubtful], kind="stable")]
        at = 0
        while at < len(doubtful):
            stop = at + 1
            while stop < len(doubtful) and stop - at < 256 and (stop + 1 - at) * size[doubtful[stop]] <= CHARS:
                stop += 1
            some = doubtful[at:stop]
            for i, path in zip(some.tolist(), self._viterbi(place, first[some], size[some])):
                out[i] = path[:-1] if path[:-1].any() else None
            at = stop
        return out

    def _viterbi(self, place: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The best paths of texts side by side, shortest first."""
        n, steps, states = len(first), int(size.max()), len(self.states)
        own = np.arange(n)
        score = np.full((n, states), SWITCH)
        score[:, 0] = 0.0
        back = np.empty((steps, n, states), np.int8)
        numbers = np.arange(states, dtype=np.int8)
        last = np.zeros(n, np.int64)
        for t in range(steps):
            enter = score[:, :1] + SWITCH
            best = score[:, 1:].argmax(axis=1) + 1
            leave = score[own, best] + SWITCH
            origin = np.where(score >= enter, numbers, 0)
            step = np.maximum(score, enter)
            left = leave > score[:, 0]
            origin[:, 0] = np.where(left, best, 0)
            step[:, 0] = np.where(left, leave, score[:, 0])
            back[t] = origin
            score = step + self.emission[place[np.minimum(first + t, len(place) - 1)]]
            done = size == t + 1
            if done.any():
                last[done] = score[done].argmax(axis=1)
        path = np.zeros((steps, n), np.int8)
        state = np.zeros(n, np.int64)
        for t in range(steps - 1, -1, -1):
            state = np.where(size == t + 1, last, state)
            path[t] = state
            state = back[t, own, state].astype(np.int64)
        return [path[:k, i] for i, k in enumerate(size.tolist())]

    def proven(self, span: str, pair: Pair) -> bool:
        """Whether a labelled span shows its damage: lost characters, a run that turns into sound letters, or one with a character that the damage makes, that sound texts never hold and that is no look-alike."""
        if pair.lossy:
            return "\ufffd" in span or bool(_LOST.search(span))
        sound, made = self.sound, self.made[PAIRS.index(pair)]
        for run in re.findall("[^\x00-\x7f]+", span):
            for part in {run, *(run[i : i + 2] for i in range(len(run) - 1))}:
                fixed = pair.restore(part)
                if len(part) > 1 and fixed and fixed != part and sound.issuperset(fixed):
                    return True
            if any(c not in sound and c in made and (len(run) > 1 or "\x80" <= c <= "\x9f") and c not in TYPOGRAPHIC and plain_look(c) == c and not unicodedata.combining(c) for c in run):
                return True
        return False

    def restore(self, text: str) -> tuple[bool, bool, str, list[str]]:
        """As ``restore_all`` for one text."""
        return self.restore_all([text])[0]

    def restore_all(self, texts: list[str]) -> list[tuple[bool, bool, str, list[str]]]:
        """(damaged, whole, restored text, names of the pairs) of each text: whole if nothing was lost; lost spans stay as they are."""
        return [(False, True, t, []) if p is None else self._undone(t, p.tolist()) for t, p in zip(texts, self.paths(texts))]

    def _undone(self, text: str, path: list[int]) -> tuple[bool, bool, str, list[str]]:
        out, whole, names, at = [], True, [], 0
        while at < len(text):
            end = at
            while end < len(text) and path[end] == path[at]:
                end += 1
            span = text[at:end]
            pair = PAIRS[path[at] - 1] if path[at] else None
            if pair and self.proven(span, pair):
                names.append(pair.name)
                fixed = pair.restore(span)
                if fixed is None and not pair.lossy:  # the span may reach over sound characters: undo its damaged runs
                    fixed = re.sub("[^\x00-\x7f]+", lambda m: pair.restore(m.group()) or m.group(), span)
                    whole &= fixed != span
                whole &= fixed is not None
                span = span if fixed is None else fixed
            out.append(span)
            at = end
        return bool(names), whole, "".join(out), list(dict.fromkeys(names))


def fit(frames: list[DataFrame]) -> EncodingModel:
    """Fit on all sound texts of each frame's only column, each different one once and whole.

    The counts of a frame of more than WEIGHT texts are scaled down to that many.
    Trigrams are counted where the rows are; the driver gets the distinct ones.
    """
    rows = tagged([df.select(F.col(df.columns[0]).alias("t")).where("trim(t) <> ''") for df in frames]).groupBy("t").agg(F.min(F.col("frame").cast("int")).alias("frame"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, TrigramCounts] = {}
        texts: dict[int, int] = {}
        for batch in batches:
            frame = batch.column("frame").to_numpy()
            for f in np.unique(frame).tolist():
                some = batch.column("t").filter(pa.array(frame == f)).to_pylist()
                texts[f] = texts.get(f, 0) + len(some)
                counts.setdefault(f, TrigramCounts()).add(some)
        for f, own in counts.items():
            for k, (grams, n) in [(-1, (np.zeros(1, np.int64), np.array([texts[f]]))), *enumerate(own.tables())]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), f, np.int32)), pa.array(np.full(len(grams), k, np.int32)), pa.array(grams), pa.array(n)], ["frame", "stream", "gram", "n"])

    found = rows.mapInArrow(run, "frame int, stream int, gram bigint, n bigint").groupBy("frame", "stream", "gram").agg(F.sum("n").alias("n")).toArrow()
    frame, stream, gram, n = (found.column(c).to_numpy() for c in ("frame", "stream", "gram", "n"))
    weight = np.zeros(len(n))
    for f, texts in zip(frame[stream < 0].tolist(), n[stream < 0].tolist()):
        weight[frame == f] = min(1.0, WEIGHT / texts)
    return EncodingModel(tables=[_summed(gram[stream == k], (n * weight)[stream == k]) for k in range(TrigramCounts.STREAMS)])


def restore_texts(spark: SparkSession, df: DataFrame, keep: list[str], text: str, model: EncodingModel) -> DataFrame:
    """``keep`` columns with ``damaged``, ``whole``, ``restored`` and ``pairs`` of ``text``.

    NULL and empty texts are undamaged. Where nothing can be restored ``whole`` is
    false and ``restored`` holds the text as it is. One row for each row of ``df``;
    texts of any length are labelled to their end.
    """
    shared = spark.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = [(*r[:2], r[2] if t else t, r[3]) for t, r in zip(texts, labeller.restore_all([t or "" for t in texts]))]
            damaged, whole, restored, pairs = ([r[k] for r in rows] for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(damaged, pa.bool_()), pa.array(whole, pa.bool_()), pa.array(restored, pa.string()), pa.array(pairs, pa.list_(pa.string()))],
                [*names, "damaged", "whole", "restored", "pairs"],
            )

    schema = source.select(*names).schema.add("damaged", "boolean").add("whole", "boolean").add("restored", "string").add("pairs", T.ArrayType(T.StringType()))
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "damaged", "whole", "restored", "pairs")
