"""Passages of test material inside a corpus, by a distributed positional inverted index.

The corpus becomes a stored index of postings: shard by shard of documents, a
sorted list of places for each term. Every run of ``length`` consecutive words of a
test text is a phrase; from the rarest of its terms on, in the whole corpus, their
lists less their offsets in the phrase are intersected inside each shard. What is
left after the last term is an exact match; lists that need only come close give
the proximity matches. Postings are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.llm.shingles import hash_words, mix, unique
from tesserine.runtime import stored

#: Rarest terms of a phrase that a proximity match needs.
ANCHORS = 3
#: Documents of an index shard, and words from which on it takes no more; a longer document is a shard of its own.
DOCS, WORDS = 4096, 1 << 20
#: Test phrases that are looked for at a time; with 12 words each, 20 MB in every task.
PHRASES = 200_000
#: Candidates that are intersected at a time.
CANDIDATES = 1 << 20


class Shard:
    """The postings of some documents: for each term its places, counted through all documents of the shard."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, starts: np.ndarray, places: np.ndarray):
        #: The place of each document's first word and, last, the end; terms; where each one's places begin and, last, end; places.
        self.first, self.terms, self.starts, self.places = first, terms, starts, places
        #: Term number and place of every posting, in order.
        self.postings = np.repeat(np.arange(len(terms)), np.diff(starts)) << 32 | places

    @staticmethod
    def of(texts: list[str]) -> Shard:
        hashed = hash_words(texts)
        order = np.argsort(hashed.word, kind="stable")
        word = hashed.word[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(word)), bool), word[1:] != word[:-1]]))
        return Shard(np.append(0, np.cumsum(hashed.n_words)), word[new], np.append(new, len(word)), order)

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term; -1 for one that does not occur."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def lists(self, numbers: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(k, start): for the k-th term every place less its offset, a bounded number at a time."""
        k = np.flatnonzero(numbers >= 0)
        n = self.starts[numbers[k] + 1] - self.starts[numbers[k]]
        ends, at = np.cumsum(n), 0
        while at < len(k):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, side="right")))
            own, w = k[at:stop], n[at:stop]
            which = np.repeat(own, w)
            place = self.places[np.arange(len(which)) - np.repeat(np.cumsum(w) - w - self.starts[numbers[own]], w)]
            yield which, place - offsets[which]
            at = stop

    def has(self, numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the list of each term has a place from ``low`` to ``high``."""
        base = np.maximum(numbers, 0) << 32
        found = np.searchsorted(self.postings, base | np.maximum(low, 0)) < np.searchsorted(self.postings, base | np.maximum(high, 0), side="right")
        return found & (numbers >= 0) & (high >= 0)

    def documents(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


def build_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """The stored index of ``df``: (docs, first, terms, starts, places), a row for each shard.

    Documents of one key and text are indexed once a task; NULL and empty texts not
    at all. It serves any number of searches.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, size = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                docs.append(d)
                texts.append(t)
                size += len(t)
                if len(docs) >= DOCS or size >= 6 * WORDS:
                    yield row(docs, texts, batch.schema.field("doc").type)
                    docs, texts, size = [], [], 0
            last = batch.schema.field("doc").type
        if docs:
            yield row(docs, texts, last)

    def row(docs: list, texts: list[str], arrow_kind: pa.DataType) -> pa.RecordBatch:
        s = Shard.of(texts)
        parts = [s.first.astype("<u4"), s.terms.astype("<u8"), s.starts.astype("<u4"), s.places.astype("<u4")]
        return pa.RecordBatch.from_arrays([pa.array([docs], pa.list_(arrow_kind)), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], ["docs", "first", "terms", "starts", "places"])

    schema = T.StructType([T.StructField("docs", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in ("first", "terms", "starts", "places")]])
    source = df.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    return stored(source.mapInArrow(run, schema), "index")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Shard]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("docs")[i].values, Shard(*[np.frombuffer(batch.column(c)[i].as_py(), k).astype(to) for c, k, to in (("first", "<u4", np.int64), ("terms", "<u8", np.uint64), ("starts", "<u4", np.int64), ("places", "<u4", np.int64))])


def phrases(tests: DataFrame, key: str, texts: list[str], length: int) -> tuple[DataFrame, DataFrame]:
    """((phrase, words), (phrase, item)): the distinct runs of ``length`` words of the test texts, as hashes, and the items that hold each."""
    kind = tests.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = hash_words(batch.column("text").to_pylist())
            start = np.arange(max(len(hashed.word) - length + 1, 0))
            start = start[hashed.doc[start] == hashed.doc[start + length - 1]]
            runs = np.stack([hashed.word[start + k] for k in range(length)], axis=1) if len(start) else np.empty((0, length), np.uint64)
            name = np.zeros(len(start), np.uint64)
            for k in range(length):
                name = mix(name * np.uint64(0x9E3779B97F4A7C15) + runs[:, k])
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array([r.tobytes() for r in runs], pa.binary()), batch.column("item").take(pa.array(hashed.doc[start]))], ["phrase", "words", "item"])

    each = tests.select(F.col(key).alias("item"), F.explode(F.array(*[F.col(t) for t in texts])).alias("text")).where("text IS NOT NULL").distinct()
    schema = T.StructType([T.StructField("phrase", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("item", kind)])
    runs = stored(each.mapInArrow(run, schema), "phrases")
    return runs.select("phrase", "words").distinct(), runs.select("phrase", "item").distinct()


def _blocks(wanted: DataFrame, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, words) of the test set, PHRASES at a time."""
    wanted = stored(wanted, "wanted")
    n = -(-wanted.count() // PHRASES)
    for k in range(n):
        rows = wanted.where(F.pmod("phrase", F.lit(n)) == k).collect()
        if rows:
            yield np.array([r.phrase for r in rows], np.int64), np.frombuffer(b"".join(bytes(r.words) for r in rows), "<u8").reshape(-1, length)


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of these terms (hashes, sorted) occurs in the whole corpus."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for _, shard in _shards(batches):
            at = shard.numbers(shared.value)
            total += np.where(at >= 0, shard.starts[np.maximum(at, 0) + 1] - shard.starts[np.maximum(at, 0)], 0) if len(shard.terms) else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in index.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each term of a block at most
        out[r["at"]] = r.n
    return out


def rarest_first(index: DataFrame, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, offsets) of each phrase, rarest term first; ties by offset."""
    terms = unique(words.ravel())
    n = term_counts(index, terms)[np.searchsorted(terms, words)]
    order = np.argsort(n, axis=1, kind="stable")
    return np.take_along_axis(words, order, axis=1), order


def _search(index: DataFrame, key: T.DataType, tests: DataFrame, test_key: str, texts: list[str], length: int, match) -> DataFrame:
    """(doc, item, phrases): the documents in which ``match(shard, terms, offsets)`` finds phrases of an item, and how many."""
    wanted, items = phrases(tests, test_key, texts, length)
    schema = T.StructType([T.StructField("doc", key), T.StructField("phrase", T.LongType())])
    found = None
    for names, words in _blocks(wanted, length):
        terms, offsets = rarest_first(index, words)
        shared = index.sparkSession.sparkContext.broadcast((names, terms, offsets))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, terms, offsets = shared.value
            for docs, shard in _shards(batches):
                hit = [unique(shard.documents(place) << 32 | k) for k, place in match(shard, shard.numbers(terms), offsets) if len(k)]
                hit = unique(np.concatenate(hit)) if hit else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(hit >> 32)), pa.array(names[hit & 0xFFFFFFFF])], ["doc", "phrase"])

        part = index.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.sparkSession.createDataFrame([], schema)
    return found.distinct().join(items, "phrase").groupBy("doc", "item").agg(F.count("*").alias("phrases"))


def exact_matches(shard: Shard, numbers: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, place): where phrase k stands, by intersecting the lists of its terms from the rarest on."""
    usable = np.flatnonzero((numbers >= 0).all(axis=1))
    numbers, offsets = numbers[usable], offsets[usable]
    for k, start in shard.lists(numbers[:, 0], offsets[:, 0]):
        for rank in range(1, numbers.shape[1]):
            at = start + offsets[k, rank]
            ok = shard.has(numbers[k, rank], at, at)
            k, start = k[ok], start[ok]
        ok = start >= 0
        k, start = k[ok], start[ok]
        ok = shard.documents(start) == shard.documents(start + numbers.shape[1] - 1)  # within one document
        yield usable[k[ok]], start[ok]


def near_matches(slop: int):
    """Matches of the ANCHORS rarest terms whose lists, less their offsets, come within ``slop`` of that of the rarest one, in one document."""

    def match(shard: Shard, numbers: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        few = min(ANCHORS, numbers.shape[1])
        usable = np.flatnonzero((numbers[:, :few] >= 0).all(axis=1))
        numbers, offsets = numbers[usable], offsets[usable]
        for k, start in shard.lists(numbers[:, 0], offsets[:, 0]):
            place = start + offsets[k, 0]
            doc = shard.documents(place)
            for rank in range(1, few):
                at = start + offsets[k, rank]
                ok = shard.has(numbers[k, rank], np.maximum(at - slop, shard.first[doc]), np.minimum(at + slop, shard.first[doc + 1] - 1))
                k, start, place, doc = k[ok], start[ok], place[ok], doc[ok]
            yield usable[k], place

    return match


def find_phrases(corpus: DataFrame, key: str, text: str, tests: DataFrame, test_key: str, test_texts: list[str], length: int = 12, index: DataFrame | None = None) -> DataFrame:
    """(doc, item): corpus documents with at least ``length`` consecutive words of a text of a test item.

    Case, punctuation and white space do not matter. NULL, empty and shorter texts
    match nothing; repeated rows count once; documents of any length are indexed
    whole, and all terms of a phrase are intersected. ``index`` saves building one.
    """
    index = build_index(corpus, key, text) if index is None else index
    return _search(index, corpus.schema[key].dataType, tests, test_key, test_texts, length, exact_matches).select("doc", "item")


def near_phrases(corpus: DataFrame, key: str, text: str, tests: DataFrame, test_key: str, test_texts: list[str], length: int = 12, slop: int = 12, index: DataFrame | None = None) -> DataFrame:
    """(doc, item, phrases): documents in which the ANCHORS rarest terms of test phrases stand within ``slop`` words of their places beside the rarest, in any order.

    The looser companion of ``find_phrases``; the same cases are defined alike, but
    that repeated rows count in how rare a term is.
    """
    index = build_index(corpus, key, text) if index is None else index
    return _search(index, corpus.schema[key].dataType, tests, test_key, test_texts, length, near_matches(slop))
