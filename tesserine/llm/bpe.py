"""Encoding with a byte-level BPE vocabulary by a tokenization automaton.

The merges are compiled, one gadget per merge in order of priority, into the
deterministic automaton that accepts exactly the token sequences the merges
produce. Its states are the tokens last read. A gadget for a merge (u, v) -> w
takes the arc v away from the state behind u, gives every state that has the
path u, v an arc w, and lets w lead to the state v led to at that time. A state
therefore differs from the one it was copied from only by the arcs taken away
since, and the table holds those differences; the rest is reached through the
state's origin. Words are encoded by running over their bytes, transition by transition of a
table that is filled in from these differences as states are met: for each prefix
exactly one token is both its suffix and a legal arc from the state before it.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splits a text into words before the merges apply (the public pattern of this vocabulary family).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded words a worker remembers; when full it starts afresh.
REMEMBERED = 1 << 18
#: Entries of the transition table that a worker fills in as it meets them; when full it starts afresh.
TRANSITIONS = 1 << 20
#: Longest word that is remembered; longer ones are encoded each time.
REMEMBERED_CHARS = 64


@functools.cache
def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + i)] = b
    return table


class TokenAutomaton:
    """The compiled automaton of a vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        import regex

        symbols = byte_symbols()
        self.split = regex.compile(PATTERN).findall
        self.byte_id = [0] * 256
        for symbol, byte in symbols.items():
            self.byte_id[byte] = vocab[symbol]
        self.label = {vocab[s]: bytes([b]) for s, b in symbols.items()}
        self.born: dict[int, int] = dict.fromkeys(self.label, -1)
        self.left: dict[int, int] = {}
        self.origin: dict[int, int] = {}
        self.taken: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self._gadget(rank, u, v, w)
        self.by_label = {label: t for t, label in self.label.items()}
        self.longest = max(map(len, self.by_label))
        lengths: dict[int, set[int]] = {}
        for label in self.by_label:
            lengths.setdefault(label[-1], set()).add(len(label))
        #: Token lengths by last byte, longest first: the suffixes worth trying.
        self.lengths = [sorted(lengths.get(b, {1}), reverse=True) for b in range(256)]
        self.words: dict[str, list[int]] = {}
        #: The transitions met so far: state and arc to whether it exists.
        self.arcs: dict[int, bool] = {}

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if w in self.born or u not in self.born or v not in self.born or not self.has_arc(u, v, rank):
            return
        self.label[w] = self.label[u] + self.label[v]
        self.taken[(u << 32) | v] = rank
        self.born[w], self.left[w], self.origin[w] = rank, u, v

    def has_arc(self, state: int, arc: int, now: int) -> bool:
        """Whether, after the gadgets before ``now``, the state behind token ``state`` has an arc ``arc``."""
        while True:
            if self.taken.get((state << 32) | arc, now) < now:
                return False
            s, a = self.born[state], self.born[arc]
            if s < 0 and a < 0:
                return True
            if a >= s:  # the arc came with its gadget, to states that had the arc of its left part
                arc, now = self.left[arc], a + 1
            else:  # the state is a copy of the one its right part led to
                state, now = self.origin[state], s

    def encode_word(self, data: bytes) -> list[int]:
        """Run over the bytes; ``last[i]`` is the state after the first i bytes."""
        whole = self.by_label.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        by_label, arcs, lengths = self.by_label, self.arcs, self.lengths
        for i in range(1, n + 1):
            for k in lengths[data[i - 1]]:
                if k > i:
                    continue
                token = by_label.get(data[i - k : i])
                if token is None:
                    continue
                before = last[i - k]
                if before < 0 and i != k:
                    continue
                if before < 0:
                    last[i], start[i] = token, i - k
                    break
                arc = arcs.get(before << 32 | token)
                if arc is None:
                    if len(arcs) >= TRANSITIONS:
                        arcs.clear()
                    arc = arcs[before << 32 | token] = self.has_arc(before, token, 1 << 40)
                if arc:
                    last[i], start[i] = token, i - k
                    break
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; NULL and the empty text have none."""
        if not text:
            return []
        out: list[int] = []
        words = self.words
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                ids = self.encode_word(word.encode("utf-8", "surrogatepass"))
                if len(word) <= REMEMBERED_CHARS:
                    if len(words) >= REMEMBERED:
                        words.clear()
                    words[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        """The text whose bytes the arcs' labels spell; bytes that are no UTF-8 become U+FFFD."""
        return None if ids is None else b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def _compiled(spec: bytes) -> TokenAutomaton:
    vocab, merges = json.loads(spec)
    return TokenAutomaton(vocab, [tuple(m) for m in merges])


def load_spec(path: str) -> bytes:
    """The vocabulary and merges of a tokenizer file, without anything else."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return json.dumps([model["vocab"], merges]).encode()


def encode_rows(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids): the token ids of every row's text, as ``array<int>``.

    NULL, like the empty text, has the defined ids ``[]``. Special tokens' strings
    are ordinary text. Texts of any length are encoded whole; repeated keys give
    repeated rows. The vocabulary, of a fixed few megabytes, is broadcast; ``path``
    is read on the driver only.
    """
    spec = df.sparkSession.sparkContext.broadcast(load_spec(path))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _compiled(spec.value)
        for batch in batches:
            ids = [automaton.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).select(F.col("key").alias(key), "ids")


def decode_rows(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """(key, text): the inverse of ``encode_rows``; NULL ids give NULL."""
    spec = df.sparkSession.sparkContext.broadcast(load_spec(path))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _compiled(spec.value)
        for batch in batches:
            texts = [automaton.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("text", T.StringType())])
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, schema).select(F.col("key").alias(key), "text")
