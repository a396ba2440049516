"""Records of evaluation splits that recur in the training split.

The evaluation texts are normalised and split into shards of bounded size. For
each shard an Aho-Corasick automaton of all its passages - runs of words, each
word as a few characters of its hash - is compiled once and stored; it scans all
training texts; of many shards, each scans those training texts that a prefix join
finds candidates for in it. Passages are numbered rarest first, so the matches of a training
text show which evaluation texts may be similar to it; sizes, sketches and at last
the shingles themselves decide. The matched intervals of an evaluation record,
from all training texts, merge into the part of it that they cover.
"""

from __future__ import annotations

import ctypes
import gc
import itertools
import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.neardup import SEEN, _first, _texts, prefix_join
from tesserine.llm.shingles import HASH_BITS, Side, common_shingles, hash_words, mix, sketch_width, sketches, sweep, unique
from tesserine.runtime import new_path, stored

#: Evaluation texts in one shard; its automaton and texts take about 1 KB for each.
BLOCK = 1 << 16
#: Shards up to which each scans all training texts.
DIRECT = 2
#: Training texts that are matched at a time.
HELD = 1 << 12
#: Bits of a word's hash in each of the characters that stand for the word.
CODE_BITS, CODE_CHARS = 6, 3


def coded(word: np.ndarray) -> np.ndarray:
    """CODE_CHARS characters for each word hash; no character occurs in two places, so matches start at words."""
    out = np.empty((len(word), CODE_CHARS), np.uint8)
    for k in range(CODE_CHARS):
        out[:, k] = ((word >> np.uint64(64 - CODE_BITS * (k + 1))) & np.uint64((1 << CODE_BITS) - 1)).astype(np.uint8) + 1 + (k << CODE_BITS)
    return out


def _prefix_lengths(n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of sets of these sizes for the larger and for the smaller set of a pair."""
    return (n - np.ceil(x * n - 1e-9).astype(np.int64) + 1 for x in (similarity, 2 * similarity / (1 + similarity)))


def compile_block(keys: list[bytes], texts: list[str], similarity: float, width: int, sketch_words: int) -> dict:
    """The automaton of a shard of evaluation texts, and what its matches are held against."""
    import ahocorasick

    kept: list[tuple] = []
    for at in range(0, len(texts), 2048):
        hashed = hash_words(texts[at : at + 2048])
        doc, h = hashed.shingles(width)
        code = coded(hashed.word)
        start = np.arange(max(len(hashed.word) - width + 1, 0))
        start = start[hashed.doc[start] == hashed.doc[start + width - 1]]
        name = np.zeros(len(start), np.uint64)
        for k in range(width):
            for c in range(CODE_CHARS):
                name = mix(name + code[start + k, c])
        n = len(hashed.n_words)
        kept.append((
            np.bincount(doc, minlength=n), hashed.n_words, sketches(doc, h, n, sketch_words), np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]),
            name, (hashed.doc[start] + at).astype(np.int32), code, start + sum(len(x[6]) for x in kept),
        ))
    size, n_words, sketch, packed, name, owner, code, start = (np.concatenate([x[k] for x in kept]) for k in range(8))
    del kept
    names = unique(name)
    passage = np.searchsorted(names, name).astype(np.int32)
    del name
    one = np.empty(len(names), np.int64)
    one[passage] = start
    del start
    number = np.empty(len(names), np.int32)
    number[np.argsort(np.bincount(passage, minlength=len(names)), kind="stable")] = np.arange(len(names))
    passage = number[passage]
    entry = unique(owner.astype(np.int64) << 32 | passage)
    holder, p = (entry >> 32).astype(np.int32), entry.astype(np.int32)
    del entry, owner
    held = np.bincount(holder, minlength=len(texts))
    rank = np.arange(len(holder)) - (np.cumsum(held) - held)[holder]
    full, short = _prefix_lengths(size, similarity)
    at = np.flatnonzero(rank < full[holder])
    is_short = rank[at] < short[holder[at]]
    del rank
    holder, p = holder[at], p[at]
    order = np.argsort(p.astype(np.int64) << 32 | size[holder], kind="stable")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    spelt = code.tobytes().decode("latin-1")
    for k, at in zip(number.tolist(), (one * CODE_CHARS).tolist()):
        automaton.add_word(spelt[at : at + width * CODE_CHARS], k)
    if len(names):
        automaton.make_automaton()
    del code, spelt
    return {
        "keys": keys, "automaton": automaton, "size": size.astype(np.int32), "n_words": n_words.astype(np.int32), "sketch": sketch, "shingles": packed, "runs": passage,
        "holder": holder[order], "token": p[order], "is_short": is_short[order],
    }


class Passages:
    """A compiled shard: scans training texts for its passages."""

    def __init__(self, block: dict, similarity: float, width: int):
        self.similarity, self.width = similarity, width
        self.automaton, self.keys, self.n_words, self.runs = (block[c] for c in ("automaton", "keys", "n_words", "runs"))
        self.size, self.holder, self.token = (block[c].astype(np.int64) for c in ("size", "holder", "token"))
        self.side = Side(self.size, block["sketch"], similarity)
        wide = np.zeros((len(block["shingles"]), 8), np.uint8)
        wide[:, :6] = block["shingles"]
        self.shingles = wide.view("<u8").ravel()
        self.run_count = np.maximum(self.n_words - width + 1, 0)
        self.is_short = block["is_short"]
        self.order = self.token << 32 | self.size[self.holder]

    def matches(self, hashed, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hit, fresh): the passages that each text contains, as text << 32 | passage, sorted; and each text's number of shingles that are none."""
        spelt = coded(hashed.word).tobytes().decode("latin-1")
        if not len(self.size) or not len(self.token):
            found = np.empty((0, 2), np.int64)
        else:
            found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(spelt)), np.int64).reshape(-1, 2)
        last = found[:, 0] // CODE_CHARS
        first = last - self.width + 1
        ok = hashed.doc[last] == hashed.doc[first]  # no passage reaches from one text into the next
        first, passage = first[ok], found[ok, 1]
        inside = hashed.doc[: max(len(hashed.word) - self.width + 1, 0)] == hashed.doc[self.width - 1 :]
        run_doc, run_hash = hashed.all_shingles(self.width)
        at = (np.cumsum(inside) - 1)[first]
        n_docs = len(hashed.n_words)
        known = unique(run_doc[at].astype(np.uint64) << np.uint64(HASH_BITS) | run_hash[at])
        known = np.bincount((known >> np.uint64(HASH_BITS)).astype(np.int64), minlength=n_docs)
        return unique(hashed.doc[first] << 32 | passage), np.bincount(doc, minlength=n_docs) - known

    def similar(self, texts: list[str], sketch_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, similarity, hits): training text i and evaluation text j that reach the similarity, and the matches of all texts."""
        hashed = hash_words(texts)
        doc, h = hashed.shingles(self.width)
        size = np.bincount(doc, minlength=len(texts))
        side = Side(size, sketches(doc, h, len(texts), sketch_words), self.similarity)
        hit, fresh = self.matches(hashed, doc, h)
        of, p = hit >> 32, hit & 0xFFFFFFFF
        each = np.bincount(of, minlength=len(texts))
        rank = np.arange(len(of)) - (np.cumsum(each) - each)[of] + fresh[of]  # shingles of no evaluation text come first
        full, short = (x[of] for x in _prefix_lengths(size, self.similarity))
        at = np.flatnonzero(rank < full)
        key = p[at] << 32 | size[of[at]]
        order = np.argsort(key)
        at, key = at[order], key[order]
        owner, is_short = of[at], (rank < short)[at]
        pairs = [np.empty(0, np.int64)]
        # the smaller set's short prefix against the larger one's full prefix, once for either being the smaller
        left = np.flatnonzero(is_short)
        low, high = (np.searchsorted(self.order, x, side) for x, side in ((key[left], "left"), (self._most(key[left]), "right")))
        for i, j in sweep(side, self.side, owner[left], low, high, np.flatnonzero(_first(key[left] >> 32)), self.holder):
            pairs.append(unique(i << 32 | j))
        there = np.zeros(int(max(self.token.max(initial=0), p.max(initial=0))) + 1, bool)
        there[p[at]] = True
        left = np.flatnonzero(self.is_short & there[self.token]) if len(self.token) else np.empty(0, np.int64)
        low, high = (np.searchsorted(key, x, "right") for x in (self.order[left], self._most(self.order[left])))
        for j, i in sweep(self.side, side, self.holder[left], low, high, np.flatnonzero(_first(self.token[left])), owner):
            pairs.append(unique(i << 32 | j))
        pair = unique(np.concatenate(pairs))
        i, j = pair >> 32, pair & 0xFFFFFFFF
        shared = common_shingles(h, self.shingles, i, j, size, self.size)
        value = shared / np.maximum(size[i] + self.size[j] - shared, 1)
        ok = value >= self.similarity - 1e-9
        return i[ok], j[ok], value[ok], hit

    def _most(self, key: np.ndarray) -> np.ndarray:
        """The keys of the same passages with the largest size that a set may have beside the given ones."""
        return (key >> 32 << 32) | np.minimum(np.floor((key & 0xFFFFFFFF) / self.similarity + 1e-9).astype(np.int64), (1 << 32) - 1)

    def intervals(self, i: np.ndarray, j: np.ndarray, hit: np.ndarray) -> list[list[list[int]]]:
        """For each pair the words of the evaluation text, from and to, that matched passages cover; overlapping ones are merged."""
        first = np.cumsum(self.run_count) - self.run_count
        out = []
        for a, b in zip(i.tolist(), j.tolist()):
            runs = self.runs[first[b] : first[b] + self.run_count[b]]
            wanted = a << 32 | runs.astype(np.int64)
            where = np.minimum(np.searchsorted(hit, wanted), len(hit) - 1)
            at = np.flatnonzero(hit[where] == wanted)
            cut = np.flatnonzero(np.diff(at) > self.width)
            lows, highs = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + self.width
            out.append(np.stack([lows, highs], axis=1).tolist())
        return out


def _release() -> None:
    """Give freed memory back to the system; the worker lives on, idle."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _file_system(uri: str):
    """(file system, path) of a place in the shared folder, for tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _qualified(spark, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it to be on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString().replace("file:/", "file:///", 1).replace("file://///", "file:///")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key): the rows that can match; ``key`` is a digest of the text."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.withColumn("key", F.unhex(F.md5("text"))).withColumn("cls", F.xxhash64("text"))


def _matches(train: DataFrame, evaluation: DataFrame, similarity: float, width: int) -> DataFrame:
    """(train_key, eval_key, similarity, n_words, cover) of all pairs of different texts, from rows of ``_rows``."""
    spark = train.sparkSession
    classes = stored(evaluation.select("cls", "key", "text").distinct(), "evaluation")
    n, words = classes.agg(F.count("*"), F.avg(F.size(F.split("text", " ")))).first()
    blocks = max(1, math.ceil(n / BLOCK))
    sketch_words = sketch_width(words or 1)
    shard = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    routed = None
    if blocks > DIRECT:
        sides = [rows.withColumn("part", F.lit("")) for rows in (train, classes)]
        candidates = stored(prefix_join(sides, similarity, width), "candidates")
        classes = stored(classes.join(candidates.select(F.col("cls_b").alias("cls")).distinct(), "cls", "left_semi"), "evaluation")
        blocks = max(1, math.ceil(classes.count() / BLOCK))
        shard = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
        routed = candidates.join(classes.select(F.col("cls").alias("cls_b"), shard.alias("block")), "cls_b").select(F.col("cls_a").alias("cls"), "block").distinct()

    root = _qualified(spark, new_path(spark, "shards"))

    def compile_one(t: pa.Table) -> pa.Table:
        """Compile a shard into a file of its own; that of an attempt which fails is never read."""
        made = compile_block(t.column("key").to_pylist(), t.column("text").to_pylist(), similarity, width, sketch_words)
        where, path = _file_system(root)
        where.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        with where.open_output_stream(f"{path}/{name}") as out:
            pickle.dump(made, out, protocol=5)
        del made
        _release()
        return pa.table({"block": t.column("block").slice(0, 1).cast(pa.int32()), "name": pa.array([name])})

    numbered = classes.select("key", "text", shard.alias("block"))
    names = {r.block: r.name for r in numbered.groupBy("block").applyInArrow(compile_one, "block int, name string").collect()}  # one short name for BLOCK texts
    shards = sorted(names.values())

    def load(name: str) -> Passages:
        where, path = _file_system(root)
        with where.open_input_stream(f"{path}/{name}") as f:
            return Passages(pickle.load(f), similarity, width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        keys: list[bytes] = []
        texts: list[str] = []
        loaded: dict[str, Passages] = {}  # one at a time
        for some, more in _texts(batches, ("key", "text")):
            for k, t in zip(some, more):
                if k not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(k)
                    keys.append(k)
                    texts.append(t)
            if len(texts) >= HELD:
                yield from against_shards(keys, texts, loaded)
                keys, texts = [], []
        if texts:
            yield from against_shards(keys, texts, loaded)
        loaded.clear()
        _release()

    def scan_routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard against its own training texts, which come shard by shard."""
        loaded: dict[str, Passages] = {}
        block, keys, texts = None, [], []
        for own, some, more in _texts(batches, ("block", "key", "text")):
            for x, k, t in zip(own, some, more):
                if texts and (x != block or len(texts) >= HELD):
                    yield from against_shards(keys, texts, loaded, [names[block]])
                    keys, texts = [], []
                block = x
                keys.append(k)
                texts.append(t)
        if texts:
            yield from against_shards(keys, texts, loaded, [names[block]])
        loaded.clear()
        _release()

    def against_shards(keys: list[bytes], texts: list[str], loaded: dict, shards: list[str] = shards) -> Iterator[pa.RecordBatch]:
        for name in shards:
            if name not in loaded:
                loaded.clear()
                loaded[name] = load(name)
            shard = loaded[name]
            i, j, value, hit = shard.similar(texts, sketch_words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[k] for k in i.tolist()], pa.binary()), pa.array([shard.keys[k] for k in j.tolist()], pa.binary()), pa.array(value, pa.float64()),
                    pa.array(shard.n_words[j], pa.int32()), pa.array(shard.intervals(i, j, hit), pa.list_(pa.list_(pa.int32()))),
                ],
                ["train_key", "eval_key", "similarity", "n_words", "cover"],
            )

    schema = "train_key binary, eval_key binary, similarity double, n_words int, cover array<array<int>>"
    if routed is None:
        found = train.select("key", "text").mapInArrow(scan, schema)
    else:
        # as many tasks as shards, and at least enough to be busy; a task loads a shard once
        each = math.ceil(4 * spark.sparkContext.defaultParallelism / blocks)
        rows = train.select("cls", "key", "text").distinct().join(routed, "cls")
        rows = rows.repartition(blocks * each, "block", F.pmod(F.xxhash64("key"), F.lit(each))).sortWithinPartitions("block")
        found = rows.select("block", "key", "text").mapInArrow(scan_routed, schema)
    return stored(found.distinct(), "overlaps")


def split_overlaps(train: DataFrame, evaluation: DataFrame, id_col: str, text_col: str, *, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(train_id, eval_id, similarity) of all training and evaluation rows whose texts reach the similarity.

    The similarity is that of the sets of word shingles. NULL ids and texts, and
    texts shorter than a shingle, match nothing; repeated rows count once; equal
    texts are scanned once a task and expanded at the end. Exact. Cost: up to DIRECT
    shards of BLOCK evaluation texts, training texts times shards; beyond, the prefix
    join and the candidates that it finds. A task holds one shard and HELD training
    texts at a time.
    """
    t, e = _rows(train, id_col, text_col), _rows(evaluation, id_col, text_col)
    return _expanded(_matches(t, e, similarity, width), t, e).select("train_id", "eval_id", "similarity")


def _expanded(found: DataFrame, train: DataFrame, evaluation: DataFrame) -> DataFrame:
    for rows, side in ((train, "train"), (evaluation, "eval")):
        ids = rows.select(F.col("id").alias(f"{side}_id"), F.col("key").alias(f"{side}_key"))
        found = found.join(ids.join(found.select(f"{side}_key").distinct(), f"{side}_key", "left_semi").distinct(), f"{side}_key")
    return found


def overlap_coverage(train: DataFrame, evaluation: DataFrame, id_col: str, text_col: str, *, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(eval_id, partners, coverage) of every evaluation row with an overlap: the training rows it overlaps with, and the share of its words in passages that these hold.

    The matched intervals of all training texts are merged, each once; cases are
    defined as in ``split_overlaps``.
    """
    t, e = _rows(train, id_col, text_col), _rows(evaluation, id_col, text_col)
    found = _matches(t, e, similarity, width)
    spans = found.select("eval_key", "n_words", F.explode("cover").alias("x")).select("eval_key", "n_words", F.col("x")[0].alias("lo"), F.col("x")[1].alias("hi")).distinct()
    words = spans.select("eval_key", "n_words", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("w")).distinct()
    covered = words.groupBy("eval_key", "n_words").agg(F.count("*").alias("c")).select("eval_key", (F.col("c") / F.col("n_words")).alias("coverage"))
    partners = _expanded(found.select("train_key", "eval_key"), t, e).groupBy("eval_id", "eval_key").agg(F.count("*").alias("partners"))
    return partners.join(covered, "eval_key").groupBy("eval_id").agg(F.sum("partners").alias("partners"), F.max("coverage").alias("coverage"))


def key_overlaps(train: DataFrame, evaluation: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """(train_id, eval_id) of all training and evaluation rows whose keys agree without regard to letter case and surrounding blanks; NULL and blank keys agree with none."""
    key = F.lower(F.regexp_replace(F.col(key_col).cast("string"), r"(?U)^\s+|\s+$", ""))
    sides = [d.select(F.col(id_col).cast("string").alias(n), key.alias("key")).where("key <> ''").distinct() for d, n in ((train, "train_id"), (evaluation, "eval_id"))]
    return sides[0].join(sides[1], "key").select("train_id", "eval_id").distinct()
