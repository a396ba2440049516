"""Near-duplicate texts by a grouped prefix join.

Every text is the set of its word shingles, ordered rarest first by counts over
the whole corpus. Two sets reach a Jaccard similarity only if they share a
shingle of their prefixes, so documents are joined on the shingles of their
prefixes. Documents of identical prefix and size collapse into one group, which
stands in the join once. Pairs of groups are filtered by size and shingle, then
expanded to their members, which a lower bound of the symmetric difference
filters; members of one group are held against each other in the same way. The
texts of every pair that is left are compared exactly.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.shingles import PAIRS_AT_A_TIME, Side, close, hash_words, jaccard_pairs, mix, sketch_width, sketches, sweep, table_pairs, unique
from tesserine.runtime import stored

#: Counters of the corpus-wide shingle counts; as rarities, of one byte each, they are broadcast (256 KB).
COUNTERS = 1 << 18
#: Prefix shingles that one task of the join is meant to hold.
ROWS_PER_TASK = 750_000
#: Text digests a task remembers in order to emit a text once; beyond it repeats reach the join, which drops them.
SEEN = 1 << 19
#: Texts hashed at a time.
DOC_BITS = 11
TEXTS = 1 << DOC_BITS
#: Bits of a shingle's hash in the join; equal ones of different shingles only cost a comparison.
TOKEN_BITS = 64 - DOC_BITS - 8
_TOKEN = np.uint64((1 << TOKEN_BITS) - 1)
#: Bits of the bucket's number among the high ones of a shingle's hash, of the rest within a bucket, and of the shingle's rank in its text.
PLACE_BITS, REST_BITS, RANK_BITS = 22, 25, 7
#: A shingle counted so often, and so many times the mean, is hot: in its place stand the pairs it makes with other hot ones.
HOT, HOT_TIMES = 1 << 18, 64
#: Prefix shingles that a task gathers before it sends them off.
FLUSH = 4_000_000


def _salt(part: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little"))


def _texts(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            piece = batch.slice(at, TEXTS)
            yield [piece.column(n).to_pylist() for n in names]


def shingle_counts(df: DataFrame, text: str, width: int) -> tuple[np.ndarray, int]:
    """How often shingles occur in all of ``df``, folded into COUNTERS counters, and the number of its texts.

    Tasks count locally and the counters are added up by range, so neither the
    shuffle nor the result grows with the corpus beyond a constant per task.
    """
    ranges = 16
    each = COUNTERS // ranges

    def count(batches):
        total, n = np.zeros(COUNTERS, np.int64), 0
        for (texts,) in _texts(batches, (text,)):
            n += len(texts)
            _, h = hash_words(texts).all_shingles(width)
            total += np.bincount((h % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        rows = [total[i * each : (i + 1) * each].astype("<i8").tobytes() for i in range(ranges)] + [np.array([n], "<i8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(ranges + 1), pa.int32()), pa.array(rows, pa.binary())], ["r", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b, "<i8") for b in t.column("counts").to_pylist()], axis=0)
        return pa.table({"r": t.column("r").slice(0, 1), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    parts = df.select(text).mapInArrow(count, "r int, counts binary").groupBy("r").applyInArrow(add, "r int, counts binary")
    total, n = np.zeros(COUNTERS, np.int64), 0
    for row in parts.toLocalIterator():  # always 17 rows, 2 MB
        if row.r == ranges:
            n = int(np.frombuffer(row.counts, "<i8")[0])
        else:
            total[row.r * each : (row.r + 1) * each] = np.frombuffer(row.counts, "<i8")
    return total, n


def _spread(spark, n: int) -> list[int]:
    """Values of which exactly one falls into each of n hash partitions."""
    found: dict[int, int] = {}
    size = n * 16
    while len(found) < n:
        rows = spark.range(size).select("id", F.expr(f"pmod(hash(cast(id as int)), {n})").alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
        found, size = {r.p: r.id for r in rows}, size * 4
    return [found[p] for p in range(n)]


@dataclass
class NearDuplicates:
    """What the join found; every table is distributed.

    source: (part, id, key, text) of every row; ``key`` is a digest of part and text.
    links: (part, key_a, key_b, similarity) of different texts that reach the similarity.
    """

    source: DataFrame
    links: DataFrame
    min_words: int
    width: int

    def members(self, rows: DataFrame | None = None) -> DataFrame:
        """(part, id, key) of the rows whose text has enough words."""

        least = max(self.min_words, self.width)

        def enough(batches):
            for parts, ids, keys, texts in _texts(batches, ("part", "id", "key", "text")):
                at = np.flatnonzero(hash_words(texts).n_words >= least)
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in at], kind) for c, kind in ((parts, pa.string()), (ids, pa.string()), (keys, pa.binary()))], ["part", "id", "key"])

        rows = (self.source if rows is None else rows).select("part", "id", "key", "text")
        return rows.mapInArrow(enough, "part string, id string, key binary").distinct()

    def pairs(self) -> DataFrame:
        """(part, id_a, id_b) of all linked ids, smaller id first, copies included."""
        ids = stored(self.source.select("part", "id", "key").distinct(), "ids")
        ends = self.links.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
        linked = ids.join(ends, "key", "left_semi")
        a, b = (linked.select(F.col("key").alias(f"key_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
        across = self.links.join(a, "key_a").join(b, "key_b").select("part", "id_a", "id_b")
        repeated = ids.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        m = self.members(self.source.join(repeated, "key", "left_semi"))
        within = m.select("part", "key", F.col("id").alias("id_a")).join(m.select("key", F.col("id").alias("id_b")), "key").where("id_a < id_b")
        return across.unionByName(within.select("part", "id_a", "id_b")).select(
            "part", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")
        )

    def groups(self) -> DataFrame:
        """(part, id, group, links) of every id: the least digest its text is connected to and its links to other texts."""
        from tesserine.operators.components import connected_components

        parts = connected_components(self.links, "key_a", "key_b")
        ends = self.links.select(F.explode(F.array("key_a", "key_b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
        return (
            self.members().join(parts.withColumnRenamed("node", "key"), "key", "left").join(ends, "key", "left")
            .select("part", "id", F.hex(F.coalesce("component", "key")).alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
        )


def near_duplicates(df: DataFrame, id_col: str, text_col: str, part_col: str | None = None, *, similarity: float = 0.8, width: int = 5, min_words: int = 0) -> NearDuplicates:
    """Find all texts of ``df`` whose shingle sets have at least the given Jaccard similarity.

    Only texts of one ``part_col`` value are compared. NULL texts and ids, and
    texts with fewer than ``min_words`` words or no shingle, take no part. Rows
    that repeat an id with the same text count once. Equal texts stand in the join
    once, whatever their number: their rows are never collected anywhere. The
    result is exact; nothing is capped. An empty table gives empty results; other
    columns are ignored.
    """
    spark = df.sparkSession
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")) if part_col else F.lit("")
    source = df.select(part.alias("part"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    # two hashes of a text: a short one that brings candidates together, and a digest that tells texts apart
    source = source.withColumn("cls", F.xxhash64("part", "text")).withColumn("key", F.unhex(F.md5(F.concat_ws("\x1f", "part", "text"))))
    candidates = stored(prefix_join([source], similarity, width, min_words), "candidates")
    wanted = candidates.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    texts = stored(source.select("part", "cls", "key", "text").join(wanted, "cls", "left_semi").distinct(), "texts")

    def verify(batches):
        for ps, kas, kbs, tas, tbs in _texts(batches, ("part", "key_a", "key_b", "text_a", "text_b")):
            _, value = jaccard_pairs(tas, tbs, width)
            at = np.flatnonzero(value >= similarity - 1e-9)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ps[i] for i in at], pa.string()), pa.array([kas[i] for i in at], pa.binary()), pa.array([kbs[i] for i in at], pa.binary()), pa.array(value[at], pa.float64())],
                ["part", "key_a", "key_b", "similarity"],
            )

    left, right = (texts.select(F.col("part").alias(f"part_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "key", "text")]) for x in "ab")
    links = candidates.join(left, "cls_a").join(right, "cls_b").where("part_a = part_b").select(F.col("part_a").alias("part"), "key_a", "key_b", "text_a", "text_b")
    links = stored(links.mapInArrow(verify, "part string, key_a binary, key_b binary, similarity double"), "links")
    return NearDuplicates(source, links, min_words, width)


def prefix_join(sides: list[DataFrame], similarity: float, width: int, min_words: int = 0) -> DataFrame:
    """(cls_a, cls_b) of all texts that may reach the similarity, from rows (part, cls, key, text).

    Pairs within the one side, the lesser hash first; or of the first side with the second one.
    """
    spark = sides[0].sparkSession
    counts, n_texts = shingle_counts(functools.reduce(DataFrame.unionByName, [side.select("text") for side in sides]), "text", width)
    total = int(counts.sum())
    tasks = min(1 << PLACE_BITS, max(spark.sparkContext.defaultParallelism, math.ceil(total * (1 - similarity) / ROWS_PER_TASK)))
    sketch_words = sketch_width(total / max(1, n_texts))
    rare = np.minimum(np.log2(counts + 1.0) * 8, 254).astype(np.uint8)
    rare[counts > max(HOT, HOT_TIMES * total / COUNTERS)] = 255
    known = spark.sparkContext.broadcast(rare)
    buckets = spark.sparkContext.broadcast(np.array(_spread(spark, tasks), np.int32))
    n_sides = len(sides)

    def features(batches):
        seen: set[bytes] = set()
        gathered: list[tuple] = []
        for parts, hashes, keys, texts in _texts(batches, ("part", "cls", "key", "text")):
            fresh = []
            for i, g in enumerate(keys):
                if g not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(g)
                    fresh.append(i)
            gathered.append(_prefixes([parts[i] for i in fresh], np.array(hashes, np.int64)[fresh], [texts[i] for i in fresh], known.value, len(buckets.value), similarity, width, min_words, sketch_words))
            if sum(len(x[-1]) for x in gathered) >= FLUSH:
                yield _packed(gathered, buckets.value)
                gathered = []
        if gathered:
            yield _packed(gathered, buckets.value)

    def join(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for side, body in zip(batch.column("side").to_pylist(), batch.column("body").to_pylist()):
                held.setdefault(side, []).append(body)
        if len(held) < n_sides:
            return
        rows = [_unpacked(held[k], sketch_words) for k in range(n_sides)]
        held.clear()
        for a, b in _join_bucket(rows[0], similarity) if len(rows) == 1 else _join_sides(*rows, similarity):
            if len(rows) == 1:
                a, b = np.minimum(a, b), np.maximum(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["cls_a", "cls_b"])

    made = [side.select("part", "cls", "key", "text").mapInArrow(features, "bucket int, body binary").withColumn("side", F.lit(k)) for k, side in enumerate(sides)]
    return functools.reduce(DataFrame.unionByName, made).repartition(tasks, "bucket").mapInArrow(join, "cls_a long, cls_b long").distinct()


def _prefixes(parts: list[str], cls: np.ndarray, texts: list[str], rare: np.ndarray, buckets: int, similarity: float, width: int, min_words: int, sketch_words: int) -> tuple:
    """(place, cls, group, n, home, sketch, shingles, token) of the prefixes of some texts, by text and bucket.

    A token's low bits are its rank in the text, rounded down to RANK_BITS steps of the prefix.
    """
    hashed = hash_words(texts)
    doc, h = hashed.shingles(width)
    size = np.bincount(doc, minlength=len(texts))
    use = (hashed.n_words >= min_words) & (size > 0)
    doc, h = doc[use[doc]], h[use[doc]]
    sketch = sketches(doc, h, len(texts), sketch_words)
    # one sortable key: text, rarity on a logarithmic scale, hash; the order of shingles is the same for every text
    rarity = rare[(h % np.uint64(len(rare))).astype(np.int64)]
    key = (doc.astype(np.uint64) << np.uint64(64 - DOC_BITS)) | (rarity.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (h & _TOKEN)
    key.sort()
    first = np.cumsum(size * use) - size * use
    rank = np.arange(len(key)) - first[doc]
    n = size[doc]
    full = n - np.ceil(similarity * n - 1e-9) + 1
    prefix = rank < full
    salts = {p: _salt(p) for p in set(parts)}
    salt = np.array([salts[p] for p in parts], np.uint64)
    # texts so small that a single shingle may be all they share keep a hot one as it is
    hot = ((key >> np.uint64(TOKEN_BITS)) & np.uint64(0xFF) == 255) & (similarity * n > 1 + 1e-9)
    group = np.zeros(len(texts), np.uint64)
    named = prefix | hot & (rank < full + 1)
    np.add.at(group, doc[named], mix(key[named] & _TOKEN))
    group = mix(group ^ salt ^ mix(size.astype(np.uint64)))
    pair_doc, pair_token, pair_rank = _hot_pairs(doc, key & _TOKEN, rank, hot & (rank < full + 1))
    keep = prefix & ~hot
    home = np.concatenate([rank[keep] == 0, _first(pair_doc)])
    doc, token, rank = np.concatenate([doc[keep], pair_doc]), np.concatenate([key[keep] & _TOKEN, pair_token]), np.concatenate([rank[keep], pair_rank])
    step = rank * _LAST_RANK // np.maximum(_last_rank(size, similarity)[doc], 1)
    token = mix(token ^ salt[doc])
    place = ((token >> np.uint64(64 - PLACE_BITS)) * np.uint64(buckets) >> np.uint64(PLACE_BITS)).astype(np.int64)
    order = np.argsort(doc << PLACE_BITS | place, kind="stable")
    doc, token, step, home, place = (x[order] for x in (doc, token, step, home, place))
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]))
    of = doc[new]
    at_home = np.logical_or.reduceat(home, new) if len(new) else np.zeros(0, bool)
    token = ((token & np.uint64((1 << REST_BITS) - 1)) << np.uint64(RANK_BITS) | step.astype(np.uint64)).astype("<u4")
    return place[new], cls[of], group[of].view(np.int64), size[of], at_home, sketch[of], np.diff(np.append(new, len(doc))), token


def _first(doc: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones(min(1, len(doc)), bool), doc[1:] != doc[:-1]])


_LAST_RANK = (1 << RANK_BITS) - 1


def _last_rank(n: np.ndarray, similarity: float) -> np.ndarray:
    """The last rank in the prefix of sets of these sizes."""
    return (n - np.ceil(similarity * n - 1e-9)).astype(np.int64)


def _reach(n: np.ndarray, step: np.ndarray, similarity: float) -> np.ndarray:
    """The largest set that one of these sizes can be similar to if a shingle of the given rank is the first that both have."""
    last = _last_rank(n, similarity)
    rank = np.where(last > 0, -(-step * last // _LAST_RANK), 0)
    return np.floor((n - rank) * ((1 + similarity) / similarity) - n + 1e-6).astype(np.int64)


def _hot_pairs(doc: np.ndarray, token: np.ndarray, rank: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, rank of the first) of each pair of hot shingles of a text's prefix longer by one.

    Sets that share no other prefix shingle share two hot ones there.
    """
    docs, tokens, ranks = doc[hot], token[hot], rank[hot]
    if not len(docs):
        return docs, tokens, ranks
    at = np.flatnonzero(_first(docs))
    out_doc, out, out_rank = [], [], []
    for s, e in zip(at, [*at[1:], len(docs)]):
        i, j = np.triu_indices(e - s, 1)
        out.append(mix(tokens[s:e][i] * np.uint64(0x9E3779B97F4A7C15) + tokens[s:e][j]) & _TOKEN)
        out_doc.append(np.full(len(i), docs[s]))
        out_rank.append(ranks[s:e][i])
    return np.concatenate(out_doc), np.concatenate(out), np.concatenate(out_rank)


def _packed(gathered: list[tuple], buckets: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: the parts of the texts that fall into it, column by column."""
    place, cls, group, n, home, sketch, count, token = (np.concatenate([g[k] for g in gathered]) for k in range(8))
    order = np.argsort(place, kind="stable")
    first = np.cumsum(count) - count
    count_in_order = count[order]
    token = token[np.arange(len(token)) - np.repeat(np.cumsum(count_in_order) - count_in_order - first[order], count_in_order)]
    place, cls, group, n, home, sketch, count = (x[order] for x in (place, cls, group, n, home, sketch, count))
    starts = np.flatnonzero(_first(place))
    tokens = np.append(0, np.cumsum(count))
    bodies = []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(place)]):
        own = token[tokens[s] : tokens[e]]
        bodies.append(b"".join(x.tobytes() for x in (np.array([e - s, len(own)], "<i8"), cls[s:e], group[s:e], (n[s:e] << 1 | home[s:e]).astype("<u4"), sketch[s:e], count[s:e].astype("<u4"), own)))
    return pa.RecordBatch.from_arrays([pa.array(buckets[place[starts]], pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "body"])


def _unpacked(bodies: list[bytes], sketch_words: int) -> tuple:
    """(cls, group, n, home, sketch, shingles, token) of all texts of a bucket."""
    parts = []
    for body in bodies:
        docs, tokens = np.frombuffer(body, "<i8", 2).tolist()
        at, out = 16, []
        for kind, size in (("<i8", docs), ("<i8", docs), ("<u4", docs), ("<u8", docs * sketch_words), ("<u4", docs), ("<u4", tokens)):
            out.append(np.frombuffer(body, kind, size, at))
            at += size * int(kind[2])
        parts.append(out)
    cls, group, n, sketch, count, token = (np.concatenate([p[k] for p in parts]) for k in range(6))
    return cls, group, (n >> 1).astype(np.int64), (n & 1).astype(bool), sketch.reshape(-1, sketch_words), count.astype(np.int64), token


class Bucket:
    """The texts of one side of a bucket in groups of identical prefix and size, and the prefix shingles of the groups.

    Two sets match on a shingle only if each reaches the other's size from its rank
    on. The holders of a shingle are sorted by the smaller of size and reach, those
    that reach their own size first.
    """

    def __init__(self, rows: tuple, similarity: float):
        cls, group, n, home, sketch, count, token = rows
        order = np.lexsort((cls, group))
        new = np.ones(len(order), bool)
        new[1:] = (cls[order][1:] != cls[order][:-1]) | (group[order][1:] != group[order][:-1])
        member = order[new]  # one row for each text, the members of a group side by side
        self.head = head = np.flatnonzero(_first(group[member]))
        self.members = np.diff(np.append(head, len(member)))
        self.home = home[member[head]]
        self.texts = Side(n[member], sketch[member], similarity)
        self.cls = cls[member]
        # a group stands for its first text; that may differ from what a member differs from by as much as it differs from the member
        of = np.repeat(np.arange(len(head)), self.members)
        inner = sum(np.bitwise_count(c ^ c[head][of]).astype(np.int64) for c in self.texts.columns)
        self.groups = Side(n[member][head], sketch[member][head], similarity)
        self.groups.room += np.maximum.reduceat(inner, head) if len(head) else 0
        first = (np.cumsum(count) - count)[member[head]]
        per = count[member[head]]
        owner = np.repeat(np.arange(len(head)), per)
        token = token[np.arange(len(owner)) - np.repeat(np.cumsum(per) - per - first, per)]
        size = self.groups.n[owner]
        reach = _reach(size, (token & np.uint32(_LAST_RANK)).astype(np.int64), similarity)
        key = self.keys(token >> np.uint32(RANK_BITS), np.minimum(size, reach), reach < size)
        order = np.argsort(key)
        self.key, self.owner, self.size, self.reach = key[order], owner[order], size[order], reach[order]
        #: Those that can be the smaller of two sets.
        self.short = np.flatnonzero(self.reach >= self.size)

    @staticmethod
    def keys(token: np.ndarray, least: np.ndarray, beyond) -> np.ndarray:
        return token.astype(np.int64) << 34 | np.clip(least, 0, (1 << 33) - 1) << 1 | beyond

    def until(self, at: np.ndarray) -> np.ndarray:
        """The last keys that the given short prefix shingles match."""
        return self.keys(self.key[at] >> 34, self.reach[at], 1)

    def starts(self, at: np.ndarray) -> np.ndarray:
        return np.flatnonzero(_first(self.key[at] >> 34))


def _join_bucket(rows: tuple, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cls, cls) of texts whose groups share a prefix shingle of this bucket and which sizes and sketches do not rule out."""
    x = Bucket(rows, similarity)
    left = x.short
    end = np.searchsorted(x.key, x.until(left), side="right")
    left, end = left[end > left + 1], end[end > left + 1]
    for a, b in sweep(x.groups, x.groups, x.owner[left], left + 1, end, x.starts(left), x.owner):
        pair = unique(np.minimum(a, b) * len(x.head) + np.maximum(a, b))
        for i, j in _expanded(x, x, pair // len(x.head), pair % len(x.head)):
            yield x.cls[i], x.cls[j]
    for k in np.flatnonzero((x.members > 1) & x.home).tolist():
        own = range(x.head[k], x.head[k] + x.members[k])
        for i, j in _table(x.texts, x.texts, own, own):
            yield x.cls[i[i < j]], x.cls[j[i < j]]


def _join_sides(rows: tuple, others: tuple, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_join_bucket`` for a text of each side."""
    x, y = Bucket(rows, similarity), Bucket(others, similarity)
    for small, large in ((x, y), (y, x)):
        left = small.short
        # pairs of one size are found once
        low = np.searchsorted(large.key, small.keys(small.key[left] >> 34, small.size[left], 0), side="left" if small is x else "right")
        high = np.searchsorted(large.key, small.until(left), side="right")
        left, low, high = left[high > low], low[high > low], high[high > low]
        for a, b in sweep(small.groups, large.groups, small.owner[left], low, high, small.starts(left), large.owner):
            pair = unique(a * len(large.head) + b)
            for i, j in _expanded(small, large, pair // len(large.head), pair % len(large.head)):
                yield (small.cls[i], large.cls[j]) if small is x else (large.cls[j], small.cls[i])


def _expanded(left: Bucket, right: Bucket, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of members of the groups a[k] of the left and b[k] of the right that the sketches do not rule out."""
    single = (left.members[a] == 1) & (right.members[b] == 1)
    yield left.head[a[single]], right.head[b[single]]
    a, b = a[~single], b[~single]
    volume = left.members[a] * right.members[b]
    large = volume > PAIRS_AT_A_TIME
    for x, y in zip(a[large].tolist(), b[large].tolist()):
        yield from _table(left.texts, right.texts, range(left.head[x], left.head[x] + left.members[x]), range(right.head[y], right.head[y] + right.members[y]))
    a, b, volume = a[~large], b[~large], volume[~large]
    ends, at = np.cumsum(volume), 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_A_TIME, side="right")))
        v = volume[at:stop]
        k = np.arange(v.sum()) - np.repeat(np.cumsum(v) - v, v)
        x, y = np.repeat(a[at:stop], v), np.repeat(b[at:stop], v)
        yield close(left.texts, right.texts, left.head[x] + k // right.members[y], right.head[y] + k % right.members[y])
        at = stop


def _table(left: Side, right: Side, rows: range, cols: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a row and a column that the sketches do not rule out, a bounded part of the table at a time."""
    for r in range(rows.start, rows.stop, 1024):
        for c in range(cols.start, cols.stop, 1024):
            i, j = table_pairs(left, right, np.arange(r, min(r + 1024, rows.stop)), np.arange(c, min(c + 1024, cols.stop)))
            yield i + r, j + c
