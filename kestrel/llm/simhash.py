"""SimHash near-duplicate detection with a Gray-order hierarchical index.

A fingerprint has 64 bits; bit b is 1 where more than half of the features' XXH64 hashes (seed 42) have it.  Distinct
fingerprints are dealt to buckets, and every bucket is searched with an index: fingerprints sorted by Gray rank, runs of eight
factored into nodes that hold the bits all members share, eight nodes into a node above, and so on.  A search walks down with
the differences accumulated so far on the factored bits and drops a whole group once they exceed the radius.

Two ways of dealing.  ``blocks`` is exact for a small radius: the 64 bits are cut into six blocks, and fingerprints within
four bits of each other agree on at least two of them, so a bucket is a pair of blocks and its 20 to 22 bits.  ``projections``
is for wider radii: ``tables`` random selections of bits, which two fingerprints at distance d share with probability about
(1 - d/64)^bits each.  The bits follow the logarithm of the number of fingerprints, so that buckets don't grow with the corpus.

A bucket reports links as a star to each connected group's representative, never as all pairs, so what is emitted stays
linear.  Buckets above ``tile`` fingerprints are cut into tiles and searched tile pair by tile pair, which is exact and
spreads a hot bucket over many tasks.

Defined results.  A null or empty text has no features and fingerprint zero, which links like any other.  Fewer words than a
shingle holds: the whole sequence is the one shingle.  Repeated rows link.  Rows with a null doc_id keep a null component.
No rows in, no rows out.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked_broadcast, discard, give_back, materialize, slices, with_arrow

FINGERPRINT = T.StructField("__fp", T.LongType(), False)
FANOUT = 8
BLOCKS = 6
#: Verifying candidates: hashes in a sketch, and how far under the asked similarity a sketch may put a pair that goes on.
SKETCH, SLACK = 128, 0.2
#: Counters for the order of shingles, and how many of them are sent together.
SLOTS, CHUNK = 1 << 20, 4096
#: One text in so many is looked at to see which buckets are hot.
PLAN = 64
#: Bit sketches in buckets: their 64-bit words, and the standard deviations that a close pair may be off.  Pairs a group offers in each round.
WORDS, SIGMAS, OFFERS = 4, 5.5, (2, 16, 128)


# ---- fingerprints -----------------------------------------------------------------------------------------------------


def shingles(text: str, k: int) -> list[bytes]:
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z only
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def distinct_words(text: str, k: int) -> list[bytes]:
    return list(set(re.findall(rb"[^\x20\x09-\x0D]+", text.encode("utf-8", "surrogatepass").lower())))


def fingerprints(texts: list[str | None], k: int, features=shingles) -> np.ndarray:
    """int64 fingerprints.  Bits are counted a block of hashes at a time, so a very long text needs no more memory."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for n, text in enumerate(texts):
        found = features(text, k) if text else []
        if not found:
            continue
        counts = np.zeros(64, np.int64)
        for at in range(0, len(found), 65536):
            h = np.fromiter((digest(s, 42) for s in found[at : at + 65536]), dtype=">u8")
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[n] = weights[counts * 2 > len(found)].sum(dtype=np.uint64)
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, words: int, kind: str = "shingles") -> DataFrame:
    """``docs`` with ``__fp``: kind ``shingles`` (repeats count) or ``words`` (each distinct word once)."""

    def make():
        features = shingles if kind == "shingles" else distinct_words

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(fingerprints(batch.column("text").to_pylist(), words, features), pa.int64())]

        return step

    return with_arrow(docs, make, [FINGERPRINT])


# ---- the index --------------------------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a code in the binary-reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A forest of Gray-ordered trees, one for every bucket.

    ``fps`` (uint64) must be sorted by (bucket, Gray rank); ``starts`` are the buckets' first positions.  Level 0 are the
    fingerprints.  A node above covers up to eight consecutive nodes and keeps ``mask``, the bits on which all of them agree,
    and ``bits``, their values there.
    """

    def __init__(self, fps: np.ndarray, starts: np.ndarray):
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.levels = [(fps, np.full(len(fps), full), np.arange(len(fps)), np.ones(len(fps), np.int64))]
        lo, hi, first, size = fps, fps, np.arange(len(fps)), np.ones(len(fps), np.int64)
        roots = np.asarray(starts)
        self.children = [None]
        while True:
            ends = np.append(roots[1:], len(lo))
            counts = (ends - roots + FANOUT - 1) // FANOUT
            owner = np.repeat(np.arange(len(roots)), counts)
            new_roots = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
            begin = roots[owner] + FANOUT * (np.arange(len(owner)) - new_roots[owner])
            lo, hi = np.bitwise_and.reduceat(lo, begin), np.bitwise_or.reduceat(hi, begin)
            self.children.append((begin, np.minimum(begin + FANOUT, ends[owner])))
            first, size = first[begin], np.add.reduceat(size, begin)
            self.levels.append((lo, ~(lo ^ hi), first, size))
            roots = new_roots
            if len(owner) == len(roots):
                break
        self.bucket = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(fps))))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For positions ``queries``: (query, member, distance) with member > query in the same bucket, or, where a whole
        group is within the radius of the query and of itself, only the group's first member."""
        fps = self.levels[0][0]
        top = len(self.levels) - 1
        stack = [(top, queries, self.bucket[queries], np.full(len(queries), 0, np.int64), np.zeros(len(queries), np.uint64))]
        while stack:
            level, q, node, acc, above = stack.pop()
            bits, mask, first, size = self.levels[level]
            acc = acc + np.bitwise_count((fps[q] ^ bits[node]) & mask[node] & ~above)  # only bits that no upper node has compared
            keep = (acc <= radius) & (first[node] + size[node] > q + 1)
            q, node, acc = q[keep], node[keep], acc[keep]
            if not len(q):
                continue
            if level == 0:
                yield q, node, acc
                continue
            free = 64 - np.bitwise_count(mask[node]).astype(np.int64)
            whole = (acc + free <= radius) & (first[node] > q)
            if whole.any():
                yield q[whole], first[node[whole]], acc[whole]
                q, node, acc = q[~whole], node[~whole], acc[~whole]
            begin, end = self.children[level]
            width = end[node] - begin[node]
            for part in _parts(width, 500_000):
                n, w = node[part], width[part]
                child = np.repeat(begin[n], w) + (np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w))
                stack.append((level - 1, np.repeat(q[part], w), child, np.repeat(acc[part], w), np.repeat(mask[n], w)))

    def tight_groups(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links inside groups that lie wholly within the radius of themselves: every member to the first."""
        for level in range(1, len(self.levels)):
            _, mask, first, size = self.levels[level]
            tight = (64 - np.bitwise_count(mask).astype(np.int64) <= radius) & (size > 1)
            f, s = first[tight], size[tight]
            yield np.repeat(f, s), np.repeat(f, s) + (np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s))


def _parts(width: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ``width`` whose sums stay near ``most``."""
    total, at = np.cumsum(width), 0
    while at < len(width):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest position of the group) after the links a-b."""
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if np.array_equal(before, label) and len(a):
            raise AssertionError("no progress")
    return label


def star_links(fps: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, representative) of all that have a link; connected groups are the buckets' exact ones."""
    index, label = GrayIndex(fps, starts), np.arange(len(fps))
    for a, b in index.tight_groups(radius):
        label = merge_labels(label, a, b)
    for at in range(0, len(fps), 100_000):
        for a, b, _ in index.search(np.arange(at, min(at + 100_000, len(fps))), radius):
            label = merge_labels(label, a, b)
    member = np.flatnonzero(label != np.arange(len(fps)))
    return member, label[member]


def candidate_links(fps: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Two links a member at most: to its nearest neighbour, and to the member nearest to its group's majority bits."""
    index, label = GrayIndex(fps, starts), np.arange(len(fps))
    near, dist = np.full(len(fps), -1), np.full(len(fps), 99)

    def offer(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        for x, y in ((a, b), (b, a)):
            order = np.lexsort((y, d, x))
            x1, first = np.unique(x[order], return_index=True)
            y1, d1 = y[order][first], d[order][first]
            better = d1 < dist[x1]
            near[x1[better]], dist[x1[better]] = y1[better], d1[better]

    for a, b in index.tight_groups(radius):
        differ = a != b
        a, b = a[differ], b[differ]
        offer(a, b, np.bitwise_count(fps[a] ^ fps[b]).astype(np.int64))
        label = merge_labels(label, a, b)
    for at in range(0, len(fps), 100_000):
        for a, b, _ in index.search(np.arange(at, min(at + 100_000, len(fps))), radius):
            offer(a, b, np.bitwise_count(fps[a] ^ fps[b]).astype(np.int64))
            label = merge_labels(label, a, b)
    member = np.flatnonzero(near >= 0)
    if not len(member):
        return member, member
    # majority bits of each group, and the member nearest to them
    order = member[np.argsort(label[member], kind="stable")]
    groups, begin = np.unique(label[order], return_index=True)
    size = np.diff(np.append(begin, len(order)))
    majority = np.zeros(len(groups), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((fps[order] >> np.uint64(bit)) & np.uint64(1), begin)
        majority |= (ones * np.uint64(2) > size.astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    away = np.bitwise_count(fps[order] ^ np.repeat(majority, size))
    best = np.lexsort((order, away, np.repeat(np.arange(len(groups)), size)))[begin]
    centre = np.repeat(order[best], size)
    a, b = np.concatenate([member, order]), np.concatenate([near[member], centre])
    differ = a != b
    return a[differ], b[differ]


# ---- dealing and searching on the cluster -----------------------------------------------------------------------------


def _search(links, radius: int):
    """mapInArrow over rows (key, node, fp) sorted by key: (a, b) node links of each key, a bounded number of rows at a time."""

    def flush(keys, nodes, fps):
        order = np.lexsort((gray_rank(fps), keys))
        keys, nodes, fps = keys[order], nodes[order], fps[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        a, b = links(fps, starts, radius)
        if len(a):
            pair = np.unique(np.stack([np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])
        give_back()

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(tuple(b.column(i).to_numpy() for i in range(3)))
            n += b.num_rows
            if n >= 400_000:
                k, v, f = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(k, k[-1]))  # the last key may go on
                if cut:
                    yield from flush(k[:cut], v[:cut], f[:cut].view(np.uint64))
                held, n = [(k[cut:], v[cut:], f[cut:])], len(k) - cut
        if n:
            k, v, f = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from flush(k, v, f.view(np.uint64))

    return run


def block_keys(fp: str = "fp") -> list[F.Column]:
    """The 15 bucket keys of the exact dealing: each pair of six blocks with their values, marked by the pair's number."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    block = [F.shiftrightunsigned(F.shiftleft(F.col(fp), edges[i]), 64 - edges[i + 1] + edges[i]) for i in range(BLOCKS)]
    out = []
    for i in range(BLOCKS):
        for j in range(i + 1, BLOCKS):
            out.append(F.shiftleft(F.shiftleft(F.lit(len(out)).cast("long"), 11).bitwiseOR(block[i]), 11).bitwiseOR(block[j]))
    return out


def projection_keys(tables: int, bits: int, fp: str = "fp") -> list[F.Column]:
    """Bucket keys of the wide dealing: fixed pseudo-random selections of ``bits`` bits, marked by the table's number."""
    rng = np.random.default_rng(20240229)
    out = []
    for t in range(tables):
        mask = 0
        for b in rng.choice(64, bits, replace=False):
            mask |= 1 << int(b)
        mask = mask - (1 << 64) if mask >> 63 else mask
        kept = F.col(fp).bitwiseAND(F.lit(mask))
        out.append(F.shiftleft(F.xxhash64(kept, F.lit(t)), 6).bitwiseOR(F.lit(t % 64).cast("long")))
    return out


def links(nodes: DataFrame, radius: int, keys: list, kind, tile: int = 32768) -> DataFrame:
    """Links (a, b) between rows (node, fp) of distinct fingerprints that meet in a bucket, without repeats."""
    n = nodes.count()
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(keys) // 400_000 + 1)
    dealt = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("key"))
    # a bucket beyond a tile is hot: its rows go to every pair of tiles that holds theirs
    hot = materialize(dealt.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > tile), "simhash-hot")
    if hot.head(1):
        k = F.ceil(F.col("m") / tile).cast("int")
        own = F.pmod(F.xxhash64("fp"), k).cast("int")
        other = F.explode(F.when(F.col("m").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), k - 1))).alias("other")
        dealt = dealt.join(hot, "key", "left").select("key", "node", "fp", F.coalesce(own, F.lit(0)).alias("own"), other)
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.select(F.when(F.col("own") + F.col("other") == 0, F.xxhash64("key", F.lit(0), F.lit(0))).otherwise(pair).alias("key"), "node", "fp")
    dealt = dealt.select("key", "node", "fp").repartition(parts, "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_search(kind, radius), "a long, b long")
    return found.groupBy("a", "b").agg(F.lit(1).alias("__one")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that is reachable, for every node with an edge.

    Large-star and small-star contractions in turn until only stars are left: no node is a leaf twice, or both leaf and centre.
    Each round is stored, so lineage stays short and lost executors cost one round.  Adjacency is never collected: a round is a
    min-aggregate and a join with it.
    """
    cur = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")
    while True:
        seen = cur.select(F.col("b").alias("u"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(cur.select("a", F.lit(0), F.lit(1)))
        roles = seen.groupBy("u").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        if not roles.filter("leaf + centre > 1").head(1):
            roots = cur.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            return cur.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.filter("a <> b").distinct().persist(StorageLevel.DISK_ONLY)  # of one round: what is lost is made again from ``cur``
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        nxt = materialize(small.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")
        large.unpersist()
        discard(cur)
        cur = nxt


def near_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` of every document; links are exact, within ``radius`` <= 4 bits."""
    if not 0 <= radius <= BLOCKS - 2:
        raise ValueError("the exact dealing serves a radius of 0 to 4")
    rows = materialize(with_fingerprint(docs.select("doc_id", "text"), words).select("doc_id", "__fp"), "simhash-fp")
    nodes = materialize(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("node")).filter("node is not null"), "simhash-nodes")
    roots = components(links(nodes, radius, block_keys(), star_links))
    roots = nodes.join(roots, "node", "left").select(F.col("fp").alias("__f"), F.coalesce("root", "node").alias("component_id"))
    out = rows.join(roots, F.col("__fp") == F.col("__f"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), component)


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 12, tables: int = 32, bits: int = 16) -> DataFrame:
    """``docs`` with one row of every group of near copies: Jaccard similarity of ``words``-shingle sets >= ``similarity``.

    Exact copies (equal texts) fall together first.  Of the rest, fingerprints of the distinct words (an edit of one word moves
    one feature, not ``words`` of them) propose candidates within a wide radius, and the shingle sets of both texts decide.
    These are few and may miss a pair; so :func:`_join_apart` then looks at all pairs that they left in two groups and that can
    be close, and joins the groups of those whose sets are.
    The row with the smallest doc_id stays (rows that repeat a doc_id stay or go together); rows with a null doc_id stay, and so do texts without a word.
    """
    text_key = F.struct(F.xxhash64("text"), F.md5("text")).alias("__text")
    rows = materialize(with_fingerprint(docs.filter("doc_id is not null").select("doc_id", "text"), words, "words").select("doc_id", "__fp", text_key, F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("__has")), "dedup-fp")
    texts = materialize(rows.filter("__has").groupBy("__text").agg(F.min("doc_id").alias("node"), F.first("__fp").alias("fp")), "dedup-texts")
    # one node for each distinct fingerprint stands for all texts that have it; such texts are candidates of one another
    nodes = materialize(texts.groupBy("fp").agg(F.min("node").alias("node")), "dedup-nodes")
    same = texts.join(nodes.withColumnRenamed("node", "rep"), "fp").filter("node > rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    # buckets of four fingerprints or so, if they were random, at any size; what fewer shared bits miss is found further below
    bits = min(40, max(bits, nodes.count().bit_length() - 2))
    wide = links(nodes, radius, projection_keys(tables, bits), candidate_links)
    pairs = materialize(wide.unionByName(same), "dedup-pairs")
    close = _close(docs, pairs, words, similarity)
    first = materialize(components(close), "dedup-first")
    label = F.coalesce("root", "node").alias("label")
    labelled = materialize(texts.select("node").distinct().join(first, "node", "left").select("node", label), "dedup-labels")
    rest = _join_apart(docs, labelled, words, similarity)
    roots = components(first.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(rest)).filter("node <> root")
    copies = rows.filter("__has").join(texts.select("__text", "node"), "__text").filter("doc_id > node").select("doc_id")
    gone = materialize(copies.union(roots.select(F.col("node").alias("doc_id"))).distinct(), "dedup-gone")
    discard(rows, texts, nodes, pairs, close, first, labelled)
    return docs.join(checked_broadcast(gone).withColumnRenamed("doc_id", "__gone"), docs["doc_id"] == F.col("__gone"), "left_anti")


def _set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles(text or "", words)), np.uint64))


def _slot_counts(texts: DataFrame, words: int) -> np.ndarray:
    """uint64[SLOTS]: about how many texts have a shingle of each slot.  Used for an order only, so a partition's counts may end at 65535."""
    most = np.iinfo(np.uint16).max

    def count(batches):
        held = np.zeros(SLOTS, np.uint32)
        for b in (part for batch in batches for part in slices(batch)):
            for t in b.column("text").to_pylist():
                np.add.at(held, (_set(t, words) & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        held = np.minimum(held, most).astype(np.uint16).reshape(-1, CHUNK)
        found = np.flatnonzero(held.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([held[i].tobytes() for i in found], pa.binary())], names=["chunk", "counts"])
        give_back()

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(x, np.uint16).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "counts"])

    sent = texts.select("text").mapInArrow(count, "chunk long, counts binary").repartition("chunk")
    out = np.zeros((SLOTS // CHUNK, CHUNK), np.uint64)
    for r in sent.mapInArrow(add, "chunk long, counts binary").collect():  # SLOTS numbers
        out[r["chunk"]] = np.frombuffer(r["counts"], np.uint64)
    return out.reshape(-1)


def _prefix_rows(texts: DataFrame, words: int, similarity: float, slots: np.ndarray) -> DataFrame:
    """(key, node, label, place): every text at the first n - ceil(similarity n) + 1 of its n shingles, rare ones first.

    ``place`` is the shingle's position in that order, with n above it.
    """

    def run(batches):
        for b in (part for batch in batches for part in slices(batch)):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for node, label, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s = _set(text, words)
                often = slots[(s & np.uint64(SLOTS - 1)).astype(np.int64)]
                take = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
                key = s[np.lexsort((s, often))[:take]]
                cols[0].append(key.view(np.int64))
                cols[1].append(np.full(len(key), node))
                cols[2].append(np.full(len(key), label))
                cols[3].append(np.arange(len(key)) + (len(s) << 32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], names=["key", "node", "label", "place"])
        give_back()

    return texts.mapInArrow(run, "key long, node long, label long, place long")


def _tiled(rows: DataFrame, hot: DataFrame, tile: int) -> DataFrame:
    """``rows`` (key, node, ...), those of the keys in ``hot`` (hot, m rows) once for every pair of tiles that holds theirs."""
    if not hot.head(1):
        return rows
    k = F.ceil(F.col("m") / tile).cast("int")
    own = F.coalesce(F.pmod(F.xxhash64("node"), k).cast("int"), F.lit(0))
    other = F.explode(F.when(F.col("m").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), k - 1)))
    t = rows.join(checked_broadcast(hot), F.col("key") == F.col("hot"), "left").withColumn("own", own).withColumn("other", other)
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return t.select(F.when(F.col("m").isNull(), F.col("key")).otherwise(pair).alias("key"), *[c for c in rows.columns if c != "key"])


def _pairs_apart(key: np.ndarray, label: np.ndarray, place: np.ndarray, similarity: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, sorted by (key, label), that have one key and two labels and whose sizes and places allow ``similarity``."""
    n, at = place >> 32, place & 0xFFFFFFFF
    new = np.append(True, key[1:] != key[:-1])
    end = np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]
    new |= np.append(True, label[1:] != label[:-1])
    after = np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]
    width = end - after  # members of the bucket with a later label
    for part in _parts(width, most):
        w = width[part]
        a = np.repeat(np.arange(part.start, part.stop), w)
        b = np.repeat(after[part], w) + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
        fit = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-6
        fit &= np.minimum(n[a] - at[a], n[b] - at[b]) >= similarity / (1 + similarity) * (n[a] + n[b]) - 1e-6
        yield a[fit], b[fit]


def _by_key(step):
    """mapInArrow over rows sorted by their first column: ``step`` gets the columns of whole keys, a bounded number of rows at a time."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(tuple(b.column(i).to_numpy() for i in range(b.num_columns)))
            n += b.num_rows
            if n >= 400_000:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
                if cut:
                    yield from step(*(c[:cut] for c in cols))
                    give_back()
                held, n = [tuple(c[cut:] for c in cols)], len(cols[0]) - cut
        if n:
            yield from step(*(np.concatenate(x) for x in zip(*held, strict=True)))
            give_back()

    return run


def _best(live: DataFrame, similarity: float, most: int | None) -> DataFrame:
    """(a, b, more): in each bucket, the ``most`` pairs of every label that the bit sketches put nearest, or all of them.

    ``more``: the bucket holds further pairs of that label.  Pairs whose sketches differ in ``SIGMAS`` deviations more bits than
    at ``similarity`` are refused; at 0.8 a close pair is with a chance of 3 in ten million.
    """
    share, size = (1 - similarity) / 2, 64 * WORDS
    differ = int(share * size + SIGMAS * (size * share * (1 - share)) ** 0.5 + 1e-9)

    def nearest(run, d, a, b):
        order = np.lexsort((b, a, d, run))
        run, d, a, b = run[order], d[order], a[order], b[order]
        first = np.append(True, run[1:] != run[:-1])
        rank = np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
        return tuple(x[rank < most] for x in (run, d, a, b)), np.unique(run[rank >= most])

    def send(node, a, b, more):
        low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        order = np.lexsort((~more, high, low))
        low, high, more = low[order], high[order], more[order]
        new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(low[new]), pa.array(high[new]), pa.array(more[new])], names=["a", "b", "more"])

    def meet(key, node, label, place, *sketch):
        order = np.lexsort((node, label, key))
        key, node, label, place = key[order], node[order], label[order], place[order]
        bits = np.stack([x[order] for x in sketch], axis=1).view(np.uint64)
        run = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (label[1:] != label[:-1])))
        empty = np.zeros(0, np.int64)
        held, over = (empty, empty, empty, empty), empty
        for a, b in _pairs_apart(key, label, place, similarity, 250_000):
            d = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            a, b, d = a[d <= differ], b[d <= differ], d[d <= differ]
            if most is None:
                if len(a):
                    yield send(node, a, b, np.zeros(len(a), bool))
                continue
            offers = ((np.concatenate([run[a], run[b]])), np.concatenate([d, d]), np.concatenate([a, a]), np.concatenate([b, b]))
            held, left_out = nearest(*(np.concatenate(x) for x in zip(held, offers, strict=True)))
            over = np.union1d(over, left_out)
        if len(held[0]):
            yield send(node, held[2], held[3], np.isin(held[0], over))

    dealt = live.select("key", "node", "label", "place", *[f"b{i}" for i in range(WORDS)]).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_by_key(meet), "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def _met(docs: DataFrame, labelled: DataFrame, words: int, similarity: float, tile: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows (node, key, place, bit sketch) of the documents that meet one of another group, their sets (:func:`_hashes`), and the
    stored tables that the rows are read from.

    Prefix filtering: in one order of all shingles, rare ones first, two sets that are close share one of the first
    n - ceil(similarity n) + 1, so close pairs meet in a bucket; at the first shingle that they share, what is left of both must
    allow the overlap.  Any order is right; the rare first keeps buckets small.
    """
    texts = docs.join(checked_broadcast(labelled), docs["doc_id"] == F.col("node")).select("node", "label", "text")

    def meet(key, node, label, place):
        order = np.lexsort((label, key))
        key, node, label, place = key[order], node[order], label[order], place[order]
        seen = np.zeros(len(key), bool)
        for a, b in _pairs_apart(key, label, place, similarity, 250_000):
            seen[a], seen[b] = True, True
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[seen]) for x in (key, node, place)], names=["key", "node", "place"])

    slots = _slot_counts(texts, words)
    # which buckets are hot is estimated, as a range exchange does it, from one text in ``PLAN``: any split gives the same pairs
    some = _prefix_rows(texts.filter(F.pmod(F.xxhash64("node", F.lit("plan")), F.lit(PLAN)) == 0), words, similarity, slots)
    hot = some.groupBy(F.col("key").alias("hot")).agg((F.count("*") * PLAN).alias("m")).filter(F.col("m") > tile)
    hot = materialize(hot, "dedup-hot")
    rows = _tiled(_prefix_rows(texts, words, similarity, slots), hot, tile).repartition("key").sortWithinPartitions("key")
    live = materialize(rows.mapInArrow(_by_key(meet), "key long, node long, place long"), "dedup-live")
    met = materialize(live.select(F.col("node").alias("id")).distinct(), "dedup-met")
    sets = _hashes(docs.join(checked_broadcast(met), docs["doc_id"] == F.col("id"), "left_semi").select("doc_id", "text"), words, None, "dedup-sets")
    bits = materialize(_bit_sketches(sets), "dedup-bits")
    return live.join(checked_broadcast(bits, 300_000), "node"), sets, [hot, live, met, bits]


def _join_apart(docs: DataFrame, labelled: DataFrame, words: int, similarity: float, tile: int = 32768) -> DataFrame:
    """Links (a, b) that join the groups ``label`` of the documents ``node`` wherever two of different groups are close.

    A bucket doesn't send its pairs.  In rounds, each group offers the few that bit sketches put nearest, the exact sets decide,
    and groups that are joined have nothing left to offer one another.  Offers grow from round to round, and the last round
    leaves out none, so every close pair has been decided or lies within a group.
    """
    live, sets, spent = _met(docs, labelled, words, similarity, tile)
    exact = _overlap() >= similarity * (F.col("n_a") + F.col("n_b") - _overlap())
    links, decided = [], None
    for most in (*OFFERS, None):
        new = offers = materialize(_best(live.join(checked_broadcast(labelled), "node"), similarity, most), "dedup-offers")
        spent.append(offers)
        if decided is not None:
            new = materialize(offers.join(decided, ["a", "b"], "left_anti"), "dedup-new")
            spent.append(new)
        new = new.select("a", "b")
        links.append(materialize(_with_both(new, _of(sets, new)).filter(exact).select("a", "b").distinct(), "dedup-close"))
        if not offers.filter("more").head(1):
            break
        decided = new if decided is None else decided.unionByName(new)
        labelled = _relabel(labelled, links[-1])
    discard(sets, *spent)
    return functools.reduce(DataFrame.unionByName, links)


def _relabel(labelled: DataFrame, close: DataFrame) -> DataFrame:
    """``labelled`` (node, label) with the groups that the links (a, b) join under one label."""
    of = lambda x: labelled.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    if not close.head(1):
        return labelled
    edges = close.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    roots = components(edges).select(F.col("node").alias("label"), "root")
    return materialize(labelled.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "dedup-labels")


def _bit_sketches(sets: DataFrame) -> DataFrame:
    """(node, b0 ...): one bit of each of 64 * WORDS minima of a text's shingles.  Two texts of similarity J differ in (1 - J) / 2 of them."""
    rng = np.random.default_rng(20240301)
    odd, salt = (rng.integers(0, 1 << 63, 64 * WORDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))

    def run(batches):
        for b in batches:
            out = np.zeros((b.num_rows, 64 * WORDS), np.uint8)
            for i, s in enumerate(b.column("s")):
                h, low = s.values.to_numpy().view(np.uint64), np.full(64 * WORDS, np.iinfo(np.uint64).max)
                for at in range(0, len(h), 4096):
                    low = np.minimum(low, ((h[at : at + 4096, None] ^ salt) * odd).min(axis=0))
                out[i] = (low >> np.uint64(20)) & np.uint64(1)
            packed = np.packbits(out, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(packed[:, i].copy()) for i in range(WORDS)]], names=["node", *[f"b{i}" for i in range(WORDS)]])
            give_back()

    return sets.select("doc_id", "s").mapInArrow(run, "node long, " + ", ".join(f"b{i} long" for i in range(WORDS)))


def _overlap() -> F.Column:
    return F.size(F.array_intersect("s_a", "s_b"))


def _close(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The stored pairs (a, b) whose shingle sets have at least ``similarity``.

    Whole sets are sent only for pairs that can still be close: first the sets' sizes must allow it, which loses nothing; then
    the ``SKETCH`` smallest hashes of both sets must not put the pair ``SLACK`` below the asked similarity.  A sketch of 128
    errs by 0.035 (one standard deviation), so a close pair is refused with a chance under one in a million.
    """
    sketches = _hashes(_of(docs, pairs).select("doc_id", "text"), words, SKETCH, "dedup-sketches")
    size = sketches.select("doc_id", "n").distinct()
    sized = pairs.join(_named(size, "a"), "a").join(_named(size, "b"), "b")
    fits = materialize(sized.filter(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")).select("a", "b"), "dedup-fits")
    upto = F.least(*[F.when(F.col(f"n_{x}") > SKETCH, F.element_at(f"s_{x}", -1)) for x in "ab"])  # least() passes over nulls
    seen = lambda x: F.when(upto.isNull(), F.size(f"s_{x}")).otherwise(F.size(F.filter(f"s_{x}", lambda h: h <= upto)))
    common = F.size(F.array_intersect("s_a", "s_b"))
    alike = common >= (similarity - SLACK) * (seen("a") + seen("b") - common)
    likely = materialize(_with_both(fits, sketches).filter(alike).select("a", "b").distinct(), "dedup-likely")
    sets = _hashes(_of(docs, likely).select("doc_id", "text"), words, None, "dedup-sets")
    exact = common >= similarity * (F.col("n_a") + F.col("n_b") - common)
    close = materialize(_with_both(likely, sets).filter(exact).select("a", "b"), "dedup-close")
    discard(sketches, fits, likely, sets)
    return close


def _named(table: DataFrame, side: str) -> DataFrame:
    return table.select(*[F.col(c).alias(side if c == "doc_id" else f"{c}_{side}") for c in table.columns])


def _with_both(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    return checked_broadcast(pairs).join(_named(hashes, "a"), "a").join(_named(hashes, "b"), "b")


def _of(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``table`` whose doc_id is in a stored pair.  There are at most twice as many ids as pairs."""
    ids = pairs.select(F.col("a").alias("__id")).union(pairs.select("b")).distinct()
    ids = F.broadcast(ids) if pairs.count() <= 1_000_000 else ids
    return table.join(ids, table["doc_id"] == F.col("__id"), "left_semi")


def _hashes(docs: DataFrame, words: int, most: int | None, label: str) -> DataFrame:
    """Stored (doc_id, n, s): how many distinct shingles a text has and their sorted hashes, all or the ``most`` smallest."""

    def run(batches):
        for b in (part for batch in batches for part in slices(batch)):
            sets = [np.sort(_set(t, words).view(np.int64)) for t in b.column("text").to_pylist()]
            kept = pa.array([s[:most] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), kept], names=["doc_id", "n", "s"])
        give_back()

    return materialize(docs.mapInArrow(run, "doc_id long, n int, s array<long>"), label)  # rows that repeat an id repeat links, which is harmless


__all__ = ["near_groups", "deduplicate", "GrayIndex", "gray_rank", "star_links", "candidate_links", "components", "links"]
