"""Token-ID output in training order.

Texts become token ids, ids are cut into sequences of at most ``length`` tokens, and every sequence gets a global slot: its
ordinal under a keyed Feistel permutation, walked along its cycle until it falls inside the number of sequences.  Slots are
dealt to partitions by range, and each partition writes whole shards: records of one fixed stride, so slot -> (shard, byte)
is arithmetic and a reader resumes at any slot.

Ordinals follow the input's files and rows: the same files read with the same splits give the same order.

Defined results.  A null or empty text has no token and gives no sequence.  Repeated rows give sequences each.  Ids may be
null and repeat; a record keeps them (null as -1).  No rows in, no shards out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Fixed value: the splitting pattern of the vocabulary's authors.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEADER = 16


# ---- tokens -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BytePairs:
    """A byte-pair vocabulary from a rank file (lines of base64 and rank)."""

    ranks_file: bytes
    pattern: str = PATTERN

    @classmethod
    def from_path(cls, path: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls(f.read())

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u2") if self.ranks_file.count(b"\n") < 65_000 else np.dtype("<u4")

    def encoding(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks_file.splitlines())}
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def encoder(self):
        """text -> bytes of its ids.  A space before a letter starts a new match whatever came before it, so texts are cut
        there and what recurs is encoded once."""
        encode, dtype, known = self.encoding().encode_ordinary, self.dtype, {}

        def run(text: str) -> bytes:
            parts = text.split(" ")
            chunks = [parts[0]]
            for p in parts[1:]:
                if p and p[0].isalpha() and p[0].isprintable():
                    chunks.append(" " + p)
                else:
                    chunks[-1] += " " + p
            out = []
            for c in chunks:
                ids = known.get(c)
                if ids is None:
                    if len(known) > 300_000:  # a cache only
                        known.clear()
                    ids = np.array(encode(c), dtype).tobytes()
                    if len(c) < 64:
                        known[c] = ids
                out.append(ids)
            return b"".join(out)

        return run


# ---- the permutation --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of range(n)."""

    n: int
    key: int = 1
    rounds: int = 6

    def _half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _keys(self) -> list[np.uint64]:
        out, x = [], self.key & (2**64 - 1)
        for _ in range(self.rounds):
            x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
            z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
            out.append(np.uint64(z ^ (z >> 31)))
        return out

    def _round(self, x: np.ndarray, k: np.uint64, half: int) -> np.ndarray:
        z = (x + k) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return z >> np.uint64(64 - half)

    def _once(self, x: np.ndarray, backward: bool) -> np.ndarray:
        half = self._half()
        low = np.uint64((1 << half) - 1)
        left, right = x >> np.uint64(half), x & low
        if backward:
            for k in reversed(self._keys()):
                left, right = right ^ self._round(left, k, half), left
        else:
            for k in self._keys():
                left, right = right, left ^ self._round(right, k, half)
        return (left << np.uint64(half)) | right

    def _walk(self, x: np.ndarray, backward: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), backward)
        while len(at := np.flatnonzero(out >= np.uint64(self.n))):  # cycle-walking: the domain is less than four times n
            out[at] = self._once(out[at], backward)
        return out.astype(np.int64)

    def slot(self, ordinals: np.ndarray) -> np.ndarray:
        return self._walk(ordinals, False)

    def ordinal(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


# ---- on the cluster ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """``length`` tokens a record, ``records`` records a shard."""

    length: int = 512
    records: int = 8192
    itemsize: int = 2

    @property
    def stride(self) -> int:
        return HEADER + self.length * self.itemsize


def tokenized(docs: DataFrame, vocabulary: BytePairs, length: int) -> DataFrame:
    """(doc_id, ids binary, n, part, first): ``first`` counts the sequences before this document in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size, part, first = vocabulary.encoder(), vocabulary.dtype.itemsize, TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [encode(t) if t else b"" for t in b.column("text").to_pylist()]
            n = np.array([-(-len(x) // (size * length)) for x in ids], np.int64)
            starts = first + np.cumsum(n) - n
            first += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n), pa.array([part] * len(n), pa.int32()), pa.array(starts)], names=["doc_id", "ids", "n", "part", "first"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n long, part int, first long")


def shards(docs: DataFrame, vocabulary: BytePairs, layout: Layout = Layout(), key: int = 1) -> DataFrame:
    """(shard, first_slot, n_records, stride, payload): payload is ``n_records`` records of ``stride`` bytes, slot after slot.

    A record is doc_id (int64), sequence within the document (int32), number of tokens (int32), then ``length`` ids, all
    little-endian, padded with zeros.
    """
    spark = docs.sparkSession
    layout = Layout(layout.length, layout.records, vocabulary.dtype.itemsize)
    tokens = materialize(tokenized(docs, vocabulary, layout.length), "order-tokens", "zstd")
    sums = tokens.groupBy("part").agg(F.sum("n").alias("m"))  # a row for each partition
    total = int(sums.agg(F.sum("m")).first()[0] or 0)
    before = F.coalesce(F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("part").alias("p"), before.alias("start"))
    placed = tokens.filter("n > 0").join(starts, F.col("part") == F.col("p")).select("doc_id", "ids", (F.col("start") + F.col("first")).alias("ordinal"))
    permute, step = Feistel(max(total, 1), key), layout.length * layout.itemsize

    def cut(batches):
        for b in batches:
            docs_, seq, parts, ordinals = [], [], [], []
            for d, ids, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n = -(-len(ids) // step)
                docs_ += [-1 if d is None else d] * n
                seq += range(n)
                ordinals += range(o, o + n)
                parts += [ids[i : i + step] for i in range(0, len(ids), step)]
            if parts:
                slots = permute.slot(np.array(ordinals, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(docs_, pa.int64()), pa.array(seq, pa.int32()), pa.array(parts, pa.binary())], names=["slot", "doc_id", "seq", "ids"])

    def assemble(batches):
        stride, per, size = layout.stride, layout.records, layout.itemsize
        shard, payload, count = None, bytearray(), 0

        def row():
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            values = (shard, shard * per, count, stride, bytes(payload))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["shard", "first_slot", "n_records", "stride", "payload"])

        for b in batches:
            for slot, d, s, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if slot // per != shard:
                    if shard is not None:
                        yield row()
                    shard, payload, count = slot // per, bytearray(), 0
                payload += d.to_bytes(8, "little", signed=True) + s.to_bytes(4, "little") + (len(ids) // size).to_bytes(4, "little")
                payload += ids.ljust(stride - HEADER, b"\0")
                count += 1
        if shard is not None:
            yield row()

    n_shards = max(1, -(-total // layout.records))
    width = max(1, -(-n_shards // max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shards // 64)))
    records = placed.mapInArrow(cut, "slot long, doc_id long, seq int, ids binary")
    dealt = records.repartitionById(-(-n_shards // width), F.expr(f"cast(slot div {layout.records * width} as int)")).sortWithinPartitions("slot")
    return dealt.mapInArrow(assemble, "shard long, first_slot long, n_records int, stride int, payload binary")


def write_shards(table: DataFrame, path: str) -> None:
    """Shards as Parquet, one row each and payloads as they are; Spark's committer makes the write all or nothing."""
    table.write.option("compression", "none").parquet(path)


def read_from(shard_table: DataFrame, slot: int, layout: Layout = Layout()) -> DataFrame:
    """Records from ``slot`` on, in slot order: earlier shards are pruned, and the first one is entered at slot's byte."""
    return records(shard_table.filter(F.col("shard") >= slot // layout.records), slot).orderBy("slot")


def records(shard_table: DataFrame, first: int = 0) -> DataFrame:
    """(slot, doc_id, seq, n_tokens, ids binary) read out of payloads by offset."""

    def run(batches):
        for b in batches:
            for start, n, stride, payload in zip(*(b.column(c).to_pylist() for c in ("first_slot", "n_records", "stride", "payload")), strict=True):
                at = np.frombuffer(payload, np.uint8).reshape(n, stride)[max(0, first - start) :]
                head = np.ascontiguousarray(at[:, :HEADER])
                d, rest = head[:, :8].copy().view("<i8")[:, 0], head[:, 8:].copy().view("<i4")
                size = (stride - HEADER) // max(1, (stride - HEADER) // 2) if stride else 2
                counts = rest[:, 1]
                ids = [at[i, HEADER : HEADER + int(c) * size].tobytes() for i, c in enumerate(counts)]
                slots = np.arange(start + max(0, first - start), start + n)
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(d, pa.int64()), pa.array(rest[:, 0], pa.int32()), pa.array(counts, pa.int32()), pa.array(ids, pa.binary())], names=["slot", "doc_id", "seq", "n_tokens", "ids"])

    return shard_table.mapInArrow(run, "slot long, doc_id long, seq int, n_tokens int, ids binary")
