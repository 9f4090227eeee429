"""Token ids as compressed wavelet matrices, one per shard, with rank and select.

A shard file holds documents in ascending doc_id order: a header, the documents' ids, ends and keys, and sixteen
bit planes with a rank directory.  Plane ``b`` holds bit ``b`` (highest first) of every id, and ids are stably split
by it before the next plane; with the counts of ones before each block of bits, which the file holds, access, count
and occurrence lookups read the one file at a block of each plane.  Files are kept as a Parquet table with one binary row per shard, so any shared store works.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import bounded_broadcast, stored, text_of
from lorekeep.llm.tokens import TERMS, public_path, term_counts, tokenizer

MAGIC = b"LKWM1\n"
#: Bits of an id; the vocabularies have fewer than 65,536 entries.
PLANES = 16
#: Ids in a shard file: what a task holds at once.  A longer document fills a file by itself.
SHARD_IDS = 1 << 20
END_ID = 1
#: Bits between two entries of the rank directory, and bits compressed together.
BLOCK, CHUNK_BITS = 512, 1 << 17
#: A row of two numbers per shard is broadcast up to this many shards.
BROADCAST_SHARDS = 200_000
#: Texts encoded at once, to bound a worker's memory.
CHUNK = 400


def tokenised(docs: DataFrame, path: str, blanks: bool, end_id: int, frequencies: bool = False) -> DataFrame:
    """doc_id, ids (little-endian 16-bit), n_tokens; null texts are empty, the end id is appended.

    With ``frequencies`` one row of each batch also tells in ``terms`` which ids its documents hold, and then how many
    of them hold each (little-endian 32-bit).
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = tokenizer(path, blanks)
        end = np.array([end_id], np.uint16)
        for frame in frames:
            df = np.zeros(TERMS, np.int64)
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at : at + CHUNK]
                ids = [np.concatenate([one, end]) for one in tool.encode(part["text"].tolist())]
                out = pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "ids": [one.astype("<u2").tobytes() for one in ids],
                        "n_tokens": [len(one) for one in ids],
                    }
                )
                if frequencies:
                    df += np.bincount(term_counts(ids)[1], minlength=TERMS)
                    met = np.flatnonzero(df) if at + CHUNK >= len(frame) else []
                    told = np.concatenate([met, df[met]]).astype("<u4").tobytes() if len(met) else None
                    out["terms"] = [told, *[None] * (len(out) - 1)]
                yield out

    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id string, ids binary, n_tokens long" + (", terms binary" if frequencies else "")
    return texts.mapInPandas(encode, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


class WaveletMatrix:
    """A sequence of 16-bit ids as bit planes with a rank directory, read from its file as far as it is asked.

    The file holds the number of ids, each plane's zeros, the ones before each block of every plane, and the planes,
    packed and compressed in chunks of CHUNK_BITS.  Access, rank and select read the directory and one chunk per
    plane; ``all`` reads every chunk once.
    """

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        self.n, at = struct.unpack_from("<Q", data)[0], 8
        self.zeros = np.frombuffer(data, "<u8", PLANES, at)
        at += 8 * PLANES
        blocks, self.chunks = -(-self.n // BLOCK), -(-self.n // CHUNK_BITS)
        # ones before each block, and in the plane
        self.ones = np.frombuffer(data, "<u4", PLANES * (blocks + 1), at).reshape(PLANES, blocks + 1)
        at += 4 * PLANES * (blocks + 1)
        self.starts = np.frombuffer(data, "<u4", PLANES * self.chunks + 1, at)
        self.base = at + 4 * (PLANES * self.chunks + 1)
        self.expand = zstandard.ZstdDecompressor().decompress
        self.held: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        now, n = ids.astype(np.uint16), len(ids)
        zeros, ones, chunks = [], [], []
        for b in range(PLANES - 1, -1, -1):
            bit = (now & np.uint16(1 << b)).astype(bool)
            packed = np.zeros(-(-n // BLOCK) * BLOCK // 8, np.uint8)
            packed[: -(-n // 8)] = np.packbits(bit, bitorder="little")
            counts = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1)
            ones.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4"))
            chunks += [squeeze(packed[at : at + CHUNK_BITS // 8].tobytes()) for at in range(0, len(packed), CHUNK_BITS // 8)]
            zeros.append(n - int(ones[-1][-1]))
            split = np.empty_like(now)
            np.compress(~bit, now, out=split[: zeros[-1]])
            np.compress(bit, now, out=split[zeros[-1] :])
            now = split
        starts = np.concatenate([[0], np.cumsum([len(c) for c in chunks])]).astype("<u4")
        head = struct.pack("<Q", n) + np.array(zeros, "<u8").tobytes() + np.concatenate(ones).tobytes() + starts.tobytes()
        return cls(head + b"".join(chunks))

    def to_bytes(self) -> bytes:
        return bytes(self.data)

    def _chunk(self, plane: int, chunk: int) -> np.ndarray:
        """The bytes of a chunk; the chunk that was asked for last of each plane is kept."""
        at = plane * self.chunks + chunk
        kept = self.held.get(plane)
        if kept is None or kept[0] != at:
            data = self.expand(self.data[self.base + self.starts[at] : self.base + self.starts[at + 1]])
            kept = self.held[plane] = (at, np.frombuffer(data, np.uint8))
        return kept[1]

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The bits of one block."""
        chunk, within = divmod(block, CHUNK_BITS // BLOCK)
        return np.unpackbits(self._chunk(plane, chunk)[within * BLOCK // 8 : (within + 1) * BLOCK // 8], bitorder="little")

    def _rank1(self, plane: int, end: int) -> int:
        """Ones among the first ``end`` bits of a plane, from the directory and one block."""
        block, rest = divmod(end, BLOCK)
        return int(self.ones[plane, block]) + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, nth: int) -> int:
        """The place of the ``nth`` (from 0) bit of this kind in a plane: a search in the directory, then one block."""
        ones = self.ones[plane]
        counts = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(counts, nth, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(plane, block) == bit)[nth - int(counts[block])])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for plane in range(PLANES):
            one = int(self._block(plane, i // BLOCK)[i % BLOCK])
            value = value << 1 | one
            i = int(self.zeros[plane]) + self._rank1(plane, i) if one else i - self._rank1(plane, i)
        return value

    def rank(self, value: int, end: int) -> int:
        """How often ``value`` occurs among the first ``end`` ids."""
        low, high = self._range(value, end)
        return high - low

    def _range(self, value: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for plane in range(PLANES):
            ones_low, ones_high = self._rank1(plane, low), self._rank1(plane, high)
            if value >> (PLANES - 1 - plane) & 1:
                low, high = int(self.zeros[plane]) + ones_low, int(self.zeros[plane]) + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return low, high

    def select(self, value: int, nth: int) -> int:
        """The place of the ``nth`` (from 0) occurrence of ``value``, or -1."""
        low, high = self._range(value, self.n)
        if not 0 <= nth < high - low:
            return -1
        at = low + nth
        for plane in range(PLANES - 1, -1, -1):
            bit = value >> (PLANES - 1 - plane) & 1
            at = self._select(plane, bit, at - int(self.zeros[plane]) * bit)
        return at

    def all(self) -> np.ndarray:
        """Every id in order: the splits undone from the last plane to the first."""
        now = np.zeros(self.n, np.uint16)
        for plane in range(PLANES - 1, -1, -1):
            parts = [self._chunk(plane, chunk) for chunk in range(self.chunks)]
            bit = np.unpackbits(np.concatenate(parts), count=self.n, bitorder="little").view(bool) if parts else now.astype(bool)
            zeros = int(self.zeros[plane])
            before = np.empty(self.n, np.uint16)
            before[~bit] = now[:zeros]
            before[bit] = now[zeros:] | np.uint16(1 << (PLANES - 1 - plane))
            now = before
        return now


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One shard file."""
    ends = np.cumsum([len(one) for one in ids], dtype=np.int64)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = zlib.compress(ends.tobytes() + keys.tobytes() + null.tobytes(), 1)
    body = WaveletMatrix.build(np.concatenate(ids)).to_bytes()
    return MAGIC + struct.pack("<QQ", len(ids), len(head)) + head + body


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """The documents' ids, their ends and the matrix of a shard file."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a shard file")
    at = len(MAGIC) + 16
    n, size = struct.unpack_from("<QQ", data, len(MAGIC))
    head = zlib.decompress(data[at : at + size])
    ends, keys = np.frombuffer(head, np.int64, n), np.frombuffer(head, np.int64, n, 8 * n)
    null = np.frombuffer(head, np.uint8, n, 16 * n)
    doc_ids = [None if z else int(k) for k, z in zip(keys, null, strict=True)]
    return doc_ids, ends, WaveletMatrix(data[at + size :])


def write_shards(docs: DataFrame, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The shard files of all documents, as a stored table: shard, n_tokens, file.

    Documents come in ascending doc_id order (null first; rows of one doc_id in any fixed order), dealt by
    ranges; a task streams through its sorted range and closes a file at every ``shard_ids`` ids.
    """
    path = path or public_path("word_bpe_49k.json")
    encoded = stored(tokenised(docs, path, False, END_ID), "wavelet-ids")
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(1, -(-int(total) // shard_ids))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held, made, task = 0, 0, 0

        def close() -> pd.DataFrame:
            return pd.DataFrame(
                {"shard": [task << 24 | made], "n_tokens": [held], "file": [shard_bytes(doc_ids, ids)]}
            )

        for frame in frames:
            for key, data, part in zip(frame["doc_id"], frame["ids"], frame["part"], strict=True):
                task = int(part)
                doc_ids.append(None if key is None or pd.isna(key) else int(key))
                ids.append(np.frombuffer(data, "<u2"))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield close()
                    doc_ids, ids, held, made = [], [], 0, made + 1
        if ids:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("ids")]  # rows of one doc_id are dealt by their ids
    dealt = encoded.repartitionByRange(ranges, *order[:2]).sortWithinPartitions(*order)
    dealt = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "ids", F.spark_partition_id().alias("part"))
    return stored(dealt.mapInPandas(build, "shard long, n_tokens long, file binary"), "wavelet-shards", "uncompressed")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, data in zip(frame["shard"], frame["file"], strict=True):
                doc_ids, ends, matrix = read_shard(data)
                ids = matrix.all().astype("<u4")
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                yield pd.DataFrame(
                    {
                        "shard": shard,
                        "doc_id": [None if d is None else str(d) for d in doc_ids],
                        "local": starts,
                        "n_tokens": ends - starts,
                        "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)],
                    }
                )

    rows = shards.select("shard", "file").mapInPandas(
        read, "shard long, doc_id string, local long, n_tokens long, ids_crc32 long"
    )
    # running sums inside groups of some thousand shards, and over the groups: no task meets a row of every shard
    sizes = shards.select("shard", "n_tokens", F.shiftright("shard", 34).alias("group"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("group").agg(F.sum("n_tokens").alias("held")).withColumn("ahead", F.coalesce(F.sum("held").over(before), F.lit(0)))
    inside = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(groups, "group").select("shard", (F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("before"))
    offsets = bounded_broadcast(offsets, sizes.count(), BROADCAST_SHARDS)
    return rows.join(offsets, "shard").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.col("before") + F.col("local")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def wavelet_round_trip(docs: DataFrame) -> DataFrame:
    """Writes all documents to shard files and reads them back; an empty table gives an empty result."""
    return read_documents(write_shards(docs))
