"""Token ids of whole documents in wavelet-matrix shards, written and read back by Spark.

A shard holds the ids of a run of documents (ascending doc_id) as one compressed blob: a
header, the documents' ids and lengths, and one bit-plane per bit of the vocabulary with rank
counts per block.  ``WaveletShard`` answers access, rank, count, select and range decoding
from the blob, and unpacks only the planes' bytes.  Blobs are rows of a parquet table, so
any store Spark reads will do.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabsight.llm.common import fresh, materialize, named_id, tables, total_bytes, whole_id

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
SHARD_TOKENS = 1 << 19
PARTITION_BYTES = 16 << 20  # text per task
_MAGIC = b"WVM1"
_BLOCK = 512  # bits per rank count
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_AT_ONCE = 32


@lru_cache(maxsize=1)
def _library(path: str):
    """The tokenizer of a file, loaded once per Python worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Packed token ids of whole texts by the tokenizers library, without special tokens."""

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self._library = _library(path)
        self.bits = max(END_ID, self._library.get_vocab_size() - 1).bit_length()
        self.kind, self._code = (np.dtype("<u2"), "H") if self.bits <= 16 else (np.dtype("<u4"), "I")

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(texts), _AT_ONCE):  # the library's results are far larger than the ids
            found = self._library.encode_batch_fast(texts[start : start + _AT_ONCE], add_special_tokens=False)
            out += [array(self._code, e.ids).tobytes() for e in found]
        return out


def build(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit-planes, most significant first; each plane's zeros are moved before its ones."""
    planes, x = [], ids
    for level in range(bits - 1, -1, -1):
        on = (x & x.dtype.type(1 << level)) != 0
        planes.append(np.packbits(on, bitorder="little"))
        x = np.concatenate([x[~on], x[on]])
    return planes


def pack(doc_ids: np.ndarray, nameless: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One shard as a blob."""
    squeeze = zstandard.ZstdCompressor(level=1)
    sections = [doc_ids.astype("<i8").tobytes(), np.packbits(nameless).tobytes(), lengths.astype("<i8").tobytes()]
    for plane in build(ids, bits):
        blocks = np.pad(plane, (0, -len(plane) % (_BLOCK // 8)))
        counts = _ONES[blocks].reshape(-1, _BLOCK // 8).sum(axis=1, dtype=np.uint32)
        before = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        sections += [blocks.tobytes(), before.tobytes()]
    packed = [squeeze.compress(s) for s in sections]
    head = struct.pack("<4sHHQQ", _MAGIC, bits, len(packed), len(doc_ids), len(ids))
    return head + struct.pack(f"<{len(packed)}Q", *map(len, packed)) + b"".join(packed)


class WaveletShard:
    """Reads one blob; planes are unpacked when first used."""

    def __init__(self, blob: bytes) -> None:
        magic, self.bits, sections, self.n_docs, self.n = struct.unpack_from("<4sHHQQ", blob)
        if magic != _MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize("<4sHHQQ")
        sizes = struct.unpack_from(f"<{sections}Q", blob, at)
        starts = at + 8 * sections + np.concatenate([[0], np.cumsum(sizes)])
        self._packed = [blob[int(starts[i]) : int(starts[i + 1])] for i in range(sections)]
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.doc_ids = np.frombuffer(self._section(0), "<i8")
        self.nameless = np.unpackbits(np.frombuffer(self._section(1), np.uint8), count=self.n_docs).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(self._section(2), "<i8"))]).astype(np.int64)

    def _section(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._packed[i])

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self._planes:
            bits = np.frombuffer(self._section(3 + 2 * level), np.uint8)
            self._planes[level] = bits, np.frombuffer(self._section(4 + 2 * level), "<u4")
        return self._planes[level]

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        bits, before = self._plane(level)
        block, rest = divmod(i, _BLOCK)
        got, at = int(before[block]), block * (_BLOCK // 8)
        got += int(_ONES[bits[at : at + rest // 8]].sum())
        return got + (bin(int(bits[at + rest // 8]) & ((1 << rest % 8) - 1)).count("1") if rest % 8 else 0)

    def _zeros(self, level: int) -> int:
        return self.n - int(self._plane(level)[1][-1])

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level in range(self.bits):
            bits, _ = self._plane(level)
            on = bits[i // 8] >> (i % 8) & 1
            ones = self._ones(level, i)
            i = self._zeros(level) + ones if on else i - ones
            value = value << 1 | int(on)
        return value

    def _descend(self, token: int, stop: int) -> tuple[int, int]:
        """The interval of ``token`` below position ``stop`` after the last plane."""
        low, high = 0, stop
        for level in range(self.bits):
            ones_low, ones_high = self._ones(level, low), self._ones(level, high)
            if token >> (self.bits - 1 - level) & 1:
                zeros = self._zeros(level)
                low, high = zeros + ones_low, zeros + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return low, high

    def rank(self, token: int, stop: int) -> int:
        """Occurrences of a token before a position."""
        if token < 0 or token >> self.bits:
            return 0
        low, high = self._descend(token, stop)
        return high - low

    def count(self, token: int) -> int:
        """Occurrences of a token in the shard."""
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        low, high = 0, self.n
        while high - low > 1:  # the position is the last one with no more than k occurrences before it
            middle = (low + high) // 2
            low, high = (middle, high) if self.rank(token, middle) <= k else (low, middle)
        return low

    def decode(self) -> np.ndarray:
        """All ids of the shard, by undoing the moves of each plane from the last to the first."""
        kind = np.dtype("<u2") if self.bits <= 16 else np.dtype("<u4")
        x = np.zeros(self.n, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            on = np.unpackbits(self._plane(level)[0], count=self.n, bitorder="little").view(bool)
            zeros = self._zeros(level)
            y = np.empty_like(x)
            y[~on] = x[:zeros]
            y[on] = x[zeros:] | kind.type(1 << (self.bits - 1 - level))
            x = y
        return x


def write_shards(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The written table (part, before, n_ids, n_docs, file), one row per shard.

    Documents are range-partitioned by doc_id (nulls first, equal ids split by a row id) and
    encoded in that order; a shard ends with the document that fills it, so a very long text
    has a shard of its own.  ``before`` is the number of ids earlier in the same partition.
    """
    row = fresh(docs, "_row")
    n = tables(total_bytes(docs, "text"), PARTITION_BYTES)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(row, F.monotonically_increasing_id())
    ordered = narrow.repartitionByRange(n, "doc_id", row).sortWithinPartitions("doc_id", row).select(*whole_id(F.col("doc_id")), "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, before = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        names: list = []
        packed: list[bytes] = []
        held = 0

        def flush() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(packed), dtype=encoder.kind)
            lengths = np.array([len(p) // encoder.kind.itemsize for p in packed], dtype=np.int64)
            missing = np.array([x is None for x in names], dtype=bool)
            doc_ids = np.array([0 if x is None else x for x in names], dtype=np.int64)
            blob = pack(doc_ids, missing, lengths, ids, encoder.bits)
            return pd.DataFrame({"part": [part], "before": [before], "n_ids": [len(ids)], "n_docs": [len(names)], "file": [blob]})

        end = np.array([end_id], dtype=encoder.kind).tobytes()
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                some = pdf.iloc[start : start + 64]
                found = encoder.encode([t or "" for t in some["text"]])
                for name, nameless, ids in zip(some["doc_id"].tolist(), some["nameless"].tolist(), found):
                    names.append(None if nameless else name)
                    packed.append(ids + end)
                    held += len(packed[-1]) // encoder.kind.itemsize
                    if held >= shard_tokens:
                        yield flush()
                        before, held = before + held, 0
                        names.clear()
                        packed.clear()
        if names:
            yield flush()

    return materialize(ordered.mapInPandas(encode, "part int, before long, n_ids long, n_docs long, file binary"), "shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from written shards."""
    # one row per partition, whose number is bounded by the bytes a task takes
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("ids")).orderBy("part").toPandas()
    first = dict(zip(sizes["part"].tolist(), np.concatenate([[0], np.cumsum(sizes["ids"])[:-1]]).tolist())) if len(sizes) else {}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, before, blob in zip(pdf["part"], pdf["before"], pdf["file"]):
                shard = WaveletShard(blob)
                raw = shard.decode().astype("<u4").tobytes()
                at = shard.starts
                yield pd.DataFrame({
                    "doc_id": shard.doc_ids, "nameless": shard.nameless,
                    "start": first[int(part)] + int(before) + at[:-1], "n_tokens": np.diff(at),
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())],
                })

    found = shards.select("part", "before", "file").mapInPandas(
        decode, "doc_id long, nameless boolean, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", named_id()).drop("nameless")


def token_digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) through the written shards.

    Null and empty texts hold the end id alone.  Repeated rows are documents of their own, a
    null doc_id sorts first, an empty table gives no rows, other columns are ignored.
    """
    return read_documents(write_shards(docs, vocabulary))
