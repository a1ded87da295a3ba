"""Token ids in sharded wavelet matrices.

Every text is encoded, an end id is appended, and the ids of all documents in
ascending order of doc_id are cut into shards at document borders. A shard is one
binary value: a header, the document table, and a wavelet matrix of the ids with
its rank and select directories. Shards are rows of a Parquet table, so Spark writes and reads them on
any store that it knows, compressed with zstd, one shard at a time.

A wavelet matrix keeps one bit-plane per bit of the ids, from the highest; after
each plane the sequence is stably split into zeros and ones. Access, counting and
occurrence lookup walk the planes with rank and select, without decoding.

Scale: one range shuffle of the texts; a task holds one shard (about a quarter
million tokens) and its longest single text. Document offsets come from running sums
over the writer's partitions, then over the shards of each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.textkit import mix, slices, span_hashes

SHARD_TOKENS = 1 << 18
END_ID = 0
_HEADER = struct.Struct("<4sBxxxQQ")
_MAGIC = b"WVM2"
_RANK_BITS, _SAMPLE = 512, 4096
_TEXT_BYTES = 1 << 18


def _cumulated(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype("<u4")


#: Position of the nth one in each byte, from the highest bit; 8 where there is none.
_NTH = np.array([[*np.flatnonzero(np.unpackbits(np.uint8(b))), *[8] * 8][:8] for b in range(256)], np.uint8)


class WaveletMatrix:
    """Rank/select structure over a sequence of non-negative integers.

    A plane has its bits, the ones before each block of 512 bits (the rank
    directory), and the block of each 4096th one and each 4096th zero (the select
    directories). All are read from the file as they are: opening counts nothing,
    a rank reads one directory entry and one block, a select the entries between
    two samples and one block.
    """

    def __init__(self, width: int, n: int, planes: list[np.ndarray], zeros: list[int], ones: list[np.ndarray], samples: list[tuple[np.ndarray, np.ndarray]]):
        self.width, self.n, self.planes, self.zeros = width, n, planes, zeros
        self._ones, self._samples = ones, samples

    @classmethod
    def build(cls, ids: np.ndarray, width: int | None = None) -> WaveletMatrix:
        width = width or max(1, int(ids.max(initial=0)).bit_length())
        seq = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros, ones, samples = [], [], [], []
        for b in range(width - 1, -1, -1):
            bit = seq & seq.dtype.type(1 << b) != 0
            packed = np.packbits(bit)
            planes.append(packed)
            counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), _RANK_BITS // 8), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
            ones.append(_cumulated(counts))
            high, low = np.flatnonzero(bit), np.flatnonzero(~bit)
            samples.append(tuple((x[::_SAMPLE] // _RANK_BITS).astype("<u4") for x in (low, high)))
            zeros.append(len(low))
            seq = np.concatenate([seq[low], seq[high]])
        return cls(width, len(ids), planes, zeros, ones, samples)

    def to_bytes(self) -> bytes:
        parts = [np.array(self.zeros, "<u8").tobytes(), *(p.tobytes() for p in self.planes), *(x.tobytes() for x in self._ones)]
        return b"".join([*parts, *(x.tobytes() for pair in self._samples for x in pair)])

    @classmethod
    def from_bytes(cls, data: memoryview, width: int, n: int) -> WaveletMatrix:
        at = 0

        def read(kind, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        zeros = read("<u8", width).tolist()
        planes = [read(np.uint8, (n + 7) // 8) for _ in range(width)]
        ones = [read("<u4", -(-n // _RANK_BITS) + 1) for _ in range(width)]
        samples = [(read("<u4", -(-z // _SAMPLE)), read("<u4", -(-(n - z) // _SAMPLE))) for z in zeros]
        return cls(width, n, planes, zeros, ones, samples)

    def decode(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up: each plane's split is undone."""
        seq = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for k in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n).view(bool)
            joined = np.empty_like(seq)
            z = self.zeros[k]
            seq[z:] |= seq.dtype.type(1 << (self.width - 1 - k))
            joined[np.flatnonzero(~bit)] = seq[:z]
            joined[np.flatnonzero(bit)] = seq[z:]
            seq = joined
        return seq

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block, plane = i // _RANK_BITS, self.planes[k]
        lo, full = block * _RANK_BITS // 8, i // 8
        ones = int(self._ones[k][block]) + int(np.bitwise_count(plane[lo:full]).sum())
        return ones + ((int(plane[full]) >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.width):
            bit = (int(self.planes[k][i // 8]) >> (7 - i % 8)) & 1
            ones = self._rank1(k, i)
            value, i = value << 1 | bit, self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        """Where occurrences of symbol in [lo, hi) stand after the last plane."""
        if symbol < 0 or symbol.bit_length() > self.width:
            return 0, 0
        for k in range(self.width):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            if symbol >> (self.width - 1 - k) & 1:
                lo, hi = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of symbol before position i."""
        lo, hi = self._range(symbol, 0, i)
        return hi - lo

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        hi = self.n if hi is None else min(hi, self.n)
        a, b = self._range(symbol, min(max(lo, 0), hi), hi)
        return b - a

    def _select_bit(self, k: int, bit: int, nth: int) -> int:
        """Position of the nth (from 0) bit of this kind in plane k."""
        ones, samples, plane = self._ones[k], self._samples[k][bit], self.planes[k]

        def before(block: int) -> int:
            own = int(ones[block])
            return own if bit else block * _RANK_BITS - own

        sample = nth // _SAMPLE
        lo = int(samples[sample])
        hi = int(samples[sample + 1]) if sample + 1 < len(samples) else len(ones) - 2
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if before(mid) <= nth else (lo, mid - 1)
        left = nth - before(lo)
        at = lo * _RANK_BITS // 8
        block = plane[at : at + _RANK_BITS // 8]
        block = block if bit else ~block
        upto = np.cumsum(np.bitwise_count(block), dtype=np.int64)
        byte = int(np.searchsorted(upto, left, side="right"))
        return 8 * (at + byte) + int(_NTH[block[byte], left - (int(upto[byte - 1]) if byte else 0)])

    def _up(self, symbol: int, at: int) -> int:
        """Where what stands at ``at`` after the last plane stood in the sequence."""
        for k in range(self.width - 1, -1, -1):
            bit = symbol >> (self.width - 1 - k) & 1
            at = self._select_bit(k, bit, at - self.zeros[k] if bit else at)
        return at

    def _select_bits(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Like ``_select_bit``, for many at a time: one search of the directory, one block each."""
        before = self._ones[k].astype(np.int64)
        before = before if bit else np.arange(len(before)) * _RANK_BITS - before
        block = np.searchsorted(before[:-1], nth, side="right") - 1
        at = block[:, None] * (_RANK_BITS // 8) + np.arange(_RANK_BITS // 8)
        own = self.planes[k][np.minimum(at, len(self.planes[k]) - 1)]
        own = own if bit else ~own
        upto = np.cumsum(np.bitwise_count(own), axis=1, dtype=np.int64)
        left = nth - before[block]
        byte = (upto <= left[:, None]).sum(axis=1)
        rows = np.arange(len(nth))
        left -= np.where(byte > 0, upto[rows, byte - 1], 0)
        return 8 * at[rows, byte] + _NTH[own[rows, byte], left]

    def occurrences(self, symbol: int) -> np.ndarray:
        """All positions of symbol, ascending, by select from the last plane up, some thousand at a time."""
        lo, hi = self._range(symbol, 0, self.n)
        out = [np.zeros(0, np.int64)]
        for first in range(lo, hi, _SAMPLE):
            at = np.arange(first, min(first + _SAMPLE, hi))
            for k in range(self.width - 1, -1, -1):
                bit = symbol >> (self.width - 1 - k) & 1
                at = self._select_bits(k, bit, at - self.zeros[k] if bit else at)
            out.append(at)
        return np.concatenate(out)

    def select(self, symbol: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        return self._up(symbol, lo + nth)


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    matrix = WaveletMatrix.build(ids)
    known = np.array([x is not None for x in doc_ids], bool)
    return b"".join(
        [
            _HEADER.pack(_MAGIC, matrix.width, len(ids), len(doc_ids)),
            np.array([x if x is not None else 0 for x in doc_ids], "<i8").tobytes(),
            known.tobytes(),
            np.array(lengths, "<u8").tobytes(),
            matrix.to_bytes(),
        ]
    )


def open_shard(data: bytes) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
    """Document ids, token counts and the wavelet matrix of a shard."""
    magic, width, n, docs = _HEADER.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a wavelet shard")
    at = _HEADER.size
    known = np.frombuffer(data, bool, docs, at + 8 * docs)
    doc_ids = pa.array(np.frombuffer(data, "<i8", docs, at), pa.int64(), mask=~known)
    lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    return doc_ids, lengths, WaveletMatrix.from_bytes(memoryview(data)[at + 17 * docs :], width, n)


_MEMORY_ENTRIES, _TOGETHER = 1_500_000, 512
_encoders: dict[str, PieceEncoder] = {}
_HASH_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_CODES = [np.random.default_rng(k).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (71, 72)]
_HEAD = np.uint64(0xD6E8FEB86659FD93)


class _Table:
    """Numbers of 64-bit keys by open addressing, looked up many at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        mask = np.uint64(len(self.keys) - 1)
        at = keys & mask
        out = np.where(self.keys[at] == keys, self.numbers[at], -1)
        todo = np.flatnonzero((out < 0) & (self.numbers[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & mask
            spot = at[todo]
            same = self.keys[spot] == keys[todo]
            out[todo[same]] = self.numbers[spot[same]]
            todo = todo[~same & (self.numbers[spot] >= 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number new, distinct keys in their order."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            old = self.keys[self.numbers >= 0][np.argsort(self.numbers[self.numbers >= 0])]
            bits = int(2 * (self.size + len(keys))).bit_length()
            self.__init__(bits)
            self.add(old)
        mask, numbers = np.uint64(len(self.keys) - 1), np.arange(self.size, self.size + len(keys), dtype=np.int32)
        at, todo = keys & mask, np.arange(len(keys))
        while len(todo):
            free = todo[self.numbers[at[todo]] < 0]
            spot, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[spot], self.numbers[spot] = keys[won], numbers[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + np.uint64(1)) & mask
        self.size += len(keys)


class _Growing:
    """An array that takes more at its end; room doubles, so that each value is copied a few times at most."""

    def __init__(self, kind: type, room: int = 1 << 12):
        self.all, self.size = np.zeros(room, kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.all):
            wider = np.empty(max(2 * len(self.all), self.size + len(more)), self.all.dtype)
            wider[: self.size] = self.all[: self.size]
            self.all = wider
        self.all[self.size : self.size + len(more)] = more
        self.size += len(more)


class PieceEncoder:
    """Whole-text encoding through a memory of space-separated pieces.

    Byte-level pre-tokenisation always cuts before a space that a non-space
    follows, so a text's ids are those of its pieces, each with the space before
    it, joined. Pieces are known by two independent hashes, of 64 and 32 bits; one that meets
    another's first hash is noticed by the second. New pieces are encoded together
    in one text, where a piece's ids begin at a token that begins with a space.
    Texts in which a space is followed by another blank or ends the text, those
    with a piece that was so noticed, and all texts under other kinds of tokenizer
    are encoded whole. The memory only saves time; it is emptied when it holds
    ``_MEMORY_ENTRIES`` pieces, at about 80 MB.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        if hasattr(self._tokenizer.model, "_resize_cache"):
            self._tokenizer.model._resize_cache(0)  # the memory here takes its place
        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        pre = how.get("pre_tokenizer") or {}
        self._by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not how.get("normalizer")
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._spaced[[k for t, k in vocabulary.items() if t.startswith("\u0120")]] = True
        self._clear()

    def _clear(self) -> None:
        self._table = _Table()
        self._second, self._flat, self._start = _Growing(np.uint32), _Growing(np.uint32), _Growing(np.int32)
        self._start.extend(np.zeros(1, np.int32))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _later(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces with a space before each, end to end, and where each begins."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.concatenate(self._whole([" " + " ".join(pieces[k : k + _TOGETHER]) for k in range(0, len(pieces), _TOGETHER)]))
        starts = np.flatnonzero(self._spaced[ids])
        if len(starts) == len(pieces) and starts[0] == 0:
            return ids, starts
        own = self._whole([" " + p for p in pieces])
        return np.concatenate(own), np.cumsum([0, *map(len, own[:-1])])

    def _learn(self, keys: np.ndarray, second: np.ndarray, pieces: list[str], heads: np.ndarray) -> None:
        order = np.argsort(heads, kind="stable")  # later pieces first, then heads
        n = int((~heads).sum())
        ids, starts = self._later([pieces[k] for k in order[:n]])
        own = self._whole([pieces[k] for k in order[n:]])
        lengths = np.concatenate([np.diff(np.append(starts, len(ids))), np.array([len(x) for x in own], np.int64)])
        self._start.extend((self._flat.size + np.cumsum(lengths)).astype(np.int32))
        self._flat.extend(np.concatenate([ids, *own]))
        self._second.extend(second[order])
        self._table.add(keys[order])

    def _pieces(self, texts: list[bytes]):
        """Spans of all pieces, their two hashes, which are heads, which are ambiguous, and pieces per text."""
        data = b" ".join(texts) + b"   "  # so that two bytes can be read beyond any piece
        buf = np.frombuffer(data, np.uint8)
        n = len(buf) - 2
        ends = np.flatnonzero(buf[:n] == 0x20)
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [mix(span_hashes(buf, starts, ends, codes, base)) for codes, base in zip(_CODES, _HASH_BASES, strict=True)]
        text_starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        heads = np.zeros(len(ends), bool)
        first = np.searchsorted(starts, text_starts)
        heads[first] = True
        hashes[0][heads] ^= _HEAD
        a, b, c = buf[starts], buf[starts + 1], buf[starts + 2]
        blank = (a == 0x20) | ((a >= 0x09) & (a <= 0x0D)) | ((a >= 0x1C) & (a <= 0x1F))
        blank |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        return data, starts, ends, hashes[0], (hashes[1] >> np.uint64(32)).astype(np.uint32), heads, blank & ~heads, np.diff(np.append(first, len(ends)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if not self._by_piece:
            return self._whole(texts)
        if self._table.size > _MEMORY_ENTRIES:
            self._clear()
        data, starts, ends, one, two, heads, odd, counts = self._pieces([t.encode() for t in texts])
        at = self._table.find(one)
        new = np.flatnonzero((at < 0) & ~odd)
        if len(new):
            keys, first = np.unique(one[new], return_index=True)
            spots = new[first]
            self._learn(keys, two[spots], [data[starts[k] : ends[k]].decode() for k in spots.tolist()], heads[spots])
            at[new] = self._table.find(one[new])
        odd |= (at < 0) | (self._second.all[at] != two)
        at[odd] = 0
        begin = self._start.all[at]
        lengths = self._start.all[at + 1] - begin
        upto = np.cumsum(lengths)
        flat = self._flat.all[np.repeat(begin - (upto - lengths), lengths) + np.arange(upto[-1])]
        last = np.cumsum(counts)
        out = np.split(flat, upto[last[:-1] - 1])
        again = np.unique(np.searchsorted(last, np.flatnonzero(odd), side="right")).tolist()
        for k, ids in zip(again, self._whole([texts[k] for k in again]), strict=True):
            out[k] = ids
        return out


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _shards(path: str, end_id: int, shard_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        total = 0

        def shard() -> pa.RecordBatch:
            data = pack_shard(docs, [len(x) for x in ids], np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, seq, len(docs), total)] + [pa.array([data], pa.binary())], names=["part", "seq", "n_docs", "n_tokens", "payload"])

        for batch in slices(batches, limit=_TEXT_BYTES):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc, own in zip(batch.column(0).to_pylist(), encoder(path).encode(texts), strict=True):
                docs.append(doc)
                ids.append(np.append(own, np.uint32(end_id)))
                total += len(ids[-1])
                if total >= shard_tokens:
                    yield shard()
                    docs, ids, total, seq = [], [], 0, seq + 1
        if docs:
            yield shard()

    return run


_SHARD = "part long, seq long, n_docs long, n_tokens long, payload binary"


def write_shards(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode doc_id, text in ascending doc_id order into a table of shards at ``path``.

    Null texts are empty and have the end id only. Rows with a null id come
    first; rows that share an id follow each other by text. Other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_shards(tokenizer_path, end_id, shard_tokens), _SHARD).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, n_docs, n_tokens, payload of each shard."""
    return spark.read.schema(_SHARD).parquet(path)


def _with_first(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``first``, the number of ids in all shards before, for rows of part and seq; payloads don't travel."""
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Parts are the writer's partitions: their table is small, each part's shards are summed by themselves.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("base"))
    inside = shards.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("within"))
    firsts = inside.join(parts, "part").select("part", "seq", (F.col("base") + F.col("within")).alias("first"))
    return rows.join(firsts, ["part", "seq"])


def _over_shards(what: Callable[[bytes], list[pa.Array]], names: list[str]):
    """Columns made from each payload, beside its part and seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own = what(b.column(2)[k].as_buffer().to_pybytes())
                n = len(own[0])
                where = [pa.array(np.full(n, b.column(c)[k].as_py(), np.int64)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*where, *own], names=["part", "seq", *names])

    return run


def _documents(payload: bytes) -> list[pa.Array]:
    docs, lengths, matrix = open_shard(payload)
    raw = matrix.decode().astype("<u4")
    ends = np.cumsum(lengths)
    crcs = [zlib.crc32(raw[b - n : b]) for b, n in zip(ends, lengths, strict=True)]
    return [docs, pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards."""
    run = _over_shards(_documents, ["doc_id", "own_start", "n_tokens", "ids_crc32"])
    rows = shards.select("part", "seq", "payload").mapInArrow(run, "part long, seq long, doc_id long, own_start long, n_tokens long, ids_crc32 long")
    return _with_first(rows, shards).select("doc_id", (F.col("first") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """(part, seq, n): occurrences of a token in each shard, from rank alone."""
    run = _over_shards(lambda x: [pa.array([open_shard(x)[2].count(token)], pa.int64())], ["n"])
    return shards.select("part", "seq", "payload").mapInArrow(run, "part long, seq long, n long")


def locate_token(shards: DataFrame, token: int) -> DataFrame:
    """position: where a token stands in the sequence of all ids, by select."""
    run = _over_shards(lambda x: [pa.array(open_shard(x)[2].occurrences(token), pa.int64())], ["at"])
    rows = shards.select("part", "seq", "payload").mapInArrow(run, "part long, seq long, at long")
    return _with_first(rows, shards).select((F.col("first") + F.col("at")).alias("position"))
