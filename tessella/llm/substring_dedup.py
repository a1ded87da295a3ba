"""Near-duplicate passages by compact windows.

A document is its sequence of 5-word shingles. A passage of 50 words (46 shingles)
on one side with similarity 0.75 has 35 shingles or more on the other, and at most a
quarter of the distinct shingles of either side are not shared.

Thinning, exact: the codes of all shingles are dealt to 256 buckets, and each slice of
documents gets back a bit per code that tells if another document has it. Only stretches of
35 positions or more stay in which three quarters are shared with anyone. A frequent line
alone is no such stretch, so it joins no documents. Both readers of the codes use one exchange.

Windows: for one hash function, the Cartesian tree of the shingles' hashes (smallest on
top) groups the subsequences of a stretch: all that begin in [left, centre] and end in
[centre, right] of a node have the node's hash as their min-hash. Nodes that span fewer
than 35 shingles hold no passage and are left out. Nodes come from sliding minima and
their spans from doubling tables of range minima, so numpy does the work.

Stretches equal to one of a smaller document are tied to the smallest and take no further part.
Two documents with a like passage have windows of one min-hash, in each function with a
chance equal to the passages' similarity; any one of six functions makes them meet, so a
pair at exactly 0.75 is missed with a chance of 2.4e-4. Windows of one min-hash are tied, without
pairs, by equal runs around their centres, to the smallest document that has the run; tied
ones are one class. So are windows that passages found by these ties lead to the same words of
one document. Between the classes that are left, windows are compared within 45 shingles of their
centres: where a passage is certain they become one class, of which a tree of pairs
goes on, and of the others all pairs go on whose shared and unshared shingles
allow one. A longer passage has a piece of 46 shingles of which that holds, with windows of
its own. Candidates are aligned: a passage
is a longest stretch of at least 50 words, of either side, with at most as many unshared
shingles as similarity 0.75 allows, confirmed on the sets of both sides. A pair that a class rests on
for which no longest stretch is found gets the passage around its centres.

Scale: a passage that a third of all documents share costs each of them a row or two,
never pairs among them. Pairs are made in blocks of fixed size and become rows only if the
shingles beside their centres allow a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch
from tessella.llm.textkit import SHINGLE_WORDS, as_bytes, mix, shingle_hashes, signed, slices, words_of

MIN_WORDS = 50
FUNCTIONS = 6
SIMILARITY = 0.75
_SPAN = MIN_WORDS - SHINGLE_WORDS + 1
_OTHER_SPAN = -(-_SPAN * 3 // 4)  # what the other side has at least
BLOCK = 4096
_CHUNK = 256  # as many windows are compared at once
_CODE_BYTES = 5  # the first is the bucket that counts the code
_BESIDE, _BOTH = _SPAN - 1, _SPAN // 2
_DRIFT = 16  # shingles that inserted or lost words may shift a passage between two windows
#: Similarity 0.75 leaves a side at most one unshared shingle for three shared ones. The first price asks for
#: less than that; what the sets then don't bear out is searched again with ever fewer unshared ones, in the end with none.
_MISMATCHES = (-2, -3, -4, -6, -13, -27, -(1 << 30))
_BY = np.random.default_rng(41).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def compact_windows(hashes: np.ndarray, borders: np.ndarray, span: int = _SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of all tree nodes of ``span`` positions or more.

    ``borders`` marks positions between documents; no window crosses one. Equal
    hashes are ordered by position.
    """
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none
    bits = np.uint64(max(1, int(n).bit_length()))
    place = np.arange(n, dtype=np.uint64)
    value = ((hashes >> bits) << bits) | place
    value[borders] = borders.astype(np.uint64)
    # One border stands before the first and after the last position.
    edges = np.concatenate([[-1], borders, [n]])
    longest = int(np.diff(edges).max())
    if longest - 1 < span:
        return none, none, none
    levels = [value]
    while 2 << len(levels) - 1 <= longest:
        half = 1 << len(levels) - 1
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]) if len(levels[-1]) > half else levels[-1][:0])
    k = int(span).bit_length() - 1
    least = np.minimum(levels[k][: n - span + 1], levels[k][span - (1 << k) :][: n - span + 1])
    centre = np.unique(least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    centre = centre[~np.isin(centre, borders)]
    own = value[centre]
    left, right = centre.copy(), centre.copy()
    for j in range(len(levels) - 1, -1, -1):
        table, step = levels[j], 1 << j
        if not len(table):
            continue
        ok = (right + 1 + step <= n) & (table[np.minimum(right + 1, len(table) - 1)] > own)
        right[ok] += step
        ok = (left - step >= 0) & (table[np.clip(left - step, 0, len(table) - 1)] > own)
        left[ok] -= step
    wide = right - left + 1 >= span
    return left[wide], centre[wide], right[wide]


def _packed(codes: np.ndarray) -> np.ndarray:
    """Codes of 40 bits as rows of bytes, the highest first."""
    return np.ascontiguousarray(codes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _CODE_BYTES :])


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // _CODE_BYTES, 8), np.uint8)
    wide[:, 8 - _CODE_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, _CODE_BYTES)
    return wide.view(">u8")[:, 0].astype(np.uint64)


_SLICE = "ids array<long>, starts array<long>, counts array<long>, data binary"


def _slice_batch(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, data: bytes, **more: int) -> pa.RecordBatch:
    """A row: of each stretch its document, first shingle and number of shingles, and the codes of all of them."""
    names = [*more, "ids", "starts", "counts", "data"]
    return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in more.values()), *(pa.array([x], pa.list_(pa.int64())) for x in (ids, starts, counts)), pa.array([data], pa.binary())], names=names)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        hashes, offsets = shingle_hashes(words_of(as_bytes(b.column(1))))
        counts = np.diff(offsets)
        # Shorter texts hold no passage.
        long = counts >= _OTHER_SPAN
        if long.any():
            codes = hashes[np.repeat(long, counts)] >> np.uint64(64 - 8 * _CODE_BYTES)
            yield _slice_batch(b.column(0).to_numpy()[long], np.zeros(long.sum(), np.int64), counts[long], _packed(codes).tobytes())


def _by_code(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of a slice, ascending; which stand in two of its documents; where they begin in the last array, the order by code."""
    order = np.argsort(codes, kind="stable")
    ordered, of = codes[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    several = np.minimum.reduceat(of, first) < np.maximum.reduceat(of, first)
    return ordered[first], several, first, order


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice and bucket, the distinct codes: their lower 32 bits, ascending."""
    for b in batches:
        for at in range(b.num_rows):
            code = np.unique(_unpacked(b.column("data")[at].as_py()))
            bucket = code >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 32)))
            low = (code & np.uint64(0xFFFFFFFF)).astype("<u4")
            parts = [x.tobytes() for x in np.split(low, cuts[1:])]
            n = b.column("slice")[at].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "slice", "codes"])


def _shared(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit for each code of a slice and bucket: another slice has it too."""
    for t in _runs(frames, 1):
        parts = [np.frombuffer(x.as_buffer(), "<u4") for c in t.column("codes").chunks for x in c]
        ordered = np.sort(np.concatenate(parts))
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        bits = []
        for x in parts:
            at = np.minimum(np.searchsorted(twice, x), max(len(twice) - 1, 0))
            bits.append(np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), bool)).tobytes())
        names = ["bucket", "slice", "bits"]
        for lo in range(0, len(bits), 1024):
            own = t.slice(lo, 1024).combine_chunks()
            yield pa.RecordBatch.from_arrays([own.column("bucket").combine_chunks(), own.column("slice").combine_chunks(), pa.array(bits[lo : lo + 1024], pa.binary())], names=names)


def _dense(shared: np.ndarray, again: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Positions in stretches of _OTHER_SPAN or more in which at most one of four is not shared; ``again`` marks codes that their document had before.

    An unshared code counts once, as a passage's similarity goes by distinct ones.
    """
    n = len(shared)
    step = np.where(shared, 1, np.where(again, 0, -3))
    step[borders] = -4 * n - 4
    sums = np.concatenate([[0], np.cumsum(step)])
    ahead = np.maximum.accumulate(sums[::-1])[::-1]
    begin = np.arange(n)
    end = np.searchsorted(-ahead, -sums[:-1], side="right") - 1
    wide = end - begin >= _OTHER_SPAN
    edges = np.bincount(begin[wide], minlength=n + 1) - np.bincount(end[wide], minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with their shared stretches only."""
    for b in batches:
        for at in range(b.num_rows):
            ids, starts, counts = (b.column(c)[at].values.to_numpy() for c in ("ids", "starts", "counts"))
            codes = _unpacked(b.column("data")[at].as_py())
            stretch = np.repeat(np.arange(len(ids)), counts)
            begins = np.cumsum(counts) - counts
            own, shared, first, order = _by_code(codes, np.unique(ids, return_inverse=True)[1][stretch])
            shared = shared.copy()
            bucket = own >> np.uint64(32)
            for part in b.column("back")[at].as_py():
                lo, hi = np.searchsorted(bucket, [part["bucket"], part["bucket"] + 1])
                shared[lo:hi] |= np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=hi - lo).astype(bool)
            flags, again = np.empty(len(codes), bool), np.zeros(len(codes), bool)
            flags[order] = np.repeat(shared, np.diff(np.append(first, len(codes))))
            ordered, of = codes[order], stretch[order]
            again[order[1:]] = (ordered[1:] == ordered[:-1]) & (of[1:] == of[:-1])
            # One position between stretches.
            spread = np.arange(len(codes)) + stretch
            borders = (begins + np.arange(len(ids)))[1:] - 1
            wide = [np.zeros(len(codes) + len(ids) - 1, bool) for _ in range(2)]
            wide[0][spread], wide[1][spread] = flags, again
            kept = _dense(*wide, borders)
            kept[borders] = False
            edge = np.flatnonzero(np.diff(kept, prepend=False, append=False))
            lo, hi = edge[0::2], edge[1::2]
            if len(lo):
                of = np.searchsorted(begins + np.arange(len(ids)), lo, side="right") - 1
                yield _slice_batch(ids[of], starts[of] + lo - of - begins[of], hi - lo, _packed(codes[kept[spread]]).tobytes(), slice=b.column("slice")[at].as_py())


def _thin(scratch: Scratch, coded: DataFrame, name: str) -> DataFrame:
    # Both readers use one exchange, so the codes of all shingles are written once.
    table = coded.select(F.monotonically_increasing_id().alias("slice"), "*").repartition("slice")
    codes = table.mapInArrow(_dealt, "bucket int, slice long, codes binary")
    bits = codes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "bucket int, slice long, bits binary")
    back = bits.groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias("back"))
    return scratch.keep(table.join(back, "slice").mapInArrow(_thinned, f"slice long, {_SLICE}").mapInArrow(_apart, "doc_id long, start long, n long, data binary"), name)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per stretch."""
    for b in batches:
        for at in range(b.num_rows):
            ids, starts, counts = (b.column(c)[at].values.to_numpy() for c in ("ids", "starts", "counts"))
            data = b.column("data")[at].as_py()
            ends = np.cumsum(counts) * _CODE_BYTES
            parts = [data[lo:hi] for lo, hi in zip((ends - counts * _CODE_BYTES).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(starts), pa.array(counts), pa.array(parts, pa.binary())], names=["doc_id", "start", "n", "data"])


def _joined(key: np.ndarray, doc: np.ndarray, left: np.ndarray, centre: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of one stretch and min-hash that overlap, as in repeated text, become one; the first centre stays."""
    if not len(key):
        return key, doc, left, centre, right
    order = np.lexsort((left, key, doc))
    key, doc, left, centre, right = (x[order] for x in (key, doc, left, centre, right))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (left[1:] > right[:-1] + 1)])
    first = np.flatnonzero(new)
    return key[first], doc[first], left[first], centre[first], np.maximum.reduceat(right, first)


#: Where runs that are compared as a whole begin before a centre: those of _OTHER_SPAN shingles, and of _SPAN.
_BEFORE = tuple((k * (_OTHER_SPAN - 1) // 4, k * (_SPAN - 1) // 4) for k in range(5))
_POWER = 0x9E3779B97F4A7C15


def _prints(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """A function of centres and their stretches: per run of _BEFORE a hash of its shingles, 0 where it leaves the stretch.

    A run of _OTHER_SPAN makes a passage with any _SPAN shingles around it if two of its shingles at most are repeated;
    where more may be, a run of _SPAN takes its place, as equal ones are a passage whatever they hold.
    """
    n = len(codes)
    powers = np.full(n + 1, _POWER, np.uint64)
    powers[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes, salt=900) * np.cumprod(powers)[:n])])
    powers[1:] = pow(_POWER, -1, 1 << 64)
    inverse = np.cumprod(powers)
    before = _previous(codes)
    repeated = np.concatenate([[0], np.cumsum((before >= 0) & (np.arange(n) - before < _OTHER_SPAN))])

    def prints(centre: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
        out = []
        for short, long in _BEFORE:
            lo = centre - short
            ok = (lo >= begins[of]) & (lo + _OTHER_SPAN <= ends[of])
            lo = np.where(ok, lo, 0)
            plain = ok & (repeated[np.where(ok, lo + _OTHER_SPAN, 0)] - repeated[lo] <= _OTHER_SPAN - 33)
            other = centre - long
            fits = (other >= begins[of]) & (other + _SPAN <= ends[of]) & ~plain
            lo, size = np.where(plain, lo, np.where(fits, other, 0)), np.where(plain, _OTHER_SPAN, np.where(fits, _SPAN, 0))
            out.append(np.where(size > 0, mix((sums[lo + size] - sums[lo]) * inverse[lo] + size.astype(np.uint64)) | np.uint64(1), np.uint64(0)))
        return out

    return prints


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of all functions, whether their stretch has _SPAN shingles, and the hashes of runs around their centres."""
    for b in slices(batches, "data"):
        ids, starts, counts = (b.column(c).to_numpy() for c in ("doc_id", "start", "n"))
        codes = _unpacked(b"".join(b.column("data").to_pylist()))
        # One position between stretches.
        begins = np.cumsum(counts) - counts + np.arange(len(ids))
        spread = np.zeros(len(codes) + len(ids) - 1, np.uint64)
        spread[np.arange(len(codes)) + np.repeat(np.arange(len(ids)), counts)] = codes
        prints = _prints(spread, begins, begins + counts)
        for f, by in enumerate(_BY):
            left, centre, right = compact_windows(mix(spread * by, salt=f), begins[1:] - 1, _OTHER_SPAN)
            of = np.searchsorted(begins, centre, side="right") - 1
            key, of, left, centre, right = _joined(mix(spread[centre], salt=500 + f), of, left, centre, right)
            shift = starts[of] - begins[of]
            # What stands beside the centre belongs to it, as far as the stretch goes.
            left, right = np.minimum(left, np.maximum(centre - _BESIDE, begins[of])), np.maximum(right, np.minimum(centre + _BESIDE, begins[of] + counts[of] - 1))
            arrays = [pa.array(signed(key)), pa.array(ids[of]), *(pa.array((x + shift).astype(np.int32)) for x in (left, centre, right)), pa.array(counts[of] >= _SPAN), *(pa.array(signed(x)) for x in prints(centre, of))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "lo", "at", "hi", "whole", *(f"print{k}" for k in range(len(_BEFORE)))])


_ROW = "key long, doc_id long, lo int, at int, hi int, whole boolean, " + ", ".join(f"print{k} long" for k in range(len(_BEFORE)))
_TIED = "key long, doc_id long, lo int, hi int, at int, class int, n int, other_id long, other_lo int, other_hi int, other_at int"


def _by_key(frames: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Some thousand rows at a time, all those of a key (the first column) together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in frames:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if n + batch.num_rows >= rows and held and (len(cuts) or key[0] != held[-1].column(0)[-1].as_py()):
            cut = int(cuts[-1]) if key[0] == held[-1].column(0)[-1].as_py() else 0
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _tied(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a min-hash that have a run around their centres in common are one class, tied to the smallest
    document whose stretch has _SPAN shingles; the windows of min-hashes with several classes come back too.
    """
    for t in _by_key(frames):
        key, doc, lo, at, hi, whole, *prints = (t.column(k).to_numpy() for k in range(t.num_columns))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        own = np.flatnonzero(np.repeat(several, np.diff(np.append(first, len(key)))))
        if not len(own):
            continue
        key, doc, lo, at, hi, whole, *prints = (x[own] for x in (key, doc, lo, at, hi, whole, *prints))
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        n = len(key)
        label, sets, links = np.arange(n), [], []
        for p in prints:
            of = mix(p.view(np.uint64) + mix(group.astype(np.uint64), salt=901))
            order = np.flatnonzero(p != 0)
            order = order[np.lexsort((at[order], doc[order], ~whole[order], of[order]))]
            if not len(order):
                continue
            begin = np.flatnonzero(np.concatenate([[True], of[order[1:]] != of[order[:-1]]]))
            size = np.diff(np.append(begin, len(order)))
            valid = whole[order[begin]]
            order, begin, size = order[np.repeat(valid, size)], None, size[valid]
            if not len(order):
                continue
            begin = np.cumsum(size) - size
            least = np.repeat(order[begin], size)
            # The smallest one's other windows are tied to another document.
            strange = np.where(doc[order] != doc[least], np.arange(len(order)), len(order))
            second = np.repeat(np.minimum.reduceat(strange, begin), size)
            same = doc[order] == doc[least]
            other = np.where(same, order[np.minimum(second, len(order) - 1)], least)
            ok = (order != least) & (~same | ((second < len(order)) & (whole[order] | whole[other])))
            links.append(order[ok] * n + other[ok])
            sets.append((order, begin, size))
        changed = True
        while changed:
            before = label.copy()
            for order, begin, size in sets:
                label[order] = np.repeat(np.minimum.reduceat(label[order], begin), size)
            label = label[label]
            changed = bool((label != before).any())
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, n))
        mixed = np.minimum.reduceat(label, start) < np.maximum.reduceat(label, start)
        rows = np.flatnonzero(np.repeat(mixed, size))
        link = np.unique(np.concatenate(links)) if links else np.zeros(0, np.int64)
        x, y = link // n, link % n
        x, y = np.where(doc[x] > doc[y], x, y), np.where(doc[x] > doc[y], y, x)
        none = lambda kind: pa.nulls(len(rows), kind)
        mine = [pa.array(key[rows]), *(pa.array(v[rows]) for v in (doc, lo, hi, at)), pa.array((label - start[group])[rows].astype(np.int32)), pa.array(size[group][rows].astype(np.int32)), none(pa.int64()), *(none(pa.int32()) for _ in range(3))]
        ties = [pa.nulls(len(x), pa.int64()), *(pa.array(v[x]) for v in (doc, lo, hi, at)), *(pa.nulls(len(x), pa.int32()) for _ in range(2)), *(pa.array(v[y]) for v in (doc, lo, hi, at))]
        names = ["key", "doc_id", "lo", "hi", "at", "class", "n", "other_id", "other_lo", "other_hi", "other_at"]
        for arrays in (mine, ties):
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of 256 rows at most, as lists and texts of many rows take much memory as Python's objects."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield b.slice(at, 256)


def _pair_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["doc_id", "other_id", "lo", "hi", "other_lo", "other_hi", "at", "other_at", "sure"])


def _runs(frames: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree in the first ``keys`` columns, which come one after the other."""
    held: list[pa.RecordBatch] = []
    run = None
    for batch in frames:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            this = tuple(ids[:, lo])
            if run is not None and this != run:
                yield pa.Table.from_batches(held)
                held = []
            run = this
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _full_runs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of a key and two blocks; those of one block each come several at a time, _CHUNK rows at most together, as the work on a few rows is the same for many."""
    held: list[pa.Table] = []
    rows = 0
    for t in _runs(frames, 3):
        if t.column(1)[0].as_py() != t.column(2)[0].as_py() or t.num_rows > _CHUNK:
            yield t
            continue
        if held and rows + t.num_rows > _CHUNK:
            yield pa.concat_tables(held)
            held, rows = [], 0
        held.append(t)
        rows += t.num_rows
    if held:
        yield pa.concat_tables(held)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with 32 bits of each shingle beside their centre, 0 where there is none."""
    beside = np.arange(2 * _BESIDE + 1)
    for b in _few(batches):
        out: list[list] = [[] for _ in range(8)]
        for doc, start, data, wanted in zip(b.column("doc_id").to_pylist(), b.column("start").to_pylist(), b.column("data"), b.column("w"), strict=True):
            own = (_unpacked(data.as_buffer()) & np.uint64(0xFFFFFFFF)).astype("<u4")
            codes = np.zeros(len(own) + 2 * _BESIDE, "<u4")
            codes[_BESIDE : _BESIDE + len(own)] = np.maximum(own, 1)
            key, lo, hi, at, kind, n = (wanted.values.field(k).to_numpy() for k in ("key", "lo", "hi", "at", "class", "n"))
            here = np.flatnonzero((at >= start) & (at < start + len(own)))
            for col, v in zip(out, (key, np.full(len(key), doc), lo, hi, at, kind, n), strict=False):
                col.append(v[here])
            out[7] += [x.tobytes() for x in codes[(at[here] - start)[:, None] + beside]]
        if out[7]:
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out[:7]), pa.array(out[7], pa.binary())], names=["key", "doc_id", "lo", "hi", "at", "class", "n", "beside"])


_SPANS = "doc_id long, other_id long, lo int, hi int, at int, other_lo int, other_hi int, other_at int, sure boolean"


def _met(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run, pairs of windows of two documents and classes that may have a passage of _SPAN around both centres.

    Windows that surely have one become one class; of these pairs a tree comes back, marked as sure, and all pairs between the classes that then are left.
    """
    names = [x.split()[0] for x in _SPANS.split(", ")]
    for t in _full_runs(frames):
        of, first, second, block, doc, lo, hi, at, kind = (t.column(k).to_numpy() for k in range(9))
        beside = np.frombuffer(b"".join(t.column(9).to_pylist()), "<u4").reshape(-1, 2 * _BESIDE + 1)
        order = np.lexsort((doc, of))
        of, block, doc, lo, hi, at, kind, beside = (x[order] for x in (of, block, doc, lo, hi, at, kind, beside))
        # Classes are those of the whole run.
        _, least, label = np.unique(np.stack([np.cumsum(np.diff(of, prepend=of[0]) != 0), kind]), axis=1, return_index=True, return_inverse=True)
        label = least[label]
        chunks = lambda x: [x[k : k + _CHUNK] for k in range(0, len(x), _CHUNK)]
        if first[0] == second[0]:
            parts = chunks(np.arange(len(of)))
            todo = [(x, y) for k, x in enumerate(parts) for y in parts[k:]]
        else:
            todo = [(x, y) for x in chunks(np.flatnonzero(block == first[0])) for y in chunks(np.flatnonzero(block == second[0]))]

        def strange(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ok = (of[x][:, None] == of[y]) & (doc[x][:, None] != doc[y]) & (label[x][:, None] != label[y])
            i, j = ok.any(axis=1), ok.any(axis=0)
            return x[i], y[j], np.triu(ok[i][:, j]) if x is y else ok[i][:, j]

        found = []
        for x, y in todo:
            same = x is y
            x, y, ok = strange(x, y)
            i, j = np.nonzero(ok)
            alike = np.zeros(ok.shape, bool)
            alike[i, j] = _surely_alike(beside[x], beside[y], i, j)
            if alike.any():
                # Windows of one class are no pairs any more.
                tied = label[x][:, None] == label[y]
                i, j = _thin_pairs(alike, alike | tied, np.ones(len(x), bool), np.ones(len(y), bool), same)
                i, j = x[i], y[j]
                label, tree = _merged(label, i, j)
                found.append((i[tree], j[tree], np.ones(len(tree), bool)))
        for x, y in todo:
            x, y, ok = strange(x, y)
            if ok.any():
                ok &= _in_common(beside[x], beside[y])[0] >= _BOTH
                i, j = np.nonzero(ok)
                near = _maybe_alike(beside[x], beside[y], i, j)
                found.append((x[i[near]], y[j[near]], np.zeros(int(near.sum()), bool)))
        for i, j, sure in found:
            i, j = np.where(doc[i] > doc[j], i, j), np.where(doc[i] > doc[j], j, i)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (doc[i], doc[j], lo[i], hi[i], at[i], lo[j], hi[j], at[j], sure)], names=names)


def _maybe_alike(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows may have a passage around their centres: _SPAN shingles of one side and _OTHER_SPAN of the other, with three shared ones for each distinct one that is not, of both sides.

    What is shared counts as in ``passages``. A longer passage has pieces of which that holds, with min-hashes of their own.
    """
    if not len(i):
        return np.zeros(0, bool)
    n = len(x)
    rows = np.concatenate([x, y])
    codes, column = np.unique(rows, return_inverse=True)
    column = column.reshape(rows.shape)
    table = np.zeros((len(rows), len(codes)), bool)
    np.put_along_axis(table, column, True, axis=1)
    order = np.argsort(rows, axis=1, kind="stable")
    fresh = np.zeros(rows.shape, bool)
    np.put_along_axis(fresh, order, np.diff(np.take_along_axis(rows, order, axis=1), axis=1, prepend=np.uint32(0)) != 0, axis=1)
    none = rows == 0
    flat = table.ravel()
    end = np.arange(_BESIDE + 1, rows.shape[1] + 1)
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 4096):
        a, b = i[k : k + 4096], j[k : k + 4096] + n
        reach = []
        for own, other in ((a, b), (b, a)):
            there = flat[column[own] + (other * len(codes))[:, None]]
            worth = np.where(there, np.int16(1), np.where(fresh[own], np.int16(-6), np.int16(0)))
            worth[none[own]] = -300
            sums = np.zeros((len(own), rows.shape[1] + 1), np.int16)
            np.cumsum(worth, axis=1, out=sums[:, 1:])
            least = np.minimum.accumulate(sums[:, : _BESIDE + 1], axis=1)
            reach.append([(sums[:, e] - least[:, np.minimum(e - size, _BESIDE)]).max(axis=1) for size in (_SPAN, _OTHER_SPAN) for e in (end[end >= size],)])
        out[k : k + 4096] = (reach[0][0] + reach[1][1] >= 0) | (reach[0][1] + reach[1][0] >= 0)
    return out


def _surely_alike(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows have _SPAN shingles of one around the centre that make a passage with those of the other at the same places."""
    order = np.argsort(x, axis=1, kind="stable")
    ordered = np.take_along_axis(x, order, axis=1)
    fresh = np.zeros(x.shape, bool)
    np.put_along_axis(fresh, order, np.diff(ordered, axis=1, prepend=np.uint32(0)) != 0, axis=1)
    full = [np.lib.stride_tricks.sliding_window_view(z > 0, _SPAN, axis=1).all(axis=2) for z in (x, y)]
    place = np.arange(x.shape[1], dtype=np.int16)
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 8192):
        a, b = i[k : k + 8192], j[k : k + 8192]
        # Of equal codes the first counts, so no fewer distinct ones are shared.
        equal = (x[a] == y[b]) & fresh[a]
        many = np.flatnonzero(np.count_nonzero(equal, axis=1) >= _OTHER_SPAN - 2)
        a, b, equal = a[many], b[many], equal[many]
        sums = np.zeros((len(a), x.shape[1] + 1), np.int16)
        np.cumsum(equal, axis=1, out=sums[:, 1:])
        # Any stretch of _SPAN or more of both around the centre, of which six of seven places are equal.
        worth = 7 * sums - 6 * np.arange(x.shape[1] + 1, dtype=np.int16)
        inside = [np.minimum.accumulate((z > 0)[:, _BESIDE::-1], axis=1).sum(axis=1) for z in (x, y)], [np.minimum.accumulate((z > 0)[:, _BESIDE:], axis=1).sum(axis=1) for z in (x, y)]
        begin = _BESIDE + 1 - np.minimum(inside[0][0][a], inside[0][1][b])
        end = _BESIDE + np.minimum(inside[1][0][a], inside[1][1][b])
        least = np.minimum.accumulate(np.where(np.arange(_SPAN) >= begin[:, None], worth[:, :_SPAN], 10000), axis=1)
        most = np.where(np.arange(_SPAN, 2 * _BESIDE + 2) <= end[:, None], worth[:, _SPAN:], -10000)
        good = (most >= least).any(axis=1)
        both = sums[:, _SPAN:] - sums[:, :-_SPAN]
        # The other side goes from the first equal place, or the centre, to the last.
        equal[:, _BESIDE] = True
        after = np.minimum.accumulate(np.where(equal, place, 1000)[:, ::-1], axis=1)[:, ::-1]
        before = np.maximum.accumulate(np.where(equal, place, -1000), axis=1)
        other = before[:, _SPAN - 1 :] - after[:, : 1 - _SPAN] + 1
        good |= ((full[0][a] | full[1][b]) & (4 * both >= 3 * (_SPAN + other - both)) & (other >= _OTHER_SPAN)).any(axis=1)
        out[k + many] = good
    return out


def _thin_pairs(ok: np.ndarray, alike: np.ndarray, open_x: np.ndarray, open_y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``ok`` between classes of ``alike``, and a tree of each class. Windows that are not open are one class from the start."""
    n, m = len(open_x), 0 if same else len(open_y)
    label = np.arange(n + m)
    shut = np.flatnonzero(~(open_x if same else np.concatenate([open_x, open_y])))
    label[shut] = shut[:1] if len(shut) else 0
    x, y = np.nonzero(alike)
    y = y + (0 if same else n)
    label, tree = _merged(label, x, y)
    i, j = np.nonzero(ok & (label[:n, None] != label[n if m else 0 :]))
    a, b = np.minimum(x[tree], y[tree]), np.maximum(x[tree], y[tree]) - (0 if same else n)
    return np.concatenate([a, i]), np.concatenate([b, j])


def _merged(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (places of the first ones) after the pairs of ``x`` and ``y`` are joined, and the pairs that join them, which make a tree."""
    tree = [np.zeros(0, np.int64)]
    while True:
        a, b = label[x], label[y]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return label, np.concatenate(tree)
        # Each class joins the smallest one that a pair leads to.
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        order = np.lexsort((low, high))
        first = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
        tree.append(apart[first])
        to = np.arange(len(label))
        to[high[first]] = low[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _in_common(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct codes each row of ``x`` shares with each of ``y``, and has; 0 is none."""
    n = len(x)
    rows = np.sort(np.concatenate([x, y]), axis=1)
    new = rows > 0
    new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
    sizes = new.sum(axis=1)
    of = np.nonzero(new)[0]
    codes, at, count = np.unique(rows[new], return_inverse=True, return_counts=True)
    kept = count[at] > 1
    column = np.cumsum(count > 1) - 1
    table = np.zeros((len(rows), int((count > 1).sum())), np.float32)
    table[of[kept], column[at[kept]]] = 1
    return table[:n] @ table[n:].T, sizes[:n], sizes[n:]


def _hulls(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a pair that overlap in both documents become one, with the centres of all their windows."""
    for b in _few(frames):
        out: list[list] = [[] for _ in range(9)]
        for a, other, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            flat = rows.values
            spans = np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi", "other_lo", "other_hi", "at", "other_at", "sure")], axis=1)
            kept: list[list] = []
            for *w, at, o_at, sure in sorted(spans.tolist()):
                for k in kept:
                    if w[0] <= k[1] and w[2] <= k[3] and k[2] <= w[3]:
                        k[1], k[2], k[3] = max(k[1], w[1]), min(k[2], w[2]), max(k[3], w[3])
                        break
                else:
                    kept.append(k := [*w, [], [], []])
                for col, v in zip(k[4:], (at, o_at, bool(sure)), strict=True):
                    col.append(v)
            for k in kept:
                for col, v in zip(out, (a, other, *k), strict=True):
                    col.append(v)
        yield _pair_batch(out)


def _good_runs(shared: np.ndarray, span: int, mismatch: int, near: np.ndarray) -> list[tuple[int, int]]:
    """Longest runs in which each unshared position is paid for by ``-mismatch`` shared ones; where no wanted position is ahead (``near``), none is looked for."""
    sums = np.zeros(len(shared) + 1, np.int64)
    np.where(shared, 1, mismatch).cumsum(out=sums[1:])
    todo, out = [(0, len(shared))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo < span or near[lo] >= hi:
            continue
        p = sums[lo : hi + 1]
        ahead = np.maximum.accumulate(p[::-1])
        least = np.minimum.accumulate(p)
        begin = np.concatenate([[0], (least[1:] < least[:-1]).nonzero()[0] + 1])
        # ahead is ascending from the last position on.
        end = len(p) - 1 - ahead.searchsorted(p[begin])
        best = int((end - begin).argmax())
        a, b = lo + int(begin[best]), lo + int(end[best])
        if b - a < span:
            continue
        hits = shared[a:b].nonzero()[0]
        # Unshared ends stay only as far as the length needs them.
        first, last = int(hits[0]), int(hits[-1])
        last = min(max(last, first + span - 1), b - a - 1)
        out.append((a + min(first, last - span + 1), a + last))
        todo += [(lo, a), (b, hi)]
    return sorted(out)


def _previous(ids: np.ndarray) -> np.ndarray:
    """Where each id stood last before, -1 for none: those below lo among ids[lo:hi] are the distinct ones there."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), -1)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _from_one_side(a: np.ndarray, b: np.ndarray, n_ids: int, span: int, wanted: np.ndarray, worth: np.ndarray, most: int) -> list[tuple[int, int, int, int, float]]:
    """Like stretches of two sequences of numbers below n_ids, as far as runs of ``a`` that hold a wanted position lead to them.

    ``worth`` has the sums of what positions of ``a`` are worth, ``most`` is what a stretch of ``b`` may be worth.
    """
    before_a, before_b = _previous(a), _previous(b)
    next_wanted = np.append(wanted, len(a))[np.searchsorted(wanted, np.arange(len(a) + 1))]
    first_b = np.full(n_ids, -1)
    once = np.flatnonzero(before_b < 0)
    first_b[b[once]] = once
    place = first_b[a]
    shared = place >= 0
    mark = np.zeros(n_ids, bool)

    def likest(lo: int, hi: int) -> tuple[float, int, int]:
        """(similarity, begin, end) of what is like a[lo : hi + 1] in b."""
        own, fresh = a[lo : hi + 1], before_a[lo : hi + 1] < lo
        n_own = int(np.count_nonzero(fresh))
        # What is shared bounds the similarity.
        if np.count_nonzero(fresh & shared[lo : hi + 1]) < SIMILARITY * n_own:
            return 0.0, 0, 0
        mark[own] = True
        hits = shared[lo : hi + 1].nonzero()[0]
        shift = place[lo + hits] - hits
        shift.sort()
        best = (0.0, 0, 0)
        for part in (7, 3):
            slack = max(_DRIFT, (hi - lo) // part)
            # The diagonal that most shared shingles lie near.
            near = shift.searchsorted(shift + slack, side="right") - shift.searchsorted(shift - slack)
            start = int(shift[near.argmax()])
            first, last = max(0, start - slack), min(len(b), start + hi - lo + slack + 1)
            inside = mark[b[first:last]].nonzero()[0]
            first, last = first + int(inside[0]), first + int(inside[-1])
            new = before_b[first : last + 1] < first
            both = int(np.count_nonzero(new & mark[b[first : last + 1]]))
            best = max(best, (both / (n_own + int(np.count_nonzero(new)) - both), first, last))
        mark[own] = False
        return best

    found = []
    for root in _good_runs(shared, span, _MISMATCHES[0], next_wanted):
        before, todo = len(found), [(*root, 0)]
        while todo:
            lo, hi, level = todo.pop()
            if next_wanted[lo] > hi:
                continue
            similarity, first, last = likest(lo, hi) if worth[hi + 1] - worth[lo] + most >= 0 else (0.0, 0, 0)
            if similarity >= SIMILARITY:
                found.append((lo, hi, first, last, similarity))
            elif level + 1 < len(_MISMATCHES):
                todo += [(lo + x, lo + y, level + 1) for x, y in _good_runs(shared[lo : hi + 1], span, _MISMATCHES[level + 1], next_wanted[lo:] - lo)]
        if len(found) == before and next_wanted[root[0]] <= root[1]:
            # What no longest run leads to: from the beginning of one shared stretch to the end of another.
            sums = np.concatenate([[0], np.cumsum(shared)])
            inside = np.flatnonzero(shared[root[0] : root[1] + 1]) + root[0]
            begins, ends = inside[np.diff(inside, prepend=-2) > 1], inside[np.diff(inside, append=len(a) + 1) > 1]
            for part in range(0, len(begins), 256):
                lo = begins[part : part + 256, None]
                n = ends - lo + 1
                # Unshared ends stay as far as the length needs them.
                his = np.minimum(np.maximum(ends, lo + span - 1), len(a) - 1)
                lows = np.maximum(0, np.minimum(lo, his - span + 1))
                good = (n > 0) & (4 * (sums[ends + 1] - sums[lo]) >= 3 * np.maximum(n, span)) & (next_wanted[lows] <= his) & (worth[his + 1] - worth[lows] + most >= 0)
                for low, hi in zip(lows[good].tolist(), his[good].tolist(), strict=True):
                    similarity, first, last = likest(low, hi)
                    if similarity >= SIMILARITY:
                        found.append((low, hi, first, last, similarity))
    return found


def passages(a: np.ndarray, b: np.ndarray, span: int = _SPAN, at: np.ndarray | None = None, other_at: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """(begin, end, begin in b, end in b, similarity) of like stretches of two shingle sequences, longest first looked for.

    Runs of both sides lead to them. A stretch that holds no passage outside a
    longer one, in neither sequence, is left out. ``at`` and ``other_at`` are pairs of
    positions; where they are given, those that no passage can cover both are left out, and only runs that hold
    another one are looked into. At similarity 0.75 a passage's unshared codes, of both sides, are at most a third of the
    shared ones: each side's shared ones less six for each unshared one are together 0 at least.
    """
    _, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    n_ids, x, y = int(ids.max(initial=-1)) + 1, ids[: len(a)], ids[len(a) :]
    worth = _worth(x, y, n_ids), _worth(y, x, n_ids)
    if at is None:
        wanted = np.arange(len(a)), np.arange(len(b))
        most = [int((np.maximum.accumulate(w[::-1])[::-1] - w).max()) for w in worth]
    else:
        reach = _reach(worth[0])[at], _reach(worth[1])[other_at]
        good = reach[0] + reach[1] >= 0
        if not good.any():
            return []
        wanted = np.unique(at[good]), np.unique(other_at[good])
        most = [int(r[good].max()) for r in reach]
        # Often all that is shared is one equal run.
        (lo, hi), (o_lo, o_hi) = (np.flatnonzero(np.diff(w) == 1)[[0, -1]].tolist() for w in worth)
        if hi - lo + 1 >= span and np.array_equal(x[lo : hi + 1], y[o_lo : o_hi + 1]):
            return [(lo, hi, o_lo, o_hi, 1.0)]
    found = _from_one_side(x, y, n_ids, span, wanted[0], worth[0], most[1]) + [(lo, hi, p, q, s) for p, q, lo, hi, s in _from_one_side(y, x, n_ids, span, wanted[1], worth[1], most[0])]
    kept: list[tuple[int, int, int, int, float]] = []
    for new in sorted(set(found), key=lambda p: (p[0] - p[1] + p[2] - p[3], p)):
        if not any(_outside(new[:2], old[:2]) < span and _outside(new[2:4], old[2:4]) < span for old in kept):
            kept.append(new)
    return sorted(kept)


def _outside(new: tuple[int, int], old: tuple[int, int]) -> int:
    """Longest stretch of ``new`` before or after ``old``."""
    if new[1] < old[0] or old[1] < new[0]:
        return new[1] - new[0] + 1
    return max(old[0] - new[0], new[1] - old[1])


def _worth(own: np.ndarray, other: np.ndarray, n_ids: int) -> np.ndarray:
    """Sums over positions: 1 for a shared one, -6 for the first of each unshared code."""
    place, mark = np.arange(len(own)), np.zeros(n_ids, bool)
    mark[other] = True
    first = np.zeros(n_ids, np.int64)
    first[own[::-1]] = place[::-1]
    return np.concatenate([[0], np.cumsum(np.where(mark[own], 1, np.where(first[own] == place, -6, 0)))])


def _reach(sums: np.ndarray) -> np.ndarray:
    """Per position, the most that a stretch of _OTHER_SPAN or more around it is worth."""
    n = len(sums) - 1
    least = -6 * n - 1
    if n < _OTHER_SPAN:
        return np.full(n, least)
    ahead = np.maximum.accumulate(sums[::-1])[::-1]
    behind = np.minimum.accumulate(sums)
    # Stretches that begin less than _OTHER_SPAN before the position, and earlier ones.
    edge = np.full(_OTHER_SPAN - 1, least)
    begun = np.concatenate([edge, ahead[_OTHER_SPAN:] - sums[: n - _OTHER_SPAN + 1], edge])
    near, width = begun, 1
    while width < _OTHER_SPAN:
        step = min(width, _OTHER_SPAN - width)
        near, width = np.maximum(near[:-step], near[step:]), width + step
    far = np.full(n, least)
    far[_OTHER_SPAN - 1 :] = ahead[_OTHER_SPAN:] - behind[: n - _OTHER_SPAN + 1]
    return np.maximum(near, far)


def _beside_centres(a: np.ndarray, b: np.ndarray, at: int, other_at: int) -> list[tuple[int, int, int, int, float]]:
    """The likest passage of _SPAN shingles of one side around two centres with those of the other at the same places, if there is one."""
    found = []
    for x, y, p, q in ((a, b, at, other_at), (b, a, other_at, at)):
        low, high = max(0, p - _BESIDE, p - q), min(len(x), p + _BESIDE + 1, p - q + len(y))
        equal = x[low:high] == y[low + q - p : high + q - p]
        again = _previous(x[max(0, p - _BESIDE) : p + _BESIDE + 1])[low - max(0, p - _BESIDE) :][: high - low] >= 0
        unlike = np.flatnonzero(~equal) + low
        run = np.arange(max([low, *(unlike[unlike < p] + 1)]), min([high, *unlike[unlike > p]]))
        fresh = np.append(np.flatnonzero(equal & ~again) + low, p)
        tries = [(o, o + _SPAN, places) for o in range(max(0, p - _BESIDE), min(p, len(x) - _SPAN) + 1) for places in (fresh, run)]
        # Longer ones of both sides, of which six of seven places are equal.
        worth = np.concatenate([[0], np.cumsum(np.where(equal & ~again, 1, -6))])
        gain = worth[None, p - low + 1 :] - worth[: p - low + 1, None]
        wide = np.arange(p - low + 1, len(worth)) - np.arange(p - low + 1)[:, None]
        if ((gain >= 0) & (wide > _SPAN)).any():
            begin, end = np.unravel_index(np.where(gain >= 0, wide, 0).argmax(), gain.shape)
            tries.append((low + int(begin), p + 1 + int(end), np.array([low + begin, p + end])))
        for begin, end, places in tries:
            inside = places[(places >= begin) & (places < end)]
            first, last = int(inside.min()), int(inside.max())
            own, theirs = set(x[begin:end].tolist()), set(y[first + q - p : last + q - p + 1].tolist())
            similarity = len(own & theirs) / len(own | theirs)
            if last - first + 1 >= _OTHER_SPAN and similarity >= SIMILARITY:
                sides = (begin, end - 1), (first + q - p, last + q - p)
                found.append((*sides[0], *sides[1], similarity) if x is a else (*sides[1], *sides[0], similarity))
    return [max(found, key=lambda f: f[4])] if found else []


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _few(batches):
        rows = []
        for doc, other, lo, o_lo, x, y, at, o_at, sure in zip(*(b.column(k).to_pylist() for k in range(6)), *(b.column(k) for k in range(6, 9)), strict=True):
            n = len(x) // _CODE_BYTES
            if x == y and n >= _SPAN:
                like = [(0, n - 1, 0, n - 1, 1.0)]
            else:
                x, y, at, o_at = _unpacked(x), _unpacked(y), at.values.to_numpy() - lo, o_at.values.to_numpy() - o_lo
                like = passages(x, y, _SPAN, at, o_at)
                # No class rests on a pair without a passage of its own there; one that a longer one all but holds was left out.
                left = sure.values.to_numpy(zero_copy_only=False)
                new = like
                while left.any():
                    for begin, end, o_begin, o_end, _ in new:
                        left = left & ((at <= begin - _SPAN) | (at >= end + _SPAN) | (o_at <= o_begin - _SPAN) | (o_at >= o_end + _SPAN))
                    if left.any():
                        first = int(left.argmax())
                        new = _beside_centres(x, y, int(at[first]), int(o_at[first]))
                        like = like + new
                        left[first] = False
            for begin, end, o_begin, o_end, s in like:
                rows.append((doc, lo + begin, end - begin + SHINGLE_WORDS, other, o_lo + o_begin, o_end - o_begin + SHINGLE_WORDS, s))
        names = ["doc_id", "start_word", "n_words", "other_id", "other_start_word", "other_n_words", "similarity"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64() if k == 6 else pa.int64()) for k in range(7)], names=names)


_PAIR = "doc_id long, other_id long, lo long, hi long, other_lo long, other_hi long, at array<int>, other_at array<int>, sure array<boolean>"
_PASSAGE = "doc_id long, start_word long, n_words long, other_id long, other_start_word long, other_n_words long, similarity double"


def _verified(stretches: DataFrame, pairs: DataFrame) -> DataFrame:
    """The passages that hold up among candidate stretches."""
    for who, lo, hi, data in (("doc_id", "lo", "hi", "x"), ("other_id", "other_lo", "other_hi", "y")):
        # A stretch stands in one row of its document; rows leave the join cut, so that none carries a whole document.
        own = stretches.select(F.col("doc_id").alias(who), "start", "n", "data")
        cut = F.expr(f"substring(data, cast(({lo} - start) * {_CODE_BYTES} + 1 as int), cast(({hi} - {lo} + 1) * {_CODE_BYTES} as int))")
        pairs = pairs.join(own, who).where(f"{lo} >= start and {hi} < start + n").withColumn(data, cut).drop("start", "n", "data")
    return pairs.select("doc_id", "other_id", "lo", "other_lo", "x", "y", "at", "other_at", "sure").mapInArrow(_verify, _PASSAGE)


def _on_hub(at: np.ndarray, passages: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The other documents of passages, where these have each position, and if it is inside."""
    hub, lo, hi, to_lo, to_hi = (passages.field(k).to_numpy() for k in ("hub", "lo", "hi", "hub_lo", "hub_hi"))
    place = at[:, None].astype(np.int64)
    return hub, to_lo + (place - lo) * (to_hi - to_lo) // np.maximum(hi - lo, 1), (place >= lo) & (place <= hi)


def _unexplained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs without the centres that passages of both documents tie to the same words of one other document."""
    for b in _few(batches):
        spans = [b.column(k).to_pylist() for k in range(6)]
        lists: list[list] = [[], [], []]
        keep = []
        for row, (at, o_at, sure, mine, theirs) in enumerate(zip(*(b.column(k) for k in range(6, 11)), strict=True)):
            at, o_at, sure = (x.values.to_numpy(zero_copy_only=False) for x in (at, o_at, sure))
            left = np.ones(len(at), bool)
            if mine.is_valid and theirs.is_valid:
                hub, to, inside = zip(*(_on_hub(x, side.values) for x, side in ((at, mine), (o_at, theirs))), strict=True)
                near = (hub[0][:, None] == hub[1]) & (np.abs(to[0][:, :, None] - to[1][:, None]) <= _DRIFT)
                left = ~(near & inside[0][:, :, None] & inside[1][:, None]).any(axis=(1, 2))
            if left.any():
                keep.append(row)
                for col, v in zip(lists, (at, o_at, sure), strict=True):
                    col.append(v[left])
        if keep:
            yield _pair_batch([*([c[row] for row in keep] for c in spans), *lists])


_OPEN = "key long, doc_id long, lo int, hi int, at int, class int, n int"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of documents with the document and place that a passage ties their centre to, or their own."""
    names = ["key", "doc_id", "lo", "hi", "at", "class", "hub", "hub_at"]
    for b in _few(batches):
        out: list[list] = [[] for _ in names]
        for doc, wanted, mine in zip(b.column("doc_id").to_pylist(), b.column("w"), b.column("mine"), strict=True):
            key, lo, hi, at, kind = (wanted.values.field(k).to_numpy() for k in ("key", "lo", "hi", "at", "class"))
            hub, place = np.full(len(at), doc), at.astype(np.int64)
            if mine.is_valid:
                hubs, to, inside = _on_hub(at, mine.values)
                row, which = np.arange(len(at)), inside.argmax(axis=1)
                tied = inside[row, which]
                hub, place = np.where(tied, hubs[which], hub), np.where(tied, to[row, which], place)
            for col, v in zip(out, (key, np.full(len(at), doc), lo, hi, at, kind, hub, place), strict=True):
                col.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)


def _refined(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of a min-hash that passages tie to the same words of one document are one; min-hashes of one class are done."""
    for t in _by_key(frames):
        key, doc, lo, hi, at, kind, hub, place = (t.column(k).to_numpy() for k in range(8))
        group = np.cumsum(np.diff(key, prepend=key[0]) != 0)
        _, least, label = np.unique(np.stack([group, kind]), axis=1, return_index=True, return_inverse=True)
        order = np.lexsort((place, hub, group))
        a, b = order[:-1], order[1:]
        near = (group[a] == group[b]) & (hub[a] == hub[b]) & (place[b] - place[a] <= _DRIFT)
        label = _merged(least[label], a[near], b[near])[0]
        start = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(start, len(key)))
        rows = np.flatnonzero(np.repeat(np.minimum.reduceat(label, start) < np.maximum.reduceat(label, start), size))
        arrays = [*(x[rows] for x in (key, doc, lo, hi, at)), (label - start[group])[rows].astype(np.int32), size[group][rows].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key", "doc_id", "lo", "hi", "at", "class", "n"])


def _known(passages: DataFrame) -> DataFrame:
    """Per document, the passages that tie it to smaller ones."""
    last = lambda start, n: F.col(start) + F.col(n) - SHINGLE_WORDS
    span = F.struct(F.col("other_id").alias("hub"), F.col("start_word").alias("lo"), last("start_word", "n_words").alias("hi"), F.col("other_start_word").alias("hub_lo"), last("other_start_word", "other_n_words").alias("hub_hi"))
    return passages.groupBy("doc_id").agg(F.collect_list(span).alias("mine"))


def _still_open(windows: DataFrame, passages: DataFrame) -> DataFrame:
    wanted = windows.groupBy("doc_id").agg(F.collect_list(F.struct("key", "lo", "hi", "at", "class")).alias("w"))
    placed = wanted.join(_known(passages), "doc_id", "left").mapInArrow(_placed, "key long, doc_id long, lo int, hi int, at int, class int, hub long, hub_at long")
    return placed.repartition("key").sortWithinPartitions("key").mapInArrow(_refined, _OPEN)


def _hulled(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "other_id").agg(F.collect_set(F.struct("lo", "hi", "other_lo", "other_hi", "at", "other_at", "sure")).alias("w")).mapInArrow(_hulls, _PAIR)


def _soon(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of each document and the smallest one that it is surely like, and the rest."""
    least = candidates.where(F.exists("sure", lambda x: x)).groupBy("doc_id").agg(F.min("other_id").alias("least"))
    marked = candidates.join(least, "doc_id", "left").withColumn("soon", F.coalesce(F.col("other_id") == F.col("least"), F.lit(False))).drop("least")
    return marked.where("soon").drop("soon"), marked.where("not soon").drop("soon")


def _apart_from(candidates: DataFrame, passages: DataFrame) -> DataFrame:
    """Candidates whose windows are not tied already, each by its document's passages, to the same words of one document."""
    known = _known(passages)
    both = candidates.join(known, "doc_id", "left").join(known.select(F.col("doc_id").alias("other_id"), F.col("mine").alias("theirs")), "other_id", "left")
    columns = [x.split()[0] for x in _PAIR.split(", ")]
    return both.select(*columns, "mine", "theirs").mapInArrow(_unexplained, _PAIR)


def _copies(scratch: Scratch, apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches without those that equal one of a smaller document, and the passages that tie these to the smallest one."""
    marked = apart.withColumn("mark", F.md5("data"))
    long = marked.where(F.col("n") >= _SPAN).select("mark", "doc_id", "start", "n")
    least = long.groupBy("mark").agg(F.min(F.struct("doc_id", "start")).alias("o"), F.max("doc_id").alias("high")).where("o.doc_id < high").drop("high")
    copies = scratch.keep(long.join(least, "mark").where("doc_id > o.doc_id").distinct(), "copies")
    stretches = scratch.keep(marked.join(copies.select("mark", "doc_id", "start"), ["mark", "doc_id", "start"], "left_anti").drop("mark"), "stretches")
    words = F.col("n") + SHINGLE_WORDS - 1
    return stretches, copies.select("doc_id", F.col("start").alias("start_word"), words.alias("n_words"), F.col("o.doc_id").alias("other_id"), F.col("o.start").alias("other_start_word"), words.alias("other_n_words"), F.lit(1.0).alias("similarity"))


def _open_runs(stretches: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of each min-hash that has several classes, in runs of two blocks."""
    wanted = windows.groupBy("doc_id").agg(F.collect_list(F.struct("key", "lo", "hi", "at", "class", "n")).alias("w"))
    around = stretches.join(wanted, "doc_id").select("doc_id", "start", "data", "w").mapInArrow(_around, "key long, doc_id long, lo int, hi int, at int, class int, n int, beside binary")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    blocked = around.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    runs = blocked.select("key", F.least("block", "to").alias("first"), F.greatest("block", "to").alias("second"), "block", "doc_id", "lo", "hi", "at", "class", "beside")
    by = ["key", "first", "second"]
    return runs.repartition(*by).sortWithinPartitions(*by)


def repeated_passages(documents: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, other_id, other_start_word, other_n_words, similarity.

    A row says that these words of doc_id stand, with similarity 0.75 or more on
    distinct 5-word shingles, in other_id too; passages have 50 words or more on one side at least,
    39 on the other. Documents that share a passage are joined by rows, directly or by way of others, each
    with a passage around the same shingle; two of one such class need no row of their own.
    Null, empty and shorter texts have none, and come back not at all. Rows with a
    null id take no part. Repeated rows of one id are one document and no passage
    of each other. Other columns are not read.
    """
    scratch = Scratch(documents.sparkSession, "passages")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    apart = _thin(scratch, docs.mapInArrow(_coded, _SLICE), "apart")
    scratch.release()
    stretches, copies = _copies(scratch, apart)
    scratch.drop("apart")
    windows = stretches.mapInArrow(_windows, _ROW).repartition("key").sortWithinPartitions("key")
    tied = scratch.keep(windows.mapInArrow(_tied, _TIED), "tied")
    scratch.release()
    ties = tied.where("key is null").select("doc_id", "other_id", "lo", "hi", "at", "other_lo", "other_hi", "other_at", F.lit(True).alias("sure"))
    pairs = scratch.keep(_hulled(ties), "pairs-tied")
    # Each document is compared with the smallest one that it is surely like, and then with what that leaves open.
    soon, later = _soon(pairs)
    first = scratch.keep(_verified(stretches, soon), "passages-tied")
    scratch.release()
    windows = scratch.keep(_still_open(tied.where("key is not null"), first), "open")
    scratch.drop("tied")
    scratch.release()
    met = scratch.keep(_open_runs(stretches, windows).mapInArrow(_met, _SPANS), "met")
    scratch.drop("open")
    scratch.release()
    candidates = scratch.keep(_apart_from(_hulled(met).unionByName(later), first), "candidates")
    scratch.drop("met", "pairs-tied")
    soon, later = _soon(candidates)
    second = scratch.keep(first.unionByName(_verified(stretches, soon)), "passages-sure")
    rest = scratch.keep(_apart_from(later, second), "rest")
    scratch.release()
    # The larger document comes first.
    out = scratch.keep(copies.unionByName(second).unionByName(_verified(stretches, rest)).distinct(), "passages")
    scratch.drop("stretches", "copies", "candidates", "passages-tied", "passages-sure", "rest")
    return out
