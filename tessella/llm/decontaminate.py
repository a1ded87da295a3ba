"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are compared as characters, in lower case, with blank
runs as one space. An item of m characters is found in a document if a part of the
document is within e = floor(m / 10) edits of it. Items below 8 characters must
stand in it as they are, between blanks or the text's ends.

Filter: one edit destroys at most q q-grams, so a match within e edits shares at
least m - q + 1 - q e q-grams with the item, at diagonals (document position less
item position) that differ by at most e. q is 8 where that bound is positive, 4
for other items, and 3 for short ones, which count with the blanks around them.
Hits are counted in diagonal bands of width 2 (e + 1) that overlap by half, so that
a match falls whole into one band; bands that reach the bound are verified by
alignment within the band, many at a time. The filter is exact: a band below the
bound holds no match.

Scale: documents are read once and never shuffled. The benchmark is cut into
blocks of at most ``BLOCK_CHARS`` characters by a checked sum of its sizes; each
block's q-gram index is broadcast, one after the other. A text is read in pieces
of about a megabyte, each with as much of the piece before as an item may reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.textkit import SLICE_BYTES, flat_texts, mix

Q, LOW_Q, SHORT_Q = 8, 4, 3
EDIT_SHARE = 0.1
BLOCK_CHARS = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_CELLS = 1 << 18
_SIGMA, _DOTTED = 0x3A3, 0x130


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def edit_budget(m: int) -> int:
    """Edits allowed for an item of m characters: a tenth."""
    return m // 10


def gram_size(m: int) -> int:
    """The q that an item of m characters is looked for by; the bound m - q + 1 - q e is positive."""
    if m < Q:
        return SHORT_Q
    return Q if m - Q + 1 - Q * edit_budget(m) > 0 else LOW_Q


def _rolled(codes: np.ndarray, q: int, base: int) -> np.ndarray:
    """Polynomial hashes of all runs of q codes, in the codes' own width."""
    if len(codes) < q:
        return codes[:0]
    bits = 8 * codes.dtype.itemsize
    single = codes + codes.dtype.type(1)
    h, n = single, 1
    for bit in bin(q)[3:]:
        h = h[:-n] * codes.dtype.type(pow(base, n, 1 << bits)) + h[n:]
        n *= 2
        if bit == "1":
            h = h[:-1] * codes.dtype.type(base & ((1 << bits) - 1)) + single[n : n + len(h) - 1]
            n += 1
    return h


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all runs of q characters."""
    return mix(_rolled(chars.astype(np.uint64), q, _BASE))


@cache
def _plain_table() -> np.ndarray:
    """The lower-case form of each code point below 0x10000 that has one of its own, blanks as 0x20."""
    chars = map(chr, range(0x10000))
    return np.array([0x20 if c.isspace() else ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars], np.uint32)


def _lowered(data: bytes) -> tuple[np.ndarray, bool]:
    """Code points of UTF-8 text in lower case with blanks as 0x20, and whether each stands for one of the text's."""
    if data.isascii():
        return _plain_table()[:256][np.frombuffer(data, np.uint8)], True
    text = data.decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = True
    if int(points.max()) > 0xFFFF or (points == _SIGMA).any() or (points == _DOTTED).any() or "�" in text:
        # Lower case that depends on neighbours, has two characters or lies beyond the table; or bytes that aren't UTF-8.
        points, same = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32), False
    table = _plain_table()
    return np.where(points < len(table), table[np.minimum(points, len(table) - 1)], points), same


@dataclass
class Segments:
    """Plain texts, or pieces of one, with a blank before and after each."""

    chars: np.ndarray
    starts: np.ndarray  # of the text itself, behind its blank
    ends: np.ndarray
    rows: np.ndarray
    offsets: np.ndarray  # where a piece begins in its plain text
    more: bool = False  # the text goes on in the next one


def _squeezed(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blank runs as one, none at either end; texts begin at ``begins`` (the last is the end). Chars, starts, ends."""
    blank = points == 0x20
    before = np.empty(len(points), bool)
    before[:1], before[1:] = True, blank[:-1]
    heads = begins[:-1]
    before[heads[heads < len(points)]] = True
    keep = ~(blank & before)
    left = np.concatenate([[0], np.cumsum(keep)])[begins]
    own = points[keep]
    n = np.diff(left)
    starts = left[:-1] + 2 * np.arange(len(n)) + 1
    chars = np.full(len(own) + 2 * len(n), 0x20, np.uint32)
    chars[np.arange(len(own)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = own
    ends = starts + n
    return chars, starts, ends - ((n > 0) & (chars[ends - 1] == 0x20))


def segments(column: pa.Array, reach: int) -> Iterator[Segments]:
    """A column's texts as segments of about SLICE_BYTES; pieces of one long text overlap by ``reach`` characters."""
    buf, offsets = flat_texts(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        data = buf[offsets[at] : offsets[to]]
        if len(data) > 2 * SLICE_BYTES:
            yield from _pieces(data, at, reach)
        else:
            raw = data.tobytes()
            points, same = _lowered(raw)
            if same:
                begins = offsets[at : to + 1] - offsets[at]
                if len(points) != len(raw):
                    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[begins]
            else:
                own = [_lowered(raw[a:b])[0] for a, b in zip(offsets[at:to] - offsets[at], offsets[at + 1 : to + 1] - offsets[at], strict=True)]
                points, begins = np.concatenate(own), np.cumsum([0, *map(len, own)])
            chars, starts, ends = _squeezed(points, begins)
            yield Segments(chars, starts, ends, np.arange(at, to), np.zeros(to - at, np.int64))
        at = to


def _pieces(data: np.ndarray, row: int, reach: int) -> Iterator[Segments]:
    """One text, read in blocks that end at a blank where there is one."""
    at, tail, offset = 0, np.zeros(0, np.uint32), 0
    while at < len(data):
        to = min(at + SLICE_BYTES, len(data))
        if to < len(data):
            blanks = np.flatnonzero(data[at:to] == 0x20)
            if len(blanks):
                to = at + int(blanks[-1]) + 1
            while to < len(data) and data[to] & 0xC0 == 0x80:
                to += 1
        points, _ = _lowered(data[at:to].tobytes())
        if not len(tail) or tail[-1] == 0x20:
            # Blanks that go on from the piece before, or begin the text.
            points = points[int((points != 0x20).argmax()) if (points != 0x20).any() else len(points) :]
        blank = points == 0x20
        keep = ~blank
        keep[:1] = True
        keep[1:] |= ~blank[:-1]
        whole = np.concatenate([tail, points[keep]])
        at = to
        chars = np.concatenate([np.array([0x20], np.uint32), whole, np.array([0x20], np.uint32)])
        end = len(whole) + 1
        if at == len(data) and len(whole) and whole[-1] == 0x20:
            end -= 1
        yield Segments(chars, np.array([1]), np.array([end]), np.array([row]), np.array([offset]), at < len(data))
        tail = whole[-reach:] if reach < len(whole) else whole
        offset += len(whole) - len(tail)


@dataclass
class Index:
    """Items that are looked for by one q."""

    q: int
    ids: list[int | None]
    chars: np.ndarray  # of all items, end to end
    begin: np.ndarray
    grams: np.ndarray  # sorted distinct
    first: np.ndarray  # offsets into item, place
    item: np.ndarray
    place: np.ndarray
    bits: int
    present: np.ndarray  # a byte per slot of the narrow hash, for a quick no
    need: np.ndarray
    budget: np.ndarray

    @property
    def reach(self) -> int:
        return int((np.diff(self.begin) + 2 * self.budget).max(initial=0)) + 2


def _index(items: list[tuple[int | None, str]], q: int) -> Index:
    own = [np.frombuffer((f" {t} " if q == SHORT_Q else t).encode("utf-32-le", "surrogatepass"), np.uint32) for _, t in items]
    chars = np.concatenate(own)
    hashes, narrow = [gram_hashes(c, q) for c in own], [_rolled(c, q, _BASE) for c in own]
    allh = np.concatenate(hashes)
    item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes])
    order = np.argsort(allh, kind="stable")
    grams, first = np.unique(allh[order], return_index=True)
    bits = min(22, max(12, len(grams).bit_length() + 4))
    present = np.zeros(1 << bits, bool)
    present[_slot(np.concatenate(narrow), bits)] = True
    lengths = np.array([len(c) for c in own], np.int64)
    budget = np.array([0 if q == SHORT_Q else edit_budget(int(m)) for m in lengths], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    return Index(q, [i for i, _ in items], chars, begin, grams, np.append(first, len(allh)), item[order], place[order].astype(np.int64), bits, present, lengths - q + 1 - q * budget, budget)


def build_index(items: list[tuple[int | None, str]]) -> list[Index]:
    """One index for each q in use; blank items are no evidence and are left out."""
    known = [(i, t) for i, t in ((i, plain(t)) for i, t in items) if t]
    by_q = {q: [(i, t) for i, t in known if gram_size(len(t)) == q] for q in (Q, LOW_Q, SHORT_Q)}
    return [_index(own, q) for q, own in by_q.items() if own]


def banded_distances(index: Index, item: np.ndarray, chars: np.ndarray, base: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate, least edits of its item against a part of its text, and where the part ends.

    A candidate's text is chars[base : base + size]. Only cells at diagonals from
    lo - budget to hi + budget are computed; a match whose q-grams lie at diagonals
    lo to hi stays within them. More edits than the budget come back as budget + 1.
    """
    most = index.budget[item]
    length, width = np.diff(index.begin)[item], hi - lo + 2 * most + 1
    edits, end = most + 1, np.full(len(item), -1, np.int64)
    order = np.lexsort((length, width))
    at = 0
    while at < len(order):
        # Candidates of like width together, about _CELLS cells at once.
        to = at + max(1, min(len(order) - at, int(_CELLS // width[order[at]])))
        to = max(at + 1, min(to, at + int(_CELLS // width[order[to - 1]])))
        pick = order[at:to]
        at = to
        steps = np.arange(int(width[pick].max()), dtype=np.int32)
        item_at, m = index.begin[item[pick]], length[pick]
        where, n = base[pick], size[pick].astype(np.int32)[:, None]
        far = (most[pick] + 1).astype(np.int32)[:, None]
        columns = (lo - most)[pick].astype(np.int32)[:, None] + steps
        within = steps < width[pick][:, None]
        row = np.where(within & (columns >= 0) & (columns <= n), 0, far)
        i = 0
        while len(pick):
            i += 1
            columns = columns + np.int32(1)
            real = within & (columns >= 0) & (columns <= n)
            inside = real & (columns >= 1)
            text = chars[np.clip(where[:, None] + columns - 1, 0, len(chars) - 1)]
            best = row + np.where(inside, text != index.chars[item_at + i - 1][:, None], far)
            best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)
            best[:, -1:] = np.minimum(best[:, -1:], far + 1)
            best = np.where(real, best, far) - steps
            row = np.minimum(np.minimum.accumulate(best, axis=1) + steps, far)
            least = row.min(axis=1)
            done = m == i
            if done.any():
                k = row[done].argmin(axis=1)
                edits[pick[done]] = least[done]
                end[pick[done]] = columns[done, k]
            go = ~done & (least < far[:, 0])
            if done.any() or 4 * go.sum() < 3 * len(go):
                pick, item_at, m, where, n, far, columns, within, row = (x[go] for x in (pick, item_at, m, where, n, far, columns, within, row))
    return edits, end


def _found(index: Index, s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, item, edits, end in its plain text) of every match within the budget in a band that reaches the bound."""
    none = np.zeros(0, np.int64)
    chars, pad = s.chars, 1 if index.q == SHORT_Q else 0
    starts, ends = s.starts - pad, s.ends + pad
    narrow = _rolled(chars, index.q, _BASE)
    at = np.flatnonzero(index.present[_slot(narrow, index.bits)])
    own = np.searchsorted(starts, at, side="right") - 1
    at = at[(own >= 0) & (at + index.q <= ends[np.maximum(own, 0)])]
    if not len(at):
        return none, none, none, none
    h = np.zeros(len(at), np.uint64)
    for k in range(index.q):
        h = h * np.uint64(_BASE) + (chars[at + k].astype(np.uint64) + np.uint64(1))
    h = mix(h)
    spot = np.minimum(np.searchsorted(index.grams, h), len(index.grams) - 1)
    true = index.grams[spot] == h
    at, spot = at[true], spot[true]
    n = index.first[spot + 1] - index.first[spot]
    upto = np.cumsum(n)
    if not len(upto):
        return none, none, none, none
    entry = np.repeat(index.first[spot] - (upto - n), n) + np.arange(int(upto[-1]))
    item, diagonal = index.item[entry], np.repeat(at, n) - index.place[entry]
    band = diagonal // (index.budget[item] + 1)
    span = len(chars) + 2
    # Band k covers [k half, (k + 2) half): a diagonal lies in its own band and the one before.
    # The code of a band is unique over all items.
    codes, counts = np.unique(item * (2 * span) + band + span, return_counts=True)
    nxt = np.zeros(len(codes), np.int64)
    follows = np.flatnonzero(np.diff(codes) == 1)
    nxt[follows] = counts[follows + 1]
    alone = np.ones(len(codes), bool)
    alone[follows + 1] = False  # its predecessor's band already holds these hits
    cand = [(codes, counts + nxt), (codes[alone] - 1, counts[alone])]
    code, count = (np.concatenate(x) for x in zip(*cand, strict=True))
    item = code // (2 * span)
    keep = count >= index.need[item]
    code, item = code[keep], item[keep]
    half = index.budget[item] + 1
    lo = (code - item * (2 * span) - span) * half
    hi = lo + 2 * half - 1
    # The match may lie in the text at the middle of the band, or at its border in a neighbour.
    first = np.maximum(np.searchsorted(starts, lo, side="right") - 1, 0)
    last = np.maximum(np.searchsorted(starts, hi + np.diff(index.begin)[item], side="right") - 1, 0)
    n = last - first + 1
    upto = np.cumsum(n)
    if not len(upto):
        return none, none, none, none
    segment = np.repeat(first - (upto - n), n) + np.arange(int(upto[-1]))
    item, lo, hi = (np.repeat(x, n) for x in (item, lo, hi))
    base, size = starts[segment], (ends - starts)[segment]
    lo, hi = np.maximum(lo - base, 0), np.minimum(hi - base, size)
    ok = lo <= hi
    segment, item, lo, hi, base, size = (x[ok] for x in (segment, item, lo, hi, base, size))
    edits, end = banded_distances(index, item, chars, base, size, lo, hi)
    ok = edits <= index.budget[item]
    return segment[ok], item[ok], edits[ok], end[ok] - 2 * pad + s.offsets[segment[ok]]


def _best(row: np.ndarray, item: np.ndarray, edits: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The least edits, then the first end, of each row and item."""
    order = np.lexsort((end, edits, item, row))
    row, item, edits, end = (x[order] for x in (row, item, edits, end))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    return row[new], item[new], edits[new], end[new]


def find(indexes: list[Index], column: pa.Array) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
    """(row numbers, item ids, edits, end) of the best match of each item in each text of a column."""
    if not indexes:
        return
    base = np.cumsum([0, *(len(x.ids) for x in indexes)])
    ids = [i for x in indexes for i in x.ids]
    held: list[tuple[np.ndarray, ...]] = []
    for s in segments(column, max(x.reach for x in indexes)):
        for k, x in enumerate(indexes):
            segment, item, edits, end = _found(x, s)
            held.append((s.rows[segment], item + base[k], edits, end))
        if s.more:
            held = [_best(*(np.concatenate(c) for c in zip(*held, strict=True)))]
            continue
        row, item, edits, end = _best(*(np.concatenate(c) for c in zip(*held, strict=True)))
        held = []
        if len(row):
            yield row, [ids[k] for k in item.tolist()], edits, end


def _indexes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """Indexes of bounded blocks of the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_CHARS))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield build_index([(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").toLocalIterator()])


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, end_char: one row per document row and item found in it.

    edits is the least distance of a part of the document from the item, end_char
    where the first such part ends in the plain text. Null and empty texts match
    nothing; null and blank items are no evidence; an item with a null id is, and
    comes back with it, as rows with a null id do. Repeated rows are searched each;
    several rows of one item_id give a row each if found. Other columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for indexes in _indexes(benchmark):
        held = documents.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row, items, edits, end in find(held.value, b.column(1)):
                    cols = [b.column(0).take(pa.array(row)), pa.array(items, pa.int64()), pa.array(edits.astype(np.int64)), pa.array(end.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "edits", "end_char"])

        part = docs.mapInArrow(run, "doc_id long, item_id long, edits long, end_char long")
        out = part if out is None else out.unionByName(part)
    return out


def _finder(held):
    @F.arrow_udf("boolean")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            hit = np.zeros(len(texts), bool)
            for row, *_ in find(held.value, texts):
                hit[row] = True
            yield pa.array(hit)

    return found


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` in which no item is found, with all their columns."""
    for indexes in _indexes(benchmark):
        found = _finder(documents.sparkSession.sparkContext.broadcast(indexes))
        documents = documents.where(~found(F.col("text")))
    return documents
