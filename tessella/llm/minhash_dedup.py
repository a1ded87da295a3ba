"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct 5-word shingles. Its signature has 32 slots of
16 bits, one per hash function. Two documents with Jaccard similarity s agree in
a slot with probability s (plus 2**-16), so at s = 0.75 a pair differs in about
8 slots, and in more than 15 with probability below 0.3 %.

Multi-index join: the slots are cut into 8 chunks of 4. If two signatures differ
in at most 15 slots, the pigeonhole principle leaves a chunk with at most one
differing slot. So each chunk is indexed once per allowed error position, with
that slot left out: 32 keys a document, and every pair within distance 15 shares
a key. Most pairs further apart that still pass 0.75 share one too (the chance
that a pair at 0.75 has no chunk with at most one error is 2e-5), and every
candidate is confirmed on the full sets.

Scale: documents with equal sets are one class before any join. In a bucket each
class is first compared with one member only, a few rounds with another member
each time. What that links is one component; after it, only buckets that still
hold more than one component are compared in full, in blocks of 512 members,
across components alone. A link inside a component changes nothing in the result,
so none that matters is lost, and a bucket of n near copies costs n comparisons,
not n squared. Before the full sets are fetched, set sizes (exactly) and 64 more
hash functions of 8 bits (at five standard deviations) rule pairs out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.scratch import Scratch, spare_mark
from tessella.llm.textkit import as_bytes, mix, shingle_hashes, signed, slices, words_of

SLOTS, CHUNK, MAX_DISTANCE = 32, 4, 15
MORE_SLOTS = 64
#: Of all 96 slots 24 differ on average at 0.75, with a standard deviation of 4.2.
FAR_DISTANCE = 45
STAR_ROUNDS, STAR_KEYS = 3, 4
BLOCK = 512
_CODE = np.dtype([("slots", np.uint16, SLOTS), ("more", np.uint8, MORE_SLOTS)])

_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, SLOTS + MORE_SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and their offsets."""
    hashes, at = shingle_hashes(words_of(as_bytes(batch.column(1))))
    own = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
    return np.concatenate([*own, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def signature_codes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One code per non-empty set."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    codes = np.empty(len(starts), dtype=_CODE)
    for k, by in enumerate(_MULTIPLIERS):
        least = mix(np.minimum.reduceat(hashes * by, starts), salt=k)
        if k < SLOTS:
            codes["slots"][:, k] = least >> np.uint64(48)
        else:
            codes["more"][:, k - SLOTS] = least >> np.uint64(56)
    return codes


def _may_link(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Pairs that sizes and all slots leave open."""
    sizes = 100 * np.minimum(n_x, n_y) >= 75 * np.maximum(n_x, n_y)
    differ = (x["slots"] != y["slots"]).sum(axis=-1) + (x["more"] != y["more"]).sum(axis=-1)
    return sizes & (differ <= FAR_DISTANCE)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _CODE)


def chunk_keys(codes: np.ndarray) -> np.ndarray:
    """For each chunk and each slot of it left out, a key of the other slots."""
    wide = codes["slots"].astype(np.uint64)
    keys = np.empty(wide.shape, dtype=np.uint64)
    for first in range(0, SLOTS, CHUNK):
        for out in range(first, first + CHUNK):
            key = np.zeros(len(codes), dtype=np.uint64)
            for k in range(first, first + CHUNK):
                if k != out:
                    key = (key << np.uint64(16)) | wide[:, k]
            keys[:, out] = mix(key, salt=out + 1)
    return keys


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hashes, offsets = _sets(batch)
        full = np.diff(offsets) > 0
        twice = [np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)]
        codes = np.zeros(batch.num_rows, _CODE)
        keys = np.zeros((batch.num_rows, SLOTS), np.uint64)
        if full.any():
            for j, out in enumerate(twice):
                out[full] = np.add.reduceat(mix(hashes, salt=90 + j), offsets[:-1][full])
            codes[full] = signature_codes(hashes, offsets)
            keys[full] = chunk_keys(codes[full])
        flat = pa.array(signed(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.diff(offsets)),
                pa.array(signed(twice[0])),
                pa.array(signed(twice[1])),
                pa.array([x.tobytes() for x in codes], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, SLOTS, dtype=np.int32), flat),
            ],
            names=["doc_id", "n_shingles", "set_a", "set_b", "codes", "keys"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hashes, offsets = _sets(batch)
        lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(signed(hashes)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "shingles"])


def _open_pairs(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pairs:
        n_a, n_b = (batch.column(k).to_numpy() for k in (4, 5))
        near = pa.array(_may_link(_codes(batch.column(2)), _codes(batch.column(3)), n_a, n_b))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(near)


def _first_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Index of the first key that each pair of codes shares."""
    differ = (x["slots"] != y["slots"]).reshape(-1, SLOTS // CHUNK, CHUNK)
    errors = differ.sum(axis=2)
    chunk = (errors <= 1).argmax(axis=1)
    row = np.arange(len(chunk))
    return chunk * CHUNK + np.where(errors[row, chunk] == 1, differ[row, chunk].argmax(axis=1), 0)


def _runs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that agree in (key, first, second), which come one after the other."""
    held: list[pa.RecordBatch] = []
    run = None
    for batch in frames:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(k).to_numpy() for k in range(3)])
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


def _open_in_run(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of pairs of a run, of different components, that may link and have their first key here."""
    comp, blk, n = (t.column(k).to_numpy() for k in ("component", "block", "n_shingles"))
    first, second, slot = (t.column(k)[0].as_py() for k in ("first", "second", "slot"))
    codes = _codes(t.column("codes"))
    left, right = np.flatnonzero(blk == first), np.flatnonzero(blk == second)
    for i in left:
        to = right[(right > i) & (comp[right] != comp[i])] if first == second else right[comp[right] != comp[i]]
        if len(to):
            to = to[_may_link(codes[to], codes[i], n[to], n[i])]
            to = to[_first_key(codes[to], codes[i]) == slot]
        if len(to):
            yield int(i), to


def _involved(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each run that have an open pair."""
    for t in _runs(frames):
        used = np.zeros(t.num_rows, bool)
        for i, to in _open_in_run(t):
            used[i] = True
            used[to] = True
        if used.any():
            yield from t.filter(pa.array(used)).combine_chunks().to_batches()


def _linked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open pairs of each run with 100 * |A & B| >= 75 * |A | B| on the full sets, which come along."""
    for t in _runs(frames):
        doc = t.column("doc_id").to_numpy()
        sets = t.column("shingles").combine_chunks()
        flat, offsets = sets.values.to_numpy(), sets.offsets.to_numpy()
        size = np.diff(offsets)
        a, b = [], []
        for i, to in _open_in_run(t):
            own = np.sort(flat[offsets[i] : offsets[i + 1]])
            ends = np.cumsum(size[to])
            theirs = flat[np.repeat(offsets[to] - (ends - size[to]), size[to]) + np.arange(ends[-1])]
            hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            both = np.add.reduceat(hit.astype(np.int64), ends - size[to])
            to = to[100 * both >= 75 * (len(own) + size[to] - both)]
            a.append(np.minimum(doc[to], doc[i]))
            b.append(np.maximum(doc[to], doc[i]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with 100 * |A & B| >= 75 * |A | B| on the full sets."""
    first = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_of_a"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_of_b"))
    both = F.size(F.array_intersect("set_of_a", "set_of_b"))
    joined = pairs.join(first, "a").join(second, "b")
    either = F.size("set_of_a") + F.size("set_of_b") - both
    return joined.where(100 * both >= 75 * either).select("a", "b")


def _left_open(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs that sizes and signatures don't rule out."""
    first = heads.select(F.col("doc_id").alias("a"), F.col("codes").alias("codes_a"), F.col("n_shingles").alias("n_a"))
    second = heads.select(F.col("doc_id").alias("b"), F.col("codes").alias("codes_b"), F.col("n_shingles").alias("n_b"))
    wide = pairs.join(first, "a").join(second, "b").select("a", "b", "codes_a", "codes_b", "n_a", "n_b")
    return wide.mapInArrow(_open_pairs, "a long, b long")


def _star(placed: DataFrame, salt: int) -> DataFrame:
    """Each member of a bucket with one member of it, if they are of different components."""
    one = F.max(F.struct(F.xxhash64(F.lit(salt), "doc_id").alias("order"), "doc_id", "component")).alias("one")
    centre = placed.groupBy("slot", "key").agg(one, F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    pairs = placed.join(centre.select("slot", "key", "one"), ["slot", "key"]).where("component <> one.component")
    named = pairs.select(F.least("doc_id", "one.doc_id").alias("a"), F.greatest("doc_id", "one.doc_id").alias("b"))
    # A pair at 0.75 shares 13 of 32 keys on average; what is passed over here waits for _rest.
    return named.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= STAR_KEYS).select("a", "b")


_RUN = "key long, first int, second int, slot int, doc_id long, component long, block int, n_shingles long, codes binary"


def _rest(placed: DataFrame, heads: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components in buckets that hold more than one, block against block.

    Full sets travel only to the runs in which a document has an open pair, and are
    compared there, so that pairs that fail never become rows.
    """
    bounds = [F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("members")]
    still = placed.groupBy("slot", "key").agg(*bounds).where("least < most").select("slot", "key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    blocked = placed.join(still, ["slot", "key"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    by = ["key", "first", "second"]
    runs = (
        blocked.join(heads.select("doc_id", "n_shingles", "codes"), "doc_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "slot", "doc_id", "component", "block", "n_shingles", "codes")
        .repartition(*by)
        .sortWithinPartitions(*by)
    )
    wide = runs.mapInArrow(_involved, _RUN).join(sets, "doc_id").select(*by, "slot", "doc_id", "component", "block", "n_shingles", "codes", "shingles")
    return wide.repartition(*by).sortWithinPartitions(*by).mapInArrow(_linked, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id reachable by links of similarity 0.75 or
    more; kept marks that document. Null or blank texts have an empty set, link
    with nothing and are kept. Rows with one id are one document: each row comes
    back, with the same component. Rows with a null id take part in no link and
    come back with a null component, kept. Other columns are not read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_shingles long, set_a long, set_b long, codes binary, keys array<long>"
    signed_docs = scratch.keep(docs.mapInArrow(_sign, schema), "signatures")
    full = signed_docs.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    identity = ["set_a", "set_b", "n_shingles"]
    # As a table, so that a large class is split over tasks when its members look up their class.
    classes = scratch.keep(full.groupBy(*identity).agg(F.min("doc_id").alias("class_id")), "classes")
    member = scratch.keep(full.select("doc_id", *identity).join(classes, identity).select("doc_id", "class_id").distinct(), "members")
    # An id whose rows have different sets ties their classes.
    first = member.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    tied = member.withColumnRenamed("class_id", "b").join(first, "doc_id").where("b <> class_id").select(F.col("class_id").alias("a"), "b").distinct()
    heads = member.where(F.col("doc_id") == F.col("class_id")).select("doc_id")
    heads = scratch.keep(full.join(heads, "doc_id", "left_semi").select("doc_id", "n_shingles", "codes", "keys"), "heads")
    keyed = heads.select(F.posexplode("keys").alias("slot", "key"), "doc_id")
    shared = keyed.groupBy("slot", "key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    touched = scratch.keep(keyed.join(shared, ["slot", "key"], "left_semi"), "touched")
    alike = touched.select("doc_id").distinct()
    sets = scratch.keep(docs.join(alike, "doc_id", "left_semi").mapInArrow(_full_sets, "doc_id long, shingles array<long>"), "sets")

    tested = found = None
    links = tied = scratch.keep(tied, "tied")
    for k in range(STAR_ROUNDS + 1):
        placed = touched.withColumn("component", F.col("doc_id"))
        if found is not None:
            placed = touched.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        if k < STAR_ROUNDS:
            pairs = _left_open(_star(placed, k), heads)
            pairs = scratch.keep(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), f"pairs-{k}")
            tested = pairs if tested is None else tested.unionByName(pairs)
            new = _confirmed(pairs, sets)
        else:
            new = _rest(placed, heads, sets)
        new = scratch.keep(new, f"links-{k}")
        links = links.unionByName(new)
        found = components(links, scratch, f"components-{k}")
    scratch.drop("classes", "heads", "touched", "sets", *(f"pairs-{k}" for k in range(STAR_ROUNDS)), *(f"links-{k}" for k in range(STAR_ROUNDS + 1)))

    result = (
        signed_docs.select("doc_id", "n_shingles")
        .join(first, "doc_id", "left")
        .join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id"))
    )
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, that stay: of each near-duplicate group the one with the smallest id.

    Rows with a null id and rows without words stay. Of several rows with one id
    the one with the smallest text stays.
    """
    mark = spare_mark(documents)
    dropped = near_duplicates(documents).where("not kept").select(F.col("doc_id").alias(f"{mark}dropped")).distinct()
    left = documents.join(dropped, F.col("doc_id").cast("long") == F.col(f"{mark}dropped"), "left_anti")
    repeated = documents.where("doc_id is not null").groupBy(F.col("doc_id").alias(f"{mark}repeated")).agg(F.count("*").alias("n")).where("n > 1").select(f"{mark}repeated")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, F.col("doc_id") == F.col(f"{mark}repeated"), "left_anti")
    several = left.join(repeated, F.col("doc_id") == F.col(f"{mark}repeated"), "left_semi")
    first = several.groupBy(F.col("doc_id").alias(f"{mark}id")).agg(F.min_by(F.struct(*documents.columns), F.struct("text")).alias(f"{mark}row")).select(f"{mark}row.*")
    return once.unionByName(first)
