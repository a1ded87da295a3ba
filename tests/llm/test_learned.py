import random
import zlib

import numpy as np
import pyarrow as pa

from llm.helpers import DOCS, docs_frame, prose
from tessella.llm import labels, quality, toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def held(i, folds, k):
    return zlib.crc32(str(i).encode()) % folds == k


def quality_rows(n=400):
    rng = random.Random(2)
    rows, marks = [], []
    for k in range(n):
        t = prose(rng.randint(20, 200), k)
        bad = k % 3 == 0
        if bad:
            t = " ".join(w.upper() + rng.choice(["!!", "###", "%%"]) for w in t.split(" "))
        rows.append((k, t, "a"))
        marks.append((k, int(not bad), 0, "not the text"))
    return rows, marks


def test_quality_held_out_and_whole_texts(spark):
    rows, marks = quality_rows()
    odd = [(1000, None, None), (1001, "", None), (None, prose(30, 1), None), (1, rows[1][1], "a"), (1002, prose(30_000, 9), "b")]
    got = quality.quality_scores(docs_frame(spark, rows + odd, True), spark.createDataFrame(marks + [(None, 1, 1, ""), (3, None, None, "")], LABELS)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: q for i, q, _, _ in marks}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"], 4, 2))
    out = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in out) / len(out) > 0.95
    one = {r["doc_id"]: r["score"] for r in got}
    assert one[1002] >= 0.7


def test_quality_reads_every_byte(monkeypatch):
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=(quality.WIDTH, quality.FILTERS)).astype(np.float32), rng.normal(size=(quality.WIDTH, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), rng.normal(size=quality.FILTERS).astype(np.float32), np.zeros(1, np.float32))
    texts = [b"", b"x", b"hello world " * 3, b"A!" * 400, "é".encode() * 999, rng.integers(0, 256, 2048).astype(np.uint8).tobytes(), rng.integers(32, 127, 9000).astype(np.uint8).tobytes()]

    def slow(t):
        halves = max(1, -(-len(t) // (quality.STEP * quality.HALF)))
        data = t.ljust(halves * quality.STEP * quality.HALF + quality.STEP * 2, b"\0")
        x = quality.BYTES[np.frombuffer(data, np.uint8)]
        top = np.zeros((halves, quality.FILTERS))
        for s in range(-(-len(t) // quality.STEP)):
            lo = s * quality.STEP
            z = x[lo : lo + 4].reshape(-1) @ model.near + model.bias
            if s + 1 < halves * quality.HALF:
                z = z + x[lo + 4 : lo + 8].reshape(-1) @ model.far
            h = s // quality.HALF
            top[h] = np.maximum(top[h], z)
        chunks = np.maximum(top, np.concatenate([top[1:], np.zeros((1, quality.FILTERS))]))
        v = chunks.mean(axis=0) @ model.out
        return 1 / (1 + np.exp(-np.clip(v, -30, 30)))

    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    alone = np.array([quality.probabilities(model, [t])[0] for t in arrays])
    assert np.allclose(alone, [slow(t) for t in texts], atol=1e-4)
    assert np.allclose(quality.probabilities(model, arrays), alone, atol=1e-4)
    assert np.allclose(quality.score_column(model, pa.array([None, *(t.decode("latin-1") for t in texts[:4])])[1:]), alone[:4], atol=1e-4)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 1024)
    assert np.allclose(quality.probabilities(model, arrays), alone, atol=1e-4)


def test_quality_memory_on_a_long_text():
    """A text of 200 MB takes little beside itself."""
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa
from tessella.llm import quality
w, f = quality.WIDTH, quality.FILTERS
rng = np.random.default_rng(0)
model = quality.Model(*(rng.normal(size=s).astype(np.float32) for s in ((w, f), (w, f), f, f, 1)))
quality.score_column(model, pa.array(["warm up " * 50000]))
column = pa.array(["0123456789abcde " * (200 << 16)], pa.large_string())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
quality.score_column(model, column)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 60


def test_toxicity_learns_pairs_that_add_nothing_alone():
    rng = random.Random(4)
    texts, y = [], []
    for k in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = prose(20, k).split(" ") + ["clodpate"] * insult + ["zorbian"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        y.append(int(insult == group))  # no single word tells
    model = toxicity.fit([toxicity.terms_of(t) for t in texts[:1200]], np.array(y[:1200]))
    score = toxicity.Scorer(model)
    right = np.mean([(score(t) > 0.5) == bool(v) for t, v in zip(texts[1200:], y[1200:], strict=True)])
    assert right > 0.95


def test_toxicity_learns_a_rare_pair_among_many_words():
    rng = random.Random(5)
    common, rare = sorted({prose(1, k) for k in range(400)}), prose(9000, 77).split(" ")
    texts, y, marked = [], [], []
    for k in range(2400):
        kind = ["", "", "", "", "", "both", "insult", "group"][k % 8]
        words = [w for w in common if rng.random() < 0.6] + rng.sample(rare, 20) + ["clodpate"] * (kind in ("both", "insult")) + ["zorbian"] * (kind in ("both", "group"))
        rng.shuffle(words)
        texts.append(" ".join(words))
        y.append(int(kind == "both") if kind else k % 8 % 2 ^ 1)  # no single word tells
        marked.append(bool(kind))
    model = toxicity.fit([toxicity.terms_of(t) for t in texts[:1800]], np.array(y[:1800]))
    assert {b for w in ("clodpate", "zorbian") for b in toxicity.buckets_of(w)[:1]} <= set(model.rows)
    score = toxicity.Scorer(model)
    tests = [(score(t) > 0.5) == bool(v) for t, v, m in zip(texts[1800:], y[1800:], marked[1800:], strict=True) if m]
    assert np.mean(tests) > 0.9


def toxic_rows(n=500):
    rng = random.Random(6)
    rows, marks = [], []
    for k in range(n):
        words = prose(rng.randint(20, 120), k).split(" ")
        bad = k % 4 == 0
        if bad:
            words += [rng.choice(["nitwit", "dolt", "grumblor"]) + rng.choice(["", "en", "isch"]) for _ in range(2)]
            rng.shuffle(words)
        rows.append((k, " ".join(words), "a"))
        marks.append((k, 1, int(bad), "not the text"))
    return rows, marks


def test_toxicity_held_out_and_odd_rows(spark):
    rows, marks = toxic_rows()
    odd = [(1000, None, None), (1001, "", None), (None, "a nitwit", None), (1, rows[1][1], "a"), (1002, prose(30_000, 9) + " nitwit and dolt", "b")]
    got = toxicity.toxicity_scores(docs_frame(spark, rows + odd, True), spark.createDataFrame(marks + [(None, 1, 1, ""), (3, None, None, "")], LABELS)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: t for i, _, t, _ in marks}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"], 3, 1))
    out = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in out) / len(out) > 0.97
    one = {r["doc_id"]: r["predicted"] for r in got}
    assert one[1002] == 1 and one[1001] == 0


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], LABELS)
    docs = docs_frame(spark, [(1, "some text", "a"), (2, None, "a")])
    assert all(r["predicted"] == 1 for r in quality.quality_scores(docs, none).collect())
    assert all(r["predicted"] == 0 for r in toxicity.toxicity_scores(docs, none).collect())
    empty = spark.createDataFrame([], DOCS)
    assert quality.quality_scores(empty, none).count() == 0 and toxicity.toxicity_scores(empty, none).count() == 0
    assert quality.keep_good(docs_frame(spark, [(1, "some text", "a")], True), none).count() == 1


def test_sample_is_bounded_and_skips_conflicts(spark):
    docs = docs_frame(spark, [(k, f"text {k}", "a") for k in range(50)])
    marks = spark.createDataFrame([(k, k % 2, 0, "") for k in range(50)] + [(4, 1, 0, ""), (6, 0, 0, "")], LABELS)
    s = labels.windows(labels.labelled_documents(docs, marks, "quality", per_class=5)).toPandas()
    assert sorted(s["y"]) == [0] * 5 + [1] * 5
    s = labels.windows(labels.labelled_documents(docs, marks, "quality", per_class=100)).toPandas()
    assert len(s) == 49 and "text 4" not in set(s["text"])
    long = docs_frame(spark, [(k, f"{k:03d}" * 3000, "a") for k in range(50)] + [(3, "another", "b"), (5, None, "b")])
    s = labels.windows(labels.labelled_documents(long, marks, "quality", per_class=20), chars=100).toPandas()
    assert len(s) == 40 and set(s["text"].str.len()) <= {100, len("another")}
    few = labels.labelled_documents(docs, marks, "quality", per_class=3)
    assert sorted(few.toPandas()["y"]) == [0] * 3 + [1] * 3 and sorted(few.collect()) == sorted(few.collect())
