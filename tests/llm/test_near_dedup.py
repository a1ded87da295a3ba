import random

import numpy as np
import pytest

from llm.helpers import changed, components, docs_frame, prose, shingles
from tessella.llm import embedding_dedup, minhash_dedup, substring_dedup


def brute(rows):
    sets = {}
    for i, t, _ in rows:
        sets.setdefault(i, []).append(shingles(t))
    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    links = [(a, b) for k, (a, x) in enumerate(flat) for b, y in flat[k + 1 :] if 100 * len(x & y) >= 75 * len(x | y)]
    return components(sets, links)


def rows():
    base = [prose(80, s) for s in range(6)]
    out = [(k * 10, t, "a") for k, t in enumerate(base)]
    out += [(100 + k, changed(base[0], 40, k), "a") for k in range(5)]  # near copies
    out += [(200 + k, base[1].upper(), "b") for k in range(4)]  # copies but for case
    out += [(300, changed(base[2], 9), "b"), (301, "  ", "b"), (302, None, None), (303, "", "c"), (304, "one two", "c"), (305, "One\ttwo", "c")]
    out += [(310, base[3] + " " + prose(30, 99), "c"), (311, prose(6000, 7), "c"), (312, changed(prose(6000, 7), 90), "c"), (313, prose(6000, 7), "c")]
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_minhash_matches_brute_force(spark, extra):
    data = rows()
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs_frame(spark, data, extra)).collect()}
    want = brute(data)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(shingles(dict((a, b) for a, b, _ in data)[i])) for i, r in got.items())


def test_minhash_random_similarities(spark):
    data, k = [], 0
    for s in range(40):
        t = prose(120, 1000 + s)
        for every in (120, 60, 45, 35, 30, 25, 20):
            data.append((k, changed(t, every, k), "a"))
            k += 1
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs_frame(spark, data)).collect()}
    assert got == brute(data)


def test_minhash_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    base = prose(60, 5)
    data = [(k, changed(base, 20 + k % 9, k), "a") for k in range(90)]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs_frame(spark, data)).collect()}
    assert got == brute(data)


def test_minhash_odd_ids_and_empty_table(spark):
    t = prose(30, 1)
    data = [(5, t, "a"), (5, t, "a"), (None, t, "a"), (3, t, None), (5, prose(30, 2), "a")]
    out = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs_frame(spark, data)).collect()]
    assert sorted(out, key=repr) == sorted([(5, 3, False)] * 3 + [(3, 3, True), (None, None, True)], key=repr)
    assert minhash_dedup.near_duplicates(docs_frame(spark, [])).count() == 0
    kept = minhash_dedup.keep_one_each(docs_frame(spark, data, True))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [3, None]
    assert kept.columns == docs_frame(spark, [], True).columns
    twice = minhash_dedup.keep_one_each(docs_frame(spark, [(1, "b c", "a"), (1, "a b", "a"), (2, None, "a")]))
    assert sorted((r["doc_id"], r["text"]) for r in twice.collect()) == [(1, "a b"), (2, None)]


def test_passages_are_found_and_clean_texts_left_alone(spark):
    p, q = prose(60, 50), prose(120, 51)
    data = [
        (1, prose(200, 1) + " " + p + " " + prose(100, 2), "a"),
        (2, p + " " + prose(300, 3), "a"),
        (3, prose(50, 4) + "\n" + p.upper() + "\n" + prose(20, 5), "b"),
        (4, prose(400, 6), "b"),
        (5, prose(70, 8) + " " + q, "c"),
        (6, changed(q, 60) + " " + prose(40, 9), "c"),
        (7, " ".join(p.split(" ")[:30]) + " " + prose(90, 10), "c"),
        (8, None, None), (9, "", None), (10, "short", None), (None, p, None),
        (11, p, "d"), (11, p, "d"),
    ]
    for extra in (False, True):
        got = substring_dedup.repeated_passages(docs_frame(spark, data, extra)).collect()
        ids = {r["doc_id"] for r in got} | {r["other_id"] for r in got}
        assert ids == {1, 2, 3, 5, 6, 11}
        one = next(r for r in got if r["doc_id"] == 3)
        assert one["start_word"] == 50 and one["n_words"] == 60 and one["similarity"] == 1.0
        near = [r for r in got if {r["doc_id"], r["other_id"]} == {5, 6}]
        assert near and all(r["n_words"] >= 100 and 0.75 <= r["similarity"] < 1 for r in near)
    assert substring_dedup.repeated_passages(docs_frame(spark, [])).count() == 0


def test_compact_windows_hold_every_subsequence_once():
    rng = np.random.default_rng(2)
    for n, span, top in ((60, 5, 1 << 60), (200, 17, 1 << 60), (9, 9, 1 << 60), (50, 4, 6)):
        h = rng.integers(1, top, n).astype(np.uint64) * np.uint64(1 << 40 if top < 100 else 1)
        left, centre, right = substring_dedup.compact_windows(h, np.zeros(0, np.int64), span)
        at = {}
        for lo, c, hi in zip(left, centre, right, strict=True):
            for i in range(lo, c + 1):
                for j in range(max(c, i + span - 1), hi + 1):
                    assert (i, j) not in at
                    at[i, j] = c
        want = {(i, j): i + int(np.argmin(h[i : j + 1])) for i in range(n) for j in range(i + span - 1, n)}
        assert at == want


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string, kept string, dim string")


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    x = [c + rng.normal(scale=s, size=24) for c in centres for s in (0.1, 0.3, 0.4, 0.5, 0.6)] + [centres[0] * 2, centres[0] * 2, np.append(np.array([0.9, (1 - 0.81) ** 0.5]), np.zeros(22)), np.eye(24)[0]]
    rows = [(k, v.tolist(), 0, "a", "b", "c") for k, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 24, 0), (902, [None] + [1.0] * 23, 0), (903, [float("nan")] * 24, 0), (904, [1.0, 2.0], 0), (905, [], 0), (None, x[0].tolist(), 0), (906, [float("inf")] + [0.0] * 23, 1)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(vectors(spark, rows + [(*o, "a", "b", "c") for o in odd])).collect()}
    m = np.array(x)
    u = m / np.sqrt((m * m).sum(1, keepdims=True))
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    near_edge = np.abs(u @ u.T - 0.9) < 1e-12
    for a, b in np.argwhere(near_edge):
        hit[a, b] = float(m[a] @ m[b]) / (float(np.sqrt(m[a] @ m[a])) * float(np.sqrt(m[b] @ m[b]))) >= 0.9
    want = components(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(hit)])
    assert all(got[k]["n_links"] == hit[k].sum() and got[k]["component_id"] == want[k] and got[k]["kept"] == (want[k] == k) for k in range(len(x)))
    assert all(got[o[0]]["n_links"] == 0 and got[o[0]]["kept"] and got[o[0]]["component_id"] == o[0] for o in odd)
    assert hit.sum() > 20
    assert embedding_dedup.near_duplicate_vectors(vectors(spark, [])).count() == 0


def hidden_pair():
    """Two documents with a passage of 60 words, and strangers below and above their ids with each of its shingles.

    Five words stand in the middle of a stranger's own, often as the least shingle of a wide window.
    """
    p = prose(60, 70).split(" ")
    rows = [(5000, prose(150, 71) + " " + " ".join(p) + " " + prose(150, 72), "a"), (5001, prose(90, 73) + " " + " ".join(p) + " " + prose(90, 74), "a")]
    for k in range(56):
        for n in range(8):
            for i in (k * 8 + n, 9000 + k * 8 + n):
                rows.append((i, " ".join([prose(24, 20_000 + i), *p[k : k + 5], prose(24, 40_000 + i)]), "b"))
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_passages_of_frequent_phrases_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block, raising=False)
    got = substring_dedup.repeated_passages(docs_frame(spark, hidden_pair())).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(5001, 5000)}
    assert {(r["start_word"], r["n_words"], r["other_start_word"], r["other_n_words"]) for r in got} == {(90, 60, 150, 60)}


def test_passage_among_documents_that_hold_it_in_pieces(spark):
    p = prose(60, 7).split(" ")
    rows = [(500 + k, " ".join([prose(80, 10 + k), *p, prose(70, 20 + k)]), "a") for k in range(3)]
    for k in range(80):
        pieces = [x for at in range(0, 60, 12) for x in (*p[at : at + 12], prose(30, 1000 + 100 * k + at))]
        rows.append((k if k < 40 else 1000 + k, " ".join([prose(30, 5000 + k), *pieces]), "b"))
    got = substring_dedup.repeated_passages(docs_frame(spark, rows)).collect()
    assert {i for r in got for i in (r["doc_id"], r["other_id"])} == {500, 501, 502}


def test_recall_of_passages_among_frequent_lines(spark):
    rng = random.Random(12)
    lines = [prose(12, 90_000 + k) for k in range(6)]
    rows, texts = [], {}
    for g in range(30):
        p = prose(60, 300 + g)
        for k, every in enumerate((1000, 60, 50, 45)):
            i = 10 * g + k
            texts[i] = changed(p, every, i) if every < 1000 else p
            around = [prose(rng.randint(20, 60), 7000 + i), rng.choice(lines), texts[i], rng.choice(lines), prose(rng.randint(20, 60), 8000 + i)]
            rows.append((i, " ".join(around), "a"))
    rows += [(2000 + k, " ".join([prose(60, 20_000 + k), *rng.sample(lines, 3), prose(50, 30_000 + k)]), "b") for k in range(120)]
    got = substring_dedup.repeated_passages(docs_frame(spark, rows)).collect()
    links = [(r["doc_id"], r["other_id"]) for r in got]
    of = components([i for i, _, _ in rows], links)
    sets = {i: shingles(t) for i, t in texts.items()}
    alike = [(a, b) for a in sets for b in sets if a < b and a // 10 == b // 10 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(alike) > 60 and np.mean([of[a] == of[b] for a, b in alike]) >= 0.97
    assert all(a // 10 == b // 10 and a < 2000 for a, b in links)


def test_neighbours_of_a_chain_are_linked_whatever_their_ends_are_tied_to(spark):
    """Four versions of a passage, each like the next one only: the middle ones are tied to the smallest and to the largest."""
    rows, sets = [], {}
    for g in range(8):
        p = prose(80, 600 + g).split(" ")
        for k, places in enumerate(((), (16, 48), (32, 64), (16, 48))):
            for at in places:
                p[at] = f"new{g}x{k}x{at}"
            sets[10 * g + k] = shingles(" ".join(p))
            rows.append((10 * g + k, " ".join([prose(60, 7000 + 10 * g + k), *p, prose(60, 9000 + 10 * g + k)]), "a"))
    got = substring_dedup.repeated_passages(docs_frame(spark, rows)).collect()
    alike = {(b, a) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert alike == {(10 * g + k + 1, 10 * g + k) for g in range(8) for k in range(3)}
    assert {(max(r["doc_id"], r["other_id"]), min(r["doc_id"], r["other_id"])) for r in got} == alike


def test_thinning_keeps_every_stretch_that_may_be_a_passage():
    rng = np.random.default_rng(6)
    size = substring_dedup._OTHER_SPAN
    for _ in range(30):
        n = int(rng.integers(size, 150))
        shared, again = rng.random(n) < rng.choice([0.5, 0.7, 0.8]), rng.random(n) < 0.1
        borders = np.unique(rng.integers(1, n - 1, int(rng.integers(0, 3))))
        want = np.zeros(n, bool)
        for i in range(n):
            for j in range(i + size, n + 1):
                if not ((i <= borders) & (borders < j)).any() and shared[i:j].sum() >= 3 * (~shared[i:j] & ~again[i:j]).sum():
                    want[i:j] = True
        assert substring_dedup._dense(shared, again, borders).tolist() == want.tolist()


def test_shingles_beside_centres_are_counted_exactly():
    rng = np.random.default_rng(8)
    x, y = (rng.integers(0, 150, (n, 91)).astype(np.uint32) for n in (7, 11))
    sets = [[set(r.tolist()) - {0} for r in rows] for rows in (x, y)]
    both, n_x, n_y = substring_dedup._in_common(x, y)
    assert both.tolist() == [[len(a & b) for b in sets[1]] for a in sets[0]]
    assert [n_x.tolist(), n_y.tolist()] == [[len(s) for s in side] for side in sets]


def test_pairs_of_windows_are_left_out_only_within_a_class():
    rng = np.random.default_rng(9)
    for same in (True, False) * 10:
        n, m = 12, 12 if same else 9
        ok = rng.random((n, m)) < 0.5
        open_x = rng.random(n) < 0.8
        open_y = open_x if same else rng.random(m) < 0.8
        ok &= open_x[:, None] | open_y
        ok = np.triu(ok, 1) if same else ok
        alike = ok & (rng.random((n, m)) < 0.2)
        i, j = substring_dedup._thin_pairs(ok, alike, open_x, open_y, same)
        kept = set(zip(i.tolist(), j.tolist(), strict=True))
        assert kept <= set(zip(*(x.tolist() for x in np.nonzero(ok)), strict=True))
        node = (lambda k: k) if same else (lambda k: n + k)
        nodes = range(n if same else n + m)
        shut = np.flatnonzero(~(open_x if same else np.concatenate([open_x, open_y]))).tolist()
        through = [(shut[0], k) for k in shut]
        links = [(a, node(b)) for a, b in zip(*(x.tolist() for x in np.nonzero(alike)), strict=True)]
        of = components(nodes, links + through)
        assert components(nodes, [(a, node(b)) for a, b in kept if alike[a, b]] + through) == of
        assert all((a, b) in kept for a, b in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True) if of[a] != of[node(b)])


def best_likeness(a, b, span):
    """Largest similarity of any two stretches, one of ``span`` or more, from all of them."""
    best = 0.0
    for i in range(len(a)):
        for k in range(i + 1, len(a) + 1):
            own = set(a[i:k])
            for j in range(len(b)):
                theirs, both = set(), 0
                for n, x in enumerate(b[j:], 1):
                    if x not in theirs:
                        theirs.add(x)
                        both += x in own
                    if n >= span or k - i >= span:
                        best = max(best, both / (len(own) + len(theirs) - both))
    return best


def test_passages_with_inserted_words_in_either_order():
    rng = np.random.default_rng(3)
    p = np.arange(56, dtype=np.uint64)
    longer = np.concatenate([p[:26], np.arange(100, 112, dtype=np.uint64), p[30:]])  # 8 words put in: 64 shingles, 52 shared
    for a, b in ((longer, p), (p, longer)):
        assert [round(x[4], 3) for x in substring_dedup.passages(a, b)] == [0.765]
    found = 0
    for n in range(40):
        x = np.arange(24, dtype=np.uint64)
        at, more = int(rng.integers(4, 20)), int(rng.integers(1, 9))
        y = np.concatenate([x[: at - 2], np.arange(100, 100 + more, dtype=np.uint64), x[at + int(rng.integers(0, 3)) :]])
        x, y = (np.concatenate([rng.integers(1000, 1 << 40, 3, dtype=np.uint64), z, rng.integers(1000, 1 << 40, 4, dtype=np.uint64)]) for z in (x, y))
        there = best_likeness(x.tolist(), y.tolist(), 18) >= 0.75
        for a, b in ((x, y), (y, x)):
            assert bool(substring_dedup.passages(a, b, 18)) == there, n
        found += there
    assert 5 < found < 40


def test_versions_of_a_text_are_tied_without_all_their_pairs(spark):
    """Versions that a text's first one ties, exact copies of some, and a stranger with a lower id that holds pieces of it."""
    base = prose(300, 60)
    words = base.split(" ")
    rows = [(0, " ".join(x for at in range(0, 300, 12) for x in (*words[at : at + 12], prose(30, 900 + at))), "b"), (1, base, "a")]
    rows += [(k, changed(base, 36 + k % 5, k), "a") for k in range(2, 32)]
    rows += [(100 + k, rows[2 + k % 10][1], "a") for k in range(40)]
    got = substring_dedup.repeated_passages(docs_frame(spark, rows)).collect()
    links = [(r["doc_id"], r["other_id"]) for r in got]
    of = components([i for i, _, _ in rows], links)
    assert all(of[i] == 1 for i, _, _ in rows if i) and of[0] == 0
    assert all(a > b for a, b in links) and len(set(links)) < 2 * len(rows)


def test_runs_without_a_wanted_position_are_not_looked_into():
    rng = np.random.default_rng(5)
    one, two = (rng.integers(1, 1 << 40, 80).astype(np.uint64) for _ in range(2))
    gap = [rng.integers(1, 1 << 40, 200).astype(np.uint64) for _ in range(2)]
    a, b = (np.concatenate([one, g, two]) for g in gap)
    at = lambda *x: (np.array(x), np.array(x))
    whole = [(0, 79, 0, 79, 1.0), (280, 359, 280, 359, 1.0)]
    assert substring_dedup.passages(a, b) == whole
    assert substring_dedup.passages(a, b, 46, *at(10)) == whole[:1]
    assert substring_dedup.passages(a, b, 46, *at(10, 300)) == whole
    assert substring_dedup.passages(a, b, 46, *at(180)) == []


def test_passages_at_the_edge_of_a_text_are_found(spark):
    """Pairs whose passage needs the first words of a text, which the search for longest runs leaves out."""
    rows, sets = [], []
    for n, seed in enumerate((20, 280, 323, 357, 732, 823, 1468)):
        rng = random.Random(seed)
        p = prose(rng.randint(40, 75), seed).split(" ")
        q = list(p)
        for k in range(rng.randint(0, 5)):
            q[rng.randrange(len(q))] = f"new{k}x{n}"
        for k, words in enumerate((p, q)):
            around = [prose(rng.randint(0, 20), seed + (2 * k + i) * 10**6) for i in (1, 2)]
            rows.append((10 * n + k, " ".join([around[0], *words, around[1]]).strip(), "a"))
        sets.append([shingle_list(rows[-2][1]), shingle_list(rows[-1][1])])
    assert all(most_alike(a, b, 46) >= 0.75 for a, b in sets)
    got = substring_dedup.repeated_passages(docs_frame(spark, rows)).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(10 * n + 1, 10 * n) for n in range(len(sets))}
    for r in got:
        a, b = sets[r["other_id"] // 10]
        own = set(b[r["start_word"] : r["start_word"] + r["n_words"] - 4])
        other = set(a[r["other_start_word"] : r["other_start_word"] + r["other_n_words"] - 4])
        assert abs(len(own & other) / len(own | other) - r["similarity"]) < 1e-9


def shingle_list(text):
    words = text.split(" ")
    return [tuple(words[k : k + 5]) for k in range(len(words) - 4)]


def most_alike(a, b, span):
    """Largest similarity of a stretch of ``span`` shingles of either side and any stretch of the other."""
    best = 0.0
    for x, y in ((a, b), (b, a)):
        for i in range(len(x) - span + 1):
            own = set(x[i : i + span])
            for j in range(len(y)):
                for k in range(j + 35, min(len(y), j + 61) + 1):
                    other = set(y[j:k])
                    best = max(best, len(own & other) / len(own | other))
    return best


def test_codes_of_texts_without_repeats_are_not_kept(spark, monkeypatch):
    from pathlib import Path

    sizes, keep = {}, substring_dedup.Scratch.keep

    def measured(self, frame, name):
        out = keep(self, frame, name)
        folder = Path(f"{self.path}/{name}".removeprefix("file:").replace("//", "/"))
        sizes[name] = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
        return out

    monkeypatch.setattr(substring_dedup.Scratch, "keep", measured)
    p = prose(60, 3)
    rows = [(k, prose(400, 10 + k) + (" " + p if k < 2 else ""), "a") for k in range(600)]
    got = substring_dedup.repeated_passages(docs_frame(spark, rows)).collect()
    assert [(r["doc_id"], r["other_id"], r["n_words"]) for r in got] == [(1, 0, 60)]
    # 240,000 shingles have codes of 1.2 MB.
    assert sizes and max(sizes.values()) < 600_000


def test_pairs_without_a_passage_beside_their_centres_are_left_out():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 32, 91).astype(np.uint32)

    def version(*places):
        out = base.copy()
        for at in places:
            out[at : at + 5] = rng.integers(1, 1 << 32, len(out[at : at + 5]))
        return out

    x = np.stack([base, version(20), version(10, 50), version(8, 28, 55, 80)])
    y = np.stack([base, version(60), version(25, 70), version(15, 35, 62, 75)])
    i, j = (v.ravel() for v in np.indices((4, 4)))
    maybe = substring_dedup._maybe_alike(x, y, i, j).reshape(4, 4)
    sure = substring_dedup._surely_alike(x, y, i, j).reshape(4, 4)
    there = np.array([[best_around(a, b) >= 0.75 for b in y] for a in x])
    assert (maybe | ~there).all() and (there | ~sure).all()
    assert not maybe[3, 3] and maybe[:2, :2].all() and sure[:2, :2].all()


def best_around(a, b):
    """Largest similarity of stretches around the middle, of 46 of one side and as many of the other."""
    best = 0.0
    for i in range(46):
        for k in range(max(i + 46, 46), 92):
            own, other = set(a[i:k].tolist()), set(b[i:k].tolist())
            best = max(best, len(own & other) / len(own | other))
    return best
