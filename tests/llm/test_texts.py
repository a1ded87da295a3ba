import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm.helpers import changed, docs_frame, prose
from tessella.llm import chat, decontaminate, mixing, wavelet, wrappers
from tessella.llm.queries import op3_chat_formatting, tokenizer_path


def best_distance(item, text):
    """Least edits of item against any part of text, in full."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(text, n, seed):
    rng, s = random.Random(seed), list(text)
    for _ in range(n):
        k = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[k] = "#"
        elif kind == 1:
            s.insert(k, "#")
        else:
            del s[k]
    return "".join(s)


def test_decontamination_is_exact_within_the_budget(spark):
    items = [(k, prose(12 + 5 * k, 70 + k)) for k in range(5)] + [(9, "tiny"), (10, None), (11, " \t"), (12, "a#"), (13, "abcdefghij#l"), (14, "Ba  nter"), (None, "null id, but text")]
    data = []
    for k, t in items[:5]:
        e = decontaminate.edit_budget(len(t))
        for extra in (0, e // 2, e, e + 3, 2 * e + 9):
            data.append((len(data), prose(40, len(data)) + "  \n" + edited(t.upper(), extra, len(data)) + " " + prose(30, 900 + len(data)), "a"))
    data += [(50, None, None), (51, "", None), (52, prose(9000, 3), "a"), (None, items[0][1], "a"), (53, items[1][1], "a"), (53, items[1][1], "a")]
    data += [(60, "a TINY bit", "a"), (61, "destiny", "a"), (62, "tiny", "a"), (63, "say A#", "a"), (64, "a#b", "a"), (65, "xx abdefghij#l", "a"), (66, "xx abefghij#l", "a")]
    data += [(67, "ba \u2003 nter", "a"), (68, "ba nters", "a"), (69, "with nul id, but text", "a"), (70, "\u0130\u03a3 \U00010400 null id, but text", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for extra in (False, True):
        got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(docs_frame(spark, data, extra), bench).collect()}
        want = {}
        for i, t, _ in data:
            if i == 52 or t is None:
                continue
            for k, b in [*items[:5], items[9]]:
                p, q = decontaminate.plain(b), decontaminate.plain(t)
                if (d := best_distance(p, q)) <= decontaminate.edit_budget(len(p)):
                    want[i, k] = d
            want |= {(i, k): 0 for k, b in (items[5], items[8], items[10]) if f" {decontaminate.plain(b)} " in f" {decontaminate.plain(t)} "}
        want |= {(69, None): 1, (70, None): 0}
        assert {(60, 9), (62, 9), (63, 12), (65, 13), (67, 14)} <= set(want) and not {(61, 9), (64, 12), (66, 13), (68, 14)} & set(want)
        assert got == want
    kept = decontaminate.clean(docs_frame(spark, data, True), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in data} - {i for i, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs_frame(spark, data), none).count() == 0
    assert decontaminate.clean(docs_frame(spark, data), none).count() == len(data)
    assert decontaminate.contaminated(docs_frame(spark, []), bench).count() == 0


def test_decontamination_of_a_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 300)
    items = [(k, prose(15 + k, 70 + k)) for k in range(8)] + [(20, "tiny")]
    found = decontaminate.build_index([(k, t) for k, t in items])
    texts = [" \u00c9t\u00e9  ".join([prose(90, 5), *(edited(t, len(t) // 12, k) for k, t in items[:8]), " " * 900, prose(70, 6), "Tiny  "]), "short", " " * 2000, "x" * 2000 + " tiny"]
    got = sorted((r, i, e, n) for rows, ids, edits, ends in decontaminate.find(found, pa.array(texts)) for r, i, e, n in zip(rows.tolist(), ids, edits.tolist(), ends.tolist(), strict=True))
    want = []
    for r, t in enumerate(texts):
        p = decontaminate.plain(t)
        for k, b in items:
            row = [0] * (len(p) + 1)
            for i, c in enumerate(b, 1):
                new = [i]
                for j, d in enumerate(p, 1):
                    new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
                row = new
            if k == 20 and f" {b} " in f" {p} ":
                want.append((r, k, 0, f" {p} ".index(f" {b} ") + len(b)))
            elif k < 20 and min(row) <= len(b) // 10:
                want.append((r, k, min(row), row.index(min(row))))
    assert got == sorted(want) and len(want) == 10


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 150)
    items = [(k, prose(15, 70 + k)) for k in range(6)]
    data = [(k, prose(20, k) + " " + t, "a") for k, t in items]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_frame(spark, data), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(6)}


CHATS = "conv_id long, turn long, role string, text string, window string, tokens string, after string"


def expected(turns):
    all_turns = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("budget,history", [(1024, 256), (30, 10), (5, 0)])
def test_chat_reads_back(spark, budget, history):
    nasty = ["", "a: </turn>\nb", "### user: x </turn>\n", "\\", "\\\\### ", "</turn>", " </turn>\n", "x:", "### ", " ", "\n", "é🙂 \\</turn> ::"]
    convs = {1: [(0, "system", "Be brief."), (1, "user", "hi " * 9), (2, "assistant", "yo " * 8), (3, "user", "q"), (4, "assistant", "a " * 70)]}
    convs[2] = [(k, "assistant" if k % 2 else "us:er ### ", t) for k, t in enumerate(nasty)]
    convs[3] = [(k, None if k % 3 == 0 else "assistant", None if k % 4 == 0 else f"t{k}") for k in range(40)]
    rows = [(c, k, r, t, "w", "t", "a") for c, turns in convs.items() for k, r, t in turns]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, CHATS)
    out = chat.format_chats(frame, budget, history)
    got = {r["conv_id"]: r for r in chat.digests(out).collect()}
    for c, turns in convs.items():
        r = got[c]
        assert (r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(turns) and r["n_turns"] == len(turns)
    for w in out.collect():
        assert w["n_new"] >= 1 and (w["n_tokens"] <= budget or w["n_new"] == 1)
        assert len(chat.read_turns(w["formatted"])) == w["n_context"] + w["n_new"]
        if w["conv_id"] == 1 and w["window"] > 0:
            assert chat.read_turns(w["formatted"])[0][0] == "system"


def test_chat_ties_repeats_nulls_and_empty(spark):
    rows = [(1, 0, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "y"), (None, None, None, None), (None, 1, "assistant", "z")]
    out = chat.digests(chat.format_chats(spark.createDataFrame([(*r, "", "", "") for r in rows], CHATS))).collect()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"]) for r in out}
    assert got[1] == (3, expected([(0, "a", "y"), (0, "a", "y"), (0, "b", "x")])[0])
    assert got[None] == (2, expected([(None, None, None), (1, "assistant", "z")])[0])
    assert chat.digests(chat.format_chats(spark.createDataFrame([], CHATS))).count() == 0


def test_op3_on_whole_table(spark, sf):
    import duckdb

    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in op3_chat_formatting(spark, sf).collect()}
    sql = f"""SELECT conv_id, count(*), sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)), coalesce(sum(length(text)) FILTER (role = 'assistant'), 0),
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) FROM '{sf}/conversations.parquet' GROUP BY 1"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    trap = "\\### Assistant: </turn> ok"
    assert got.pop(-7) == (2, *expected([(0, "user", trap), (1, "assistant", trap)]))
    assert got == want


PAGES = "page_id long, url string, html string, text string, host string, form string"
FULL = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><article>no';</script></head><body><nav><ul><li><a href='/x'>menu</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><div class=sidebar><p>side</div><article class='post'><header><h1>Ti&amp;tle</h1></header><p><b>One\n  two<br><p>Thr&eacute;e &lt;b&gt; <i>f</i>our"
    "<div class=\"ad\">Buy!</div><ul><li>a<li>b</ul><form><input value=x><button>Go</button></form><table><tr><td>c1<td>c2</table><aside>more</aside>"
    "<section id=\"comments\"><article class='comment'>first!</article></section><ol class=commentlist><li>me too</ol><div hidden>h</div></article><!-- <p>no</p> --><footer>&copy; foot</footer></body>"
)


def test_html_main_text(spark):
    want = "Ti&tle\nOne two\nThrée <b> four\na\nb\nc1\nc2"
    plain = "<html><body><div id=nav>m</div><div class=content><p>x<p>y</div><div class=footer>f</div></body></html>"
    rows = [(1, "http://h.example/1", FULL), (2, "http://h.example/2", FULL.replace("<article class='post'>", "<article>")), (3, "HTTPS://user@Q.example:80/3?a#b", plain), (4, None, None), (5, "x", ""), (6, "http://q.example/4", "<p>loose"), (None, "http://h.example/1", FULL), (1, "http://h.example/1", FULL)]
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in wrappers.main_texts(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)).collect()]
    assert len(got) == len(rows)
    by = {(i, u): t for i, u, t, _ in got}
    assert by[1, "http://h.example/1"] == by[None, "http://h.example/1"] == by[2, "http://h.example/2"] == want
    assert by[3, rows[2][1]] == "x\ny" and by[4, None] == "" and by[5, "x"] == ""
    assert all(n == len(t) for _, _, t, n in got)
    assert wrappers.main_texts(spark.createDataFrame([], PAGES)).count() == 0


def test_html_pages_of_one_host_with_different_roots(spark):
    bodies = {
        1: "<article><p>one article</p></article>",
        2: "<main><p>two main</p></main>",
        3: "<div class=content><p>three content</p></div>",
        4: "<p>loose",
        5: "<article><p>a teaser</p></article><main><p>" + "long main text " * 5 + "</p></main>",
        6: "<article></article><div><p>beside</p></div>",
        7: "only words",
    }
    rows = [(i, url, f"<html><body><nav>menu</nav>{b}<footer>foot</footer></body></html>") for i, b in bodies.items() for url in ("http://h.example/", None)]
    got = [(r["page_id"], r["text"]) for r in wrappers.main_texts(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)).collect()]
    want = {1: "one article", 2: "two main", 3: "three content", 4: "loose", 5: ("long main text " * 5).strip(), 6: "beside", 7: "only words"}
    assert sorted(got) == sorted([(i, t) for i, t in want.items()] * 2)


def test_html_page_without_the_roots_of_its_host(spark):
    plain = "<html><body><div class=content><p>x<p>y</div></body></html>"
    rows = [(3, "HTTPS://user@Q.example:80/3?a#b", plain), (6, "http://q.example/4", "<p>loose")]
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)).collect()}
    assert got == {3: "x\ny", 6: "loose"}


def test_html_names_count_as_a_whole(spark):
    parts = "".join(f"<div class='{c}'><p>{c}</p></div>" for c in ("share-price", "section-header", "menu-title", "commentary", "comment-list", "share", "shareButtons"))
    rows = [
        (1, "http://a.example/", f"<article class=commentary>{parts}</article>"),
        (2, "http://b.example/", "<div class='content with-sidebar'><p>text</p></div><div class='side menu'><p>no</p></div>"),
        (3, "http://c.example/", "<div class=entry-content><p>text</p></div><div><p>one</p><p>two</p></div>"),
    ]
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)).collect()}
    assert got == {1: "share-price\nsection-header\nmenu-title\ncommentary", 2: "text", 3: "text"}


def test_wrappers_find_options_and_repeats():
    page = lambda *parts: wrappers.page_wrapper(wrappers.walk("<ul>" + "".join(parts) + "</ul>"))
    li, hr = "<li>x</li>", "<hr>"
    w = wrappers.merge_wrappers(page(li, li), page(li, hr))
    assert wrappers.as_pattern(w) == "<ul> ( <li> #text </li> )+ ( <hr>  </hr> )? </ul>"
    assert wrappers.as_pattern(wrappers.merge_wrappers(w, page(li, li, li))) == wrappers.as_pattern(w)


def test_html_template_goes_without_telling_names(spark):
    page = lambda k: f"<div class=a1><b>MEGA MENU</b> home</div><div class=b2><p>Story {k} begins.</p><p>It goes on, {k * 7}.</p><p>Read our offer!</p></div><div class=c3>C 2020</div>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(6)] + [(10, "http://a.example/x", page(3))]
    # Few different pages have no template: copies of one page don't count as several.
    rows += [(20 + k, "http://b.example/", page(k % 3)) for k in range(9)]
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)).collect()}
    assert all(got[k] == f"Story {k} begins.\nIt goes on, {k * 7}." for k in range(6)) and got[10] == got[3]
    assert all("Read our offer!" in got[20 + k] for k in range(9))
    # Without its host's wrapper a page reads otherwise.
    alone = wrappers.content_paths(wrappers.page_wrapper(wrappers.walk(page(1))))
    assert wrappers.extract(page(1), alone) != got[1]


def test_html_deep_and_wide_pages(spark):
    deep = "<div>" * 100_000 + "<p>far down</p>" + "<li>x" * 20_000 + "</b></i>" * 20_000
    wide = "<article>" + "".join(f"<h2>t{k}</h2><p>one {k}</p><ul><li>two {k}</ul><pre>three</pre>" for k in range(5000)) + "</article><div class=sidebar>no</div>"
    odd = "<ul>" + "<li><b>x" * 20_000
    rows = [(1, "http://a.example/", deep), (2, "http://b.example/", wide), (3, "http://c.example/", odd), (4, "http://b.example/2", "<article><p>" + "word " * 500_000 + "</article>")]
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)).collect()}
    assert got[1].split("\n") == ["far down"] + ["x"] * 20_000
    assert got[2].split("\n") == [x for k in range(5000) for x in (f"t{k}", f"one {k}", f"two {k}", "three")]
    assert got[3].split("\n") == ["x"] * 20_000 and got[4] == " ".join(["word"] * 500_000)


def test_html_matches_the_article_on_whole_table(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def encode(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def test_pieces_encode_as_whole_texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "don't", "é", "\u00a0", "\u3000", "<|endoftext|>", "123", "!!", ".", " x", "'s", "Ω", "\x1c", "\x85", "日本", "🙂", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    own = wavelet.PieceEncoder(tokenizer_path())
    got = [x.tolist() for k in range(0, len(texts), 50) for x in own.encode(texts[k : k + 50])]
    assert got == encode(texts)


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(1)
    for top, n in ((2, 1), (5, 700), (50_000, 5000), (1 << 20, 300), (3, 0)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        m = wavelet.WaveletMatrix.build(ids)
        m = wavelet.WaveletMatrix.from_bytes(memoryview(m.to_bytes()), m.width, m.n)
        assert m.decode().tolist() == ids.tolist()
        for k in rng.integers(0, max(n, 1), 20) if n else []:
            s = int(ids[k])
            assert m.access(int(k)) == s and m.rank(s, int(k)) == (ids[:k] == s).sum() and m.count(s, 3, n) == (ids[3:] == s).sum()
            assert m.occurrences(s).tolist() == np.flatnonzero(ids == s).tolist() and m.select(s, 0) == np.flatnonzero(ids == s)[0]
        assert m.count(top + 7) == 0


class Touched:
    """An array that counts the bytes read of it."""

    def __init__(self, array, log):
        self.array, self.log = array, log

    def __len__(self):
        return len(self.array)

    def __getitem__(self, key):
        out = self.array[key]
        self.log.append(np.asarray(out).nbytes)
        return out


def test_wavelet_answers_read_few_bytes():
    rng = np.random.default_rng(6)
    counts = []
    for n in (1 << 14, 1 << 18):
        ids = (rng.pareto(1.0, n) * 40).astype(np.int64).clip(0, 49_999).astype(np.uint32)
        docs, lengths, m = wavelet.open_shard(wavelet.pack_shard([5, None], [n - 3, 3], ids))
        assert docs.to_pylist() == [5, None] and lengths.tolist() == [n - 3, 3]
        log = []
        m.planes, m._ones = [Touched(x, log) for x in m.planes], [Touched(x, log) for x in m._ones]
        m._samples = [tuple(Touched(x, log) for x in pair) for pair in m._samples]
        most = [0, 0, 0]
        for k in rng.integers(0, n, 40):
            s, nth = int(ids[k]), int((ids[:k] == ids[k]).sum())
            for j, (f, want) in enumerate(((lambda: m.access(int(k)), s), (lambda: m.rank(s, int(k)), nth), (lambda: m.select(s, nth), int(k)))):
                log.clear()
                assert f() == want
                most[j] = max(most[j], sum(log))
        with pytest.raises(IndexError):
            m.select(s, n)
        assert most[0] <= m.width * 75 and most[1] <= m.width * 150 and most[2] <= m.width * 300
        counts.append(most)
    assert sum(counts[1]) < 1.3 * sum(counts[0])  # sixteen times the tokens


def test_token_shards_round_trip(spark, tmp_path):
    data = [(7, prose(300, 1), "a"), (3, None, None), (5, "", "b"), (None, "null id", "a"), (9, prose(20_000, 2), "a"), (7, "tie", "a"), (7, "tie", "a"), (1, "last words  ", "z")]
    path = str(tmp_path / "shards")
    wavelet.write_shards(docs_frame(spark, data, True), path, tokenizer_path(), shard_tokens=500)
    shards = wavelet.read_shards(spark, path)
    got = sorted(wavelet.read_documents(shards).collect(), key=lambda r: r["start"])
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at, flat = [], 0, []
    for (i, _, _), ids in zip(order, encode([t or "" for _, t, _ in order]), strict=True):
        ids = [*ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        flat += ids
    assert [tuple(r) for r in got] == want
    token = flat[40]
    assert sorted(r["position"] for r in wavelet.locate_token(shards, token).collect()) == [k for k, x in enumerate(flat) if x == token]
    assert sum(r["n"] for r in wavelet.count_token(shards, 0).collect()) == flat.count(0)
    wavelet.write_shards(docs_frame(spark, []), path, tokenizer_path())
    assert wavelet.read_documents(wavelet.read_shards(spark, path)).count() == 0


def water_fill(sizes, weights=(5.0, 2.0, 1.0)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing_targets_and_takes(spark):
    rng = random.Random(8)
    sources = ["a", "b", "Z", "é", None, "tiny"]
    data = [(k, prose(rng.randint(0, 90), k), sources[min(5, int(rng.random() ** 2 * 7))]) for k in range(300)] + [(900, None, "a"), (901, " \t", "b"), (None, "x y z", "a"), (5, "again", "a"), (902, "", "void")]
    size = lambda t: len((t or "").split(" ")) if (t or "").strip() else 0
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = water_fill(sizes)
    frame = docs_frame(spark, data, True)
    rows = mixing.plan(frame.drop("__size", "__extra", "__dropped", "___row", "__own")).collect()
    assert len(rows) == len(data)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(r["__target"] == pytest.approx(want[s]) and r["__source_size"] == sizes[s] for r in own)
        assert abs(sum(r["__whole"] * r["__size"] + r["__extra"] for r in own) - want[s]) <= 1
    assert all(r["__whole"] * r["__size"] + r["__extra"] <= 2 * r["__size"] for r in rows)
    again = mixing.plan(frame.drop("__size", "__extra", "__dropped", "___row", "__own").repartition(5)).collect()
    take = lambda rs: sorted(((r["doc_id"], r["text"], r["__whole"], r["__extra"]) for r in rs), key=repr)
    assert take(rows) == take(again)
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    out = {}
    for r in mixed.collect():
        out[r["source"]] = out.get(r["source"], 0) + size(r["text"])
    assert all(abs(out.get(s, 0) - want[s]) <= 1 for s in sizes)
    assert mixing.mix(docs_frame(spark, [])).count() == 0


def test_mixing_many_sources_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    data = [(k, prose(1 + k % 9, k), f"s{k % 11}") for k in range(60)]
    rows = mixing.plan(docs_frame(spark, data)).collect()
    total = sum(r["__size"] for r in rows)
    assert abs(sum(r["__whole"] * r["__size"] + r["__extra"] for r in rows) - 1.5 * total) <= 11


def test_changed_helper_changes():
    assert changed("a b c d", 2) != "a b c d"


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(k, prose(30 + k, k), "ab"[k % 2]) for k in range(40)]
    docs, named = docs_frame(spark, rows), docs_frame(spark, rows, True)
    plain = sorted((r["doc_id"], r["text"]) for r in mixing.mix(docs).collect())
    got = mixing.mix(named)
    assert got.columns == named.columns and sorted((r["doc_id"], r["text"]) for r in got.collect()) == plain
    assert all(r["__size"] == "1" and r["__extra"] == "2" for r in got.collect())
    with pytest.raises(ValueError):
        mixing.plan(named)


def test_chat_read_back_on_whole_table(spark, sf):
    import duckdb

    from tessella.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = QUERIES["chat_read_back"](spark, sf)
    want = con.sql(SQL["chat_read_back"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_piece_memory_is_not_copied_at_each_batch():
    from tessella.llm import wavelet
    from tessella.llm.queries import tokenizer_path

    e = wavelet.PieceEncoder(tokenizer_path())
    moved = 0
    held = None
    for k in range(200):
        texts = [" ".join(f"w{k}x{j} a-{j}.\nb" for j in range(50))]
        assert e.encode(texts)[0].tolist() == e._tokenizer.encode(texts[0], add_special_tokens=False).ids
        now = e._flat.all
        moved += now is not held
        held = now
    assert moved < 20
