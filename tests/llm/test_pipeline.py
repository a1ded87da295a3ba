import corpus_pipeline
from llm.helpers import components, docs_frame, shingles
from tessella.llm import decontaminate
from tessella.llm.queries import tokenizer_path


def test_stages_do_what_they_say(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, frames = [], [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], sf).persist()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        frames.append(out)
        rows.append([r.asDict() for r in out.collect()])
    quality, unique, clean, mixed, tokens = rows
    texts = {r["doc_id"]: r["text"] for r in quality}
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    assert {r["doc_id"] for r in unique} == {i for i in ids if comp[i] == i}
    bench = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in unique if any(b in decontaminate.plain(r["text"]) for b in bench)}
    assert held and {r["doc_id"] for r in clean} <= {r["doc_id"] for r in unique} - held
    size = lambda rs: sum(len(r["text"].split()) for r in rs)
    assert abs(size(mixed) - 1.5 * size(clean)) <= 50
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    assert sum(r["n_tokens"] for r in tokens) == sum(len(e.ids) + 1 for e in t.encode_batch([r["text"] for r in mixed], add_special_tokens=False))


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_stages_take_odd_and_empty_tables(spark, sf):
    odd = docs_frame(spark, [(None, None, None), (1, "", "a"), (1, "plain words here", None), (2, "plain words here", "b")], True)
    for frame in (odd, odd.where("false")):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() >= 0
