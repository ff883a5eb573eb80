"""The pipeline's stages, each against its operator's brute-force rule."""

import corpus_pipeline
from colloquy.llm import decontam, linededup, simhash
from colloquy.llm.common import stash


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.toPandas()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = stash(stage(spark, docs, sf_dir))
        after = docs.toPandas()
        seen[name] = (before, after)
        if name != "mixing":
            assert docs.columns == columns and set(after.doc_id) <= set(before.doc_id)
        before = after
    before, after = seen["line_dedup"]
    old = dict(zip(before.doc_id, before.text, strict=True))
    lines = [x for t in after.text for x in t.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    assert all(set(t.split("\n")) <= set(old[i].split("\n")) for i, t in zip(after.doc_id, after.text, strict=True))
    assert (after.n_chars == after.text.str.len()).all()
    sets = [linededup.shingles(x) for x in lines if len(x) > 60]
    assert not any(linededup.similar(a, b) for i, a in enumerate(sets) for b in sets[:i])
    before, after = seen["simhash"]
    prints = [simhash.fingerprint(t) % (1 << 64) for t in after.text]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
    before, after = seen["decontamination"]
    items = [decontam.words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = {i for i, t in zip(before.doc_id, before.text, strict=True) if any(" ".join(w) in " ".join(decontam.words(t)) for w in items)}
    assert holds.isdisjoint(after.doc_id) and len(before) - len(after) <= len(holds) + 2
    before, after = seen["mixing"]
    assert sorted(after.doc_id) == sorted(before.doc_id) and (after.taken <= 3 * after["size"]).all()


def test_run_reaches_the_last_stage(spark, sf_dir):
    assert {"doc_id", "taken", "target"} <= set(corpus_pipeline.run(spark, sf_dir).columns)
