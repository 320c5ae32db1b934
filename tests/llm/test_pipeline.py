"""The pipeline, stage by stage, against the plain meaning of each stage."""

from collections import Counter

import corpus_pipeline
from graphloom.llm import lm, ngram_join, pii, sp_sampling, toxicity
from graphloom.llm.common import table
from graphloom.llm.lattice import load

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == seen["documents"].columns
        docs = out
    ids = {k: Counter(r.doc_id for r in v.select("doc_id").collect()) for k, v in seen.items()}
    flagged = {r.doc_id for r in toxicity.score(seen["documents"], toxicity.train(seen["documents"], table(spark, SF, "labels"))).where("flagged").collect()}
    assert set(ids["toxicity"]) == set(ids["documents"]) - flagged
    comps = {r.doc_id: r.component_id for r in ngram_join.clusters(seen["toxicity"]).collect()}
    assert set(ids["ngram_join"]) == {d for d, c in comps.items() if d == c}
    assert ids["pii"] == ids["ngram_join"]
    assert all(not pii.base_spans(r.text or "") for r in seen["pii"].collect())
    assert any(pii.base_spans(r.text or "") for r in seen["ngram_join"].collect())
    assert all(r.n_chars == len(r.text) for r in seen["pii"].where("text is not null").collect())
    assert set(ids["mixing"]) <= set(ids["pii"]) and max(ids["mixing"].values()) <= 3
    texts = {r.doc_id: r.text or "" for r in seen["mixing"].collect()}
    v = load(lm.VOCABULARY)
    rows = seen["sentencepiece"].collect()
    assert Counter(r.doc_id for r in rows if r.sample == 0) == ids["mixing"] and {r.sample for r in rows} == {0, 1}
    assert all(sp_sampling.decode(v, r.ids) == texts[r.doc_id] and r.exact for r in rows)


def test_run_on_odd_rows(spark, tmp_path):
    """Null, empty and repeated rows, equal and null ids, and columns named like inner ones."""
    base = " ".join(f"w{i % 50} x{i}" for i in range(60))
    rows = [(1, base), (1, base), (2, base + " more"), (None, "other text without an id here"), (None, None), (3, ""), (4, "mail a@b.org now " + "z" * 100_000)]
    docs = spark.createDataFrame([(i, t, "en", None if i == 3 else "s", 5, "u__", 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, u__ string, score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {(r.doc_id, r.n_chars) for r in out}
    assert {d for d, _ in texts} <= {1, None, 3, 4} and 1 in {d for d, _ in texts} and all(r.exact for r in out)
    assert {r.u__ for r in out} == {"u__"} and {r.score for r in out} == {0.5}
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(400)]
    sets = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    rows = [(0, " ".join(words[:100])), (1, " ".join(words[:122])), (2, " ".join(words[200:300])), (3, " ".join(words[200:330]))]
    alike = {(i, j) for i, t in rows for j, u in rows if i < j and 100 * len(sets(t) & sets(u)) >= 80 * len(sets(t) | sets(u))}
    assert alike == {(0, 1)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.without_copies(spark, docs, SF).collect()} == {0, 2, 3}
