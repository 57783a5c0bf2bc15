"""The pipeline's stages against plain rules on a small corpus: what each keeps of its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
from test_operators import expected_groups


def test_stages_keep_the_columns_and_their_decisions(spark, sf):
    docs = corpus_pipeline.table(spark, sf, "documents")
    before, tables = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.cut(stage(spark, before, sf), name)
        assert after.columns == docs.columns
        tables[name] = ([tuple(r) for r in before.select("doc_id", "text").collect()], [tuple(r) for r in after.select("doc_id", "text").collect()])
        before = after
    rows, kept = tables["language_id"]
    assert sorted(kept) == sorted(r for r in rows if any(c.isalpha() for c in r[1] or ""))
    rows, kept = tables["near_dedup"]
    assert sorted(i for i, _ in kept) == sorted(g[0] for g in expected_groups(rows) if g[3])
    rows, kept = tables["decontamination"]
    words = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").translate({k: k + 32 for k in range(65, 91)})).split(" ")
    grams = lambda t: (lambda w: {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1))} if w else set())([x for x in words(t) if x])
    wins = set().union(*(grams(r["text"]) for r in corpus_pipeline.table(spark, sf, "benchmark").collect()))
    assert all(len(w) == 10 for w in wins)
    assert sorted(i for i, _ in kept) == sorted(i for i, t in rows if not grams(t) & wins)
    rows, kept = tables["mixing"]
    assert {i for i, _ in kept} <= {i for i, _ in rows} and dict(kept).items() <= dict(rows).items()
    out = corpus_pipeline.STAGES[-1][1](spark, before, sf).toPandas()
    assert Counter(out.doc_id.tolist()) == Counter(i for i, _ in kept)
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert Counter(map(digest, out.text)) == Counter(digest(t) for _, t in kept)
    assert (out["size"] == [len((t or "").encode()) + 1 for t in out.text]).all()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
