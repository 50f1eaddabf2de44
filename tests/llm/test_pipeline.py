"""The pipeline's stages: columns, order, and what each of them leaves."""

import corpus_pipeline as C
from paddock.llm import secrets
from paddock.llm.store import stored
from test_operators import brute_classes

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, tables = docs.columns, [docs]
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "secret_scans", "best_fit_packing"]
    for name, stage in C.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), f"test-{name}"))
    assert all(t.columns == columns for t in tables[:-1])
    rows = [{r.doc_id: r.text for r in t.collect()} for t in tables[:-1]]
    good = [i for i in rows[0] if labels.get(i) == 1]
    bad = [i for i in rows[0] if labels.get(i) == 0]
    assert sum(i in rows[1] for i in good) > 0.97 * len(good) and sum(i in rows[1] for i in bad) < 0.3 * len(bad)
    want = {i for i, (_, c) in brute_classes(list(rows[1].items()), 5, 80).items() if c == i}
    assert set(rows[2]) == want and all(rows[2][i] == rows[0][i] for i in want)
    assert set(rows[3]) <= set(rows[2]) and all(len(rows[3][i]) <= len(rows[2][i]) for i in rows[3])
    assert set(rows[4]) == set(rows[3]) and not any(secrets.base(t or "") for t in rows[4].values())
    assert {r.doc_id for r in tables[-1].select("doc_id").distinct().collect()} == set(rows[4])
