"""Registered queries against their SQL, and the pipeline's stages."""

import numpy as np
import pytest
from compare import SF, same
from test_files import check_packing

from quillon.llm import quality, simhash
from quillon.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


def test_all_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


def stages(spark, docs, folder):
    """Each stage's rows, written and read again."""
    import corpus_pipeline as P

    out = []
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, folder), "test")
        out.append(docs)
    return out


def test_pipeline_against_plain_python(spark, monkeypatch):
    """Every stage's decisions over the whole table, computed again document by document and pair by pair."""
    import corpus_pipeline as P
    from test_texts import brute_contamination, brute_linked, brute_spans

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    net = quality.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "text", "quality", 3, 1)
    good = {d for d, t in texts.items() if quality.probability(net, (t or "").encode()) >= 0.5}
    order = sorted(good)
    prints = np.array([np.frombuffer(simhash.document_fingerprint(texts[d], 5, simhash.WORDS), ">u8").astype(np.uint64) for d in order])
    far = np.array([np.bitwise_count(prints ^ p).sum(1) for p in prints])
    component = list(range(len(order)))  # each one's smallest linked, until nothing changes
    while True:
        new = [min(component[j] for j in np.flatnonzero(far[i] <= 104)) for i in range(len(order))]
        if new == component:
            break
        component = new
    first = {order[i] for i in range(len(order)) if component[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d in first if not brute_contamination(texts[d], items)[4]}
    blanked = {}
    for d in clean:
        t = texts[d] or ""
        base = [(int(s), int(e)) for _, s, e in (x.split(":") for x in filter(None, brute_spans(t).split(",")))]
        spans = sorted(base + [(s, e) for s, e, _ in brute_linked(t)])
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        blanked[d] = out + t[at:] if spans else texts[d]
    written, real = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name: written.append(real(df, name)) or written[-1])
    packed = P.run(spark, SF)
    kept, unique, whole, safe = written
    for got, want in ((kept, good), (unique, first), (whole, clean), (safe, clean)):
        assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    assert 100 < len(clean) < len(first) < len(good) < len(texts)
    rows = {r["doc_id"]: r for r in safe.collect()}
    assert {d: r["text"] for d, r in rows.items()} == blanked and all(r["n_chars"] == len(blanked[d]) for d, r in rows.items() if blanked[d] is not None)
    assert check_packing(packed.toPandas(), sorted(blanked.items())) == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, null texts, extra columns with clashing names, and empty tables go through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(40).selectExpr("*", "'x' as row", "1 as id", "'y' as score", "2 as mark")
    odd = some.unionByName(some.limit(10)).unionByName(some.limit(5).selectExpr("cast(null as bigint) as doc_id", "upper(text) as text", "lang", "source", "n_chars", "row", "id", "score", "mark"))
    odd = odd.unionByName(some.limit(1).selectExpr("cast(77777 as bigint) as doc_id", "cast(null as string) as text", "lang", "source", "n_chars", "row", "id", "score", "mark"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    *texts, packed = stages(spark, odd, f"file://{tmp_path}")
    for got in texts:
        assert got.columns == odd.columns and got.where("row = 'x' and id = 1 and score = 'y' and mark = 2").count() == got.count()
    ids = [r["doc_id"] for r in texts[-1].select("doc_id").collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and packed.where("start = 0").count() == texts[-1].count() > 0
    *texts, packed = stages(spark, odd.limit(0), f"file://{tmp_path}")
    assert all(got.count() == 0 and got.columns == odd.columns for got in texts) and packed.count() == 0
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
    *texts, packed = stages(spark, odd, f"file://{tmp_path}")  # nothing learned: every text is kept by the classifier
    assert texts[0].count() == odd.count() and packed.count() > 0
