"""Registered queries against their SQL, and the pipeline against its stages run one by one."""

import duckdb
import pytest

import corpus_pipeline
from terradelta.llm import packing, queries, simhash
from terradelta.llm.oracle import ORACLE
from terradelta.llm.tables import staged
from tests.llm import reference as plain
from tests.llm.test_near_copies import kept


def compared(rows):
    return sorted((tuple(sorted(r.items())) for r in rows), key=repr)


@pytest.mark.parametrize("name", ORACLE)
def test_query_and_sql_agree(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = db.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    expected = [dict(zip(names, r)) for r in found.fetchall()]
    got = [r.asDict() for r in queries.QUERIES[name](spark, sf_dir).collect()]
    assert expected and compared(got) == compared(expected)


def test_pipeline_by_hand(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    bench = [(r["item_id"], r["text"]) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near duplicates", "decontamination", "secrets", "packing"]
    stage = {n: lambda *a, f=f: staged(f(*a), "stage") for n, f in corpus_pipeline.STAGES}

    good = stage["quality"](spark, docs, sf_dir)
    judged = queries.QUERIES["op5_quality"](spark, sf_dir).where("kept").select("doc_id").collect()
    assert good.columns == docs.columns
    left = {r["doc_id"] for r in good.collect()}
    assert left == {r["doc_id"] for r in judged}

    one = stage["near duplicates"](spark, good, sf_dir)
    alone = kept([(d, rows[d]["text"]) for d in sorted(left)])  # five-word Jaccard of all pairs
    left = {r["doc_id"] for r in one.collect()}
    assert one.columns == docs.columns and left == alone

    dirty = plain.contamination([(d, rows[d]["text"]) for d in left], bench)
    clean = stage["decontamination"](spark, one, sf_dir)
    left = {d for d in left if not dirty[d][4]}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == left

    safe = stage["secrets"](spark, clean, sf_dir)
    texts = {r["doc_id"]: r.asDict() for r in safe.collect()}
    assert safe.columns == docs.columns and set(texts) == left
    for d, r in texts.items():
        assert (r["text"] == rows[d]["text"]) or "[SECRET]" in r["text"]
        assert not plain.secrets(r["text"]) and r["n_chars"] == len(r["text"])

    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    encoder = packing.Encoder()
    for d, r in texts.items():
        ids = [*encoder.exact.encode(r["text"], add_special_tokens=False).ids, packing.END]
        own = sorted((p for p in pieces if p["doc_id"] == d), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == len(ids)
        assert [p["ids_crc32"] for p in own] == [plain.crc(ids[p["start"] : p["start"] + p["length"]]) for p in own]
    assert {p["doc_id"] for p in pieces} == left


def test_fingerprints_of_the_query(spark, sf_dir):
    got = {r["doc_id"]: r["fingerprint"] for r in queries.QUERIES["op4_simhash"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    assert got == {d: f"{plain.fingerprint(t):016x}" for d, t in texts.items()}
    assert simhash.fingerprint(b"") == 0
