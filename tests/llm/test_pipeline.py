"""Each stage of the pipeline against the plain version of its operator, on what the stage before kept."""

import importlib
import importlib.util
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
cp = importlib.import_module("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None
PATH = "/root/testdata/sf0.001"


@pytest.mark.skipif(cp is None, reason="the pipeline is a part of its own")
def test_stages_equal_brute_force(spark):
    from crease.llm.common import written
    from helpers import union_find
    from test_op02 import brute as clean
    from test_op03 import brute_fingerprint
    from test_op05 import check
    from test_op10 import expected

    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    stages = [f for _, f in cp.STAGES]
    inputs = [docs]
    for f in stages:
        inputs.append(written(f(spark, inputs[-1], PATH), "stage"))
    for df in inputs[1:5]:
        assert df.columns == docs.columns and df.filter("n_chars <> length(text)").count() == 0
    rows = [df.collect() for df in inputs]
    by_id = lambda rs: sorted((r.doc_id, r.text) for r in rs)

    judged = {r.doc_id: clean(r.text) for r in rows[0]}
    assert by_id(rows[1]) == sorted((d, t) for d, (x, t) in judged.items() if x[6])

    hashes = {r[0]: r[1] for r in inputs[1].selectExpr("doc_id", "xxhash64(text)").collect()}
    gone = expected([(r.doc_id, hashes[r.doc_id], r.text) for r in rows[1]])
    want = []
    for r in rows[1]:
        cut = {x[0] for x in gone.get((r.doc_id, hashes[r.doc_id]), [])}
        text = "\n".join(l for n, l in enumerate(r.text.split("\n")) if n not in cut)
        if not cut or text.strip():
            want.append((r.doc_id, text))
    assert by_id(rows[2]) == sorted(want)

    ids = sorted((r.doc_id, r.text) for r in rows[2])
    fps = [brute_fingerprint(t) for _, t in ids]
    root = union_find(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert by_id(rows[3]) == [x for i, x in enumerate(ids) if root[i] == i]

    source = {r.doc_id: r.source for r in rows[3]}
    mixed = {}
    for r in rows[4]:
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + 1
    from crease.llm.op05_mixing import with_copies
    from crease.llm.common import n_words
    from pyspark.sql import functions as F
    copies = with_copies(inputs[3], n_words(F.col("text")), "source").collect()
    check([(r.doc_id, source[r.doc_id], r.text) for r in rows[3]],
          [(r.doc_id, r.mix["size"], r.mix["source_size"], r.mix["target"], r.mix["copies"] * r.mix["size"]) for r in copies])
    assert mixed == {r.doc_id: r.mix["copies"] for r in copies if r.mix["copies"]}

    pieces, n_docs = rows[5], {}
    for r in pieces:
        n_docs[r.doc_id] = n_docs.get(r.doc_id, 0) + r.length
    tokens = {r.doc_id: r.doc_tokens for r in pieces}
    assert n_docs == {d: tokens[d] * k for d, k in mixed.items()}
    used = {}
    for r in pieces:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 2048
