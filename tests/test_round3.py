"""Plans that derive or read things once (FINDINGS_r03)."""

import datetime

import pytest

from crease.operators.ingest import ingest
from crease.operators.reports import evaluate
from crease.sources import eval_fixtures as X
from crease.sources.match_docs import build_match_documents


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two matches: 80 orders of two lines each."""
    folder = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(2019, 4, 1)
    put = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    put("orders", [(i, i % 7, "FOP"[i % 3], 1.0, day, "1-URGENT") for i in range(80)],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    put("lineitem", [(i, (i + 3 * j) % 20, i % 4, j, float(4 * (i % 5)), 10.0 + j, 0.01 * (i % 11), 0.01 * (i % 8), "RNA"[i % 3], "O", day)
                     for i in range(80) for j in (1, 2)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    put("part", [(i, f"part {i}", "b", "t", 1, 1.0) for i in range(20)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    put("supplier", [(i, f"supplier {i}", 1, 1.0) for i in range(4)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    return folder


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_derive_deliveries_twice_at_most(spark, tables):
    docs = build_match_documents(spark, tables)
    assert sum("Relation" in x and "l_orderkey" in x for x in plan_of(docs).splitlines()) == 2
    first = {r.match_id: r for r in docs.collect()}[0]
    delivery = first.innings[0].overs[1].deliveries[0]
    assert (delivery.batter, delivery.non_striker, delivery.bowler) == ("part 4 (P4)", "part 5 (P5)", "supplier 1 (S1)")
    assert {k.strip(): v for k, v in first.info.registry.people.items()}["part 5 (P5)"] == "P5"


def test_deliveries_are_resolved_once(spark, tables):
    loaded = ingest(build_match_documents(spark, tables))
    for df in (loaded.deliveries, loaded.fielder_dismissals):
        assert "innings" not in plan_of(df) and "registry" not in plan_of(df)
    ids = sorted(r.delivery_id for r in loaded.deliveries.collect())
    assert ids == list(range(1, len(ids) + 1)) and len(ids) > 100
    assert {r.delivery_id for r in loaded.fielder_dismissals.collect()} <= set(ids)


def test_answers_are_sorted_without_a_comparator(spark, tables):
    plan = plan_of(evaluate(X.gold_dataset(spark, tables), X.benchmark_results(spark, tables)))
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_batches_read_gold_entries_derived_before(spark, tables, monkeypatch):
    from crease.plans import file_queries as Q
    seen, start = [], Q.start_incremental_evaluation

    def spy(session, inbox, gold, *args, **kwargs):
        seen.append(plan_of(gold))
        return start(session, inbox, gold, *args, **kwargs)

    monkeypatch.setattr(Q, "start_incremental_evaluation", spy)
    assert Q.streamed_scores(spark, tables).count() == 160
    assert len(seen) == 2 and not any("Aggregate" in p or "Join" in p for p in seen)


def test_text_files_are_scanned_once(spark, tmp_path):
    """What is made of separated files reads their pieces, not the files again."""
    from crease.operators.dataset import convert_files

    for i in range(3):
        (tmp_path / f"text-{i}.txt").write_text(f"https://example.com/live-cricket-scores/{i}\n---\nQuestion: q{i}\nSQL: s\nAnswer:\n1\n---\n\n---\nstray")
    df = convert_files(spark, str(tmp_path))
    assert not [x for x in plan_of(df).splitlines() if "Relation" in x and x.rstrip().endswith(" text")]
    rows = sorted((r.file[-5], r.pos, r.chunk_class, r.context_url[-1], r.question) for r in df.collect())
    assert rows == sorted(x for i in "012" for x in ((i, 0, "url", i, None), (i, 1, "triplet", i, f"q{i}"), (i, 3, "skipped", i, None)))
