"""Plan-shape checks: the properties that make the queries hold at scale."""

import pytest

import __spark_entry__ as entry
from bytelane import catalog
from corpus_helpers import SF_CHECK

NO_STREAMS = [n for n in catalog.QUERIES if not (n.startswith("stream_") or n == "metric_stream")]


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    qs = entry.queries()
    return {n: plan_text(qs[n](spark, SF_CHECK)) for n in NO_STREAMS}


def test_no_single_partition_exchange_over_data(plans):
    # budget is a global sum (one partial row per task crosses the exchange)
    allowed = {"budget"}
    offenders = [n for n, p in plans.items() if "SinglePartition" in p and n not in allowed]
    assert offenders == []


def test_per_group_top_n_limits_before_the_shuffle(plans):
    for name in ("top_checkpoints", "first_k"):
        assert plans[name].count("WindowGroupLimit") >= 2, name


def test_scans_prune_columns(plans):
    # the flagship reads only the key and the text of `documents`
    p = plans["byte_windows"]
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p or "struct<doc_id:bigint,text:string>" in p
    assert "lang" not in p.split("ReadSchema")[1][:200] if "ReadSchema" in p else True


def test_windows_do_not_shuffle_whole_documents(spark):
    # whole windows come straight from the scan; only boundary pieces are aggregated
    df = entry.queries()["byte_windows"](spark, SF_CHECK)
    p = plan_text(df)
    assert "Union" in p and "ObjectHashAggregate" in p


def test_bucketed_corpus_keeps_contents_in_place(spark):
    from bytelane.operators import offsets as O
    from bytelane.operators import windows as W
    from bytelane.sources.corpus import bucket_corpus, corpus_from_table
    from bytelane.sources.tables import table

    docs = corpus_from_table(table(spark, SF_CHECK, "documents"), "doc_id", "text")
    b = bucket_corpus(docs, "bytelane_test_docs", 8)
    offs, tot = W.corpus_offsets(b)
    joined = O.join_small_or_shuffle(b.select("doc_id", "content"), offs, "doc_id", tot.rows, max_broadcast_rows=0)
    p = plan_text(joined)
    # the only exchanges move metadata (bucket of the prefix sum, offsets by doc_id)
    exchanges = [line for line in p.split("\n") if "Exchange" in line]
    assert len(exchanges) == 2 and all("content" not in e for e in exchanges)
    assert "Bucketed: true" in p
    # and the windows over the bucketed table are the same
    w1, _ = W.byte_windows(docs, 2048)
    w2, _ = W.byte_windows(b, 2048)
    key = lambda r: (r.idx, bytes(r.tokens))
    assert sorted(map(key, w1.collect())) == sorted(map(key, w2.collect()))
