import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bytelane.functions import scoring as SC
from bytelane.functions.tokens import TokenIds
from bytelane.operators import params as PM
from bytelane.operators import qa as QA
from corpus_helpers import SF_SMALL

STATE = "key STRING, row INT, vec ARRAY<FLOAT>"


def state(spark, spec):
    rows = [(k, r, [float(r)] * w) for k, n, w in spec for r in range(n)]
    return spark.createDataFrame(rows, STATE)


@pytest.mark.parametrize("n_src,n_tgt", [(4, 4), (2, 3), (4, 10)])
def test_extend_embeddings(spark, n_src, n_tgt):
    src = state(spark, [("emb.weight", n_src, 3), ("other", 2, 3)]).withColumn("vec", F.transform("vec", lambda x: x + 100))
    tgt = state(spark, [("emb.weight", n_tgt, 3), ("other", 2, 3)])
    out = PM.extend_embeddings(src, tgt, ["emb.weight"]).where(F.col("key") == "emb.weight").orderBy("row").collect()
    assert [r.vec[0] for r in out] == [r + 100.0 for r in range(n_src)] + [float(r) for r in range(n_src, n_tgt)]
    other = PM.extend_embeddings(src, tgt, ["emb.weight"]).where(F.col("key") == "other").collect()
    assert all(not r.from_source for r in other)


def test_extend_refused(spark):
    with pytest.raises(ValueError, match="more rows"):
        PM.extend_embeddings(state(spark, [("e", 3, 2)]), state(spark, [("e", 2, 2)]), ["e"])
    with pytest.raises(ValueError, match="width"):
        PM.extend_embeddings(state(spark, [("e", 2, 4)]), state(spark, [("e", 2, 5)]), ["e"])
    with pytest.raises(ValueError, match="different keys"):
        PM.extend_embeddings(state(spark, [("e", 2, 4)]), state(spark, [("f", 2, 4)]), ["e"])


def test_rename_and_count(spark):
    s = state(spark, [("encoder.layer.w", 2, 3), ("decoder.w", 1, 3)])
    r = sorted({x.key for x in PM.rename_keys(s, [("encoder.", "stage0."), ("decoder.", "stage1.")]).collect()})
    assert r == ["stage0.layer.w", "stage1.w"]
    with pytest.raises(ValueError):
        PM.rename_keys(s, [("enc", "a"), ("encoder", "b")])
    counts = {x.prefix: x.n_params for x in PM.param_count(s, F.split("key", r"\.")[0]).collect()}
    assert counts == {"encoder": 6, "decoder": 3, None: 9}


QUESTION_DOC = {
    "info": {"split": "val", "license": "CC BY 4.0", "version": "1.0", "date": "2017"},
    "questions": [
        {
            "image_index": 0,
            "program": [
                {"inputs": [], "function": "scene", "value_inputs": []},
                {"inputs": [0], "function": "filter_size", "value_inputs": ["large"]},
                {"inputs": [1], "function": "exist", "value_inputs": []},
            ],
            "question_index": 0,
            "image_filename": "img_0.png",
            "question_family_index": 39,
            "split": "val",
            "answer": "cylinder",
            "question": "Is there a large thing? " + "x" * 181,
        },
        {
            "image_index": 0,
            "program": [{"inputs": [], "function": "count", "value_inputs": []}],
            "question_index": 1,
            "image_filename": "img_0.png",
            "question_family_index": 2,
            "split": "val",
            "answer": "10",
            "question": "How many?",
        },
    ],
}


def test_questions(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text(json.dumps(QUESTION_DOC, indent=2))
    q = QA.read_questions(spark, str(p))
    rows = q.select("idx", QA.question_type().alias("t"), QA.answer_codes(q, "answer").alias("c"),
                    F.octet_length("question").alias("n")).orderBy("idx").collect()
    assert [(r.idx, r.t, r.c) for r in rows] == [(0, "exists", "F"), (1, "count", "A")]
    assert rows[0].n == QA.MAX_QUESTION_LEN_BYTES
    with pytest.raises(ValueError):
        QA.raw_record(q, 0, "test")
    assert QA.raw_record(q, 1, "valid").first().answer == "10"
    assert [r.idx for r in QA.iter_records(q, max_items=1).collect()] == [0]
    bad = spark.createDataFrame([("maybe",)], "answer STRING")
    with pytest.raises(Exception):
        bad.select(QA.answer_codes(bad, "answer")).collect()
    imgs = spark.createDataFrame([("img_0.png", 1)], "image_filename STRING, pixels INT")
    assert QA.join_images(q, imgs).count() == 2


def test_token_collisions(spark):
    df = spark.createDataFrame([([1, 2, 10],), ([10, 3],)], "t ARRAY<INT>")
    got = {(r.token, r.occurrences) for r in QA.token_collisions(df, "t", TokenIds(pad=0, eom=10)).collect()}
    assert got == {("eom", 2)}


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def test_cross_entropy_and_means(spark):
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(6, 5))
    targets = [0, 1, 2, 3, 4, 1]
    df = spark.createDataFrame([(logits[i].tolist(), targets[i]) for i in range(6)], "l ARRAY<DOUBLE>, t INT")
    ce = [r.ce for r in df.select(SC.cross_entropy("l", "t", ignore_index=0).alias("ce")).collect()]
    exp = [0.0 if t == 0 else -math.log(softmax(logits[i])[t]) for i, t in enumerate(targets)]
    assert np.allclose(ce, exp)
    z = spark.createDataFrame([(0.0, 1.0), (2.0, 0.0)], "l DOUBLE, w DOUBLE")
    assert z.agg(SC.nonzero_weighted_mean("l", "w")).first()[0] == 0.0
    m = spark.createDataFrame([(1.0, False)], "l DOUBLE, m BOOLEAN").agg(SC.masked_mean("l", "m")).first()[0]
    assert math.isnan(m)


def test_top_k_and_gumbel(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.5, 2.0],)], "l ARRAY<DOUBLE>")
    assert SC.top_k_count(5, 0.5) == 2
    f = df.select(SC.top_k_filter("l", 2).alias("f")).first().f
    assert f[1] == 3.0 and f[2] == 3.0 and all(math.isinf(v) for i, v in enumerate(f) if i not in (1, 2))
    # Gumbel-max draws follow softmax(l / T)
    logits = [0.0, 1.0, 2.0]
    draws = spark.range(30000).select(
        SC.gumbel_argmax(F.array(*[F.lit(v) for v in logits]), 1.0, F.lit(3), F.col("id")).alias("s")
    )
    freq = {r.s: r["count"] / 30000 for r in draws.groupBy("s").count().collect()}
    p = softmax(np.array(logits))
    assert all(abs(freq.get(i, 0) - p[i]) < 0.02 for i in range(3))
    one = spark.range(50).select(SC.gumbel_argmax(SC.top_k_filter(F.array(*[F.lit(v) for v in logits]), 1), 0.5, F.col("id")).alias("s"))
    assert {r.s for r in one.collect()} == {2}


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["worker", "idx", "start", "n_bytes", "md5"] and df.count() > 0
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 40
    for name in ("byte_offsets", "kind_counts"):
        assert qs[name](spark, SF_SMALL).count() > 0
