import json
import random

import pytest
from pyspark.sql import types as T

from bytelane.operators import qa
from bytelane.operators import windows as W
from bytelane.sources import json_ranges as J
from bytelane.sources import ranges as R
from corpus_helpers import corpus_df


def put(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return str(folder)


def digests(docs, length, **kw):
    w, _ = W.byte_windows(docs, length, **kw)
    return sorted((r.worker, r.idx, bytes(r.tokens)) for r in w.select("worker", "idx", "tokens").collect())


@pytest.mark.parametrize(("range_bytes", "length"), [(7, 10), (64, 10), (1000, 33), (100, 256)])
def test_windows_of_ranges_equal_those_of_whole_files(spark, tmp_path, range_bytes, length):
    rnd = random.Random(range_bytes)
    files = {f"b {i}é.txt": rnd.randbytes(n) for i, n in enumerate((300, 0, 1, 700, range_bytes))}
    put(tmp_path / "validation", files)
    docs = R.corpus_from_ranges(spark, str(tmp_path), "valid", range_bytes=range_bytes)
    whole = [files[name] for name in sorted(files)]
    rows = docs.orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(len(rows))) and max(r.n_bytes for r in rows) <= range_bytes
    assert b"".join(bytes(r.content) for r in rows) == b"".join(whole)
    for kw in ({}, {"workers": 2, "offset": 3, "include_tail": True}):
        assert digests(docs, length, **kw) == digests(corpus_df(spark, whole), length, **kw)


def test_a_file_beyond_two_gigabytes_is_planned_and_read_in_part(spark, tmp_path):
    big = tmp_path / "big.bin"
    with big.open("wb") as f:  # a sparse file
        f.seek(3 << 30)
        f.write(b"the end")
    ranges = R.list_ranges(spark, str(tmp_path), 1 << 30)
    assert [(r.start, r.length) for r in ranges.orderBy("start").collect()] == [(i << 30, 1 << 30) for i in range(3)] + [(3 << 30, 7)]
    assert [bytes(r.content) for r in R.with_content(ranges.where("start >= 3221225472")).collect()] == [b"the end"]


def test_a_file_that_shrinks_is_an_error(tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    with open(tmp_path / "x", "rb") as f, pytest.raises(OSError, match="has changed"):
        R.read_at(f, 1, 3)


HARD = ['{"a": [1, {"q": "]}"}]}', '\\', '"', '\\"', '{{[[', 'é"\\\\"', '\n', '\\u0041', "", "questions", '"questions": [{', "\\" * 9, "}" * 5]


def question(rnd, i):
    return {"image_index": i, "program": [{"inputs": [1, 2], "function": rnd.choice(HARD), "value_inputs": [rnd.choice(HARD)]}] * rnd.randint(0, 3),
            "question_index": i, "image_filename": rnd.choice(HARD), "question_family_index": 1, "split": "train", "answer": rnd.choice(HARD),
            "question": "".join(rnd.choice(HARD) for _ in range(rnd.randint(0, 6)))}


def document(rnd, n):
    parts = {"info": {"split": rnd.choice(HARD), "license": "[{", "version": "}", "date": '"'}, "questions": [question(rnd, i) for i in range(n)],
             "other": [{"question": "not this one"}] * rnd.randint(0, 3), "empty": [], "nested": {"questions": [{"question": "nor this"}]}}
    keys = list(parts)
    rnd.shuffle(keys)
    text = json.dumps({k: parts[k] for k in keys}, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, None, 1]))
    return parts["questions"], text.encode()


@pytest.mark.parametrize("range_bytes", [11, 64, 500, 1 << 20])
def test_records_of_split_documents(spark, tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(J, "LOOK", 5)
    monkeypatch.setattr(J, "ROWS", 3)
    rnd = random.Random(range_bytes)
    want, files = [], {}
    for i, n in enumerate((3, 0, 9) if range_bytes < 100 else (40, 0, 90)):
        records, files[f"{i}.json"] = document(rnd, n)
        want += records
    path = put(tmp_path / "docs", files)
    got = J.read_records(spark, path, qa.QUESTION, "questions", range_bytes).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(len(want)))
    assert [r.question for r in got] == [q["question"] for q in want]
    assert [[s.function for s in r.program] for r in got] == [[s["function"] for s in q["program"]] for q in want]
    whole = qa.read_questions(spark, path).orderBy("idx").collect()
    assert [tuple(r) for r in whole] == [tuple(r) for r in got]


def test_backslashes_across_the_cut(spark, tmp_path):
    for lead in range(9):
        data = ("[" + json.dumps("x" * lead + "\\" * 7 + '"')).encode()
        for start in range(1, len(data)):
            path = tmp_path / "x"
            path.write_bytes(data)
            with open(path, "rb") as f:
                assert J._escaped_at(f, start) == ((len(data[:start]) - len(data[:start].rstrip(b"\\"))) % 2 == 1)


@pytest.mark.parametrize("text", ['{"questions": [{"question": "a"}', '{"questions": [{"question": "a}]}', '{"questions": ]}[', '{"questions": [{"question": 1 2}]}'])
def test_broken_documents_are_errors(spark, tmp_path, text):
    path = put(tmp_path / "bad", {"x.json": text.encode()})
    with pytest.raises(Exception):  # noqa: B017
        J.read_records(spark, path, qa.QUESTION, "questions", 8).collect()


def test_written_documents_are_json(spark, tmp_path):
    rows = [(i, json.dumps({"question": f"q{i}", "answer": "yes"})) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, r string")
    out = str(tmp_path / "out")
    J.document_lines(df, "r", ["k"], '{"split": "train"}', "questions", 4).write.text(out)
    texts = [p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert [q["question"] for t in texts for q in json.loads(t)["questions"]] == [f"q{i}" for i in range(100)]
    got = J.read_records(spark, out, T._parse_datatype_string("question string"), "questions", 50).orderBy("idx").collect()
    assert [r.question for r in got] == [f"q{i}" for i in range(100)]
