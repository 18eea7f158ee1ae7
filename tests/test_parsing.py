import json
import random

import pytest

from bytelane.sources import parsing as P


def parser():
    """A function that travels to the tasks by value, as one from a notebook does."""

    def parse(line):
        d = json.loads(line)
        return d["n"], d.get("text")

    return parse


def write(folder, seed):
    rnd, good, bad = random.Random(seed), [], []
    folder.mkdir()
    for f in range(3):
        lines = []
        for i in range(rnd.choice([0, 400, 900])):
            n = f * 1000 + i
            line = json.dumps({"n": n, "text": rnd.choice(["é", "a b", None])}, ensure_ascii=False)
            broken = rnd.random() < 0.05
            if broken:
                line = rnd.choice([line[:-3], "", "[]", '{"n": "seven"}', '{"text": "no n"}'])
                bad.append((f"{f}.jsonl", i + 1, line))
            else:
                good.append((n, json.loads(line)["text"]))
            lines.append(line)
        (folder / f"{f}.jsonl").write_text("".join(x + "\n" for x in lines))
    return sorted(good, key=str), sorted(bad)


@pytest.mark.parametrize("split", ["128m", "2000"])
def test_good_and_bad_rows_add_up(spark, tmp_path, split):
    good, bad = write(tmp_path / "d", split)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        g, b = P.parse_lines(spark, str(tmp_path / "d"), parser(), "n long, text string")
        assert sorted((tuple(r) for r in g.collect()), key=str) == good
        rows = b.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted((r.file.rsplit("/", 1)[1], r.line, r.text) for r in rows) == bad
    assert {r.error.split(":")[0] for r in rows} <= {"JSONDecodeError", "TypeError", "KeyError", "ArrowInvalid", "ArrowTypeError"}


def test_the_first_bad_line_is_named(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"1\n2\nthree\n\xff\xfe\n5\n")
    good, bad = P.parse_lines(spark, str(tmp_path / "x.txt"), lambda s: (int(s),), "n int")
    assert sorted(r.n for r in good.collect()) == [1, 2, 5]
    assert [(r.line, r.error.split(":")[0]) for r in bad.orderBy("line").collect()] == [(3, "ValueError"), (4, "UnicodeDecodeError")]
    with pytest.raises(ValueError, match=r"x.txt, line 3: ValueError"):
        P.require_good(bad)
    P.require_good(bad.where("false"))


def test_values_of_other_types_are_bad(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\nbb\n")
    good, bad = P.parse_lines(spark, str(tmp_path / "x.txt"), lambda s: (len(s), s) if len(s) == 1 else (s,), "n int, s string")
    assert [tuple(r) for r in good.collect()] == [(1, "a")]
    assert [r.error for r in bad.collect()] == ["ValueError: 1 values for 2 fields"]
