import hashlib
import random

from pyspark.sql import functions as F

from bytelane.llm import chat


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rows():
    rnd = random.Random(8)
    bits = ["<|turn|>", "<|text|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "word ", "é🥰\n", "<\\|end|>", "$1 "]
    out = []
    for conv in range(12):
        for turn in range(rnd.randrange(1, 14)):
            role = "system" if turn == 0 and conv % 2 else rnd.choice(["user", "assistant", "system", "a<|text|>\n"])
            out.append((conv, turn, role, "".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) + "long " * rnd.choice([0, 5, 30])))
    out += [(50, 0, "system", "only this"), (51, 0, None, None), (51, 1, "assistant", None), (51, 1, "assistant", None), (51, None, "assistant", "x"),
            (None, 0, "assistant", "null conversation"), (52, 0, "user", "w " * 900), (52, 1, "assistant", "v " * 900)]
    return out


def test_round_trip_and_loss(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "conv_id long, turn long, role string, text string, window string, n int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_windows(df, budget=64, history=20)).collect()}
    assert set(got) == {r[0] for r in data}
    for conv, r in got.items():
        own = sorted(((t, role or "", text or "") for c, t, role, text in data if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for _, role, text in own))
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_windows_keep_the_budget_the_system_turn_and_the_history(spark):
    data = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", "word " * (i % 7 + 1)) for i in range(1, 60)]
    w = chat.format_windows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), budget=60, history=15).orderBy("window").collect()
    assert len(w) > 5
    for i, r in enumerate(w):
        assert r["n_tokens"] <= 60 and not r["over_budget"]
        assert r["formatted"].startswith("<|turn|>system<|text|>be kind<|end|>")
        old = [s for s in r["spans"][1:] if not s["fresh"]]
        assert bool(old) == (i > 0) and not any(s["loss"] for s in old)
    fresh = [r["formatted"][s["start"]:s["end"]] for r in w for s in r["spans"] if s["fresh"]]
    assert fresh == [t for *_, t in data]
    big = chat.format_windows(spark.createDataFrame([(1, 0, "user", "w " * 99)], "conv_id long, turn long, role string, text string"), budget=60, history=15)
    assert [r["over_budget"] for r in big.collect()] == [True]


def test_escaping_is_reversible_and_hides_control_strings(spark):
    texts = [r[3] or "" for r in rows()] + ["<\\\\|end|>", "<<|end|>", "[[INST]]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<|turn|>", "<|text|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]"))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_windows(df)).count() == 0
