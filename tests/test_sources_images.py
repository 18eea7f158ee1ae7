import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from bytelane.functions import pixels as PX
from bytelane.operators import qa as QA
from bytelane.operators import runs as R
from bytelane.operators import windows as W
from bytelane.sources import corpus as CP


def write_png(path, rgb: np.ndarray):
    """Minimal RGB PNG writer (no image library in the environment)."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].tobytes() for y in range(h))

    def chunk(tag, data):
        c = struct.pack(">I", len(data)) + tag + data
        return c + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
    png += chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    path.write_bytes(png)


def test_file_corpus_books(spark, tmp_path):
    split = tmp_path / "validation"
    split.mkdir()
    texts = {"b.txt": "über alles\n", "a.txt": "日本 ", "c.txt": "🥰 end"}
    for n, t in texts.items():
        (split / n).write_text(t, encoding="utf8")
    docs = CP.corpus_from_files(spark, str(tmp_path), "valid")
    order = [r.name for r in docs.orderBy("doc_id").collect()]
    assert order == ["a.txt", "b.txt", "c.txt"]
    w, spec = W.byte_windows(docs, 4)
    joined = b"".join(bytes(r.tokens) for r in w.orderBy("idx").collect())
    corpus = "".join(texts[n] for n in order).encode()
    assert joined == corpus[: spec.count * 4]
    assert CP.book(docs, "b.txt") == "über alles\n"
    assert [r.name for r in CP.iter_books(docs).collect()] == order
    try:
        CP.book(docs, "zzz.txt")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_image_source_and_chain(spark, tmp_path):
    rng = np.random.default_rng(4)
    rgb = rng.integers(0, 256, (12, 15, 3), dtype=np.uint8)
    write_png(tmp_path / "img_0.png", rgb)
    imgs = QA.read_images(spark, str(tmp_path))
    row = imgs.first()
    assert (row.height, row.width, row.n_channels) == (12, 15, 3)
    bgr = np.frombuffer(bytes(row.data), dtype=np.uint8).reshape(12, 15, 3)
    assert (bgr[..., ::-1] == rgb).all()  # Spark stores BGR
    as_struct = imgs.select(
        "image_filename",
        PX.bgr_to_rgb(F.struct("height", "width", "n_channels", PX.bytes_to_array("data").alias("data"))).alias("img"),
    )
    assert as_struct.first().img.data == [int(v) for v in rgb.reshape(-1)]
    out = PX.process_images(as_struct, "image_filename", "img", crop_hw=(0.25, 0.2), resize_wh=(5, 4), bins=2, shift_start=11)
    px = out.first().pixels
    assert len(px) == 3 * 4 * 5 and set(px) <= {11, 12}
    # a same-size resize keeps the image
    same = PX.resize_array(rgb, 15, 12)
    assert np.abs(same.astype(int) - rgb.astype(int)).max() <= 1


def test_resume_lineage(spark):
    runs = spark.createDataFrame(
        [("r1", "c1.pth", None), ("r2", "c2.pth", "c1.pth"), ("r3", "c3.pth", "c2.pth"), ("s1", "d1.pth", None)],
        "run_id STRING, checkpoint_file STRING, resumed_from STRING",
    )
    got = sorted((r.run_id, r.root_run, r.depth) for r in R.resume_lineage(runs).collect())
    assert got == [("r1", "r1", 0), ("r2", "r1", 1), ("r3", "r1", 2), ("s1", "s1", 0)]


def test_registry_and_sample_source(spark):
    from bytelane.sources import registry as RG

    assert {"books", "questions"} <= set(RG.registered())
    try:
        RG.retrieve("nope")
        raise AssertionError("expected KeyError")
    except KeyError:
        pass

    def get_sample(i):
        data = [(i + k) % 256 for k in range(4)]
        return data, [1.0] * 4

    src = RG.sample_source("sine_like", get_sample, 21, "tokens ARRAY<INT>, loss_mask ARRAY<DOUBLE>", partitions=3)
    spark.dataSource.register(src)
    df = spark.read.format("sine_like").load()
    rows = sorted(df.collect(), key=lambda r: r.idx)
    assert [r.idx for r in rows] == list(range(21))
    assert rows[5].tokens == [5, 6, 7, 8] and rows[5].loss_mask == [1.0] * 4
    assert df.rdd.getNumPartitions() == 3


def test_masked_source_and_test_split_flag(spark, tmp_path):
    import pytest

    from bytelane.sources import registry as REG

    (tmp_path / "train").mkdir()
    for name, data in (("b.txt", b"y" * 70), ("a.txt", b"x" * 50)):
        (tmp_path / "train" / name).write_bytes(data)
    build = REG.retrieve("masked_books", masked=True)
    rows = build(spark, str(tmp_path), seq_len=40, masking_proba=0.5).orderBy("idx").collect()
    assert [r.idx for r in rows] == [0, 1, 2] and rows[0].labels == [120] * 40
    for r in rows:
        assert all((i == -100) == m and (m or i == t) for i, m, t in zip(r.masked_ids, r.mask, r.labels))
    assert 0 < sum(sum(r.mask) for r in rows) < 120
    with pytest.raises(KeyError):
        REG.retrieve("masked_books")
    assert REG.supports_test("books") and REG.supports_test("masked_books") and not REG.supports_test("questions")


def test_file_order_by_hash_is_dense_and_reads_no_content(spark, tmp_path):
    from bytelane.operators import windows as W
    from bytelane.sources.corpus import corpus_from_files

    (tmp_path / "train").mkdir()
    for i in range(9):
        (tmp_path / "train" / f"f{i}.txt").write_bytes(bytes([65 + i]) * (i + 1))
    docs = corpus_from_files(spark, str(tmp_path), order="hash")
    assert sorted(r.doc_id for r in docs.collect()) == list(range(9))
    offs, tot = W.corpus_offsets(corpus_from_files(spark, str(tmp_path)))
    assert tot.total == 45
    scans = [x for x in offs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation" in x]
    assert all("content" not in x for x in scans)


def test_question_index_runs_on_over_files(spark, tmp_path):
    import json

    from bytelane.operators import qa as QA

    for name, n in (("a.json", 2), ("b.json", 3)):
        (tmp_path / name).write_text(json.dumps({"info": {}, "questions": [{"question": f"{name}{i}"} for i in range(n)]}))
    got = sorted((r.idx, r.question) for r in QA.read_questions(spark, str(tmp_path)).collect())
    assert got == [(0, "a.json0"), (1, "a.json1"), (2, "b.json0"), (3, "b.json1"), (4, "b.json2")]


def plain_resize(pixels, h, w, c, width, height):
    """Lanczos-3 in whole numbers, pixel by pixel."""
    import math

    def weights(n_in, n_out):
        scale = n_in / n_out
        wide = max(scale, 1.0)
        out = []
        for o in range(n_out):
            centre = (o + 0.5) * scale
            lo, hi = max(int(centre - 3 * wide + 0.5), 0), min(int(centre + 3 * wide + 0.5), n_in)
            ks = []
            for j in range(lo, hi):
                x = (j - centre + 0.5) * (1.0 / wide)
                sinc = lambda v: 1.0 if v == 0 else math.sin(v * math.pi) / (v * math.pi)
                ks.append(sinc(x) * sinc(x / 3) if -3 <= x < 3 else 0.0)
            total = sum(ks)
            out.append((lo, [int(k / total * (1 << 22) + (0.5 if k >= 0 else -0.5)) for k in ks]))
        return out

    def byte(s):
        return min(max((s + (1 << 21)) >> 22, 0), 255)

    wide = weights(w, width)
    rows = [[[byte(sum(k * pixels[(y * w + lo + i) * c + ch] for i, k in enumerate(ks))) for ch in range(c)] for lo, ks in wide] for y in range(h)]
    tall = weights(h, height)
    return [byte(sum(k * rows[lo + i][x][ch] for i, k in enumerate(ks))) for lo, ks in tall for x in range(width) for ch in range(c)]


def test_resize_against_whole_numbers(spark):
    import random

    rnd = random.Random(2)
    images = []
    for i, (h, w, c) in enumerate([(7, 9, 3), (4, 3, 1), (1, 1, 3), (30, 17, 3), (5, 6, 3)]):
        images.append((i, (h, w, c, [rnd.choice([0, 255, rnd.randrange(256)]) for _ in range(h * w * c)])))
    df = spark.createDataFrame(images, "k long, img struct<height:int,width:int,n_channels:int,data:array<int>>").repartition(2)
    for width, height in ((6, 5), (12, 20), (1, 1)):
        got = {r.k: r.img for r in PX.resize_images(df, "k", "img", width, height).collect()}
        for k, (h, w, c, data) in images:
            assert (got[k].height, got[k].width, got[k].n_channels) == (height, width, c)
            assert list(got[k].data) == plain_resize(data, h, w, c, width, height)


def test_resize_fixed_vectors():
    import numpy as np

    # a step edge rings and is clipped; a flat image stays flat
    edge = np.array([[0, 0, 0, 255, 255, 255]], np.uint8)[:, :, None]
    assert PX.resize_array(edge, 3, 1).ravel().tolist() == plain_resize(edge.ravel().tolist(), 1, 6, 1, 3, 1) == [0, 128, 255]
    assert (PX.resize_array(np.full((5, 4, 3), 77, np.uint8), 9, 2) == 77).all()


def test_image_files_are_read_folders_at_a_time(spark, tmp_path, monkeypatch):
    """No read lists more than `FOLDERS_A_READ` folders; documents without text have no image."""
    import hashlib

    from bytelane import catalog_sources as S

    texts = {i: "é€" * i for i in range(9)} | {9: None}
    spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id BIGINT, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(S, "IMAGES_A_FOLDER", 2)
    monkeypatch.setattr(S, "FOLDERS_A_READ", 2)
    asked, read = [], QA.read_images
    monkeypatch.setattr(QA, "read_images", lambda s, paths: asked.append(len(paths)) or read(s, paths))
    got = {r.image_id: (r.height, r.width, r.bgr_md5) for r in S.q_image_files(spark, str(tmp_path)).collect()}
    assert asked == [2, 2, 1] and spark.conf.get(S.CODE) == "FALLBACK"
    want = {}
    for i in range(1, 9):
        data = texts[i].encode()
        h = -(-len(data) // 48)
        bgr = np.frombuffer(data.ljust(h * 48, b"\0"), np.uint8).reshape(-1, 3)[:, ::-1].tobytes()
        want[i] = (h, 16, hashlib.md5(bgr.hex().upper().encode()).hexdigest())
    assert got == want
