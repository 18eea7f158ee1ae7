import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelane.functions import pixels as PX
from bytelane.functions import tokens as TK
from bytelane.operators import patches as PT

IDS = TK.TokenIds(pad=10, eom=11, som_image=12, som_text=13)


def one(spark, expr, schema, value):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first().r


def test_special_tokens_and_padding(spark):
    expr = TK.pad_right_to(TK.with_som(TK.with_eom("x", IDS.eom), IDS.som_text), 15, IDS.pad)
    out = one(spark, expr, "x ARRAY<INT>", list(range(10)))
    assert len(out) == 15 and out[0] == 13 and out[11] == 11 and out[12:] == [10, 10, 10]


def test_none_ids_are_no_ops(spark):
    ids = TK.TokenIds(pad=0)
    assert one(spark, TK.with_som(TK.with_eom("x", ids.eom), ids.som_image), "x ARRAY<INT>", [1, 2]) == [1, 2]


def test_pad_strict_and_crop(spark):
    with pytest.raises(Exception):
        one(spark, TK.pad_right_to("x", 2, 0), "x ARRAY<INT>", [1, 2, 3])
    assert one(spark, TK.pad_right_to("x", 2, 0, strict=False), "x ARRAY<INT>", [1, 2, 3]) == [1, 2]


def test_loss_weights(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5, 6], [7, 8, 9])], "a ARRAY<INT>, b ARRAY<INT>, c ARRAY<INT>")
    w = df.select(TK.loss_weights([("a", 2.0), ("b", 1.0), ("c", 0.1)]).alias("w")).first().w
    assert np.allclose(w, [2, 2, 2, 1, 1, 1, 0.1, 0.1, 0.1])


def test_qa_sample_positions(spark):
    ids = TK.TokenIds(pad=1001, eom=1002, som_image=1003, som_text=1004)
    df = spark.createDataFrame([([1, 2], [7, 8, 9], [5])], "q ARRAY<INT>, i ARRAY<INT>, a ARRAY<INT>")
    s = df.select(TK.qa_sample("q", "i", "a", ids, 20, (0.0, 0.5, 0.0, 1.0)).alias("s")).first().s
    assert s.tokens[:16] == [1004, 1, 2, 1002, 1003, 7, 8, 9, 1002, 1004, 1, 2, 1002, 1004, 5, 1002]
    assert s.tokens[16:] == [1001] * 4 and s.len_padding == 4
    assert s.loss_mask == [0.0] * 4 + [0.5] * 5 + [0.0] * 4 + [1.0] * 3 + [0.0] * 4


def test_dense_remap(spark):
    a = [2, 3, 3, 1, 2, 3, 3, 5, 1]
    r = one(spark, PX.dense_remap(F.col("x"), 11), "x ARRAY<INT>", a)
    assert r.remapped == [11 + v for v in [1, 2, 2, 0, 1, 2, 2, 3, 0]]
    assert r.unique == [1, 2, 3, 5] and [r.unique[i] for i in r.inverse] == a


def _img_df(spark, arr):
    h, w, c = arr.shape
    return spark.createDataFrame(
        [(h, w, c, [int(v) for v in arr.reshape(-1)])], "height INT, width INT, n_channels INT, data ARRAY<INT>"
    ).select(F.struct("height", "width", "n_channels", "data").alias("img"))


def test_crop_and_layout(spark):
    rng = np.random.default_rng(0)
    arr = rng.integers(0, 256, (12, 15, 3), dtype=np.uint8)
    df = _img_df(spark, arr)
    c = df.select(PX.crop(F.col("img"), 0.25, 0.20).alias("c")).first().c
    assert (c.height, c.width) == (6, 9)
    assert c.data == [int(v) for v in arr[3:9, 3:12].reshape(-1)]
    chw = df.select(PX.hwc_to_chw(F.col("img")).alias("x")).first().x
    assert chw == [int(v) for v in arr.transpose(2, 0, 1).reshape(-1)]
    back = df.select(
        PX.chw_to_hwc(PX.hwc_to_chw(F.col("img")), F.col("img.height"), F.col("img.width"), F.col("img.n_channels")).alias("x")
    ).first().x
    assert back == [int(v) for v in arr.reshape(-1)]
    g = df.select(PX.grayscale(F.col("img")).alias("g")).first().g
    r, gg, b = (arr[..., i].astype(np.int64) for i in range(3))
    assert g.data == [int(v) for v in ((19595 * r + 38470 * gg + 7471 * b + 32768) >> 16).reshape(-1)]


@pytest.mark.parametrize("mode,values", [("lower", (0, 127)), ("upper", (127, 255)), ("mean", (63, 191))])
def test_channel_bins(spark, mode, values):
    lut = PX.bin_lookup(2, mode)
    assert set(lut) == set(values)
    out = one(spark, PX.downsample_channels("x", 2, mode), "x ARRAY<INT>", list(range(256)))
    assert out == lut
    assert PX.bin_lookup(255) == list(range(256))
    with pytest.raises(ValueError):
        PX.bin_lookup(0)


def test_patches_round_trip(spark):
    df = spark.createDataFrame([(list(range(13)),)], "x ARRAY<INT>")
    p = df.select(PT.to_patches("x", [4, 2, 3], pad=-1).alias("p")).first().p
    assert len(p) == 3 and all(len(m) == 2 and all(len(i) == 3 for i in m) for m in p)
    assert [v for m in p for i in m for v in i] == list(range(13)) + [-1] * 5
    back = df.select(PT.from_patches(PT.to_patches("x", [4, 2, 3], pad=-1), 2, F.size("x")).alias("b")).first().b
    assert back == list(range(13))
    with pytest.raises(Exception):
        df.select(PT.to_patches("x", [2, 2, 3], pad=-1)).collect()
    assert one(spark, PT.shift_right("x", 99), "x ARRAY<INT>", [1, 2, 3]) == [99, 1, 2]


def test_patch_windows_equal_the_array_form(spark):
    from bytelane.functions.bytes import bytes_to_array
    from bytelane.operators import patches as PT

    data = [bytes(range(n)) for n in (0, 1, 31, 32, 33, 64, 200)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "idx INT, tokens BINARY")
    a = PT.patch_windows(df, [8, 8, 4], 256).select("idx", "patches").collect()
    b = df.select("idx", PT.to_patches(bytes_to_array("tokens"), [8, 8, 4], 256).alias("p")).collect()
    assert {r.idx: r.patches for r in a} == {r.idx: r.p for r in b}


def test_bins_for_every_count():
    from bytelane.functions import pixels as PX

    for n in range(1, 255):
        low, high, mean = (PX.bin_lookup(n, m) for m in ("lower", "upper", "mean"))
        assert len(set(low)) <= n and low == sorted(low) and high == sorted(high)
        assert all(a <= v <= b + 1 and a <= m <= b for v, (a, m, b) in enumerate(zip(low, mean, high)))
        assert low[0] == 0 and high[255] == 255


def test_images_without_pixels_and_gray_ones(spark):
    from pyspark.sql import functions as F

    from bytelane.functions import pixels as PX

    rows = [(0, 4, 3, []), (1, 2, 1, [7, 9]), (1, 1, 4, [1, 2, 3, 4])]
    df = spark.createDataFrame([(r,) for r in rows], "img STRUCT<height: INT, width: INT, n_channels: INT, data: ARRAY<INT>>")
    got = [r.d for r in df.select(PX.bgr_to_rgb(F.col("img"))["data"].alias("d")).collect()]
    assert got == [[], [7, 7, 7, 9, 9, 9], [3, 2, 1]]
    assert [r.d for r in df.limit(2).select(PX.grayscale(F.col("img"))["data"].alias("d")).collect()] == [[], [7, 9]]
    assert df.limit(1).select(PX.chw_to_hwc(F.col("img.data"), F.col("img.height"), F.col("img.width"), F.col("img.n_channels")).alias("d")).first().d == []


def test_pixel_moves_are_not_interpreted(spark):
    """Moves of pixels run over Arrow batches, and null, empty and short images keep their results."""
    rows = [(0, None), (1, b""), (2, bytes(range(200))), (3, bytes(48))]
    df = spark.createDataFrame(rows, "k INT, content BINARY").select("k", PX.image_from_bytes("content", 16).alias("img"))
    out = df.select("k", "img", PX.crop(F.col("img"), 0.25, 0.20).alias("c"), PX.hwc_to_chw(F.col("img")).alias("chw"))
    back = out.select("k", "c", "chw", (PX.chw_to_hwc(F.col("chw"), F.col("img.height"), F.col("img.width"), F.col("img.n_channels")) == F.col("img.data")).alias("same"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan
    got = {r.k: r for r in back.collect()}
    full = np.zeros((5, 16, 3), np.int64)
    full.reshape(-1)[:200] = range(200)
    assert (got[0].c.height, got[0].c.width, got[0].c.data, got[0].chw, got[0].same) == (None, 10, None, None, None)
    assert (got[1].c.height, got[1].c.data, got[1].chw, got[1].same) == (0, [], [], True)
    assert got[2].c.data == full[1:4, 3:13].reshape(-1).tolist() and got[2].chw == full.transpose(2, 0, 1).reshape(-1).tolist() and got[2].same
    assert got[3].c.height == 1 and got[3].same
    # an image that ends early, with a null among its values
    odd = spark.createDataFrame([((4, 5, 1, [*range(7), None, *range(8, 13)]),)], "img STRUCT<height: INT, width: INT, n_channels: INT, data: ARRAY<INT>>")
    assert odd.select(PX.crop(F.col("img"), 0.25, 0.20)["data"].alias("d")).first().d == [6, None, 8, 11, 12]


def test_images_are_made_a_few_bytes_a_task(spark, tmp_path):
    """Arrow functions over pixels get a task's rows at once, so no task may hold many bytes, whatever part of a file it reads."""
    from bytelane import catalog

    rows = [(i if i % 3 else 7, None if i == 5 else chr(97 + i % 26) * (40_000 if i % 50 == 0 else 9_000)) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sizes = F.sum(F.coalesce(F.size("img.data"), F.lit(0)))
    held = catalog.images(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).agg(sizes.alias("n"), F.count("*").alias("rows")).collect()
    assert sum(r.rows for r in held) == 1500
    assert max(r.n for r in held) <= 6 << 20
    got = catalog.q_chw(spark, str(tmp_path)).collect()
    assert len(got) == 1500 and sum(r.round_trip is None for r in got) == 1 and all(r.round_trip in (True, None) for r in got)
    assert len({r.chw_md5 for r in got}) == len({t for _, t in rows})
