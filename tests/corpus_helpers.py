"""Constants and plain-Python readings shared by the tests."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def corpus_df(spark, chunks):
    """A byte corpus from a list of byte strings (document order = list order)."""
    rows = [(i, f"d{i}", bytes(c)) for i, c in enumerate(chunks)]
    return spark.createDataFrame(rows, "doc_id BIGINT, name STRING, content BINARY")


def ref_windows(data: bytes, L: int, workers: int, worker: int, offset: int, tail: bool = False):
    """Plain-Python reading of the sharding rule (brute force for the tests)."""
    S = len(data) // workers
    off = offset % L
    cnt = max((S - off) // L, 0)
    base = worker * S + off
    out = [data[base + j * L: base + j * L + L] for j in range(cnt)]
    if tail:
        t = data[base + cnt * L: base + cnt * L + L]
        if t:
            out.append(t)
    return out
