import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from bytelane.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.read_model(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def samples():
    rnd = random.Random(11)
    alphabet = "ab ▁\n\t\x00é日🥰 th in er<s>0x41 ​́"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(800)]
    return texts + ["", " ", "  a  b ", " " * 100, "a" * 3000, "▁" * 40 + "x", "the the\n\n  the", "日本語" * 300, "x" * 97, "é" * 96]


def test_ids_and_decoding_equal_the_library(model, library):
    for text in samples():
        ids = library.encode(text)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)
    rnd = random.Random(2)
    for _ in range(300):  # any ids, broken byte sequences too
        ids = [rnd.randrange(0, 600) for _ in range(rnd.randrange(9))]
        if 0 not in ids:
            assert model.decode(ids) == library.decode(ids)


def test_short_and_long_merging_agree(model):
    for text in samples():
        for stretch in model.stretches(model.normalize(text)[0]):
            assert model._merge_short(stretch) == model._merge_long(stretch)


def test_spans_tile_the_original_bytes(model):
    for text in samples():
        data = text.encode()
        ids = model.encode(text)
        starts, ends = model.spans(ids, model.normalize(text)[1])
        assert list(starts[1:]) == list(ends[:-1])
        assert not ids or (starts[0] == 0 and ends[-1] == len(data))
        for i, a, b in zip(ids, starts, ends):
            piece = model.pieces[i].replace(pieces.BLANK, " ").encode()
            if model.kinds[i] != pieces.BYTE:
                assert data[a:b].decode().replace(pieces.BLANK, " ").encode() in (piece, piece[1:])


def char_map(rules):
    """A double-array trie of `rules` (bytes -> bytes), placed naively."""
    texts, at = b"", {}
    for k, v in rules.items():
        at[k] = len(texts)
        texts += v + b"\0"
    nodes = {b""} | {k[:i] for k in rules for i in range(1, len(k) + 1)}
    units, used, base, place = {}, {0}, {}, {b"": 0}
    for node in sorted(nodes, key=len):
        labels = [n[-1] for n in nodes if len(n) == len(node) + 1 and n.startswith(node)] + ([0] if node in rules else [])
        offset = 1
        while any((place[node] ^ offset ^ x) in used for x in labels):
            offset += 1
        base[node] = offset
        for x in labels:
            used.add(place[node] ^ offset ^ x)
            if x:
                place[node + bytes([x])] = place[node] ^ offset ^ x
            else:
                units[place[node] ^ offset] = at[node] | 1 << 31
        label = node[-1] if node else 0
        units[place[node]] = label | base[node] << 10 | (256 if node in rules else 0)
    size = max(units) + 1
    blob = b"".join(units.get(i, 0x7F << 24 | 1).to_bytes(4, "little") for i in range(size))
    return len(blob).to_bytes(4, "little") + blob + texts


def test_longest_prefix_of_the_character_map(model):
    rules = {"ﬁ".encode(): b"fi", b"a": b"x", b"ab": b"yy", b"abc": b" ", "é".encode(): "é".encode()}
    m = pieces.CharMap(char_map(rules))
    assert m.longest(b"abcd", 0) == (3, b" ")
    assert m.longest(b"zabz", 1) == (2, b"yy")
    assert m.longest("ﬁ".encode(), 0) == (3, b"fi")
    assert m.longest(b"z", 0) is None
    old = model.char_map, model.squeeze
    model.char_map, model.squeeze = m, True
    try:
        normal, source = model.normalize("  aé  abc ﬁ ")
        assert normal == "▁xé▁fi"
        assert source.tolist() == [2] * 3 + [2] + [3, 3, 3] + [5] * 3 + [11, 11] + [14]
        assert model.normalize("   ")[0] == ""
    finally:
        model.char_map, model.squeeze = old


def test_query_columns(spark, library):
    rows = [(1, "a b", "x"), (1, "a b", None), (None, None, "y"), (2, "", ""), (3, "The thing " * 9000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    blob = pieces.read_model(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((text or "").encode())))
    got = [tuple(r) for r in pieces.digests(df, blob).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    tokens = {r["doc_id"]: r for r in pieces.encode(df.where("doc_id = 3"), blob).collect()}
    assert [t["id"] for t in tokens[3]["tokens"]] == library.encode(rows[-1][1]) and tokens[3]["decoded"] == rows[-1][1]
    assert pieces.digests(df.limit(0), blob).count() == 0
