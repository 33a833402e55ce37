"""BPE, token files and packing: against the libraries, exact round trips, bounds."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronopanel.llm import bpe, packing, tokenfile, tokens
from chronopanel.llm.catalog import JSON_MODEL, RANK_MODEL
from chronopanel.llm.shared import importable

ODD = [" ", "  ", "\n", "\n\n", " \n", "a", "the", "'s", "=", "--", "é", "日本", " ", "\t", "\x1c", "1", "23", "<|endoftext|>",
       "\0", "😀", "\r\n", "́", "​", " "]


@pytest.fixture(scope="module")
def plain():
    return tokens.from_file(JSON_MODEL[1])


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_MODEL[1], "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def runs(encoder, texts):
    ids, n = encoder.encode(texts)
    ends = np.cumsum(n)
    return [ids[b - k:b].tolist() for b, k in zip(ends, n)]


def test_encoders_equal_the_libraries(plain, tik):
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(3000)] + ["", "a" * 5000, " " * 300, "x= " * 50]
    assert runs(tokens.encoder(*JSON_MODEL), texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert runs(tokens.encoder(*RANK_MODEL), texts) == [tik.encode_ordinary(t) for t in texts]


def test_encoder_forgets_and_stays_right(plain):
    small = tokens.PieceEncoder(plain, most_characters=100)
    texts = [f"word{i} and more text {i}\nline" for i in range(200)]
    for _ in range(2):
        for lo in range(0, 200, 20):
            assert runs(small, texts[lo:lo + 20]) == [plain.encode(t, add_special_tokens=False).ids for t in texts[lo:lo + 20]]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_decoding_and_offsets(text):
    own = tokens.encoder(*RANK_MODEL)
    ids, n = own.encode([text])
    assert own.table.decode(ids) == text.encode()
    assert "".join(tokens.token_texts(own.table, ids)) == text
    starts, ends = tokens.character_offsets(text, np.cumsum(own.table.length[ids]))
    for i, a, b in zip(ids, starts, ends):
        raw = own.table.decode(np.array([i]))
        assert raw in text[a:b].encode()
    assert not len(ids) or (starts[0] == 0 and ends[-1] == len(text))


def test_token_texts_give_a_split_character_to_its_last_id():
    own = tokens.encoder(*RANK_MODEL)
    ids, _ = own.encode(["日😀"])
    parts = tokens.token_texts(own.table, ids)
    assert len(parts) > 2 and "".join(parts) == "日😀" and "" in parts


ROWS = [(5, "Of the and.\nTwo"), (1, None), (3, ""), (2, "héllo wörld"), (5, "Of the and.\nTwo"), (None, "no key"), (9, "long " * 9000)]


def frame(spark, rows=ROWS, extra=True):
    importable(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "1 AS ids", "'x' AS own", "2 AS n_tokens", "3 AS size", "4 AS `key`") if extra else df


def test_encode_frame(spark, plain):
    out = bpe.encode(frame(spark), JSON_MODEL, append=2, offsets=True).collect()
    want = sorted((str(k), tuple(plain.encode(t or "", add_special_tokens=False).ids) + (2,)) for k, t in ROWS)
    got = sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out)
    assert got == want and all(r.n_tokens == len(r.ids) // 4 == len(r.byte_ends) + 1 for r in out)
    back = bpe.decode(bpe.encode(frame(spark), RANK_MODEL), RANK_MODEL).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in ROWS)


def test_encode_empty_table(spark):
    none = frame(spark, [])
    assert bpe.encode(none, JSON_MODEL).count() == 0
    assert tokenfile.read(tokenfile.write(bpe.encode(tokenfile.ordered(none), JSON_MODEL, "key"), 50_257)).count() == 0
    packed, proof = packing.pack(packing.pieces(bpe.encode(none, JSON_MODEL), 64).drop("ids"), capacity=64)
    assert packed.count() == 0 and proof["bins"] == proof["bound"] == 0


# ------------------------------------------------------------------ token files


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.lists(st.integers(0, 2**20 - 1), max_size=80))
def test_pack_round_trip(bits, ids):
    ids = np.array([i % (1 << bits) for i in ids], np.uint32)
    raw = tokenfile.pack(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    assert tokenfile.unpack(raw, bits, len(ids)).tolist() == ids.tolist()


def test_widths():
    assert [tokenfile.bits_for(v) for v in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("vocabulary", [50_257, 70_000])
def test_shard_random_access(tmp_path, vocabulary):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, vocabulary, n).astype(np.uint32) for n in (0, 5, 1000, 0, 63, 64, 65, 1)]
    out = tokenfile.ShardWriter(f"{tmp_path}/a.ids", tokenfile.bits_for(vocabulary), 64)
    for k, ids in enumerate(docs):
        out.add(None if k == 3 else k, ids)
        out.ids(ids)
    out.close()
    back, flat = tokenfile.ShardReader(f"file://{tmp_path}/a.ids"), np.concatenate(docs)
    assert [back.document(k).tolist() for k in range(8)] == [d.tolist() for d in docs]
    for a, b in ((0, 0), (63, 65), (10, 900), (0, len(flat)), (len(flat) - 1, len(flat))):
        assert back.range(a, b).tolist() == flat[a:b].tolist()
    assert back.nulls.tolist() == [k == 3 for k in range(8)]
    with pytest.raises(ValueError):
        out = tokenfile.ShardWriter(f"{tmp_path}/b.ids", 4, 64)
        out.ids(np.array([16], np.uint32))


def test_written_in_order_and_read_back(spark, plain):
    encoded = bpe.encode(tokenfile.ordered(frame(spark)), JSON_MODEL, "key", append=2)
    manifest = tokenfile.write(encoded, 50_257, block=50, shard_ids=20)
    got = sorted(tokenfile.read(manifest, group=16).collect(), key=lambda r: r.start)
    ids = {k: plain.encode(t or "", add_special_tokens=False).ids + [2] for k, t in ROWS}
    assert [r.key for r in got] == [None, 1, 2, 3, 5, 5, 9]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(ids[r.key]), ids[r.key])
        at += r.n_tokens
    assert manifest.count() > 1


def test_a_second_attempt_leaves_the_first_ones_files_alone(spark, tmp_path):
    """Attempts write under their own names; what is not in the manifest is never read."""
    encoded = bpe.encode(tokenfile.ordered(frame(spark)), JSON_MODEL, "key", append=2)
    tables = [tokenfile.write(encoded, 50_257, folder=f"file://{tmp_path}/shards", block=50, shard_ids=20) for _ in range(2)]
    paths = [{r.path for r in t.collect()} for t in tables]
    assert not paths[0] & paths[1] and len(list((tmp_path / "shards").glob("*.ids"))) == len(paths[0]) + len(paths[1])
    rows = [sorted((r.start, r.n_tokens, bytes(r.ids)) for r in tokenfile.read(t).collect()) for t in tables]
    assert rows[0] == rows[1] and len(rows[0]) == len(ROWS)


def test_names_of_object_stores(monkeypatch):
    from pyarrow import fs

    asked = []

    class Named:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return None, uri

    monkeypatch.setattr(fs, "FileSystem", Named)
    for uri in ("s3a://bucket/a b", "s3n://bucket/x", "hdfs://host/x", "file:/tmp/x"):
        tokenfile._files(uri)
    assert asked == ["s3://bucket/a b", "s3://bucket/x", "hdfs://host/x", "file:/tmp/x"]


# --------------------------------------------------------------------- packing


def optimum(sizes, capacity):
    """Fewest bins, by trying all placements of few items."""
    best = len(sizes)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(sizes):
            best = len(room)
            return
        for i in {r: i for i, r in enumerate(room)}.values():
            if room[i] >= sizes[k]:
                room[i] -= sizes[k]
                place(k + 1, room)
                room[i] += sizes[k]
        place(k + 1, [*room, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8), st.integers(20, 24))
def test_bound_and_best_fit(sizes, capacity):
    bins = packing.best_fit(np.array(sizes), capacity)
    assert np.bincount(bins, sizes).max() <= capacity
    assert packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= optimum(sizes, capacity) <= bins.max() + 1


def test_bound_beats_volume():
    counts = np.zeros(101, int)
    counts[51], counts[34] = 10, 9
    assert packing.lower_bound(counts, 100) == 10 > -(-(51 * 10 + 34 * 9) // 100)


def check(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("group", [40, 300, 5000])
def test_pack_frame(spark, group):
    rng = random.Random(group)
    items = [(k % 7, rng.randint(1, 64)) for k in range(1500)] + [(0, 64)] * 20
    df = spark.createDataFrame(items, "cell long, length long").selectExpr("*", "length AS size", "'b' AS bin", "1.5 AS fill")
    packed, proof = packing.pack(df, capacity=64, group=group)
    rows = packed.collect()
    assert sorted((r.cell, r.length) for r in rows) == sorted(items) and packed.columns[:5] == df.columns
    assert check(rows, 64) == proof["bins"]
    assert proof["bound"] == packing.lower_bound(np.bincount([n for _, n in items], minlength=65), 64)
    assert proof["bins"] <= proof["bound"] * 1.05 + 1
    counts = [r["bins"] for r in proof["rounds"]]
    assert counts == sorted(counts, reverse=True)


def test_pack_rejects_other_sizes(spark):
    for bad in (0, 65, None):
        with pytest.raises(Exception, match="sizes must be"):
            packing.pack(spark.createDataFrame([(bad,)], "length long"), capacity=64)[0].collect()


def test_pieces(spark, plain):
    text = "word " * 300
    ids = np.array(plain.encode(text, add_special_tokens=False).ids + [0], "<u4")
    for capacity in (64, len(ids), len(ids) - 1):
        got = packing.pieces(bpe.encode(frame(spark, [(4, text)]), JSON_MODEL, append=0), capacity).orderBy("piece").collect()
        assert b"".join(bytes(r.ids) for r in got) == ids.tobytes()
        assert [r.start for r in got] == np.cumsum([0, *[r.length for r in got][:-1]]).tolist()
        assert all(r.length == capacity for r in got[1:]) and zlib.crc32(bytes(got[0].ids)) == zlib.crc32(ids[:got[0].length].tobytes())
