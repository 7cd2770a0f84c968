import random
import zlib

import numpy as np
import pytest

from neardup.llm import sentencepiece_codec, token_counts, token_files
from neardup.llm.vocab import ByteLevel, vocabulary_path

SP, BPE = "piece_bpe_32k.model", "byte_bpe_50k.json"
PARTS = ["a", "b", "the", " ", "  ", "\n", "\n\n", "▁", ".", ",", "é", "ß", "\t", " ", "　", "<s>", "<|endoftext|>",
         "'s", "1", "23", "😀", "中文", "x" * 90, " \n", "\n ", "\r\n", "​", "'", "\x1c", "-", "ing", "tion"]


def texts(n, seed=1, most=25):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(SP)


def test_piece_lengths_are_the_librarys():
    counter = token_counts.PieceLengths(SP)
    x = texts(3000)
    assert counter.pieces.splits
    assert counter.count(x) == [len(i) for i in counter.pieces.library.encode(x, num_threads=1)]


def test_byte_level_ids_are_the_librarys():
    encoder = ByteLevel(BPE)
    encoder.CUT = 20
    x = texts(3000, 2)
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.library.encode_batch(x, add_special_tokens=False)]
    assert encoder.encode(x) == want
    assert encoder.encode(x) == want


def test_counts_query_form(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "héllo wörld " * 5000, "x"), (3, "dup", "y"), (3, "dup", "y"), (None, "n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in token_counts.count_tokens(df, SP).collect()), key=str)
    lib = token_counts.PieceLengths(SP).pieces.library
    want = [(i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 4096) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(df.limit(0), SP).count() == 0
    by_path = token_counts.count_tokens(df, vocabulary_path(BPE)).collect()
    assert len(by_path) == len(rows)


def test_batches_are_balanced_by_bytes():
    import pyarrow as pa
    from neardup.llm.common import by_bytes
    sizes = [5, 5, 100, 1, 1, 1, 0, 40, 40]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes])], names=["t"])
    cuts = [(a, b) for _, a, b in by_bytes(iter([batch]), "t", 50)]
    assert [x for a, b in cuts for x in range(a, b)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) <= 50 or b == a + 1 for a, b in cuts)


@pytest.mark.parametrize("planes", [4, 32])
@pytest.mark.parametrize("n", [1, 7, 8, 4096, 10001])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    index, payload = token_files.pack(ids, 1000, planes)
    blocks = -(-n // 1000)
    assert len(index) == blocks * planes and index[-1] == len(payload)
    back = [token_files.unpack_block(payload, index, k, n, 1000, planes) for k in range(blocks)]
    assert (np.concatenate(back) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_hold_all_ids_in_order(spark, scratch, planes):
    x = texts(300, 3)
    rows = [(1000 - i, t, i) for i, t in enumerate(x)] + [(7, None, 0), (None, "null id", 0), (900, "twice", 0), (900, "twice", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    token_files.write_ids(df, scratch + "/ids", BPE, 2, planes=planes, block_ids=100, segment_ids=1000)
    got = token_files.read_ids(spark, scratch + "/ids").collect()
    lib = ByteLevel(BPE).library
    ids = {t: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for _, t, _ in rows}
    want = sorted((i is not None, i or 0, len(ids[t]), zlib.crc32(ids[t].tobytes())) for i, t, _ in rows)
    got = sorted(got, key=lambda r: r.start)
    assert [g.start for g in got] == np.cumsum([0, *(g.n_tokens for g in got)])[:-1].tolist()
    assert [(g.doc_id is not None, g.doc_id or 0) for g in got] == [w[:2] for w in want]
    assert sorted((g.doc_id is not None, g.doc_id or 0, g.n_tokens, g.ids_crc32) for g in got) == want
    token_files.write_ids(df.limit(0), scratch + "/none", BPE, 2)
    assert token_files.read_ids(spark, scratch + "/none").count() == 0


def brute(codec, s):
    """The whole Viterbi table, without window or commits."""
    best = [(0.0, 0, None)] + [None] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - codec.longest), j):
            found = codec.vocabulary.get(s[i:j])
            if found is None and j > i + 1:
                continue
            total = best[i][0] + (found[1] if found else codec.unknown)
            if best[j] is None or total > best[j][0]:
                best[j] = (total, i, [found[0]] if found else [codec.byte[b] for b in s[i:j].encode()])
    out, j = [], len(s)
    while j:
        out = best[j][2] + out
        j = best[j][1]
    return out


def test_stream_and_windows_are_the_whole_search(codec):
    marked = [t.replace(" ", "▁") for t in texts(800, 4)]
    for t in marked:
        assert codec.search(t) == brute(codec, t)
    short = [t for t in marked if 0 < len(t) <= codec.longest]
    for t, ids in zip(short, codec.windows(short)):
        assert ids is None or np.frombuffer(ids, "<i4").tolist() == brute(codec, t)


def test_ids_are_committed_within_a_bounded_window(codec):
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5000))
    parts = list(codec.stream(text))
    assert [i for p in parts for i in p] == brute(codec, text)
    assert max(map(len, parts)) < 20 * codec.longest


def test_codec_round_trip(spark, codec):
    rows = [(i, t, "lang") for i, t in enumerate(texts(200, 6))] + [(500, None, "x"), (500, "", "x"), (None, "word " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sentencepiece_codec.round_trip(df, SP).collect()
    assert len(got) == len(rows)
    marks = {t for _, t, _ in rows if t and "▁" in t}
    assert sum(not r.same for r in got) == sum(t in marks for _, t, _ in rows)
    coded = sentencepiece_codec.encode(df, SP)
    back = sentencepiece_codec.decode(coded, SP).select("text", "decoded", "ids", "n_ids").collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") and r.n_ids == len(r.ids) for r in back)
    one = next(r for r in back if r.text and 20 < len(r.text) < 400 and "  " not in r.text)
    assert one.ids == brute(codec, ("▁" + one.text.replace(" ", "▁")))
    assert sentencepiece_codec.round_trip(df.limit(0), SP).count() == 0
