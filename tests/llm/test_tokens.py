"""Encoding against the library, record round trips, and the packing invariants."""

import io
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("weftmill.llm")
pytest.importorskip("public_tokenizers")
from weftmill.llm import packing, tokenbin  # noqa: E402
from weftmill.llm.tokens import encoder  # noqa: E402

ODD = [
    "", "a  b", "a\n\nb \n c", "x's don't WE'LL i'm", "  lead", "trail  ", "é è́ éx", " nbsp\xa0 em ", "a\x1cb \x1d c", "123 4.5,6!?", "İstanbul ı ſ K ŉ ß",
    "日本語 テスト。", "a<|endoftext|>b  <|endoftext|>", "<|startoftext|> hi", "tab\there", "\r\n\r\nx", "word.Next, (par) [x]", " . , ", "😀 ok😀.", "foo's. bar'sé. don't.", "a " * 3000, "z" * 5000,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    e = encoder(name)
    for t in ODD:
        assert e.encode_batch([t])[0] == e.whole(t), t
    assert e.encode_batch([None, "x"]) == [b"", e.whole("x")]


def docs(spark):
    rows = [(7, None, "p"), (3, "One two\nthree", "q"), (11, "", "r"), (3, "another three", "s"), (None, "no id", "t"), (2, "long text, " * 4000, "u"), (2, "long text, " * 4000, "u")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def crc(e, text, end):
    ids = np.append(np.frombuffer(e.whole(text or ""), dtype="<u2"), end).astype("<u4")
    return len(ids), zlib.crc32(ids.tobytes())


def test_records_round_trip(spark, tmp_path):
    base = f"file://{tmp_path}/set"
    got = tokenbin.round_trip(docs(spark), base, shard_bytes=20_000).orderBy("start").collect()
    e = encoder("word_bpe_49k.json")
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), r) for r in docs(spark).collect())
    at = 0
    for g, (_, r) in zip(got, rows, strict=True):
        n, c = crc(e, r.text, 2)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, n, c)
        at += n
    shards = {tokenbin._PART.search(p.name)[1]: p for p in (tmp_path / "set/records").iterdir() if p.name.startswith("part")}
    g = got[-1]
    with open(shards[f"{g.shard:05d}"], "rb") as f:
        doc_id, ids = tokenbin.read_record(f, g.offset)
    assert doc_id == g.doc_id and len(ids) == g.n_tokens


def test_damage_is_found():
    good = tokenbin.frame(5, np.arange(9, dtype="<u2").tobytes()) + b"\n"
    assert tokenbin.record_at(good)[0] == 5
    assert tokenbin.read_record(io.BytesIO(b"xx" + good), 2)[1].tolist() == list(range(9))
    for i in range(len(good)):
        with pytest.raises((ValueError, Exception)):
            tokenbin.record_at(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :])


def check_packing(rows, want):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_seq[r.sequence_id].append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert seq[0].window in packing.TIERS and (at == seq[0].window or at < packing.TIERS[0] and seq[0].window == 1024)
    tasks = defaultdict(int)
    for number, seq in by_seq.items():
        tasks[number >> 36] += sum(r.length for r in seq) < seq[0].window
    assert max(tasks.values(), default=0) <= 1  # at most one padded sequence a task
    assert sum(r.length for r in rows) == sum(want)


def test_packing(spark):
    e = encoder("byte_bpe_50k.json")
    rows = packing.pack(docs(spark), round_tokens=3000).collect()
    check_packing(rows, [crc(e, r.text, 0)[0] for r in docs(spark).collect()])
    for r in docs(spark).collect():
        ids = np.append(np.frombuffer(e.whole(r.text or ""), dtype="<u2"), 0).astype("<u4")
        mine = sorted((p for p in rows if p.doc_id == r.doc_id and p.doc_tokens == len(ids)), key=lambda p: p.start)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in mine)
        assert {p.start for p in mine} | {p.start + p.length for p in mine} >= {0, len(ids)}
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    whole = packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    check_packing(whole, [r.doc_tokens for r in {p.doc_id: p for p in whole}.values()])


def test_what_is_left_stays_in_the_tiers():
    p = packing.Packer()
    for d, n in enumerate((300, 77, 15, 999, 3)):
        p.add(d, n)
    p.pack(True)
    assert [(size, sum(x[0] for x in w)) for size, w in p.windows] == [(1024, 1024), (256, 256), (1024, 114)] and p.left == 0


def test_steps_are_balanced():
    rng = np.random.default_rng(3)
    p = packing.Packer()
    for d, n in enumerate(rng.integers(1, 3000, 400)):
        p.add(d, int(n))
    p.pack(True)
    assert p.left == 0 and not p.pieces
    steps = packing.deal(p.windows, 1 << 14)
    tokens = defaultdict(int)
    for (size, _), s in zip(p.windows, steps, strict=True):
        tokens[s, size] += size
    assert len({s for s, _ in tokens}) == len(tokens) and max(tokens.values()) <= 1 << 14
