import random
import zlib

import numpy as np
import pytest

from weftline.llm import packing, token_store, tokens
from weftline.llm.shared import fresh_uri

PARTS = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "a", "é", "'s", "'", "12", "!?", "<|endoftext|>", "\xa0", "　", "\x1c", "漢", "😀", "\r\n", "​", "x" * 50, "\r", "a,", "word.", "The"]


@pytest.fixture(scope="module")
def tok():
    return tokens.tokenizer(tokens.default_vocabulary())


def library(tok, text):
    return np.asarray(tok.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_cached_encoding_equals_the_library(tok, spark, sf_dir):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + [None]
    assert tok.encode(texts) == [library(tok, t) for t in texts]


def test_forgetting_changes_nothing():
    small = tokens.WordCachedTokenizer(tokens.default_vocabulary(), limit=5)
    texts = ["one two three four", "five six seven eight nine", "one two"] * 5
    assert [small.encode([t])[0] for t in texts] == [library(small, t) for t in texts]


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 4097])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (token_store.from_planes(token_store.to_planes(ids, planes), n) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_store_round_trip(planes, spark, sf_dir, tok):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = fresh_uri(spark, "tokens")
    token_store.write_tokens(docs, path, tokens.default_vocabulary(), end_id=2, planes=planes, block=1000, shards=5)
    got = sorted(token_store.read_tokens(spark, path).collect())
    start = 0
    for row, doc in zip(got, sorted((r.doc_id, r.text) for r in docs.collect()), strict=True):
        ids = library(tok, doc[1]) + (2).to_bytes(4, "little")
        assert tuple(row)[:4] == (doc[0], start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_one_chunk_is_read_alone(tmp_path):
    import pyarrow.fs

    fs = pyarrow.fs.LocalFileSystem()
    with fs.open_output_stream(str(tmp_path / "s")) as out:
        w = token_store.ShardWriter(out, block=100)
        w.add(1, np.arange(250, dtype=np.uint32))
        w.close()
    reader = token_store.ShardReader(fs.open_input_file(str(tmp_path / "s")))
    assert reader.chunk(1).tolist() == list(range(100, 200)) and len(reader.footer["chunks"]) == 3
    (tmp_path / "cut").write_bytes((tmp_path / "s").read_bytes()[:-5])
    with pytest.raises(ValueError):
        token_store.ShardReader(fs.open_input_file(str(tmp_path / "cut")))


def test_packing_is_whole_and_full(spark, sf_dir, tok):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack_documents(docs, tokens.default_vocabulary(), end_id=0, group_tokens=4096).collect()
    texts = {r.doc_id: library(tok, r.text) + bytes(4) for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(texts[p.doc_id][4 * p.start : 4 * (p.start + p.length)]) and p.length > 0
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for doc, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(texts[doc]) // 4
            at += p.length
        assert at == len(texts[doc]) // 4
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0 and at == ps[0].tier or at < 128
    full = {}
    for s, ps in by_sequence.items():
        full.setdefault(ps[0].step_group, []).append(sum(p.length for p in ps))
    assert max(map(sum, full.values())) <= 4096


def test_packer_fills_gaps_from_shorter_tiers():
    p = packing.Packer(tiers=(16, 8, 4), group_tokens=32, buffered=1000)
    for k, n in enumerate([12, 3, 1, 9, 7, 20]):
        p.add(k, np.full(n, k, np.uint32))
    p.close()
    windows = {}
    for r in p.rows:
        windows.setdefault(r[5], []).append(r)
    assert sum(r[2] for r in p.rows) == 52
    assert all(sum(r[2] for r in w) in (1, 2, 4, 8, 16) for w in windows.values())


def test_pieces_are_learned_together_without_marks_between_them(tok):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéĠßж漢😀'.9") for _ in range(rng.randint(1, 9)))
    texts = ["\n".join(" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 5))) for _ in range(600)]
    small = tokens.WordCachedTokenizer(tokens.default_vocabulary())
    given = []

    class Seen:
        def encode_batch_fast(self, batch, **options):
            given.extend(batch)
            return tok.tokenizer.encode_batch_fast(batch, **options)

    small.tokenizer = Seen()
    assert small.encode(texts) == [library(tok, t) for t in texts]
    # pieces after a space meet with nothing but their spaces, those that begin a line or a text with their lines
    assert len(given) < 30 and not any(g[0] == " " and "\n" in g for g in given)
