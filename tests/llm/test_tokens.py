import hashlib
import random
import zlib

import numpy as np
import pytest

from pulsegrid.llm import bpe_words, sstable
from pulsegrid.llm.common import Workspace
from pulsegrid.llm.wordbpe import WordEncoder, default_vocabulary

from .data import SCHEMA, documents, frame


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def test_splitter_equals_library(library):
    rng = random.Random(5)
    alphabet = list("abé'sS tT1²<|>_-\n\t ẞß😀Σς中́ͅİ")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "<|startoftext|>", "<|endoftext", "it's don''t 12³", "\x85a b", "x\x1cy", "</w> a</w>b"]
    enc = WordEncoder(default_vocabulary())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want


def test_cache_generations(library, monkeypatch):
    monkeypatch.setattr("pulsegrid.llm.wordbpe.CACHE_WORDS", 50)
    enc = WordEncoder(default_vocabulary())
    rng = random.Random(1)
    for _ in range(20):
        texts = [" ".join(f"w{rng.randrange(80)}" for _ in range(20)) for _ in range(3)]
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encode_decode(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(bpe_words, "PAGE_DISTINCT", 700)
    monkeypatch.setattr(bpe_words, "CHUNK_WORDS", 300)
    rows = documents()
    got = bpe_words.encode_decode(frame(spark, rows, tmp_path / "d")).collect()
    assert len(got) == len(rows)
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, tuple(r.ids), r.decoded) for r in got], key=key) == sorted(want, key=key)


def test_decoding_is_the_join(spark, tmp_path, library, monkeypatch):
    """Another piece in the table, or none, shows in the decoded texts; ids stay."""
    import pyarrow as pa

    text = "some words and the other words"
    ids = library.encode(text, add_special_tokens=False).ids
    plain = bpe_words.piece_table

    def other(path):
        rows = plain(path).to_pylist()
        return pa.Table.from_pylist([r | {"piece": "CHANGED" if r["id"] == ids[0] else r["piece"]} for r in rows if r["id"] != ids[-1]], pa.schema([("id", pa.int32()), ("piece", pa.string())]))

    monkeypatch.setattr(bpe_words, "piece_table", other)
    got = bpe_words.encode_decode(frame(spark, [(1, text, None, None)], tmp_path / "d")).first()
    pieces = [library.id_to_token(i) for i in ids]
    assert list(got.ids) == ids and got.decoded == " ".join("CHANGED" if i == ids[0] else "" if i == ids[-1] else x for i, x in zip(ids, pieces))


def test_empty_tables(spark, tmp_path):
    empty = frame(spark, [], tmp_path / "e")
    assert bpe_words.encode_decode(empty).count() == 0
    manifest = sstable.write_shards(empty, Workspace(spark, "t").root)
    assert manifest.count() == 0 and sstable.read_shards(spark, manifest).count() == 0


def test_shards(spark, tmp_path, library):
    rows = documents()
    manifest = sstable.write_shards(frame(spark, rows, tmp_path / "d"), Workspace(spark, "t").root, shards=4)
    got = sstable.read_shards(spark, manifest).collect()
    assert len(got) == len(rows) and manifest.count() > 1
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    by = {}
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
        by.setdefault(r.doc_id, []).append(np.frombuffer(r.ids, "<u4").tolist())
    for doc, text, *_ in rows:
        assert library.encode(text or "", add_special_tokens=False).ids + [2] in by[doc]
    for doc in (0, 7, None):
        assert sorted(x.tolist() for x in sstable.lookup(manifest, doc)) == sorted(by[doc])
    assert sstable.lookup(manifest, 10_000_000) == [] and sstable.lookup(manifest, -5) == []


def test_shard_file(tmp_path):
    w = sstable.ShardWriter(2)
    keys = [sstable.key_bytes(x) for x in (None, -3, 0, 5, 5, 1 << 40, "a", "ab", "b")]
    assert keys == sorted(keys) and [sstable.key_value(k) for k in keys][1:4] == [-3, 0, 5]
    old, sstable.BLOCK_BYTES = sstable.BLOCK_BYTES, 20
    try:
        data = b"".join(b"".join(w.add(k, bytes([i, 0]) * (i + 1))) for i, k in enumerate(keys)) + b"".join(w.finish())
    finally:
        sstable.BLOCK_BYTES = old
    path = tmp_path / "x.sst"
    path.write_bytes(data)
    s = sstable.Shard(f"file://{path}")
    assert len(s.blocks) > 2 and [k for k, _ in s.scan()] == keys and s.entries == 9
    assert len(s.get(keys[3])) == 2 and s.get(sstable.key_bytes(4)) == []
    assert sum(s.may_hold(sstable.key_bytes(i)) for i in range(1000, 3000)) < 200
    path.write_bytes(data[:-40] + bytes([data[-40] ^ 1]) + data[-39:])
    with pytest.raises(ValueError):
        sstable.Shard(f"file://{path}")


def test_queries(spark, tmp_path, library):
    rows = [r for r in documents() if r[0] is not None][:40]
    frame(spark, rows, tmp_path / "documents.parquet", extra=False)
    text = {r[0]: r[1] or "" for r in rows}
    for r in bpe_words.query(spark, str(tmp_path)).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    start = 0
    for r in sorted(sstable.query(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert SCHEMA
