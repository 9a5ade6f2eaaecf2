import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulsegrid.llm import chunkdedup, linededup, ngramjoin, suffixdedup
from pulsegrid.llm.common import Workspace
from pulsegrid.llm.components import connected
from pulsegrid.llm.suffixsort import Suffixes

from .data import documents, frame, unique


def test_components(spark):
    import random

    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()}
    assert got == {x: find(x) for x in parent}


def shingles(text, n):
    w = text.encode().lower().split() if text else []
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent):
    sets = {d: shingles(t, n) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def chains(n):
    """Near copies in long chains and in one dense group."""
    import random

    rng = random.Random(9)
    w = [f"c{i}" for i in range(60)]
    out = []
    for i in range(n):
        w = list(w)
        w[rng.randrange(len(w))] = f"e{i}"
        out.append(" ".join(w))
    dense = [f"d{i}" for i in range(80)]
    for i in range(n):
        v = list(dense)
        for _ in range(rng.randrange(4)):
            v[rng.randrange(len(v))] = f"f{i}{rng.random()}"
        out.append(" ".join(v))
    return out


@pytest.mark.parametrize("n,percent,staged", [(3, 90, 20_000), (5, 80, 0)])
def test_jaccard_join(spark, tmp_path, monkeypatch, n, percent, staged):
    monkeypatch.setattr(ngramjoin, "STAGED", staged)
    rows = unique(documents()) + [(500 + i, t, None, None) for i, t in enumerate(chains(40))]
    found = ngramjoin.jaccard_join(frame(spark, rows, tmp_path / "d"), n=n, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.documents.collect()} == brute_components(rows, n, percent)
    sets = {d: shingles(t, n) for d, t, *_ in rows}
    for r in found.links.collect():
        assert r.overlap == len(sets[r.a] & sets[r.b])


@pytest.mark.parametrize("n,percent,share", [(3, 90, 500), (5, 80, 7)])
def test_jaccard_join_gives_every_link(spark, tmp_path, monkeypatch, n, percent, share):
    monkeypatch.setattr(ngramjoin, "SHARE", share)
    # Kin: equal but for one word that no other document has.
    kin = [" ".join(f"k{j}" if j != at else f"own{i}" for j in range(90)) for i, at in enumerate([89] * 6 + [0] * 6)]
    rows = unique(documents()) + [(500 + i, t, None, None) for i, t in enumerate(chains(40) + kin)]
    found = ngramjoin.jaccard_join(frame(spark, rows, tmp_path / "d"), n=n, percent=percent, every_link=True)
    sets = {d: shingles(t, n) for d, t, *_ in rows}
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    reps = sorted(first[s] for s in first if s)
    want = {(a, b): len(sets[a] & sets[b]) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    got = found.links.collect()
    assert len(got) == len(want) > 100 and {(r.a, r.b): r.overlap for r in got} == want
    ends = Counter(x for pair in want for x in pair)
    components = brute_components(rows, n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in found.documents.collect()} == {d: (*components[d], ends[first[sets[d]]] if sets[d] else 0) for d in sets}
    assert len(ngramjoin.jaccard_join(frame(spark, rows, tmp_path / "s"), n=n, percent=percent).links.collect()) < len(want)
    assert {r.n_links for r in ngramjoin.jaccard_join(frame(spark, documents()[60:64], tmp_path / "e"), every_link=True).documents.collect()} == {0}


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        both, x, y = (rng.integers(0, 1 << 63, rng.integers(1, 700), dtype=np.uint64) for _ in range(3))
        a, b = np.unique(np.concatenate((both, x))), np.unique(np.concatenate((both, y)))
        u, v = ngramjoin.bitmap(a, len(a)), ngramjoin.bitmap(b, len(b) + int(rng.integers(0, 400)))
        width = min(len(u), len(v))
        apart = int(np.bitwise_count(ngramjoin.folded(u[None], width) ^ ngramjoin.folded(v[None], width)).sum())
        assert apart <= len(np.setxor1d(a, b)) and len(u) * 64 >= 2 * len(a)


def test_jaccard_join_of_a_loose_group(spark, tmp_path):
    """Many edits of one text, about as far apart as the threshold: components as of all pairs."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"own{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(w), None, None))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(86)} for i, t, *_ in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    got = ngramjoin.jaccard_join(frame(spark, rows, tmp_path / "d"), n=5, percent=80).documents.collect()
    assert {r.doc_id: r.component_id for r in got} == root and 1 < len(set(root.values())) < 110


def test_jaccard_join_where_no_hub_fits(spark, tmp_path):
    # Near copies 1 and 2; a much longer document with a smaller id has their n-grams among its rarest.
    words, rest = [f"n{i}" for i in range(100)], [f"m{i}" for i in range(300)]
    rows = [(i, " ".join(w), None, None) for i, w in enumerate([words + rest, words, words[:-1], rest, rest, rest])]
    got = ngramjoin.jaccard_join(frame(spark, rows, tmp_path / "d")).documents.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, 90)


@pytest.mark.parametrize("every_link", [False, True])
def test_staged_overlaps_of_short_texts(spark, tmp_path, monkeypatch, every_link):
    """Ten common n-grams often leave the last vertical parts empty; counted part by part, such pairs still link."""
    monkeypatch.setattr(ngramjoin, "STAGED", 0)
    rows = [(2 * i + j, " ".join(f"s{i}x{k}" for k in range(13 - j)), None, None) for i in range(150) for j in (0, 1)]
    found = ngramjoin.jaccard_join(frame(spark, rows, tmp_path / "d"), every_link=every_link)
    assert {(r.a, r.b, r.overlap) for r in found.links.collect()} == {(2 * i, 2 * i + 1, 10) for i in range(150)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.documents.collect()} == {2 * i + j: (11 - j, 2 * i) for i in range(150) for j in (0, 1)}


def test_jaccard_join_odd_rows(spark, tmp_path):
    rows = documents()
    got = ngramjoin.jaccard_join(frame(spark, rows, tmp_path / "d")).documents.collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngramjoin.jaccard_join(frame(spark, [], tmp_path / "e")).documents.count() == 0
    nothing = ngramjoin.jaccard_join(frame(spark, [(1, None, None, None), (2, "", None, None)], tmp_path / "f")).documents.collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in nothing} == {(1, 0, 1), (2, 0, 2)}


def test_perfect_hash():
    rng = np.random.default_rng(3)
    h1 = rng.integers(-(1 << 62), 1 << 62, 5000)
    h1[10:14] = h1[10]  # equal 64 bits, told apart by the fingerprint
    h2 = rng.integers(-(1 << 62), 1 << 62, 5000)
    index = linededup.LineIndex.load(linededup.LineIndex.build(h1, h2, np.arange(1, 5001, dtype=np.uint32), np.arange(5000)).dump())
    assert index.hash.size == 5000
    counts, keeps = index.find(h1, h2)
    assert counts.tolist() == list(range(1, 5001)) and keeps.tolist() == list(range(5000))
    counts, _ = index.find(rng.integers(-(1 << 62), 1 << 62, 5000), h2)
    assert not counts.any()


def brute_lines(rows):
    docs = defaultdict(set)
    for i, (d, t, *_) in enumerate(rows):
        for k in {linededup.line_key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                docs[k].add(i)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            k = linededup.line_key(x)
            ids = [rows[i][0] for i in docs.get(k, ()) if rows[i][0] is not None]
            if len(docs.get(k, ())) >= 3 and ids and d != max(ids):
                continue
            kept.append(x)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("held", [128 << 20, 0])
def test_lines(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 1)
    monkeypatch.setattr(linededup, "CACHE_BYTES", held)
    monkeypatch.setattr(linededup, "PAGE_BYTES", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(linededup, "small_batches", lambda spark: None)
    rows = documents()
    got = linededup.drop_lines(frame(spark, rows, tmp_path / "d"), extra=["lang", "kept", "row"]).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == Counter(brute_lines(rows))
    assert got[0].row.kept == "clash" and sum(r.n_dropped for r in got) > 0
    assert linededup.drop_lines(frame(spark, [], tmp_path / "e")).count() == 0


def brute_substrings(rows, width=50):
    seen, out = {}, {}
    for d, t, *_ in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if seen.setdefault(raw[p : p + width], d) < d:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("wide", [20_000, 0])
def test_substrings(spark, tmp_path, monkeypatch, wide):
    monkeypatch.setattr(suffixdedup, "WIDE_ANCHOR", wide)
    monkeypatch.setattr(suffixdedup, "PAGE_BYTES", 4000)
    monkeypatch.setattr(suffixdedup, "SLICE_BYTES", 700)
    monkeypatch.setattr(suffixdedup, "SORT_WINDOWS", 300)
    rows = unique(documents()) + [(900 + i, "ab" * (30 + i), None, None) for i in range(4)]
    frame(spark, rows, tmp_path / "documents.parquet", extra=False)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.query(spark, str(tmp_path)).collect()}
    assert got == brute_substrings(rows)


def local_substrings(rows, folder, monkeypatch, fragments=3, wide=20_000):
    """The operator's steps without Spark, in this process."""
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))

    def grouped(batches, by_page=False):
        table = pa.Table.from_batches(list(batches), suffixdedup._ROWS).to_pylist()
        out = defaultdict(list)
        for r in table:
            out[r["page"] if by_page else (r["frag"], r["page"] if r["frag"] < 0 else None)].append(r)
        return [pa.Table.from_pylist(sorted(out[k], key=lambda r: r["frag"]), suffixdedup._ROWS) for k in sorted(out, key=str)]

    def every(f, tables):
        return [b for t in tables for b in f(t).to_batches()]

    batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "t": [r[1] for r in rows]})
    at = suffixdedup._pages(folder, fragments)(iter([batch]))
    at = every(suffixdedup._wanted(wide), grouped(at))
    at = suffixdedup._ask(folder, fragments)(b for t in grouped(at, True) for b in t.to_batches())
    for _ in range(2):
        at = every(suffixdedup._sorted_windows(fragments, 300), grouped(at))
    out = suffixdedup._finish(folder)(b for t in grouped(at, True) for b in t.to_batches())
    return {r["id"]: (r["n_bytes"], sum(x["stop"] - x["start"] for x in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for b in out for r in b.to_pylist()}


@pytest.mark.parametrize("wide", [20_000, 0])
def test_substrings_when_digests_collide(tmp_path, monkeypatch, wide):
    """Every unit has the same digest, and k-grams one of four hashes: bytes decide all the same."""
    monkeypatch.setattr(suffixdedup, "digest", lambda raw: 7)
    plain = suffixdedup.gram_hashes
    monkeypatch.setattr(suffixdedup, "gram_hashes", lambda data: plain(data) >> np.uint64(62) << np.uint64(62))
    monkeypatch.setattr(suffixdedup, "PAGE_BYTES", 6000)
    rows = [(d, t) for d, t, *_ in unique(documents(n=40)) if len(t or "") < 3000] + [(900 + i, "ab" * (30 + i)) for i in range(4)]
    got = local_substrings(rows, f"file://{tmp_path}", monkeypatch, wide=wide)
    assert got == brute_substrings(rows) and sum(x[1] for x in got.values()) > 1000


def test_substrings_odd_rows(spark, tmp_path):
    rows = documents()
    got = suffixdedup.drop_repeats(frame(spark, rows, tmp_path / "d")).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 0 for r in got) == 3 and all(not r.spans for r in got if r.doc_id == 0)
    assert suffixdedup.drop_repeats(frame(spark, [], tmp_path / "e")).count() == 0


def test_suffix_sort():
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = rng.integers(97, 97 + rng.integers(1, 4), 400).astype(np.uint8)
        depth = int(rng.integers(1, 20))
        at, group = rng.integers(0, 400 - depth, 300), np.sort(rng.integers(0, rng.integers(1, 40), 300))
        order, same = Suffixes(text, depth).sort(at, group)
        piece = lambda i: text[at[i] : at[i] + depth].tobytes()
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            assert sorted(order[own]) == own.tolist()
            pieces = [piece(i) for i in order[own]]
            assert pieces == sorted(pieces) and same[own].tolist() == [False, *(x == y for x, y in zip(pieces, pieces[1:]))]


def test_suffix_collision_is_sorted_by_bytes(monkeypatch):
    text = np.frombuffer(b"abcdabceabcdabcz", np.uint8)
    s = Suffixes(text, 4)
    s.prefix = np.zeros_like(s.prefix)  # every hash equal
    order, same = s.sort(np.array([0, 4, 8, 12]), np.zeros(4, np.int64))
    assert [text[i * 4 : i * 4 + 4].tobytes() for i in order] == [b"abcd", b"abcd", b"abce", b"abcz"] and same.tolist() == [False, True, False, False]


def naive_chunks(raw, least=128):
    """Chunks by the rolling definition, a byte at a time."""
    if 0 < len(raw) < least:
        return [(0, len(raw))]
    h, hashes = 0, []
    for b in raw:
        h = (h << 1) + int(chunkdedup._GEAR[b]) & 0xFFFFFFFF
        hashes.append(h)
    cuts = [i + 1 for i, x in enumerate(hashes) if x >> 28 == 0]
    for a, b in zip([0, *cuts], [*cuts, len(raw)]):
        if b - a > 128:
            own = hashes[a:b]
            cuts += [a + i + 1 for i, x in enumerate(own) if x == min(own[max(0, i - 24) : i + 25])]
    places = [0]
    for c in sorted(cuts):
        if c < len(raw):
            while raw[c] & 0xC0 == 0x80:
                c -= 1
            if c - places[-1] >= 8:
                places.append(c)
    places.append(len(raw))
    out = []
    for a in places:
        far = [b for b in places if b - a >= least]
        if far:
            out.append((a, far[0]))
    return out


def brute_chunks(rows):
    last = 1 << 70
    first, cut = {}, []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        cut.append([(a, b, raw[a:b]) for a, b in naive_chunks(raw)])
        for *_, k in cut[-1]:
            first[k] = min(first.get(k, last), last if d is None else d)
    out = []
    for (d, t, *_), own in zip(rows, cut):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for a, b, k in own:
            if first[k] < (last if d is None else d):
                gone[a + 1 : b + 1] = True
        starts, ends = np.flatnonzero(~gone[:-1] & gone[1:]).tolist(), np.flatnonzero(gone[:-1] & ~gone[1:]).tolist()
        out.append((d, len(raw), int(gone.sum()), tuple(zip(starts, ends))))
    return out


def test_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunkdedup, "PAGE_CHUNKS", 60)
    rows = [r for r in documents() if len(r[1] or "") < 5000]
    rows += [(950, "short text that comes twice", None, None), (951, "short text that comes twice", None, None), (952, "z " * 300, None, None), (953, "é" * 400, None, None), (954, "ab" * 90 + "é" * 300, None, None)]
    docs = frame(spark, rows, tmp_path / "d")
    got = chunkdedup.repeated_spans(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, tuple(tuple(x) for x in r.spans)) for r in got) == Counter(brute_chunks(rows))
    assert all(r.n_spans == len(r.spans) for r in got)
    by = {r.doc_id: r for r in got}
    # The shared passage of sixty words is found in every document but the first that has it.
    assert not by[3].n_spans and all(by[i].n_removed > 100 for i in range(9, 60, 6))
    assert chunkdedup.repeated_spans(frame(spark, [], tmp_path / "e")).count() == 0
    few = frame(spark, unique(rows), tmp_path / "f")
    kept = {r.doc_id: r.text for r in chunkdedup.remove_spans(few, chunkdedup.repeated_spans(few)).collect()}
    texts = {d: t for d, t, *_ in rows}
    assert all(len(kept[d].encode()) == len(texts[d].encode()) - by[d].n_removed for d in kept if texts[d] and d is not None)


def test_many_fragments_send_little_more():
    """A page's rows for 8 and for 512 fragments."""
    from types import SimpleNamespace
    from unittest.mock import patch

    import pyarrow as pa

    rng = random.Random(3)
    words = [f"word{i}" for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(900)), "t": [" ".join(rng.choice(words) for _ in range(300)) for _ in range(900)]})
    size = {}
    with patch("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0)):
        for n in (8, 512):
            size[n] = sum(len(r[c] or b"") for b in chunkdedup._pages(n, 128)(iter([batch])) for r in b.to_pylist() for c in ("head", "h", "g", "u"))
    assert size[512] < 1.5 * size[8]


def test_periodic_passages_are_found():
    rng = np.random.default_rng(9)
    for period in (1, 2, 5, 13, 31, 50, 200):
        unit = rng.integers(97, 100, period).astype(np.uint8)
        passage = np.tile(unit, 2 + 700 // period)[:700]
        cuts = []
        for _ in range(2):
            text = np.concatenate((rng.integers(97, 123, rng.integers(200, 400)).astype(np.uint8), passage, rng.integers(97, 123, 300).astype(np.uint8)))
            cuts.append({text[a:b].tobytes() for a, b in zip(*chunkdedup.chunk_ranges(text))})
        assert cuts[0] & cuts[1], period


def test_cuts_resist_shifts():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 4000).astype(np.uint8)
    moved = np.concatenate((data[:1000], np.frombuffer(b"inserted", np.uint8), data[1000:]))
    a, b = set(chunkdedup.cut_places(data)), set(chunkdedup.cut_places(moved))
    assert {x for x in a if x < 900} <= b and len({x + 8 for x in a if x > 1200} - b) <= 3


def test_kin_of_one_edited_place(spark, tmp_path):
    """Many documents that differ from one text in the first, or the last, word only: two dense clusters."""
    base = [f"k{i}" for i in range(15)]
    rows = [(i, " ".join([f"first{i}", *base[1:]]), None, None) for i in range(30)] + [(100 + i, " ".join([*base[:-1], f"last{i}"]), None, None) for i in range(30)]
    rows += [(200 + i, " ".join([*base[:7], f"mid{i}", *base[8:]]), None, None) for i in range(5)] + [(300, " ".join(base), None, None)]
    for n, percent in ((5, 80), (3, 90), (3, 85), (2, 70)):
        found = ngramjoin.jaccard_join(frame(spark, rows, tmp_path / f"d{n}{percent}"), n=n, percent=percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.documents.collect()} == brute_components(rows, n, percent)
