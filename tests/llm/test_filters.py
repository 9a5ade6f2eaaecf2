from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import decontam, langid, quality, warc
from pulsegrid.llm.common import Workspace, open_fs

from .data import documents, frame


def brute_quality(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_quality(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", limit)
    rows = documents() + [(700, "# a line | <b>\n# a line | <b>\n \n \nx", None, None), (701, "q w e r t y q w e r t y u i o p q w e r t", None, "odd")]
    got = quality.apply_rules(frame(spark, rows, tmp_path / "d")).collect()
    assert len(got) == len(rows)
    want = Counter((d, *brute_quality(t)) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    by = {r.host: r for r in got}
    assert by["src0"].host_kept and not by["odd"].host_kept
    # Shrinking pulls a host's rate towards the others'.
    assert by["odd"].rate_base < by["odd"].failed_base / by["odd"].host_docs
    # Verdicts by brute force.
    import statistics

    soft = ("symbols", "lines", "word_length")
    strict = {}
    for rule in ("base", *soft):
        fails = lambda r, rule=rule: r.base_failed if rule == "base" else r[f"fails_{rule}"]
        own = {h: [fails(r) for r in got if r.host == h] for h in by}
        rates = [sum(x) / len(x) for x in own.values()]
        m, v = statistics.mean(rates), statistics.variance(rates)
        weight = max(m * (1 - m) / v - 1, 1.0) if v > 1e-12 else 100.0
        centre = m if v > 1e-12 else sum(map(sum, own.values())) / len(got)
        for h, x in own.items():
            rate = (sum(x) + centre * weight) / (len(x) + weight)
            strict[rule, h] = rate > (0.5 if rule == "base" else centre + (centre * (1 - centre) / (weight + 1)) ** 0.5)
    for r in got:
        assert r.kept == (not r.base_failed and not strict["base", r.host] and not any(r[f"fails_{rule}"] and strict[rule, r.host] for rule in soft))


def test_host_that_is_strict_in_a_rule(spark):
    """A document that fails a soft rule goes only from a host where that is unusually frequent."""
    clean = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    rows = [(100 * h + i, clean(100 * h + i) + (" # % & $" if i < (30 if h == 7 else 2) else ""), f"h{h}") for h in range(8) for i in range(60)]
    got = quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.host for r in got if r.strict_symbols} == {"h7"} and all(r.host_kept for r in got)
    assert {r.doc_id for r in got if not r.kept} == {700 + i for i in range(30)}
    assert sum(r.fails_symbols and r.kept for r in got) == 14


def test_quality_of_nothing(spark, tmp_path):
    assert quality.apply_rules(frame(spark, [], tmp_path / "e")).count() == 0


def test_languages(spark, tmp_path):
    import random

    rng = random.Random(3)
    pieces = {"aa": ["the", "ing", "and", "wh", "ou"], "bb": ["der", "sch", "ung", "ei", "ge"], "cc": ["que", "eau", "oi", "é", "ç"]}
    rows = [(i, " ".join("".join(rng.choice(pieces[g]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 80))), g, None) for i in range(240) for g in [rng.choice(sorted(pieces))]]
    odd = [(1000, None, "aa", None), (1001, "", None, None), (1002, "123 %% 45", "bb", None), (None, "the anding", "aa", None), (1003, "é", None, None), (1004, "the wh and " * 60_000, None, None)]
    docs = frame(spark, rows + odd, tmp_path / "documents.parquet")
    got = {r.doc_id: r for r in langid.query(spark, str(tmp_path)).collect()}
    import zlib

    own = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(own) > 20 and all(got[d].held_out for d, *_ in own)
    assert sum(got[d].lang_pred == g for d, _, g, _ in own) >= 0.95 * len(own)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[1004].lang_pred == "aa" and got[1003].lang_pred == "cc" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    out = langid.predict(docs, langid.Prototypes("", ()), extra=["n", "row"]).collect()
    assert {r.lang_pred for r in out} == {"und"} and out[0].row.n == "clash"
    assert langid.learn(frame(spark, [], tmp_path / "e")).blocks == ()


def test_languages_by_brute_force(spark, tmp_path, monkeypatch):
    """Predictions and scores against vectors made letter by letter; prototypes in several files, texts in several slices."""
    import random
    import unicodedata
    import zlib

    monkeypatch.setattr(langid, "BLOCK_LANGS", 2)
    monkeypatch.setattr(langid, "KEPT_BLOCKS", 1)
    monkeypatch.setattr(langid, "SLICE_TEXTS", 3)
    rng = random.Random(2)
    letters = {f"l{k}\0{k}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyzéüñç", 9)) for k in range(7)}
    rows = [(i, " ".join("".join(rng.choice(letters[g]) for _ in range(rng.randrange(1, 7))).title() + rng.choice(["", ",", " 7"]) for _ in range(rng.randrange(1, 30))), g, None) for i in range(90) for g in [rng.choice(sorted(letters))]]
    rows += [(200, None, "l0", None), (201, "--", "l1", None), (202, "ab", None, None)]
    space = langid.Space()

    def vector(text):
        codes = [32]
        for c in (text or "").lower():
            if unicodedata.category(c)[0] == "L":
                codes.append(ord(c))
            elif codes[-1] != 32:
                codes.append(32)
        codes += [32] * (codes[-1] != 32)
        out = np.zeros(langid.DIMS)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            out += np.roll(space.letter(a), 2) * np.roll(space.letter(b), 1) * space.letter(c)
        return out if len(codes) > 1 else None

    sums = {}
    for d, t, g, _ in rows:
        if g and zlib.crc32(str(d).encode()) % 5 and (v := vector(t)) is not None:
            sums[g] = sums.get(g, 0) + v
    frame(spark, rows, tmp_path / "documents.parquet")
    got = {r.doc_id: r for r in langid.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and len(sums) > 4
    for d, t, *_ in rows:
        if (v := vector(t)) is None:
            assert (got[d].lang_pred, got[d].score) == ("und", 0)
            continue
        cosines = {g: float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for g, p in sums.items()}
        best = max(cosines.values())
        assert abs(got[d].score - max(0, best)) < 1e-9 and cosines[got[d].lang_pred] > best - 1e-9


def test_more_labels_than_a_task_holds(spark, tmp_path):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}{chr(0x4E00 + i)} " * 3, f"g{i}", None) for i in range(4500)]
    docs = frame(spark, rows, tmp_path / "d", extra=False)
    prototypes = langid.learn(docs)
    assert len(prototypes.blocks) > 5
    few = docs.filter("doc_id % 300 = 0")
    assert {(r.doc_id, r.lang_pred) for r in langid.predict(few, prototypes).collect()} == {(i, f"g{i}") for i in range(0, 4500, 300)}


def test_bundle_is_the_sum_of_bound_letters():
    s = langid.Space(64)
    codes = langid._symbols("Ab, c")
    assert codes.tolist() == [32, 97, 98, 32, 99, 32]
    counts, found = langid._counts([codes], np.array([0]), 1)
    want = sum(np.roll(s.letter(a), 2) * np.roll(s.letter(b), 1) * s.letter(c) for a, b, c in zip(codes.tolist(), codes[1:].tolist(), codes[2:].tolist()))
    assert (s.bundle(counts, found)[0] == want).all()


def five(text):
    w = (text or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_decontamination(spark, tmp_path):
    import random

    rng = random.Random(8)
    items = [(i, " ".join(f"q{rng.randrange(900)}" for _ in range(rng.randrange(15, 60)))) for i in range(30)] + [(90, None), (91, "too short here"), (92, " ".join(["same"] * 20))]
    rows = documents()
    for i in range(40):
        w = items[i % 30][1].split()
        if i >= 30:
            w[len(w) // 2] = "changed"
        rows.append((800 + i, " ".join(["before"] * (i % 7) + w + [f"after{i}", "that"] * 4), None, None))
    rows += [(900, items[0][1].upper(), None, None), (901, " ".join(["same"] * 25), None, None), (902, " ".join(items[3][1].split()[:8]), None, None), (None, items[5][1], None, None)]
    rows += [rows[-4], rows[-4]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(frame(spark, rows, tmp_path / "d"), benchmark).collect()
    want = {}
    for d, t, *_ in rows:
        s = five(t)
        for i, x in items:
            own = five(x)
            m = len(own)
            if not m:
                continue
            best = 0.0
            for a in range(max(1, len(s) - m + 1)):
                both = sum((Counter(s[a : a + m]) & Counter(own)).values())
                if both and len(s[a : a + m]) == m:
                    best = max(best, both / (2 * m - both))
            if best >= 0.8:
                want[(d, i)] = best
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    assert len(found) == len(got) and got.keys() == want.keys() and len(want) > 30
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(frame(spark, rows, tmp_path / "d2"), none).count() == 0
    assert decontam.contaminated(frame(spark, [], tmp_path / "e"), benchmark).count() == 0


def best_windows(rows, items):
    """Best similarity by (document, item) over all windows of item size; over the whole text if that is shorter."""
    want = {}
    for d, t in rows:
        s = five(t)
        for i, x in items:
            own = five(x)
            both = max(sum((Counter(s[a : a + len(own)]) & Counter(own)).values()) for a in range(max(1, len(s) - len(own) + 1)))
            if own and (best := both / (min(len(s), len(own)) + len(own) - both)) >= 0.8:
                want[(d, i)] = best
    return want


def test_decontamination_where_a_text_ends(spark):
    import random

    rng = random.Random(21)
    items = [(i, " ".join(f"q{rng.randrange(5000)}" for _ in range(40 + 2 * i))) for i in range(11)]
    rows = []
    for i, x in items:
        w, filler = x.split(), [f"f{i}x{k}" for k in range(10)]
        cut = [w[:-1], w[1:], w[:-4], w[:-3] + w[-2:], w[:2] + w[3:], w]
        rows += [" ".join(h + c + t) for c in cut for h in ([], filler) for t in ([], filler[:1])]
    rows = list(enumerate(rows))
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = best_windows(rows, items)
    got = {(r.doc_id, r.item_id): r for r in found}
    assert len(found) == len(got) and got.keys() == want.keys() and len(want) == len(rows)
    texts = dict(rows)
    for k, r in got.items():
        n = len(texts[r.doc_id].split())
        assert abs(r.similarity - want[k]) < 1e-12
        assert 0 <= r.start and r.start + r.n_words <= n and r.n_words == min(n, len(items[r.item_id][1].split()))


def test_blocks_find_everything_within_the_radius():
    rng = np.random.default_rng(1)
    for _ in range(500):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, decontam.RADIUS, replace=False):
            b ^= 1 << int(bit)
        assert any((a >> at) % (1 << bits) == (b >> at) % (1 << bits) for at, bits in decontam.blocks())


def test_item_of_very_many_words(spark):
    from pulsegrid.llm.decontam import contaminated

    long = " ".join(f"w{i % 70_001}" for i in range(70_000))
    docs = [(1, "before " + long + " after"), (2, " ".join(long.split()[:50_000])), (3, "nothing of it"), (4, " ".join(f"w{i}" for i in range(40)))]
    items = [(10, long), (11, " ".join(f"w{i}" for i in range(40)))]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == {(d, i): 1.0 for d, i in ((1, 10), (1, 11), (2, 11), (4, 11))}


def test_recall_near_the_threshold():
    """The share of pairs at similarity 0.80 to 0.83 whose fingerprints are within the radius."""
    rng = np.random.default_rng(5)
    bits = lambda hashes: (hashes[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(bool)
    found = tried = 0
    for m in (20, 36, 55, 100):
        shared = next(s for s in range(m) if s / (2 * m - s) >= 0.8)
        for _ in range(1500):
            h = rng.integers(0, 1 << 63, 2 * m - shared, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * m - shared, dtype=np.uint64)
            a, b = bits(h[:m]), bits(h[m - shared :])
            distance = int(((a.sum(0) * 2 > m) != (b.sum(0) * 2 > m)).sum())
            found, tried = found + (distance <= decontam.RADIUS), tried + 1
    assert found >= 0.995 * tried, found / tried


def pages(spark, path, n=90):
    rows = [(i, f"http://h{i % 3}/p{i}", f"<p>page {i} é" + "x" * (i * 7 % 300) + "</p>") for i in range(n)] + [(None, None, None), (3, "u", ""), (3, "u", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path)), rows


def test_archives_and_audit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    df, rows = pages(spark, tmp_path / "pages.parquet")
    ws = Workspace(spark, "t")
    folders = [ws.path("a"), ws.path("b")]
    for f in folders:
        fs, p = open_fs(f)
        fs.create_dir(p)
    manifest = warc.write_archives(df, folders)
    m = manifest.collect()
    assert len(m) == len(rows) and len({r.archive for r in m}) > 3
    for r in m[:20]:
        fs, p = open_fs(f"{folders[0]}/{r.archive}")
        with fs.open_input_file(p) as file:
            file.seek(r.start)
            head, body = warc.parse_record(file.read(r.length))
        assert any(x[0] == r.page_id and (x[2] or "").encode() == body and (x[1] or "") == head["WARC-Target-URI"] for x in rows)
    trees = [ws.table(warc.hash_trees(manifest, f), f"t{i}") for i, f in enumerate(folders)]
    assert warc.audit(*trees).count() == 0
    # Damage: one bit of a record, the tail of an archive, a whole archive.
    names = sorted({r.archive for r in m})
    bad = set()
    flip = max((r for r in m if r.archive == names[0]), key=lambda r: r.record)
    _, p = open_fs(f"{folders[1]}/{names[0]}")
    raw = bytearray(open(p, "rb").read())
    raw[flip.start + 5] ^= 4
    open(p, "wb").write(raw)
    bad.add((names[0], flip.record))
    last = max((r for r in m if r.archive == names[1]), key=lambda r: r.record)
    _, p = open_fs(f"{folders[1]}/{names[1]}")
    open(p, "r+b").truncate(last.start + 3)
    bad.add((names[1], last.record))
    fs, p = open_fs(f"{folders[1]}/{names[2]}")
    fs.delete_file(p)
    bad |= {(r.archive, r.record) for r in m if r.archive == names[2]}
    damaged = ws.table(warc.hash_trees(manifest, folders[1]), "damaged")
    assert {(r.archive, r.record) for r in warc.audit(trees[0], damaged).collect()} == bad


def test_tree_shape():
    n = 40
    nodes = warc.tree([(i, i + 1) for i in range(n)], [bytes([i]) * 32 for i in range(n)])
    assert [sum(x[0] == k for x in nodes) for k in range(3)] == [40, 3, 1] and [x for x in nodes if x[5]][0][2:4] == (0, n)
    assert warc.tree([], []) == [] and warc.tree([(0, 5)], [b"x"])[0][5]


def test_audit_of_very_many_archives(spark):
    from pyspark.sql import functions as F

    ws = Workspace(spark, "many")
    tall = [("tall", *x) for x in warc.tree([(i, i + 1) for i in range(300)], [bytes([i % 256]) * 32 for i in range(300)])]
    ddl = warc._NODES_DDL
    flat = spark.range(130_000).select(F.concat(F.lit("a"), "id").alias("archive"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("lo"), F.lit(9).cast("long").alias("hi"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("hash"), F.lit(True).alias("root"))
    a = ws.table(flat.unionByName(spark.createDataFrame(tall, ddl)), "a")
    other = [("tall", *x) for x in warc.tree([(i, i + 1) for i in range(300)], [bytes([i % 256 ^ (i == 257)]) * 32 for i in range(300)])]
    b = ws.table(flat.withColumn("hash", F.lit(b"other")).unionByName(spark.createDataFrame(other, ddl)), "b")
    bad = warc.audit(a, b)
    assert bad.count() == 130_001 and [r.record for r in bad.filter("archive = 'tall'").collect()] == [257]


def test_url_with_line_breaks():
    head, body = warc.parse_record(warc.record_bytes(7, "http://h/a\r\nX-Page-Id: 8\n b", "body\r\n\r\nmore"))
    assert head["WARC-Target-URI"] == "http://h/a%0D%0AX-Page-Id:%208%0A%20b" and head["X-Page-Id"] == "7" and body == b"body\r\n\r\nmore"


def test_archive_query(spark, tmp_path):
    _, rows = pages(spark, tmp_path / "pages.parquet")
    got = warc.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    # Leaves by brute force: what each record holds, hashed with its range.
    held = Counter()
    for p, url, html in rows:
        held[p, warc.record_bytes(p, url, html)] += 1
    for r in got:
        mine = [data for (p, data), _ in held.items() if p == r.page_id and len(data) == r.length]
        import hashlib
        import struct

        assert r.leaf_hash in [hashlib.sha256(b"\x00" + struct.pack("<QQ", r.start, r.start + r.length) + data).hexdigest() for data in mine]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert warc.query(spark, str(tmp_path / "none")).count() == 0


def test_decontamination_sends_no_rows_through_python_workers(spark, tmp_path, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(1, text, None, "s"), (2, "other words", None, "s")], tmp_path / "d.parquet", extra=False)
    items = spark.createDataFrame([(7, text), (8, "few words")], "item_id long, text string")

    def fail(*a, **k):
        raise AssertionError("rows from Python are read by a worker of their own in every executor")

    monkeypatch.setattr(type(spark), "createDataFrame", fail)
    assert [(r.doc_id, r.item_id, r.similarity) for r in decontam.contaminated(docs, items).collect()] == [(1, 7, 1.0)]
