"""Exact substring dedup over UTF-8 bytes, by suffixes sorted around shared anchors.

A byte goes if a string of ``width`` bytes that covers it also starts in a document
with a smaller id. Strings are judged on the input.

1. Every window of ``width`` bytes has an anchor: the leftmost of its smallest k-grams
   by hash. Equal windows have equal anchors at equal places, so only windows with one
   anchor need be compared. Neighbouring windows with one anchor are one *unit*: on
   average a dozen windows.
2. A page (a run of documents of one task) keeps one of its units of equal bytes, that
   of its smallest document, and deals it by anchor. A fragment tells which anchors are
   in more than one document; only those units' bytes are asked for.
3. Those bytes are dealt by anchor again. A fragment sorts the windows as suffixes
   (hash-compared merge sort, see ``suffixsort``, which compares neighbours' bytes); a
   run of equal ones has a smallest document, and every other document's windows in it
   are repeats. Pieces of equal bytes are sorted as one. No digest decides: equal bytes
   do, in the page, in the fragment and in the sort.
4. Pages join the answers by position and cut the bytes out.

Texts wait in their page's file in the shared folder. Anchors with very many units are
dealt by window, not by anchor, and in SALTS shares; what a share doesn't settle (its
smallest documents) is sorted once more over all shares. So a passage that a third of
all documents hold is at most a window a page, and no task has all of them.

Edge cases: null text has no bytes. A text shorter than ``width`` loses nothing. Rows
of equal id take nothing from each other. A null id counts as larger than every id.
Repeats within one document alone stay. A very long text is worked on in overlapping
pieces, but a page holds it whole. Kept bytes may split a character: they are
bytes, not text. Other columns aren't read, whatever they are called. An empty table gives an empty result. The
input must give the same rows in the same order when a task is run again, as a stored
table does.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunkdedup import LAST, merged
from .common import Workspace, fragment_count, open_fs, pack, pack_ints, pack_sorted, scale_parts, small_batches, trim, unpack, unpack_ints, unpack_sorted, write_atomically
from .suffixsort import _BASE, _BYTE, Suffixes

#: Bytes of a string; of a k-gram; of a page; worked on at once; windows sorted at once.
WIDTH, GRAM = 50, 20
PAGE_BYTES, SLICE_BYTES, SORT_WINDOWS = 8 << 20, 1 << 19, 1 << 19
#: Units of one anchor after which their windows are dealt one by one, in so many shares.
WIDE_ANCHOR, SALTS = 20_000, 256
#: In place of a fragment: a row that names a page; a page's repeats.
PAGE, HITS = -1, -2


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling; GRAM = 16 + 4."""
    h = _BYTE[data]
    held = {1: h}
    power = {1: _BASE}
    for k in (1, 2, 4, 8):
        h = held[k]
        held[2 * k] = h[:-k] * power[k] + h[k:] if len(h) > k else h[:0]
        power[2 * k] = np.uint64(int(power[k]) ** 2 & 0xFFFFFFFFFFFFFFFF)
    n = max(0, len(data) - GRAM + 1)
    h = held[16][:n] * power[4] + held[4][16 : 16 + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def least_at(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost smallest of h[i : i + span], for every i."""
    at = np.arange(len(h), dtype=np.int32)
    best, k = h, 1
    while 2 * k <= span:
        worse = best[k:] < best[:-k]
        at, best = np.where(worse, at[k:], at[:-k]), np.where(worse, best[k:], best[:-k])
        k *= 2
    if (d := span - k) > 0:
        worse = best[d:] < best[:-d]
        at = np.where(worse, at[d:], at[:-d])
    return at


digest = xxhash.xxh3_64_intdigest


class Units:
    """Units of documents laid end to end: first window, windows, anchor's distance, hashes, document."""

    def __init__(self, raws: list[bytes]):
        sizes = np.array([len(r) for r in raws], np.int64)
        data = np.frombuffer(b"".join(raws), np.uint8)
        self.doc = self.start = self.count = self.lead = np.zeros(0, np.int64)
        self.anchor = self.body = np.zeros(0, np.uint64)
        windows = len(data) - WIDTH + 1
        if windows <= 0:
            return
        h = gram_hashes(data)
        at = least_at(h, WIDTH - GRAM + 1)[:windows]
        doc = np.repeat(np.arange(len(raws)), sizes)
        ok = doc[:windows] == doc[WIDTH - 1 :]
        new = np.ones(windows, bool)
        new[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1]) | (doc[1:windows] != doc[: windows - 1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, windows))
        keep = ok[first]
        self.start, self.count = first[keep], count[keep]
        self.doc = doc[self.start]
        self.lead = at[self.start] - self.start
        self.anchor = h[at[self.start]]
        flat = data.tobytes()
        ends = (self.start + self.count + WIDTH - 1).tolist()
        self.body = np.array([digest(flat[a:b]) for a, b in zip(self.start.tolist(), ends, strict=True)], np.uint64)


def _cut_long(raw: bytes, step: int) -> list[tuple[int, bytes]]:
    """A text in pieces that overlap by WIDTH - 1 bytes, so every window is in one piece."""
    return [(lo, raw[lo : lo + step + WIDTH - 1]) for lo in range(0, max(1, len(raw) - WIDTH + 1), step)]


_ROWS = pa.schema([("page", pa.int64()), ("frag", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_DDL = "page long, frag int, a binary, b binary, c binary, d binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(_ROWS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _ROWS, strict=True)], schema=_ROWS)


def _save(uri: str, **arrays: bytes) -> None:
    out = io.BytesIO()
    np.savez(out, **{k: np.frombuffer(v, np.uint8) for k, v in arrays.items()})
    write_atomically(uri, [out.getvalue()])


def _load(uri: str) -> dict[str, bytes]:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        z = np.load(io.BytesIO(f.read()))
        return {k: z[k].tobytes() for k in z.files}


class _Page:
    """A page read back: ids, byte lengths, texts, and units by number."""

    def __init__(self, folder: str, number: int, texts: bool = True):
        z = _load(_uri(folder, number))
        self.ids = np.frombuffer(z["ids"], "<i8")
        self.sizes = unpack_ints(z["sizes"]).astype(np.int64)
        self.doc, self.start, self.count, self.lead = (unpack_ints(z[k]).astype(np.int64) for k in ("doc", "start", "count", "lead"))
        self.settled, self.like, self.rep = (unpack_ints(z[k]).astype(np.int64) for k in ("settled", "like", "rep"))
        self.doc = np.cumsum(self.doc)
        self.offsets = np.append(0, np.cumsum(self.sizes))
        self.text = unpack(z["text"]) if texts else b""


def _uri(folder: str, number: int, kind: str = "page") -> str:
    return f"{folder}/{kind}-{number >> 24:06d}-{number & 0xFFFFFF:06d}.npz"


def _pages(folder: str, fragments: int):
    """Documents to the units of their pages by fragment of the anchor's hash."""
    width = np.uint64(-(-(1 << 64) // fragments))

    def close(number: int, ids: list[int], raws: list[bytes]) -> Iterator[pa.RecordBatch]:
        pieces = [(i, lo, part) for i, raw in enumerate(raws) if len(raw) >= WIDTH for lo, part in _cut_long(raw, SLICE_BYTES)]
        cols: dict[str, list] = {k: [] for k in ("doc", "start", "count", "lead", "anchor", "body")}
        lo = 0
        while lo < len(pieces):
            hi, size = lo, 0
            while hi < len(pieces) and (hi == lo or size + len(pieces[hi][2]) <= SLICE_BYTES):
                size += len(pieces[hi][2])
                hi += 1
            part = pieces[lo:hi]
            u = Units([p[2] for p in part])
            base = np.cumsum([0, *(len(p[2]) for p in part)])
            cols["doc"].append(np.array([p[0] for p in part], np.int64)[u.doc])
            cols["start"].append(u.start - base[u.doc] + np.array([p[1] for p in part], np.int64)[u.doc])
            for k in ("count", "lead", "anchor", "body"):
                cols[k].append(getattr(u, k))
            lo = hi
        own = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in cols.items()}
        own["anchor"], own["body"] = own["anchor"].astype(np.uint64), own["body"].astype(np.uint64)
        docs = np.array(ids, "<i8")
        doc = docs[own["doc"]]
        # Of equal units one goes on, of the page's smallest document; equal means equal bytes.
        text = b"".join(raws)
        lo = (np.cumsum([0, *(len(r) for r in raws)]))[own["doc"]] + own["start"]
        hi = lo + own["count"] + WIDTH - 1
        order = np.lexsort((doc, own["body"], own["anchor"]))
        a, b = own["anchor"][order], own["body"][order]
        head = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        first = order[head][np.cumsum(head) - 1] if len(a) else order
        go = head.copy()
        again = np.flatnonzero(~head)
        x, y = order[again], first[again]
        go[again] = [text[p:q] != text[r:s] for p, q, r, s in zip(lo[x].tolist(), hi[x].tolist(), lo[y].tolist(), hi[y].tolist(), strict=True)]
        larger = doc[order] > doc[first]
        settled, like, rep = order[~go & larger], order[~go & ~larger], first[~go & ~larger]
        go = order[go]
        a, d = own["anchor"][go], doc[go]
        _save(_uri(folder, number), ids=docs.tobytes(), sizes=pack_ints(np.array([len(r) for r in raws])), doc=pack_ints(np.diff(own["doc"], prepend=0)), start=pack_ints(own["start"]), count=pack_ints(own["count"]), lead=pack_ints(own["lead"]), settled=pack_ints(np.sort(settled)), like=pack_ints(like), rep=pack_ints(rep), text=pack(text))
        ranked, inverse = np.unique(d, return_inverse=True)
        names = pack_ints(ranked.astype(np.uint64) ^ np.uint64(1 << 63))
        cuts = np.append(np.searchsorted(a, np.arange(fragments, dtype=np.uint64) * width), len(a))
        for f in range(fragments):
            x, y = cuts[f], cuts[f + 1]
            if y > x:
                yield _rows([(number, f, pack_sorted(a[x:y] - np.uint64(f) * width), pack_ints(go[x:y]), _two(names, pack_ints(inverse[x:y])), None)])
        yield _rows([(number, PAGE, None, None, None, None)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids, raws, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                ids.append(LAST if doc is None else doc)
                raws.append(raw)
                held += len(raw)
                if held >= PAGE_BYTES:
                    yield from close(number, ids, raws)
                    number, ids, raws, held = number + 1, [], [], 0
                    trim()
        if ids:
            yield from close(number, ids, raws)
            del ids, raws
            trim()

    return run


def _two(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def _untwo(x: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(x[:8], "little")
    return x[8 : 8 + n], x[8 + n :]


def _wanted(wide: int):
    """A fragment's units from all pages: a: whose bytes are wanted, as another document has the anchor; b: wanted by window."""

    def run(table: pa.Table) -> pa.Table:
        frag = int(table.column("frag")[0].as_py())
        pages = table.column("page").to_pylist()
        if frag < 0:
            return table
        anchor = np.concatenate([unpack_sorted(x) for x in table.column("a").to_pylist()])
        units = [unpack_ints(x) for x in table.column("b").to_pylist()]
        doc = np.concatenate([(unpack_ints(n) ^ np.uint64(1 << 63)).view(np.int64)[unpack_ints(i).astype(np.int64)] for n, i in map(_untwo, table.column("c").to_pylist())])
        trim()
        order = np.argsort(anchor, kind="stable")
        a, d = anchor[order], doc[order]
        del anchor, doc
        starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        sizes = np.diff(np.append(starts, len(a)))
        want = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
        flags = np.zeros(len(order), np.uint8)
        flags[order] = np.repeat(want + (want & (sizes > wide)), sizes)
        rows, at = [], 0
        for page, u in zip(pages, units, strict=True):
            f = flags[at : at + len(u)]
            at += len(u)
            if f.any():
                rows.append((page, frag, *(pack_ints(u[f == k]) for k in (1, 2)), None, None))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted batches, page by page."""
    trim()
    page, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _ROWS.names), strict=True):
            if row[0] != page:
                if page is not None:
                    yield page, held
                page, held = row[0], []
            held.append(row[1:])
    if page is not None:
        yield page, held


def _ask(folder: str, fragments: int):
    """The wanted units' bytes, dealt by anchor; those wanted by window, by share and window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _gather(batches):
            answers = [r for r in rows if r[0] >= 0]
            join = lambda k, answers=answers: np.concatenate([np.zeros(0, np.int64), *(unpack_ints(r[k]).astype(np.int64) for r in answers)])
            want, wide = join(1), join(2)
            page = _Page(folder, number)
            # (unit, first window, windows, anchor's distance) of what is asked.
            own = [np.column_stack((want, np.zeros(len(want), np.int64), page.count[want], page.lead[want]))]
            if len(wide):
                n = page.count[wide]
                skip = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                u = np.repeat(wide, n)
                own.append(np.column_stack((u, skip, np.ones(len(u), np.int64), page.lead[u] - skip)))
            own = np.concatenate(own)
            lo = page.offsets[page.doc[own[:, 0]]] + page.start[own[:, 0]] + own[:, 1]
            texts = [page.text[a : a + n] for a, n in zip(lo.tolist(), (own[:, 2] + WIDTH - 1).tolist(), strict=True)]
            lead = own[:, 3].tolist()
            keys = np.array([xxhash.xxh32_intdigest(t if i >= len(want) else t[p : p + GRAM]) % fragments for i, (t, p) in enumerate(zip(texts, lead, strict=True))], np.int64)
            keys[len(want) :] += fragments * (1 + number * 0x9E3779B1 % SALTS)
            order = np.argsort(keys, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(keys[order], prepend=-1)), len(keys))
            ids = page.ids[page.doc[own[:, 0]]]
            for x, y in zip(cuts, cuts[1:], strict=False):
                yield _rows([(number, int(keys[order[x]]), *_dealt(own, ids, texts, order[x:y]), None, None)])
            yield _rows([(number, PAGE, None, None, None, None)])

    return run


def _dealt(own: np.ndarray, ids: np.ndarray, texts: list[bytes], at: np.ndarray) -> tuple[bytes, bytes]:
    """Pieces of text with (unit, first window, windows, anchor's distance, document) of each."""
    return pack(np.concatenate((own[at].T.ravel(), ids[at])).astype("<i8").tobytes()), pack(b"".join([texts[i] for i in at.tolist()]))


def _met_again(keys: np.ndarray) -> np.ndarray:
    """Which keys are there twice or more."""
    order = np.argsort(keys)
    k = keys[order]
    equal = k[1:] == k[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


def _sorted_windows(fragments: int, at_once: int):
    """As ``_repeats``; a share of wide anchors' windows also hands on what it didn't settle, for the sort over all shares."""

    def run(table: pa.Table) -> pa.Table:
        frag = int(table.column("frag")[0].as_py())
        return table if frag < 0 else _repeats(table, frag % fragments if frag >= fragments else None, at_once)

    return run


def _repeats(table: pa.Table, hand_to: int | None, at_once: int) -> pa.Table:
    """A fragment's pieces of text: their windows that a smaller document has too.

    Pieces of equal bytes are one, with their smallest document. Where an anchor has
    several, their windows are sorted as suffixes; a run of equal ones has a smallest
    document. A piece's window is a repeat if its document is larger than that.
    """
    pages, metas, texts = table.column("page").to_pylist(), [], []
    for m, t in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        metas.append(np.frombuffer(unpack(m), "<i8").reshape(5, -1))
        texts.append(np.frombuffer(unpack(t), np.uint8))
    unit, skip, count, lead, doc = np.concatenate(metas, axis=1)
    page = np.repeat(np.arange(len(pages)), [m.shape[1] for m in metas])
    text = np.concatenate(texts)
    base = np.cumsum(count + WIDTH - 1) - (count + WIDTH - 1)
    flat = text.tobytes()
    number: dict[tuple[bytes, int], int] = {}
    alike = np.fromiter((number.setdefault((flat[x:y], k), len(number)) for x, y, k in zip(base.tolist(), (base + count + WIDTH - 1).tolist(), lead.tolist(), strict=True)), np.int64, len(base))
    del number, metas, texts
    order = np.lexsort((doc, alike))
    first = order[np.flatnonzero(np.diff(alike[order], prepend=-1))]  # the smallest document's piece of each
    start = np.cumsum(count[first]) - count[first]
    limit = np.repeat(doc[first], count[first])  # of each distinct piece's windows
    grams = np.array([xxhash.xxh3_64_intdigest(flat[a : a + GRAM]) for a in (base + lead)[first].tolist()], np.uint64)
    several = np.flatnonzero(_met_again(grams))
    pieces = several[np.argsort(grams[several], kind="stable")]
    total = np.cumsum(count[first[pieces]])
    lo = 0
    while lo < len(pieces):
        # Whole groups of one anchor, some at_once windows at a time.
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + at_once, side="right"))
        hi = max(hi, lo + 1)
        while hi < len(pieces) and grams[pieces[hi]] == grams[pieces[hi - 1]]:
            hi += 1
        own = pieces[lo:hi]
        lo = hi
        n = count[first[own]]
        of = np.repeat(own, n)
        j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        place = lead[first[of]] - j  # the anchor's distance from the window's start
        order = np.lexsort((place, grams[of]))
        of, j, place = of[order], j[order], place[order]
        change = np.concatenate(([True], (grams[of][1:] != grams[of][:-1]) | (place[1:] != place[:-1])))
        group = np.cumsum(change) - 1
        alone = np.bincount(group)[group] == 1
        of, j, group = of[~alone], j[~alone], group[~alone]
        if not len(of):
            continue
        # Only this round's bytes are hashed.
        used = np.unique(of)
        size = count[first[used]] + WIDTH - 1
        at = np.cumsum(size) - size
        take = np.repeat(base[first[used]] - at, size) + np.arange(size.sum())
        suffixes = Suffixes(text[take], WIDTH)
        where = at[np.searchsorted(used, of)] + j
        # A window whose hash no other of its group has can't repeat; the others are sorted.
        twin = _met_again(suffixes.hashes(where) ^ (group.astype(np.uint64) * _BASE))
        of, j, group, where = of[twin], j[twin], group[twin], where[twin]
        if not len(of):
            continue
        order, same = suffixes.sort(where, group)
        runs = np.flatnonzero(~same)
        window = start[of[order]] + j[order]
        limit[window] = np.repeat(np.minimum.reduceat(limit[window], runs), np.diff(np.append(runs, len(window))))
    trim()
    # Pieces whose windows are all repeats, and windows of the others.
    most = np.maximum.reduceat(limit, start)
    least = np.minimum.reduceat(limit, start)
    whole = doc > most[alike]
    part = np.flatnonzero(~whole & (doc > least[alike]))
    n = count[part]
    p = np.repeat(part, n)
    w = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
    hit = doc[p] > limit[start[alike[p]] + w]
    one = np.flatnonzero(whole & (count == 1))
    p, w, whole = np.concatenate((p[hit], one)), np.concatenate((w[hit], np.zeros(len(one), np.int64))), np.flatnonzero(whole & (count > 1))
    order = np.lexsort((w + skip[p], unit[p], page[p]))
    p, w = p[order], w[order]
    cuts, ends = (np.searchsorted(page[x], np.arange(len(pages) + 1)) for x in (p, whole))
    rows = []
    for i, name in enumerate(pages):
        x, y = cuts[i], cuts[i + 1]
        all_of = whole[ends[i] : ends[i + 1]]
        if y > x or len(all_of):
            rows.append((name, HITS, pack_sorted(unit[p[x:y]]), pack_ints(skip[p[x:y]] + w[x:y]), pack_ints(unit[all_of]), None))
    if hand_to is not None:  # pieces of one window each
        left = np.ones(len(page), bool)
        left[p] = False
        own = np.column_stack((unit, skip, count, lead))
        windows = [flat[a : a + WIDTH] for a in base.tolist()]
        for i, name in enumerate(pages):
            at = np.flatnonzero(left & (page == i))
            if len(at):
                rows.append((name, hand_to, *_dealt(own, doc, windows, at), None, None))
    return pa.Table.from_batches([_rows(rows)])


def _followers(page: _Page, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit those of the same document that have its bytes, in a row, and how many."""
    order = np.argsort(page.rep, kind="stable")
    rep = page.rep[order]
    lo, hi = np.searchsorted(rep, units), np.searchsorted(rep, units, side="right")
    n = hi - lo
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return page.like[order][at], n


_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def _finish(folder: str):
    """A page's last answers: spans and remaining bytes of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _gather(batches):
            page = _Page(folder, number)
            hits, none = [r for r in rows if r[0] == HITS], np.zeros(0, np.int64)
            units = np.concatenate((none, *(unpack_sorted(r[1]).astype(np.int64) for r in hits)))
            windows = np.concatenate((none, *(unpack_ints(r[2]).astype(np.int64) for r in hits)))
            more, n = _followers(page, units)
            whole = np.concatenate((none, *(unpack_ints(r[3]).astype(np.int64) for r in hits)))
            whole = np.concatenate((page.settled, whole, _followers(page, whole)[0]))
            u = np.concatenate((whole, units, more))
            doc = page.doc[u]
            start = page.start[u] + np.concatenate((np.zeros(len(whole), np.int64), windows, np.repeat(windows, n)))
            stop = start + WIDTH + np.concatenate((page.count[whole] - 1, np.zeros(len(u) - len(whole), np.int64)))
            order = np.lexsort((start, doc))
            doc, start, stop = doc[order], start[order], stop[order]
            cuts = np.searchsorted(doc, np.arange(len(page.ids) + 1))
            out, held = [], 0
            for i, (name, size) in enumerate(zip(page.ids.tolist(), page.sizes.tolist(), strict=True)):
                a, b = merged(start[cuts[i] : cuts[i + 1]], stop[cuts[i] : cuts[i + 1]])
                raw = page.text[page.offsets[i] : page.offsets[i] + size]
                at, kept, spans = 0, [], []
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    kept.append(raw[at:x])
                    spans.append({"start": x, "stop": y})
                    at = y
                out.append((None if name == LAST else name, size, spans, b"".join([*kept, raw[at:]])))
                held += size
                if held > 2 << 20 or i == len(page.ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
                    out, held = [], 0

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, spans, kept)``: removed byte ranges and the remaining bytes of each document."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    fragments = 2 * fragment_count(docs.select(text_col), spark)  # two fragments a partition: a task works on one at a time
    parts = 2 * scale_parts(spark)
    folder = Workspace(spark, "suffixes").root
    by_fragment = ["frag", F.when(F.col("frag") < 0, F.col("page")).alias("own")]  # rows of a page alone stay apart
    units = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_pages(folder, fragments), _DDL)
    wanted = units.groupBy(*by_fragment).applyInArrow(_wanted(WIDE_ANCHOR), _DDL)
    asked = wanted.repartition(parts, "page").sortWithinPartitions("page", "frag").mapInArrow(_ask(folder, fragments), _DDL)
    found = asked.groupBy(*by_fragment).applyInArrow(_sorted_windows(fragments, SORT_WINDOWS), _DDL)
    found = found.groupBy(*by_fragment).applyInArrow(_sorted_windows(fragments, SORT_WINDOWS), _DDL)
    done = found.repartition(parts, "page").sortWithinPartitions("page", "frag").mapInArrow(_finish(folder), "id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
    return done.withColumnRenamed("id", id_col)


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS p FROM d WHERE octet_length(b) >= 50),
windows AS (SELECT doc_id, p, b[p:p+49] AS x FROM starts),
firsts AS (SELECT x, min(doc_id) AS f FROM windows GROUP BY x HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT doc_id, p FROM windows JOIN firsts USING (x) WHERE doc_id > f),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hits),
islands AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 49 AS z FROM islands GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) + 1 AS a, a - 1 AS z FROM spans
  UNION ALL SELECT doc_id, max(z) + 1, NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN coalesce(g.z, octet_length(b)) >= g.a THEN hex(b[g.a:coalesce(g.z, octet_length(b))]) ELSE '' END, '' ORDER BY g.a) AS h
  FROM gaps g JOIN d USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, sum(z - a + 1) AS n, count(*) AS k FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN removed ON d.doc_id = removed.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: what repeats of 50 bytes leave of every document."""
    found = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.col("n_bytes") - F.length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
