"""Removal of byte strings repeated from earlier documents, by hash-compared suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller id. Sorting every
suffix of a corpus would shuffle a multiple of it, so documents are dealt over parts of bounded size, and suffixes meet in
two rounds of messages between parts:

1. Every window of ``length`` bytes contains an *anchor*, its smallest hashed k-mer. Equal windows have equal anchors, so
   only anchors that occur in several documents matter. Each part sends the hashes of its anchors (a few bytes for every
   16 of text) to the parts that count them, and is answered which of them are repeated, and which very often.
2. Around repeated anchors, the bytes of the windows they stand for (a context of at most 2 * length - k bytes) are dealt
   by anchor. Their suffixes from the anchor on, and backwards from it, are merge-sorted; two suffixes are compared by
   binary search for their common extension over prefix polynomial hashes. The order and the extensions of neighbours are
   verified byte by byte. Runs of neighbours whose extensions cover a window are its occurrences.

Contexts of an anchor that occurs more than ``hot`` times are dealt window by window, by anchor and bytes: equal windows
still meet, while unlike ones spread. What a part holds more than once is resolved within it and sent once, so a string in
a third of all documents reaches a task once per part.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, spans, text_bytes, utf8

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 18
#: Kinds of messages: contexts to compare; windows that go; windows and contexts that fare as an equal one of their document.
ASK, GONE, LIKE_WINDOW, LIKE_CONTEXT = range(4)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    inverse = pow(BASE, -1, 1 << 64)
    up = np.cumprod(np.r_[np.ones(1, U), np.full(n - 1, BASE, U)], dtype=U)
    down = np.cumprod(np.r_[np.ones(1, U), np.full(n - 1, inverse, U)], dtype=U)
    return up, down


_UP, _DOWN = _powers((1 << 20) + 4096)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width]; the last width - 1 places hold f over what is there."""
    out, step = x.copy(), 1
    while 2 * step <= width:
        out[:-step] = f(out[:-step], out[step:])
        step *= 2
    if step < width and width - step < len(out):
        out[: -(width - step)] = f(out[: -(width - step)], out[width - step:])
    return out


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, k: int, wanted=None) -> Iterator[tuple[np.ndarray, ...]]:
    """Blockwise: anchor positions and key hashes; with ``wanted`` (hashes -> booleans), of the wanted ones only, with the
    first window that each stands for and how many.

    Anchors are the smallest k-mers of each window of ``length`` bytes within a document; ties are anchors too.
    """
    n, w = len(buf), length - k + 1
    for s in range(0, n, BLOCK):
        e = min(n, s + BLOCK)
        lo, hi = max(0, s - w + 1), min(n, e + length)
        if hi - lo < length:
            continue
        m = hi - lo
        q = np.zeros(m + 1, U)
        np.cumsum((buf[lo:hi].astype(U) + U(1)) * _UP[:m], out=q[1:])
        h = _mix((q[k:] - q[:-k]) * _DOWN[: m - k + 1]) | U(1)
        a, z = np.searchsorted(offsets, lo, side="right"), np.searchsorted(offsets, hi, side="left")
        edges = np.clip(np.r_[lo, offsets[a: z + 1], hi], lo, hi)
        end = np.repeat(np.r_[offsets[a: z + 1], n], np.diff(edges))[: m - length + 1]
        least = _slide(h, w, np.minimum)[: m - length + 1]
        least[end - np.arange(lo, lo + len(least)) < length] = 0  # no window of one document starts here
        back = np.zeros(len(h), U)
        back[: len(least)] = least
        top = _slide(back[::-1], w, np.maximum)[::-1]
        at = np.flatnonzero(top[s - lo: e - lo] == h[s - lo: e - lo]) + (s - lo)
        if not len(at):
            continue
        if wanted is None:
            yield at + lo, h[at]
            continue
        at = at[wanted(h[at])]
        if not len(at):
            continue
        padded = np.r_[np.zeros(w - 1, U), back]
        own = padded[at[:, None] + np.arange(w)] == h[at][:, None]
        first = own.argmax(1)
        yield at + lo, h[at], at + lo - (w - 1) + first, own.sum(1)


# -- messages


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each split into byte planes: high planes are mostly constant and shrink in the shuffle."""
    parts = []
    for x in arrays.values():
        x = np.ascontiguousarray(x)
        planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T
        parts += [struct.pack("<Q2s", len(x), x.dtype.str[1:].encode()), np.ascontiguousarray(planes).tobytes()]
    return b"".join(parts)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n, kind = struct.unpack_from("<Q2s", blob, at)
        at += 10
        t = np.dtype(kind.decode())
        planes = np.frombuffer(blob, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        at += n * t.itemsize
    return out


def _gather(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    parts = [_unpack(b) for b in blobs]
    return [np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, t in enumerate(kinds)]


def _by(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the places where it stands, in order."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(part[rows[0]]), rows


ROWS = pa.schema([("part", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
SCHEMA = "part int, src int, kind int, blob binary"


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    """Messages: to which part, from which, of which kind."""
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ROWS)], schema=ROWS)


def _split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of a key, in two columns."""
    return (key >> U(16)).astype(np.uint32), (key & U(0xFFFF)).astype(np.uint16)


def _load(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A part's documents in an order that doesn't depend on how they arrived (id, then text), with ids, bytes, offsets.

    Rows are named by their places in it.
    """
    ids = table["doc_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    again = np.flatnonzero(np.diff(ids[order]) == 0)
    if len(again):
        some = np.unique(np.r_[again, again + 1])
        texts = dict(zip(order[some].tolist(), (t or b"" for t in table["text"].take(pa.array(order[some])).cast(pa.binary()).to_pylist())))
        order = np.array(sorted(order.tolist(), key=lambda r: (ids[r], texts.get(r, b""))), np.int64)
    table = table.take(pa.array(order))
    return table, ids[order], *utf8(table["text"])


# -- round 1: which anchors are repeated


def _send_anchors(table: pa.Table, length: int, k: int, parts: int) -> list[tuple[int, int, int, bytes]]:
    """To each part that counts them: the part's distinct anchors, how often they occur and whether in several documents."""
    me = table["part"][0].as_py()
    _, ids, buf, offsets = _load(table)
    found = list(anchors(buf, offsets, length, k))
    if not found:
        return []
    pos, key = (np.concatenate(x) for x in zip(*found))
    key >>= U(16)
    doc = ids[np.searchsorted(offsets, pos, side="right") - 1]
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    several = np.minimum.reduceat(doc[order], start) != np.maximum.reduceat(doc[order], start)
    times = np.minimum(np.diff(np.r_[start, len(key)]), 0x7FFF)
    note = (times << 1 | several).astype(np.uint16)
    key = key[order][start]
    out = []
    for p, rows in _by((key % U(parts)).astype(np.int64)):
        a, b = _split(key[rows])
        out.append((p, me, 0, _pack(a=a, b=b, note=note[rows])))
    return out


def _answer_anchors(table: pa.Table, hot: int) -> list[tuple[int, int, int, bytes]]:
    """To each part: those of its anchors that several documents hold, and whether they occur ``hot`` times or more."""
    me, blobs = table["part"][0].as_py(), table["blob"].to_pylist()
    a, b, note = _gather(blobs, ("u4", "u2", "u2"))
    src = np.repeat(table["src"].to_numpy(), [struct.unpack_from("<Q", x)[0] for x in blobs])
    key = a.astype(U) << U(16) | b
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    many = np.diff(np.r_[start, len(key)])
    several = (many > 1) | (np.maximum.reduceat(note[order] & 1, start) == 1)
    often = np.add.reduceat((note[order] >> 1).astype(np.int64), start) >= hot
    hit = order[np.repeat(several, many)]
    hit_often = np.repeat(often, many)[np.repeat(several, many)]
    out = []
    for p, rows in _by(src[hit]):
        a, b = _split(key[hit[rows]])
        out.append((p, me, 0, _pack(a=a, b=b, hot=hit_often[rows].astype(np.uint8))))
    return out


# -- round 2: which windows are repeated


def _identity(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    h = np.zeros(len(x), U)
    for c in [*x.view(U).T, *(m.astype(U) for m in more)]:
        h = _mix(h * U(BASE) + c)
    return h


def _padded(buf: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int = 1 << 14) -> np.ndarray:
    """Strings of ``buf`` as rows of ``width`` bytes, zeros behind; ``step`` rows at a time, as the places take 8 times as much."""
    out, span = np.zeros((len(start), width), np.uint8), np.arange(width)
    for i in range(0, len(start), step):
        at = start[i: i + step, None] + span
        part = buf[np.minimum(at, max(len(buf) - 1, 0))]
        part[span >= size[i: i + step, None]] = 0
        out[i: i + step] = part
    return out


def _width(length: int, k: int) -> int:
    width = 2 * length - k
    return width + -width % 8


def _merged(x: np.ndarray, size: np.ndarray, off: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows in an order in which equal contexts are neighbours (they are compared byte by byte): those whose equal lies in an
    earlier document of the part; of the others, one of each class of equals, which stands for them elsewhere; and the rest
    (of the same document), with the row that stands for each."""
    new = np.ones(len(x), bool)
    new[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (off[1:] != off[:-1]) | (x[1:] != x[:-1]).any(1)
    cls = np.cumsum(new) - 1
    least = _least(doc, cls)
    mine = np.flatnonzero(doc == least[cls])
    lead = mine[np.r_[True, np.diff(cls[mine]) != 0]] if len(mine) else mine
    rest = np.setdiff1d(mine, lead, assume_unique=True)
    return np.flatnonzero(doc > least[cls]), lead, rest, lead[cls[rest]]


def _join(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)]


def _send_contexts(docs: pa.Table, answers: pa.Table, length: int, k: int, parts: int, block: int = 1 << 14) -> list[tuple[int, int, int, bytes]]:
    if not docs.num_rows or not answers.num_rows:
        return []
    me = docs["part"][0].as_py()
    a, b, hot = _gather(answers["blob"].to_pylist(), ("u4", "u2", "u1"))
    asked = a.astype(U) << U(16) | b
    order = np.argsort(asked)
    asked, hot = asked[order], hot[order].astype(bool)
    _, ids, buf, offsets = _load(docs)

    def hit(h: np.ndarray) -> np.ndarray:
        h = h >> U(16)
        return asked[np.minimum(np.searchsorted(asked, h), len(asked) - 1)] == h

    got = list(anchors(buf, offsets, length, k, hit))
    if not got:
        return []
    pos, key, first, count = (np.concatenate(x) for x in zip(*got))
    row = np.searchsorted(offsets, pos, side="right") - 1
    key >>= U(16)
    often = hot[np.searchsorted(asked, key)]
    off, width, span = pos - first, _width(length, k), np.arange(_width(length, k))
    gone, alike, asks = [], {LIKE_CONTEXT: [], LIKE_WINDOW: []}, []

    def strings(n: int, *columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for i in range(0, n, block):
            yield _padded(buf, *(c[i: i + block] for c in columns[:2]), width), *(c[i: i + block] for c in columns[1:])

    def settle(kind: int, key: np.ndarray, row: np.ndarray, first: np.ndarray, count: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Notes what the part itself decides, and returns the rows that stand for the others elsewhere. Contexts go by blocks in
        the order of their identities: equal ones that a block's end parts are only sent twice."""
        size, leads = count + length - 1, []
        order = np.argsort(np.concatenate([_identity(*x) for x in strings(len(key), first, size, off, key)]), kind="stable")
        for i in range(0, len(order), block):
            r = order[i: i + block]
            later, lead, rest, like = (r[x] for x in _merged(_padded(buf, first[r], size[r], width), size[r], off[r], key[r], ids[row[r]]))
            gone.append((row[later], first[later] - offsets[row[later]], _full(count[later])))
            alike[kind].append((first[rest], first[like], count[rest].astype(np.uint8)))
            leads.append(lead)
        return np.concatenate(leads)

    lead = settle(LIKE_CONTEXT, key, row, first, count, off)
    cold, r = lead[~often[lead]], lead[often[lead]]
    asks.append((key[cold], row[cold], first[cold], count[cold], off[cold]))
    if len(r):  # window by window, each with a key of its anchor and bytes
        t = np.arange(count[r].sum()) - np.repeat(np.cumsum(count[r]) - count[r], count[r])
        r = np.repeat(r, count[r])
        key, row, first, off, count = key[r], row[r], first[r] + t, off[r] - t, np.ones(len(r), np.int64)
        key = np.concatenate([_identity(x, k) for x, _, k in strings(len(r), first, np.full(len(r), length), key)]) >> U(16)
        lead = settle(LIKE_WINDOW, key, row, first, count, off)
        asks.append((key[lead], row[lead], first[lead], count[lead], off[lead]))
    key, row, first, count, off = _join(asks)
    n = np.argsort(key, kind="stable")  # neighbours' keys have their high bytes in common, which shrinks them
    key, row, first, count, off = key[n], row[n], first[n], count[n], off[n]
    size, out = count + length - 1, []
    for p, r in _by((key % U(parts)).astype(np.int64)):
        a, b = _split(key[r])
        body = np.concatenate([x[span < n[:, None]] for x, n in strings(len(r), first[r], size[r])])
        begin = (first[r] - offsets[row[r]]).astype(np.uint32)
        out.append((p, me, ASK, _pack(a=a, b=b, doc=ids[row[r]], row=row[r].astype(np.uint32), begin=begin, size=size[r].astype(np.uint16), off=off[r].astype(np.uint8), body=body)))
    out.append((me, me, GONE, _masks(*_join(gone))))
    for kind, found in alike.items():
        if found and len((x := _join(found))[0]):
            out.append((me, me, kind, _pack(at=x[0], like=x[1], count=x[2])))
    return out


def _least(doc: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(doc, np.flatnonzero(np.r_[True, np.diff(cls) != 0])) if len(doc) else doc


def _full(count: np.ndarray) -> np.ndarray:
    return ((np.int64(1) << count.astype(np.int64)) - 1).astype(np.uint64)


def _masks(row: np.ndarray, begin: np.ndarray, mask: np.ndarray) -> bytes:
    return _pack(row=row.astype(np.uint32), begin=begin.astype(np.uint32), mask=mask.astype(np.uint64))


def merge_sort(x: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts byte strings (rows of ``x``, ``size`` bytes each) within sorted groups: the order, and each one's common
    extension with the one before it (0 at a group's start).

    Strings are compared by binary search for their common extension over prefix polynomial hashes, a logarithmic number
    of comparisons; all groups' runs are merged bottom-up at once. The extensions and the order of neighbours are then
    verified byte by byte; should a hash have collided, the strings are sorted by their bytes instead.
    """
    n, width = x.shape
    q = np.zeros((n, width + 1), U)
    np.cumsum((x.astype(U) + U(1)) * _UP[:width], axis=1, out=q[:, 1:])
    q = q.ravel()
    size = size.astype(np.int64)

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        top = np.minimum(size[i], size[j])
        a, b = i * (width + 1), j * (width + 1)
        low, high = np.zeros(len(i), np.int64), top.copy()
        for _ in range(int(width).bit_length()):
            mid = (low + high + 1) >> 1
            same = q[a + mid] == q[b + mid]
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    flat = x.ravel()

    def less(i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        c = common(i, j)
        done_i, done_j = c == size[i], c == size[j]
        d = np.minimum(c, width - 1)
        by_byte = flat[i * width + d] < flat[j * width + d]
        return np.where(done_i & done_j, or_equal, np.where(done_i, True, np.where(done_j, False, by_byte)))

    order = np.arange(n)
    start = np.flatnonzero(np.r_[True, np.diff(group) != 0]) if n else order
    many_ = np.diff(np.r_[start, n])
    base, many = np.repeat(start, many_), np.repeat(many_, many_)
    place = np.arange(n) - base
    run = 1
    while n and run < many_.max():
        todo = np.flatnonzero(many > run)
        p, b, s = place[todo], base[todo], many[todo]
        left = p // run % 2 == 0
        other = np.where(left, (p // run + 1) * run, (p // run - 1) * run)
        low, high = np.zeros(len(todo), np.int64), np.clip(s - other, 0, run)
        mine = order[todo]
        for _ in range(run.bit_length()):
            open_ = low < high
            mid = (low + high) >> 1
            theirs = order[np.minimum(b + other + mid, n - 1)]
            # a left element comes before its equals of the right run
            before = less(theirs, mine, ~left) & open_
            low = np.where(before, mid + 1, low)
            high = np.where(open_ & ~before, mid, high)
        order[b + np.where(left, p, p - run) + low] = mine
        run *= 2
    hashed = np.zeros(n, np.int64)
    hashed[1:] = np.where(group[1:] == group[:-1], common(order[:-1], order[1:]), 0)
    exact = _extension(x, size, group, order)
    if (hashed != exact).any() or not _in_order(x, size, group, order, exact):
        order = np.lexsort((size, *x.T[::-1], group))
        exact = _extension(x, size, group, order)
    return order, exact


def _in_order(x: np.ndarray, size: np.ndarray, group: np.ndarray, order: np.ndarray, common: np.ndarray) -> bool:
    """Whether neighbours of a group, ``common`` bytes of which are equal, stand in ascending order."""
    i, j, c = order[:-1], order[1:], common[1:]
    at = np.minimum(c, x.shape[1] - 1)
    less = np.where(c == size[i], True, np.where(c == size[j], False, x[i, at] < x[j, at]))
    return bool((less | (group[i] != group[j])).all())


def _extension(x: np.ndarray, size: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), np.int64)
    if len(order) > 1:
        i, j = order[:-1], order[1:]
        top = np.minimum(size[i], size[j])
        differ = (x[i] != x[j]) | (np.arange(x.shape[1]) >= top[:, None])
        found = np.where(differ.any(1), differ.argmax(1), x.shape[1])
        out[1:] = np.where(group[i] == group[j], found, 0)
    return out


def repeated_windows(x: np.ndarray, off: np.ndarray, count: np.ndarray, doc: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Bit masks of the rows' windows (bit t: the window at place t) that also occur in a row of a smaller ``doc``.

    Rows are contexts, in the order of their keys. A window is its bytes from the anchor on and those before it.
    Both parts are suffix-sorted, the latter backwards; at each distance of the anchor from a window's start, windows are
    equal if no common extension between them falls short on either side.
    """
    n = len(x)
    off, size = off.astype(np.int64), (count + length - 1).astype(np.int64)
    kid = np.r_[0, np.cumsum(key[1:] != key[:-1])]
    width = int((size - off).max())
    span = np.arange(width)
    right = np.where(span < (size - off)[:, None], x[np.arange(n)[:, None], np.minimum(off[:, None] + span, x.shape[1] - 1)], 0).astype(np.uint8)
    deep = max(int(off.max()), 1)
    span = np.arange(deep)
    left = np.where(span < off[:, None], x[np.arange(n)[:, None], np.maximum(off[:, None] - 1 - span, 0)], 0).astype(np.uint8)
    ro, rx = merge_sort(right, size - off, kid)
    lo, lx = merge_sort(left, off, kid)
    rnew, lnew = (np.r_[True, kid[o][1:] != kid[o][:-1]] for o in (ro, lo))
    mask = np.zeros(n, np.uint64)
    rid, lid = np.empty(n, np.int64), np.empty(n, np.int64)
    for rel in range(int(off.max()) + 1):
        has = np.flatnonzero((off >= rel) & (off - rel < count))
        if not len(has):
            continue
        rid[ro] = np.cumsum(rnew | (rx < length - rel))
        lid[lo] = np.cumsum(lnew | (lx < rel))
        both = rid[has] * (n + 1) + lid[has]
        o = np.argsort(both, kind="stable")
        cls = np.cumsum(np.r_[True, np.diff(both[o]) != 0]) - 1
        d = doc[has[o]]
        gone = has[o[d > _least(d, cls)[cls]]]
        mask[gone] |= U(1) << (off[gone] - rel).astype(U)
    return mask


def _answer_contexts(table: pa.Table, length: int, k: int, block: int = 1 << 15) -> list[tuple[int, int, int, bytes]]:
    """To each part: its rows' windows that also occur in an earlier document. Keys are sorted in blocks of whole keys."""
    me, kinds = table["part"][0].as_py(), table["kind"].to_numpy()
    blobs, src = table["blob"].to_pylist(), table["src"].to_numpy()
    out = [(me, me, int(kind), b) for b, kind in zip(blobs, kinds) if kind != ASK]
    mine = np.flatnonzero(kinds == ASK)
    if not len(mine):
        return out
    blobs = [blobs[i] for i in mine]
    a, b, doc, row, begin, size, off, body = _gather(blobs, ("u4", "u2", "i8", "u4", "u4", "u2", "u1", "u1"))
    src = np.repeat(src[mine], [struct.unpack_from("<Q", x)[0] for x in blobs])
    key = a.astype(U) << U(16) | b
    size = size.astype(np.int64)
    at = np.cumsum(size) - size
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    many = np.diff(np.r_[start, len(key)])
    several = np.minimum.reduceat(doc[order], start) != np.maximum.reduceat(doc[order], start)
    order = order[np.repeat(several, many)]
    ends = np.cumsum(many[several])
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + block, side="right")))
        r = order[ends[i - 1] if i else 0: ends[j - 1]]
        x = _padded(body, at[r], size[r], _width(length, k))
        mask = repeated_windows(x, off[r], size[r] - length + 1, doc[r], key[r], length)
        r, mask = r[mask != 0], mask[mask != 0]
        for p, n in _by(src[r]):
            out.append((p, me, GONE, _masks(row[r[n]], begin[r[n]], mask[n])))
        i = j
    return out


# -- what is left of the documents


def _finish(docs: pa.Table, answers: pa.Table | None, length: int, texts: bool) -> list[pa.Array]:
    if answers is None:
        buf, offsets = utf8(docs["text"])
    else:
        docs, _, buf, offsets = _load(docs)
    n = len(offsets) - 1
    removed, runs, shas, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
    hit = _starts(answers, offsets) if answers is not None and answers.num_rows else None
    for i, j in spans(offsets, BLOCK):
        at = np.flatnonzero(hit[offsets[i]: offsets[j]]) + offsets[i] if hit is not None else np.zeros(0, np.int64)
        doc = np.searchsorted(offsets, at, side="right") - 1
        # a run goes on with a window that starts within it or where it ends
        first = np.flatnonzero(np.r_[True, (np.diff(at) > length) | (np.diff(doc) != 0)]) if len(at) else at
        last = np.r_[first[1:], len(at)][: len(first)] - 1
        start, end, doc = at[first], at[last] + length, doc[first]
        removed[i:j] = np.bincount(doc - i, end - start, j - i).astype(np.int64)
        runs[i:j] = np.bincount(doc - i, minlength=j - i)
        ends = np.searchsorted(doc, np.arange(i, j), side="right").tolist()
        start, end, r = start.tolist(), end.tolist(), 0
        for d in range(i, j):
            sha, left, a = hashlib.sha256(), [], int(offsets[d])
            for r in range(r, ends[d - i]):
                left.append(buf[a: start[r]])
                a = end[r]
            r = ends[d - i]
            left.append(buf[a: offsets[d + 1]])
            for x in left:
                sha.update(x)
            shas.append(sha.hexdigest())
            if texts:
                kept.append(b"".join(x.tobytes() for x in left).decode("utf-8", "replace"))
    cols = [docs["doc_id"], pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs), pa.array(shas, pa.string())]
    return cols + ([pa.array(kept, pa.string())] if texts else [])


def _starts(answers: pa.Table, offsets: np.ndarray) -> np.ndarray:
    """By byte of the part's texts: whether a window that goes starts there."""
    kinds, blobs = answers["kind"].to_numpy(), answers["blob"].to_pylist()
    of = lambda kind: [x for x, y in zip(blobs, kinds) if y == kind]
    hit = np.zeros(int(offsets[-1]) + 64, bool)
    for blob in of(GONE):
        row, begin, mask = _unpack(blob)
        at = offsets[row] + begin
        for t in range(64):
            hit[at[(mask >> U(t) & U(1)).astype(bool)] + t] = True
    for kind in (LIKE_WINDOW, LIKE_CONTEXT):  # a context's windows may themselves be like others
        at, like, count = _gather(of(kind), ("i8", "i8", "u1"))
        for t in range(int(count.max(initial=0))):
            on = (count > t) & hit[like + t]
            hit[at[on] + t] = True
    return hit


def remove_repeats(docs: DataFrame, length: int = 50, k: int = 20, texts: bool = False, part_bytes: int = 16 << 20, hot: int = 1 << 14) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept_text.

    Null and empty texts have no bytes. Rows of a null doc_id have no earlier document: they lose nothing and cause no
    removal. Rows that repeat an id are one document's for the comparison (neither removes the other's bytes), and each
    gets its result. ``kept_text`` shows characters cut in two as replacement characters. Every string is judged on the
    input. Extra columns play no part; an empty table gives no rows.

    There are as many parts as shuffle partitions, or more, so that one holds about ``part_bytes`` of text; a task holds
    one part at a time. ``hot`` only bounds what one anchor brings into a task; results don't depend on either.
    """
    if not 1 <= k <= length or length - k + 1 > 64:
        raise ValueError("1 <= k <= length, and length - k < 64")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = slim.where("doc_id IS NOT NULL")
    parts = max(partitions(docs.sparkSession), -(-text_bytes(known) // part_bytes))
    dealt = lambda df: df.repartitionById(parts, "part").groupBy("part")
    # with the text, so that rows of one frequent id spread as well
    placed = known.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept_text"] if texts else [])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if texts else "")

    first = dealt(placed).applyInArrow(lambda d: _table(_send_anchors(d, length, k, parts)), SCHEMA)
    repeated = dealt(first).applyInArrow(lambda t: _table(_answer_anchors(t, hot)), SCHEMA)
    second = dealt(placed).cogroup(dealt(repeated)).applyInArrow(lambda d, a: _table(_send_contexts(d, a, length, k, parts)), SCHEMA)
    masks = dealt(second).applyInArrow(lambda t: _table(_answer_contexts(t, length, k)), SCHEMA)
    out = dealt(placed).cogroup(dealt(masks)).applyInArrow(lambda d, a: pa.Table.from_arrays(_finish(d, a, length, texts), names), schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from pa.Table.from_arrays(_finish(pa.table(b), None, length, texts), names).to_batches()

    return out.unionByName(slim.where("doc_id IS NULL").mapInArrow(whole, schema))
