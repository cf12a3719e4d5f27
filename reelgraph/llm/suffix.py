"""Removal of passages that repeat across documents, by a sparse suffix array.

A byte goes if a string of LENGTH bytes over it also starts in a document of a smaller doc_id. Only
suffixes at anchors are kept: the leftmost least GRAM hash in each string, so every string of LENGTH
bytes has one anchor that its text alone decides, and an anchor stands for a run of strings: those
that start NEAR to FAR bytes before it. The steps:

1. The texts are copied to block files in the shared folder; exact copies of an earlier text go at once.
2. Each block sends its anchors' hashes, dealt by hash, and gets back those that two texts have.
   Strings whose anchor no other text has are done.
3. Each block sends the windows around the other anchors (the suffix, and what stands before it, as
   far as its strings reach), every distinct window once with its least doc_id. So a passage that a
   block's documents share is one row of the block, however many have it.
4. The windows are range-partitioned by their suffixes with sampled splitters, sorted within each
   range by multikey quicksort, and neighbours are compared byte by byte: the lengths of their common
   prefixes, of the suffix and of what stands before it, tell which strings are the same. Ranges may
   be cut inside a run of equal suffixes; so strings whose run reaches an end of the range are
   compared once more across ranges, by their least doc_id in each.
5. Each block cuts what was found out of its texts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BASE_INVERSE, as_local, drop_dir, mix, on_workers, powers, prefix_hash, released, shared_dir, stored

LENGTH, GRAM = 50, 24
#: Windows of a range, documents of a block, bytes of text looked at at once, and parts of a group of exact copies.
RANGE_ROWS, BLOCK_ROWS, STRETCH, SALT = 60_000, 4000, 1 << 19, 16
#: Rows in which a block sends its keys, and blocks whose rows are split together.
ROWS_OF_BLOCK, SOME_BLOCKS = 64, 32


def sliding(h: np.ndarray, w: int, take) -> np.ndarray:
    """take (minimum or maximum) over every window of w values."""
    size, out = 1, h
    while 2 * size <= w:
        out = take(out[:-size], out[size:])
        size *= 2
    return take(out[: len(h) - w + 1], out[w - size : w - size + len(h) - w + 1])


def anchors(buf: np.ndarray, ok: np.ndarray, length: int, gram: int):
    """(hash, place, first and last start) of the anchors of a stretch of texts.

    ok: for every place where length bytes fit into buf, whether a string starts there; those that
    an anchor stands for follow each other.
    """
    q = np.flatnonzero(ok)
    if not len(q):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    # Grams are ordered by the upper half of their hash; all of it is only made for anchors.
    p, n = prefix_hash(buf), len(buf) - gram + 1
    raw = (p[gram:] - p[:n]) * powers(BASE_INVERSE, n)
    h = (raw >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    w = length - gram + 1
    least = np.where(ok, sliding(h, w, np.minimum), np.uint32(0))
    edge = np.zeros(w - 1, np.uint32)
    mark = sliding(np.concatenate((edge, least, edge)), w, np.maximum) == h
    place = np.flatnonzero(mark)
    a = (np.cumsum(mark) - mark)[q]
    while len(wrong := np.flatnonzero(h[place[a]] != least[q])):
        a[wrong] += 1
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (q[1:] != q[:-1] + 1))))
    p = place[a[new]]
    return mix(raw[p]) | np.uint64(1), p, q[new], q[np.append(new[1:], len(q)) - 1]


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows by their words (8 bytes each, most significant first): rows are split by one word,
    and only those that tie go on to the next."""
    order = np.argsort(words[:, 0], kind="stable")
    group = np.zeros(len(order), np.int64)
    for d in range(words.shape[1]):
        w = words[order, d]
        if d:
            tied = np.zeros(len(order), bool)
            same = group[1:] == group[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            if not tied.any():
                break
            at = np.flatnonzero(tied)
            order[at] = order[at[np.lexsort((w[at], group[at]))]]
            w = words[order, d]
        new = np.ones(len(order), np.int64)
        new[1:] = (w[1:] != w[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
    return order


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """For sorted rows of bytes: how many leading bytes each shares with the one before it; -1 for the first."""
    differ = rows[1:] != rows[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate(([-1], n))


def as_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, filled up with zeros."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


class Blocks:
    """The block files: where they lie, and their rows in pieces. A block's number is that of its file."""

    def __init__(self, path: str, example: str):
        name = example.rsplit("/", 1)[-1]
        self.path, self.shape = path, re.sub(r"-c\d+(?=\.)", "-c{c:03d}", re.sub(r"^part-\d+", "part-{p:05d}", name.replace("{", "").replace("}", "")))

    def file(self, block: int) -> str:
        return f"{self.path}/{self.shape.format(p=block // 1_000_000, c=block % 1_000_000)}"

    @staticmethod
    def number():
        """Column: the number of the block that a row is in."""
        part = lambda shape: F.regexp_extract("_metadata.file_name", shape, 1).cast("long")
        return part(r"^part-(\d+)") * 1_000_000 + part(r"-c(\d+)\.")

    def pieces(self, block: int, carry: list[str], gone, rows: int = 500):
        """(first row, record batch, doc_ids, offsets, bytes, ends) of a block: ends is 0 for texts that are left out."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, at = as_local(self.file(block))
        first, gone = 0, np.asarray(gone, np.int64)
        with fs.open_input_file(at) as f:
            for b in pq.ParquetFile(f).iter_batches(rows, columns=["doc_id", "text", *carry]):
                text = b.column(1).cast(pa.binary())
                _, off, data = text.buffers()
                off = np.frombuffer(off, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
                buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
                off = off - off[0]
                ends = off[1:].copy()
                ends[gone[(gone >= first) & (gone < first + len(text))] - first] = 0
                ids = b.column(0)
                if ids.null_count:
                    ends[ids.is_null().to_numpy(zero_copy_only=False)] = 0
                yield first, b, ids.fill_null(0).to_numpy(), off, buf, ends
                first += len(text)


def stretches(off: np.ndarray, buf: np.ndarray, ends: np.ndarray, length: int):
    """(start, bytes, ok) of pieces of a batch's text, however long its documents are."""
    for s in range(0, len(buf) - length + 1, STRETCH):
        e = min(s + STRETCH, len(buf) - length + 1)
        lo, hi = np.searchsorted(off, (s, e - 1), side="right") - 1
        to = np.repeat(ends[lo : hi + 1], np.diff(np.clip(off[lo : hi + 2], s, e)))
        yield s, buf[s : e + length - 1], np.arange(s, e) + length <= to


def gram_key(h: np.ndarray, ranges: int) -> np.ndarray:
    """range << 32 | 32 bits."""
    g = mix(h ^ np.uint64(0x5DEECE66D))
    return (g >> np.uint64(33)) % np.uint64(ranges) << np.uint64(32) | g & np.uint64(0xFFFFFFFF)


def _find(blocks: Blocks, ranges: int, length: int, gram: int, parts: int = 1):
    """Rows (range, block, keys, several, part) of each block's anchors; several: whether more than one text has the key.

    A row is for parts ranges that follow each other; part tells, for each key, which of them. So a block has
    ranges / parts rows at most.
    """

    @released
    def run(batches):
        for pdf in batches:
            for block, gone in zip(pdf["block"], pdf["gone"], strict=True):
                keys, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                for first, _, _, off, buf, ends in blocks.pieces(block, [], gone):
                    for s, part, ok in stretches(off, buf, ends, length):
                        h, p, _, _ = anchors(part, ok, length, gram)
                        keys.append(gram_key(h, ranges))
                        rows.append(np.searchsorted(off, p + s, side="right") - 1 + first)
                key, row = np.concatenate(keys), np.concatenate(rows)
                by = np.argsort(key, kind="stable")
                key, row = key[by], row[by]
                new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
                several = row[new] != row[np.append(new[1:], len(key)) - 1]
                key = key[new]
                fine = (key >> np.uint64(32)).astype(np.int64)
                of, within = fine // parts, (fine % parts).astype("<u4")
                cut = np.append(np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))), len(of)) if len(of) else np.zeros(1, np.int64)
                low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
                for i in range(0, len(cut) - 1, 256):
                    part = [(int(of[a]), block, low[a:z].tobytes(), several[a:z].tobytes(), within[a:z].tobytes() if parts > 1 else None) for a, z in zip(cut[i : i + 256].tolist(), cut[i + 1 : i + 257].tolist(), strict=False)]
                    yield pd.DataFrame(part, columns=["range", "block", "keys", "several", "part"])

    return run


KEYS = "range int, block long, keys binary, several binary, of binary"


def _split(parts: int):
    """The keys of some blocks for parts ranges, one row (KEYS) for each range, with each key's block (of)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
        keys, several, within = join("keys", "<u4"), join("several", bool), join("part", "<u4")
        block = np.repeat(pdf["block"].to_numpy(), [len(k) // 4 for k in pdf["keys"]])
        by = np.argsort(within, kind="stable")
        keys, several, within, block = keys[by], several[by], within[by], block[by]
        cut = [*np.flatnonzero(np.diff(within.astype(np.int64), prepend=-1)).tolist(), len(within)]
        first = int(pdf["range"].iloc[0]) * parts
        out = [(first + int(within[a]), -1, keys[a:z].tobytes(), several[a:z].tobytes(), block[a:z].astype("<i8").tobytes()) for a, z in zip(cut, cut[1:], strict=False)]
        return pd.DataFrame(out, columns=["range", "block", "keys", "several", "of"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block of a range: its keys that several texts have. Rows are of one block, or of several (of)."""
    keys = np.frombuffer(b"".join(pdf["keys"]), "<u4")
    block = np.concatenate([np.full(len(k) // 4, b) if o is None else np.frombuffer(o, "<i8") for k, b, o in zip(pdf["keys"], pdf["block"], pdf["of"], strict=True)])
    value, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    shared = n > 1
    shared[back[np.frombuffer(b"".join(pdf["several"]), bool)]] = True
    met = np.flatnonzero(shared[back])
    met = met[np.argsort(block[met], kind="stable")]
    cut = [*np.flatnonzero(np.diff(block[met], prepend=-1)).tolist(), len(met)]
    range_ = pdf["range"].iloc[0]
    out = [(block[met[a]], range_, keys[met[a:z]].tobytes(), None) for a, z in zip(cut, cut[1:], strict=False)]
    return pd.DataFrame(out, columns=["block", "range", "keys", "gone"])


WINDOWS = "block long, wid int, window binary, near int, far int, doc long, pack binary"


def _flat(rows: np.ndarray):
    """An Arrow array of binary values of one size."""
    import pyarrow as pa

    off = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(rows))])


def same_windows(wide: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows in groups of equal windows, by doc in each, and where groups start."""
    words = wide.view(np.uint64)
    h = np.zeros(len(wide), np.uint64)
    for c in words.T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    order = np.argsort(doc, kind="stable")
    order = order[np.argsort(h[order], kind="stable")]
    starts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    leader = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    if (words[order] != words[leader]).any():  # two windows of one hash
        order = np.lexsort((doc, *words.T))
        starts = np.flatnonzero(np.concatenate(([True], (words[order][1:] != words[order][:-1]).any(axis=1))))
    return order, starts


def _windows(blocks: Blocks, ranges: int, length: int, gram: int):
    """A block's distinct windows around the anchors that other texts have too, and where they stand."""
    reach = length - gram

    def run(key, batches):
        import pyarrow as pa

        block, shared, gone = key[0].as_py(), [], []
        for b in batches:
            for r, k, g in zip(b.column("range").to_pylist(), b.column("keys").to_pylist(), b.column("gone").to_pylist(), strict=True):
                gone += g or []
                if k:
                    shared.append(np.frombuffer(k, "<u4").astype(np.uint64) | np.uint64(r) << np.uint64(32))
        if not shared:
            return
        shared = np.sort(np.concatenate(shared))
        wide, docs, rows, places = [], [], [], []
        for first, _, ids, off, buf, ends in blocks.pieces(block, [], gone):
            padded = np.concatenate((np.zeros(reach, np.uint8), buf, np.zeros(length, np.uint8)))
            view = np.lib.stride_tricks.sliding_window_view(padded, reach + length)
            for s, part, ok in stretches(off, buf, ends, length):
                h, p, lo, hi = anchors(part, ok, length, gram)
                k = gram_key(h, ranges)
                met = shared[np.minimum(np.searchsorted(shared, k), len(shared) - 1)] == k
                if not met.any():
                    continue
                p, near, far = p[met] + s, (p - hi)[met], (p - lo)[met]
                got = view[p]
                out = np.zeros((len(p), -(-(reach + length + 2) // 8) * 8), np.uint8)
                out[:, :length] = got[:, reach:] * (np.arange(length) < (length - near)[:, None])
                out[:, length : length + reach] = got[:, reach - 1 :: -1][:, :reach] * (np.arange(reach) < far[:, None])
                out[:, length + reach], out[:, length + reach + 1] = near, far
                row = np.searchsorted(off, p, side="right") - 1
                wide.append(out)
                docs.append(ids[row])
                rows.append(row + first)
                places.append(p - off[row])
        if not wide:
            return
        wide, doc, row, place = map(np.concatenate, (wide, docs, rows, places))
        order, starts = same_windows(wide, doc)
        size = np.diff(np.append(starts, len(order)))
        doc = doc[order]
        least = doc[starts]
        mine = np.add.reduceat((doc == np.repeat(least, size)).astype(np.int64), starts)
        wide = wide[order[starts]]
        near, far = wide[:, length + reach].astype(np.int32), wide[:, length + reach + 1].astype(np.int32)
        pack = np.int64(len(starts)).tobytes() + b"".join(x.astype("<u4").tobytes() for x in (near, far, size, mine, row[order], place[order]))
        names = ["block", "wid", "window", "near", "far", "doc", "pack"]
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), pa.array([None], pa.binary()), *(pa.array([None], x) for x in (pa.int32(), pa.int32(), pa.int64())), pa.array([pack], pa.binary())], names)
        for i in range(0, len(starts), 20_000):
            n = len(starts[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(i, i + n, dtype=np.int32)), _flat(wide[i : i + n, : length + reach]), pa.array(near[i : i + n]), pa.array(far[i : i + n]), pa.array(least[i : i + n]), pa.nulls(n, pa.binary())], names)

    return run


FOUND = "block long, wid int, found long, string binary, doc long"


def compare(window: np.ndarray, near: np.ndarray, far: np.ndarray, doc: np.ndarray, length: int):
    """(found, edge): for each window the strings that a smaller doc has, as bits; and, as (row, bit), the strings of
    the least doc whose run of equal suffixes reaches an end of the range."""
    suffix, before = window[:, :length], window[:, length:]
    by = multikey_order(as_words(suffix))
    at = np.empty(len(by), np.int64)
    at[by] = np.arange(len(by))
    prefix = common_prefix(suffix[by])
    back = multikey_order(as_words(before))
    there = np.empty(len(back), np.int64)
    there[back] = np.arange(len(back))
    left = common_prefix(before[back])
    rise = np.argsort(doc, kind="stable")
    found, rows, bits = np.zeros(len(doc), np.int64), [], []
    for o in range(before.shape[1] + 1):
        own = rise[(near[rise] <= o) & (o <= far[rise])]
        if not len(own):
            continue
        run = np.cumsum(prefix < length - o)
        of = run[at[own]]
        pair = of * (len(by) + 1) + np.cumsum(left < o)[there[own]]
        order = np.argsort(pair, kind="stable")
        first = np.concatenate(([True], pair[order][1:] != pair[order][:-1]))
        least = np.empty(len(own), np.int64)
        least[order] = doc[own][order][np.flatnonzero(first)[np.cumsum(first) - 1]]
        later = doc[own] > least
        found[own[later]] |= np.int64(1) << o
        outer = ~later & ((of == run[0]) | (of == run[-1]))
        rows.append(own[outer])
        bits.append(np.full(int(outer.sum()), o))
    empty = [np.empty(0, np.int64)]
    return found, np.concatenate(rows or empty), np.concatenate(bits or empty)


def _compare(length: int):
    @released
    def run(batches):
        import pyarrow as pa

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        del got
        column = lambda n: t.column(n).chunk(0).to_numpy(zero_copy_only=False)
        block, wid, near, far, doc = (column(n) for n in ("block", "wid", "near", "far", "doc"))
        raw = t.column("window").chunk(0)
        off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        window = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(len(raw), -1)
        found, row, bit = compare(window, near, far, doc, length)
        names = ["block", "wid", "found", "string", "doc"]
        some = np.flatnonzero(found)
        for i in range(0, len(some), 20_000):
            x = some[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(block[x]), pa.array(wid[x]), pa.array(found[x]), pa.nulls(len(x), pa.binary()), pa.array(doc[x])], names)
        for i in range(0, len(row), 20_000):
            x, o = row[i : i + 20_000], bit[i : i + 20_000]
            string = np.empty((len(x), length), np.uint8)
            for k in np.unique(o).tolist():
                w = window[x[o == k]]
                string[o == k] = np.concatenate((w[:, length : length + k][:, ::-1], w[:, : length - k]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(block[x]), pa.array(wid[x]), pa.array(np.int64(1) << o), _flat(string), pa.array(doc[x])], names)

    return run


def _cut(blocks: Blocks, carry: list[str], schema: T.StructType, length: int, gram: int):
    def run(key, batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType, timestamp_utc=True) for f in schema]
        names = [f.name for f in schema]
        block, gone, packs, wids, bits = key[0].as_py(), [], [], [], []
        for b in batches:
            for g, p in zip(b.column("gone").to_pylist(), b.column("pack").to_pylist(), strict=True):
                gone += g or []
                packs += [p] if p else []
            wid = b.column("wid").fill_null(-1).to_numpy()
            wids.append(wid[wid >= 0])
            bits.append(b.column("found").fill_null(0).to_numpy()[wid >= 0])
        row = place = mask = np.empty(0, np.int64)
        for p in packs:  # one, if any
            n = int(np.frombuffer(p[:8], np.int64)[0])
            x = np.frombuffer(p[8:], "<u4").astype(np.int64)
            near, far, size, mine = x[: 4 * n].reshape(4, n)
            row, place = x[4 * n :].reshape(2, -1)
            found = np.zeros(n, np.int64)
            np.bitwise_or.at(found, np.concatenate(wids), np.concatenate(bits))
            every = (np.int64(2) << far) - (np.int64(1) << near)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            # Those of the window's least doc_id in the block have what was found; the others repeat that document.
            mask = np.where(nth < np.repeat(mine, size), np.repeat(found, size), np.repeat(every, size))
            by = np.flatnonzero(mask)
            by = by[np.argsort(row[by], kind="stable")]
            row, place, mask = row[by], place[by], mask[by]
        for first, b, _, off, buf, _ in blocks.pieces(block, carry, gone):
            n = b.num_rows
            lo, hi = np.searchsorted(row, (first, first + n))
            cover = np.zeros(len(buf), bool)
            if hi > lo:
                i, o = np.nonzero(mask[lo:hi, None] >> np.arange(length - gram + 1) & 1)
                start = np.zeros(len(buf) + length, np.int32)
                start[off[row[lo:hi][i] - first] + place[lo:hi][i] - o + length] = 1
                total = np.cumsum(start)
                cover = total[length:] > total[:-length]
            for g in gone:
                if first <= g < first + n and off[g - first + 1] - off[g - first] >= length:
                    cover[off[g - first] : off[g - first + 1]] = True
            removed = np.concatenate(([0], np.cumsum(cover)))
            lost = np.diff(removed[off])
            kept, to = buf[~cover].tobytes(), off - removed[off]
            spans: list[list] = [[] for _ in range(n)]
            texts = b.column(1)
            if lost.any():
                head, tail = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
                head[off[:-1]], tail[off[1:]] = True, True
                a = np.flatnonzero(cover & (head[:-1] | ~np.concatenate(([False], cover[:-1]))))
                z = np.flatnonzero(cover & (tail[1:] | ~np.concatenate((cover[1:], [False])))) + 1
                of = np.searchsorted(off, a, side="right") - 1
                for r, s, e in zip(of.tolist(), (a - off[of]).tolist(), (z - off[of]).tolist(), strict=True):
                    spans[r].append([s, e])
                plain = texts.cast(pa.binary()).to_pylist()
                texts = pa.array([(plain[r] or b"") if not x else kept[to[r] : to[r + 1]].decode("utf-8", "ignore").encode() for r, x in enumerate(lost.tolist())], pa.binary()).cast(pa.string())
            elif texts.null_count:
                texts = texts.fill_null("")
            digest = [hashlib.sha256(kept[s:e]).hexdigest() for s, e in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
            columns = [b.column(0), pa.array(np.diff(off)), pa.array(lost.astype(np.int64)), pa.array([len(x) for x in spans], pa.int64()), pa.array(digest), pa.array(spans, types[5]), texts, *(b.column(2 + i) for i in range(len(carry)))]
            yield pa.RecordBatch.from_arrays([c if c.type == t else c.cast(t) for c, t in zip(columns, types, strict=True)], names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = (), rows_of_block: int = ROWS_OF_BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, text, carried) per row of docs.

    spans: [start, end) of the removed runs of UTF-8 bytes. text: what is kept; characters of which a
    part goes are left out of it (not of the digest). carried: a struct of the columns named in carry,
    whatever their names. Null text is empty. Texts under length bytes and rows of one doc_id never lose
    to each other; of two rows of one doc_id with different texts, each is judged by its own. A row
    without a doc_id loses nothing, and nothing is lost to it. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    on_workers(spark)
    work = shared_dir(spark, "repeats")
    inner = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(i) for c, i in zip(carry, inner, strict=True)])
    copy = stored(rows, f"{work}/texts", compression="zstd", maxRecordsPerFile=str(BLOCK_ROWS))
    files = copy.inputFiles()
    blocks, count = Blocks(f"{work}/texts", files[0]), len(files)
    # A range has about two blocks' keys. A block sends rows_of_block rows at most, each for several ranges where there
    # are more; those are split once the rows of some blocks have come together.
    ranges = max(8, count // 2)
    parts = -(-ranges // rows_of_block)
    ranges = -(-ranges // parts) * parts

    long = (F.octet_length("text") >= length) & F.col("doc_id").isNotNull()
    same = copy.select("doc_id", F.when(long, F.md5(F.col("text").cast("binary"))).alias("digest"), Blocks.number().alias("block"), F.col("_metadata.row_index").cast("int").alias("row"))
    same = stored(same, f"{work}/digests")
    first = same.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # A group of copies is dealt in SALT parts.
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    late = same.where("digest IS NOT NULL").withColumn("salt", F.pmod(F.col("row"), F.lit(SALT))).join(first, ["digest", "salt"]).where("doc_id > first")
    items = same.select("block").distinct().join(late.groupBy("block").agg(F.collect_list("row").alias("gone")), "block", "left")
    items = stored(items.withColumn("gone", F.coalesce("gone", F.expr("CAST(array() AS array<int>)"))), f"{work}/items")

    keys = items.repartitionByRange(count, "block").mapInPandas(_find(blocks, ranges, length, gram, parts), "range int, block long, keys binary, several binary, part binary")
    if parts > 1:
        some = F.pmod(F.xxhash64("block"), F.lit(-(-count // SOME_BLOCKS)))
        keys = keys.groupBy("range", some.alias("some")).applyInPandas(_split(parts), KEYS)
    else:
        keys = keys.select("range", "block", "keys", "several", F.col("part").alias("of"))
    answers = keys.groupBy("range").applyInPandas(_answer, "block long, range int, keys binary, gone array<int>")
    asked = answers.unionByName(items.select("block", F.lit(-1).alias("range"), F.lit(None).cast("binary").alias("keys"), "gone")).repartitionByRange(count, "block")
    windows = stored(asked.groupBy("block").applyInArrow(_typed(_windows(blocks, ranges, length, gram)), WINDOWS), f"{work}/windows", compression="zstd")

    each = windows.where("wid >= 0").select("block", "wid", "window", "near", "far", "doc")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), each.count() // RANGE_ROWS + 1)
    found = stored(each.repartitionByRange(tasks, "window", "block").mapInArrow(_compare(length), FOUND), f"{work}/found", compression="zstd")
    edge = found.where("string IS NOT NULL").withColumn("least", F.min("doc").over(Window.partitionBy("string"))).where("doc > least")
    found = found.where("string IS NULL").select("block", "wid", "found").unionByName(edge.select("block", "wid", "found"))

    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    parcels = items.select("block", "gone", none("pack", "binary"), none("wid", "int"), none("found", "long"))
    parcels = parcels.unionByName(windows.where("wid < 0").select("block", none("gone", "array<int>"), "pack", none("wid", "int"), none("found", "long")))
    parcels = parcels.unionByName(found.select("block", none("gone", "array<int>"), none("pack", "binary"), "wid", "found"))
    parcels = stored(parcels.repartitionByRange(count, "block"), f"{work}/parcels", compression="zstd")
    for part in ("digests", "items", "windows", "found"):
        drop_dir(spark, f"{work}/{part}")

    out = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, text string")
    schema = T.StructType([*out.fields, *(T.StructField(i, copy.schema[i].dataType) for i in inner)])
    done = parcels.repartitionByRange(count, "block").groupBy("block").applyInArrow(_typed(_cut(blocks, inner, schema, length, gram)), schema)
    return done.select(*out.names, F.struct(*[F.col(i).alias(c) for i, c in zip(inner, carry, strict=True)]).alias("carried") if carry else F.lit(None).cast("string").alias("carried"))


def _typed(run):
    """run as a function of a group's key and its batches, as Spark tells such by their annotations."""
    from collections.abc import Iterator

    import pyarrow as pa

    from ._common import release

    def grouped(key, batches):
        yield from run(key, batches)
        release()

    grouped.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return grouped
