"""Token ids of a public tokenizer, and the binary files that hold them as wavelet matrices.

A shard file holds the ids of consecutive documents as a wavelet matrix: one bit plane per bit of an
id's place among the shard's distinct ids, highest first; each plane orders the ids by the bits above (zeros before ones, stable). Planes
are cut into blocks that are compressed on their own, with the number of ones before each block, so
access, rank, select and decoding read only the blocks they need.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_local, on_workers, shared_dir, stored

END_ID = 2
#: Words whose ids a worker remembers (as many again stay from the time before), and tokens of a shard.
WORDS_KEPT, SHARD_TOKENS = 700_000, 1 << 21
#: The letters, numbers and white space of Latin-1, and how byte-level BPE splits a text before its merges.
L, N, S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t\n\x0b\x0c\r \x85\xa0"
WORDS = rf" ?[{L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_encoders: dict = {}


def encoder(path: str):
    """texts -> their ids as little-endian unsigned 32-bit integers, by the tokenizers library.

    Byte-level BPE merges inside words only, so for Latin-1 texts without added tokens the library's
    ids of each distinct word are remembered and joined; other texts go to the library whole. New words
    go to it many at a time.
    """
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    spec = json.loads(tok.to_str())
    pre = spec.get("pre_tokenizer") or {}
    by_word = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = [x["content"] for x in spec.get("added_tokens", [])]
    find, plain = re.compile(WORDS).findall, re.compile(rf" [{L}]+").fullmatch
    vocabulary = tok.get_vocab()
    blank = np.zeros(max(vocabulary.values()) + 1, bool)
    blank[[i for x, i in vocabulary.items() if x.startswith("\u0120")]] = True  # the blank as byte-level BPE writes it
    known: dict[str, bytes] = {}
    before: dict[str, bytes] = {}

    def whole(text: str) -> bytes:
        return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()

    def simple(text: str) -> bool:
        if not by_word or any(a in text for a in added):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def learn(words: list[str]) -> None:
        """Words of a blank and letters are split as they stand when one follows the other, so they share a call;
        of their ids only the first of each begins with the blank."""
        rows = [w for w in words if plain(w)]
        for i in range(0, len(rows), 512):
            part = rows[i : i + 512]
            ids = np.array(tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = [*np.flatnonzero(blank[ids]).tolist(), len(ids)]
            if len(cut) == len(part) + 1 and not cut[0]:
                raw = ids.tobytes()
                known.update((w, raw[4 * a : 4 * z]) for w, a, z in zip(part, cut, cut[1:], strict=False))
        rest = [w for w in words if w not in known]
        for w, e in zip(rest, tok.encode_batch_fast(rest, add_special_tokens=False) if rest else (), strict=True):
            known[w] = array("I", e.ids).tobytes()

    def encode(texts: Iterable[str | None]) -> list[bytes]:
        nonlocal known, before
        out: list[list] = []
        gaps: list[tuple[list, int, str]] = []
        for text in texts:
            if not text or not simple(text):
                out.append([whole(text)] if text else [])
                continue
            words = find(text)
            got = list(map(known.get, words))
            gaps += [(got, i, words[i]) for i, x in enumerate(got) if x is None]
            out.append(got)
        new = {w for _, _, w in gaps}
        if len(known) + len(new) > WORDS_KEPT:
            known, before = {}, known
        ask = []
        for w in new:
            if (x := before.get(w)) is None:
                ask.append(w)
            else:
                known[w] = x
        learn(ask)
        for got, i, w in gaps:
            got[i] = known[w]
        return [b"".join(x) for x in out]

    _encoders[path] = encode
    return encode


def encoded(texts, encode, at_once: int = 64) -> Iterator[bytes]:
    """encode() of many texts, some at a time."""
    texts = list(texts)
    for i in range(0, len(texts), at_once):
        yield from encode(texts[i : i + at_once])


class Wavelet:
    """Built from ids, written to bytes, and opened from a seekable binary file."""

    MAGIC, BLOCK = b"WVMX0001", 1 << 19  # bits of a block

    @classmethod
    def write(cls, ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        alphabet = np.unique(ids) if ids.max(initial=0) >> 22 else np.flatnonzero(np.bincount(ids))
        levels = max(1, (len(alphabet) - 1).bit_length())
        kind = np.uint16 if levels <= 16 else np.uint32
        if ids.max(initial=0) >> 22:
            now = np.searchsorted(alphabet, ids).astype(kind)
        else:
            place = np.zeros(int(ids.max(initial=0)) + 1, kind)
            place[alphabet] = np.arange(len(alphabet))
            now = place[ids]
        body, head = [], {"n": len(ids), "levels": levels, "docs": len(doc_ids), "zeros": [], "blocks": [], "ones": []}
        at = 0

        def put(raw: bytes) -> list[int]:
            nonlocal at
            body.append(pack(raw))
            at += len(body[-1])
            return [at - len(body[-1]), len(body[-1])]

        head["alphabet"] = put(alphabet.astype("<u4").tobytes())
        head["doc_ids"], head["lengths"] = put(doc_ids.astype("<i8").tobytes()), put(lengths.astype("<i8").tobytes())
        for level in reversed(range(levels)):
            bit = (now & now.dtype.type(1 << level)) != 0
            plane = np.packbits(bit)
            ones = [int(np.count_nonzero(bit[i : i + cls.BLOCK])) for i in range(0, len(bit), cls.BLOCK)]
            head["ones"].append([0, *np.cumsum(ones).tolist()])
            head["blocks"].append([put(plane[i // 8 : (i + cls.BLOCK) // 8].tobytes()) for i in range(0, len(bit), cls.BLOCK)])
            zeros = len(bit) - sum(ones)
            head["zeros"].append(zeros)
            if level:
                after = np.empty_like(now)
                np.compress(bit, now, out=after[zeros:])
                np.compress(np.logical_not(bit, out=bit), now, out=after[:zeros])
                now = after
        text = json.dumps(head).encode()
        return b"".join([cls.MAGIC, struct.pack("<Q", len(text)), text, *body])

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        file.seek(0)
        if file.read(8) != self.MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<Q", file.read(8))
        self.head = json.loads(file.read(size))
        self.base = 16 + size
        self.n, self.levels = self.head["n"], self.head["levels"]
        self.kept: dict = {}
        self.alphabet = np.frombuffer(self._get(self.head["alphabet"]), "<u4")

    def _get(self, at: list[int]) -> bytes:
        self.file.seek(self.base + at[0])
        return self.unpack(self.file.read(at[1]))

    @property
    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._get(self.head["doc_ids"]), "<i8")

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._get(self.head["lengths"]), "<i8")

    def _bits(self, level: int, block: int) -> np.ndarray:
        if (level, block) not in self.kept:
            if len(self.kept) > 64:
                self.kept.clear()
            size = min(self.BLOCK, self.n - block * self.BLOCK)
            self.kept[level, block] = np.unpackbits(np.frombuffer(self._get(self.head["blocks"][level][block]), np.uint8), count=size)
        return self.kept[level, block]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        b, r = divmod(i, self.BLOCK)
        return self.head["ones"][level][b] + (int(np.count_nonzero(self._bits(level, b)[:r])) if r else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for level in range(self.levels):
            b, r = divmod(i, self.BLOCK)
            bit = int(self._bits(level, b)[r])
            ones = self._ones(level, i)
            i = self.head["zeros"][level] + ones if bit else i - ones
            out = out * 2 + bit
        return int(self.alphabet[out])

    def rank(self, x: int, i: int) -> int:
        """How often id x is among the first i ids."""
        lo, hi = 0, i
        at = int(np.searchsorted(self.alphabet, x))
        if at == len(self.alphabet) or self.alphabet[at] != x:
            return 0
        x = at
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            zeros = self.head["zeros"][level]
            lo, hi = (zeros + a, zeros + b) if x >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, x: int) -> int:
        return self.rank(x, self.n)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        ones = self.head["ones"][level]
        before = ones if bit else [min(self.n, b * self.BLOCK) - n for b, n in enumerate(ones)]
        b = bisect_right(before, k) - 1
        return b * self.BLOCK + int(np.flatnonzero(self._bits(level, b) == bit)[k - before[b]])

    def select(self, x: int, k: int) -> int:
        """Place of the k-th (from 0) id x; ValueError if there are fewer. From the lowest plane up."""
        if not 0 <= k < self.count(x):
            raise ValueError("no such occurrence")
        x, at = int(np.searchsorted(self.alphabet, x)), 0
        bits = [x >> (self.levels - 1 - level) & 1 for level in range(self.levels)]
        for level, bit in enumerate(bits):
            ones = self._ones(level, at)
            at = self.head["zeros"][level] + ones if bit else at - ones
        at += k
        for level in reversed(range(self.levels)):
            at = self._select(level, bits[level], at - self.head["zeros"][level] if bits[level] else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        now = None
        for level in reversed(range(self.levels)):
            size = len(self.head["blocks"][level])
            raw = b"".join(self._get(x) for x in self.head["blocks"][level][:size])
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).astype(bool)
            if now is None:
                out = bit.astype(np.uint16 if self.levels <= 16 else np.uint32)
            else:
                zeros = self.head["zeros"][level]
                out = np.empty_like(now)
                now[zeros:] |= now.dtype.type(1 << (self.levels - 1 - level))
                out[bit] = now[zeros:]
                out[np.logical_not(bit, out=bit)] = now[:zeros]
            now = out
        return self.alphabet[now]


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write docs in ascending doc_id order to shard files under path; returns their manifest.

    Manifest: (part, file, first long: ids of the part before this file, n_tokens). Parts are ranges
    of doc_id in order. A retried task writes files of other names, and only those in the manifest
    count. Null text is empty and has the end id only. Rows without a doc_id are left out; rows of
    the same doc_id follow each other by the hash of their text, and may be in several parts. A document
    is never cut, so a shard holds one at least. Other columns are not read. An empty table has no files.
    """
    spark = docs.sparkSession
    on_workers(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)

    def run(batches):
        encode = encoder(tokenizer)
        fs, root = as_local(path)
        fs.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        end = array("I", [end_id]).tobytes()
        held, ids, size, first, made = [], [], 0, 0, []

        def flush():
            nonlocal held, ids, size, first
            all_ids = np.frombuffer(b"".join(ids), "<u4")
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            name = f"shard-{part:06d}-{len(made):05d}-{attempt}.wvm"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(Wavelet.write(all_ids, np.array(held, np.int64), lengths))
            made.append((part, f"{path}/{name}", first, len(all_ids)))
            first += len(all_ids)
            held, ids, size = [], [], 0

        for pdf in batches:
            for i, raw in zip(pdf["doc_id"], encoded(pdf["text"], encode), strict=True):
                x = raw + end
                held.append(i)
                ids.append(x)
                size += len(x) // 4
                if size >= shard_tokens:
                    flush()
        if held:
            flush()
        yield pd.DataFrame(made, columns=["part", "file", "first", "n_tokens"])

    return stored(rows.mapInPandas(run, "part int, file string, first long, n_tokens long"), f"{path}-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    spark = manifest.sparkSession
    on_workers(spark)
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    todo = manifest.join(before, "part").select("file", (F.col("before") + F.col("first")).alias("start"))
    todo = todo.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")

    def run(batches):
        for pdf in batches:
            for file, start in zip(pdf["file"], pdf["start"], strict=True):
                fs, at = as_local(file)
                with fs.open_input_file(at) as f:
                    w = Wavelet(f)
                    ids, docs, lengths = memoryview(w.ids().tobytes()), w.doc_ids, w.lengths
                to = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (b - n) : 4 * b]) for b, n in zip(to.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": docs, "start": start + to - lengths, "n_tokens": lengths, "ids_crc32": crc})

    return todo.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_shards(write_shards(docs, shared_dir(docs.sparkSession, "shards"), tokenizer))
