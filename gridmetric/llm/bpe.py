"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a token is one probe. Tier two
merges the bytes of all other pre-tokens with a heap over a linked list. Distinct pre-tokens are looked up once per batch.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmetric.llm.common import dictionary, gather_ragged, held_model, mix64, pieces, quoted, table, texts

#: Whitespace of the Unicode property, which the pattern's \s means; Python's \s also takes U+001C-U+001F.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Remembered merges of one worker; the memory is emptied beyond that.
REMEMBERED = 300_000


class PerfectHash:
    """Minimal perfect hash of distinct byte strings (hash and displace): n keys, n slots, one displacement a bucket."""

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = r = max(1, n // 3)
        h = self.hashes(keys)
        self.shift = np.zeros(r, np.int64)
        self.slot_key: list[bytes | None] = [None] * n
        self.slot_value = np.full(n, -1, np.int64)
        bucket = (h % np.uint64(r)).astype(np.int64)
        load = np.bincount(bucket, minlength=r)
        taken = np.zeros(n, bool)
        by_bucket = np.argsort(bucket, kind="stable")
        begin = np.cumsum(load) - load
        slot_of = np.full(len(keys), -1, np.int64)
        for m in range(int(load.max(initial=0)), 1, -1):  # large buckets first
            todo, d = np.flatnonzero(load == m), 0
            while len(todo):
                d += 1
                own = by_bucket[begin[todo][:, None] + np.arange(m)]
                slots = self._place(h[own], d)
                fits = (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1) & ~taken[slots].any(axis=1)
                first = np.full(n, len(todo), np.int64)  # of buckets that want one slot, the first gets it
                np.minimum.at(first, slots[fits].ravel(), np.repeat(np.flatnonzero(fits), m))
                fits &= (first[slots] == np.arange(len(todo))[:, None]).all(axis=1)
                taken[slots[fits]] = True
                slot_of[own[fits]] = slots[fits]
                self.shift[todo[fits]] = d
                todo = todo[~fits]
        single = np.flatnonzero(load == 1)
        free = np.flatnonzero(~taken)[: len(single)]
        slot_of[by_bucket[begin[single]]] = free
        self.shift[single] = -free - 1
        for i, s in enumerate(slot_of.tolist()):
            self.slot_key[s], self.slot_value[s] = keys[i], i

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _place(self, h: np.ndarray, d) -> np.ndarray:
        return (mix64(h ^ np.asarray(d, np.uint64)) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """Position of each key in the list that was hashed, or -1."""
        if not keys:
            return np.zeros(0, np.int64)
        h = self.hashes(keys)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, self._place(h, np.maximum(d, 0)))
        slot_key = self.slot_key
        same = np.fromiter((slot_key[s] == k for s, k in zip(slot.tolist(), keys)), bool, len(keys))
        return np.where(same, self.slot_value[slot], -1)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the adjacent pair of least rank merges first, the leftmost of equal ones."""
    n = len(piece)
    end = list(range(1, n + 1))  # the part that begins at i ends before end[i]
    before = list(range(-1, n - 1))
    heap = []
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        r, i, stop = heapq.heappop(heap)
        if gone[i]:
            continue
        j = end[i]
        if j >= n or end[j] != stop:
            continue  # one side has grown since
        end[i] = stop
        gone[j] = 1
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0:
            r = get(piece[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Ranks of a .tiktoken file and the pattern that makes pre-tokens."""

    def __init__(self, rank_lines: list[bytes], pattern: str):
        pairs = [line.split() for line in rank_lines if line.strip()]
        self.tokens = [base64.b64decode(a) for a, _ in pairs]
        self.ids = np.array([int(b) for _, b in pairs], np.int64)
        self.ranks = dict(zip(self.tokens, self.ids.tolist()))
        self.hash = PerfectHash(self.tokens)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        #: Where a cut before each space could part a run of white space.
        self.odd = regex.compile(rf"[{WHITE}] | [{WHITE}]|[^\S \n]")
        by_id = sorted(zip(self.ids.tolist(), self.tokens))
        self.bytes_of = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        size = np.zeros(by_id[-1][0] + 1 if by_id else 1, np.int64)
        for i, t in by_id:
            size[i] = len(t)
        self.byte_len, self.byte_start = size, np.cumsum(size) - size
        self.known: dict[bytes, tuple[int, ...]] = {}

    def units(self, text: str) -> list[str]:
        """Runs of whole pre-tokens: the text cut before each space, where single spaces stand between other characters."""
        if "\x00" in text or self.odd.search(text):
            return self.pattern.findall(text)
        return text.replace(" ", "\x00 ").split("\x00")

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens laid end to end, and how many each has."""
        raw = [p.encode() for p in parts]
        at = self.hash.lookup(raw)
        known, ranks, ids = self.known, self.ranks, self.ids[at].tolist()
        if len(known) > REMEMBERED:
            known.clear()
        runs = []
        for i, whole in enumerate((at >= 0).tolist()):
            if whole:
                runs.append((ids[i],))
            else:
                p = raw[i]
                got = known.get(p)
                if got is None:
                    got = known[p] = tuple(merge_bytes(p, ranks))
                runs.append(got)
        counts = np.fromiter(map(len, runs), np.int64, len(runs))
        return np.fromiter(chain.from_iterable(runs), np.int64, int(counts.sum())), counts

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct units, each cut into its pre-tokens."""
        found = list(map(self.pattern.findall, units))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        codes, parts = dictionary(list(chain.from_iterable(found)), pa.large_string())
        flat, counts = self.encode_parts(parts)
        ids = flat[gather_ragged(np.cumsum(counts) - counts, counts, codes)]
        ends = np.concatenate([[0], np.cumsum(counts[codes])])[np.cumsum(sizes)]
        return ids, np.diff(ends, prepend=0)

    def encode(self, batch_texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not batch_texts:
            return []
        found = [self.units(t) for t in batch_texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        codes, units = dictionary(list(chain.from_iterable(found)), pa.large_string())
        flat, counts = self.encode_units(units)
        ids = flat[gather_ragged(np.cumsum(counts) - counts, counts, codes)].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(counts[codes])])[np.cumsum(sizes)]
        return np.split(ids, ends[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_of[gather_ragged(self.byte_start, self.byte_len, ids.astype(np.int64))].tobytes()


def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    key = (xxhash.xxh3_64_intdigest(rank_file), pattern)
    return held_model(("ranks", key), lambda: Encoder(rank_file.splitlines(), pattern))


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids (binary: little-endian unsigned 32-bit) and decoded (binary) of every row of docs.

    rank_file: the content of a .tiktoken file, broadcast (the vocabulary bounds its size). A null or empty text has no ids.
    Rows are taken as they come: repeated ids, ties and extra columns change nothing; an empty table gives an empty one. Texts
    of any length are whole; a batch holds about 8 MB or one text.
    """
    shared = docs.sparkSession.sparkContext.broadcast((rank_file, pattern))
    kind = docs.schema[id_col].dataType

    def run(batches):
        encoder = _encoder(*shared.value)
        for batch in pieces(batches, "text"):
            ids = encoder.encode(texts(batch, "text"))
            yield pa.record_batch({
                "id": batch.column("id"),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
                "decoded": pa.array([encoder.decode(x) for x in ids], pa.binary()),
            })

    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind.simpleString()}, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    coded = encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
