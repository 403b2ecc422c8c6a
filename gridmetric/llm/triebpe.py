"""Byte-level BPE of a tokenizers file over a trie of distinct words.

The tokens of a word's prefix are those of a shorter prefix and one last token: the only token that ends there and stands beside the one before it
without a merge over their border. Distinct words of a batch are put into a trie in sorted order, so that its nodes come depth first; each new node
takes its last token from the states of the nodes above it. Words with a common prefix share its nodes, and so its encoding is computed once.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmetric.llm.bpe import WHITE, Encoder
from gridmetric.llm.common import gather_ragged, held_model, pieces, quoted, table, texts

#: Fixed value: the pattern by which the files' byte-level pre-tokenizer parts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that Unicode 16 added to 15.1. The files' library knows those of 16 and no later ones.
ADDED_IN_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
#: Nodes after which a trie is begun anew, remembered borders after which they are forgotten, and words of each of two generations whose ids are kept.
NODES, BORDERS, WORDS = 250_000, 300_000, 150_000
#: Bytes beyond which a word is a path of its own, whose states take a few bytes each and go with it.
LONG = 256
NEVER = sys.maxsize


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the files: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _pattern() -> regex.Pattern:
    """PATTERN with the white space, letters and numbers of Unicode 16, whatever later ones the regex library knows."""
    known, added = regex.compile(r"[\p{L}\p{N}]"), {c for a, b in ADDED_IN_16 for c in range(a, b + 1)}
    every = map(chr, chain(range(0xD800), range(0xE000, 0x110000)))
    later = [c for c in known.findall("".join(every)) if unicodedata.category(c)[0] not in "LN" and ord(c) not in added]
    spans: list[list[int]] = []
    for c in map(ord, later):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    newer = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]" if spans else None
    text = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[[^{WHITE}\\p{{L}}\\p{{N}}]||{newer}]" if newer else f"[^{WHITE}\\p{{L}}\\p{{N}}]")
    text = text.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
    if newer:
        text = text.replace(r" ?\p{L}+", f" ?[\\p{{L}}--{newer}]+").replace(r" ?\p{N}+", f" ?[\\p{{N}}--{newer}]+")
    return regex.compile("(?V1)" + text)


class Borders:
    """Which tokens can stand side by side, from the merges that make them."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[int, int, int]]):
        """merges: left part, right part and token, those of least rank first."""
        self.rank_of = {made: r for r, (_, _, made) in enumerate(merges)}
        self.parts = {made: (a, b) for a, b, made in merges}
        self.right_of: dict[int, dict[int, int]] = {}  # left part: {right part: rank}
        for r, (a, b, made) in enumerate(merges):
            if self.rank_of[made] != r or max(self.rank_of.get(a, -1), self.rank_of.get(b, -1)) >= r:
                raise ValueError("a token is made by two merges, or before its parts")
            self.right_of.setdefault(a, {})[b] = r
        self.ends: dict[int, list] = {}
        self.starts: dict[int, list] = {}
        self.remembered: dict[int, bool] = {}
        self.made = {t for k, t in tokens.items() if len(k) == 1 and t not in self.rank_of}
        for r, (a, b, made) in enumerate(merges):  # a token that its own bytes give: no other merge passes its border before its own
            if a in self.made and b in self.made and self.first_merge(a, b) == r:
                self.made.add(made)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Parts that lie at one end of a token while it is made, the whole first: each with the rank of the merge that takes it."""
        known = self.ends if side else self.starts
        out = known.get(token)
        if out is None:
            out = [(token, NEVER)]
            if token in self.parts:
                out += [(self.parts[token][side], self.rank_of[token]), *self._edge(self.parts[token][side], side)[1:]]
            known[token] = out
        return out

    def first_merge(self, a: int, b: int) -> int:
        """Rank of the first merge of parts of a and b over their border; NEVER if there is none.

        Of equal ranks the left pair merges first: a part of a is taken before a merge of the same rank over the border, one of b after it.
        """
        first, right_of = NEVER, self.right_of
        for u, taken_u in self._edge(a, 1):
            ranks = right_of.get(u)
            if ranks:
                for v, taken_v in self._edge(b, 0):
                    r = ranks.get(v)
                    if r is not None and r < taken_u and r <= taken_v and r < first:
                        first = r
        return first

    def fit(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.remembered.get(key)
        if got is None:
            if len(self.remembered) > BORDERS:
                self.remembered.clear()
            got = self.remembered[key] = self.first_merge(a, b) == NEVER
        return got


class WordTrie:
    """Words with the last token of each of their prefixes."""

    def __init__(self, tokens: dict[bytes, int], borders: Borders):
        self.borders = borders
        #: Beginnings of tokens: the token, or -1 where it is only the beginning of others.
        self.beginnings: dict[bytes, int] = {}
        for word, token in tokens.items():
            if token in borders.made:
                for k in range(1, len(word)):
                    self.beginnings.setdefault(word[:k], -1)
                self.beginnings[word] = token
        self.clear()

    def clear(self) -> None:
        self.below: dict[int, int] = {}  # node * 256 + byte: node
        #: Of each node its last token, the node before that, and the length of the longest beginning of a token at its end.
        self.token, self.back, self.reach = array("i", [-1]), array("i", [-1]), array("i", [0])

    def extend(self, word: bytes, last, reach: int) -> tuple[list[int], list[int]]:
        """Appends to last, which has the last tokens of the word's prefixes from the empty one on, those of all longer ones.

        reach: the longest beginning of a token at the end of the last prefix that is known. Returns where each new token begins, and the reach of each
        new prefix, which is longer by one byte at most than that of the prefix before; no token is longer. Only one token fits.
        """
        begins, reaches = [], []
        get, known, fit = self.beginnings.get, self.borders.remembered.get, self.borders.fit
        for end in range(len(last), len(word) + 1):
            begin = end - reach - 1
            token = get(word[begin:end])
            while token is None:
                begin += 1
                token = get(word[begin:end])
            reach = end - begin
            while True:
                if token is not None and token >= 0:
                    if not begin:
                        break
                    fits = known(last[begin] << 32 | token)
                    if fits or (fits is None and fit(last[begin], token)):
                        break
                begin += 1
                token = get(word[begin:end])
            last.append(token)
            begins.append(begin)
            reaches.append(reach)
        return begins, reaches

    def insert(self, word: bytes) -> int:
        """The word's node; its new nodes get their states."""
        node, path, below, token = 0, [0], self.below, self.token
        for byte in word:
            child = below.get(node << 8 | byte)
            if child is None:
                break
            path.append(child)
            node = child
        depth = len(path)
        if depth <= len(word):
            last = [token[n] for n in path]
            begins, reaches = self.extend(word, last, self.reach[node])
            fresh = len(token)
            path += range(fresh, fresh + len(begins))
            token.extend(last[depth:])
            self.back.extend([path[begin] for begin in begins])
            self.reach.extend(reaches)
            for byte, above, child in zip(word[depth - 1 :], path[depth - 1 :], path[depth:]):
                below[above << 8 | byte] = child
        return path[-1]

    def encode(self, word: bytes) -> list[int]:
        out = []
        if len(word) > LONG:
            last, end = array("i", [-1]), len(word)
            begins = array("i", self.extend(word, last, 0)[0])
            while end:
                out.append(last[end])
                end = begins[end - 1]
        else:
            node, token, back = self.insert(word), self.token, self.back
            while node:
                out.append(token[node])
                node = back[node]
        out.reverse()
        return out

    def encode_sorted(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Distinct words with their tokens, depth first in the trie."""
        for word in sorted(words):
            if len(self.token) > NODES:
                self.clear()
            yield word, self.encode(word)


class TrieEncoder(Encoder):
    """A byte-level BPE file of the tokenizers library: its added tokens, pattern and merges."""

    def __init__(self, file: bytes):
        made = json.loads(file)
        model, pre = made["model"], made["pre_tokenizer"] or {}
        plain = all(not made.get(k) for k in ("normalizer", "truncation", "padding")) and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        known = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        added = made.get("added_tokens", [])
        if not plain or not known or (made.get("decoder") or {}).get("type") != "ByteLevel" or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("not a byte-level BPE file without normalizer, with plain added tokens")
        letters = byte_letters()
        tokens = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        if any(bytes([b]) not in tokens for b in range(256)):
            raise ValueError("the file lacks tokens of single bytes")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs]
        self.trie = WordTrie(tokens, Borders(tokens, merges))
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pattern = _pattern()
        self.odd = regex.compile(rf"[{WHITE}] | [{WHITE}]|[^\S \n]")
        self.added = {t["content"]: t["id"] for t in added}
        names = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        by_id = {i: t for t, i in tokens.items()} | {i: t.encode() for t, i in self.added.items()}
        size = np.zeros(max(by_id) + 1, np.int64)
        for i, t in by_id.items():
            size[i] = len(t)
        self.byte_len, self.byte_start = size, np.cumsum(size) - size
        self.bytes_of = np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens laid end to end, and how many each has."""
        raw = [p.encode() for p in parts]
        young, old = self.young, self.old
        new = []
        for word in raw:
            if word not in young:
                if word in old:
                    young[word] = old[word]
                else:
                    new.append(word)
        for word, ids in self.trie.encode_sorted(new):
            young[word] = array("I", ids).tobytes()
        runs = [young[word] for word in raw]
        if len(young) > WORDS:
            self.old, self.young = young, {}  # the words not met since the last turn go
        counts = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        return np.frombuffer(b"".join(runs), "<u4").astype(np.int64), counts

    def encode(self, batch_texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, whose added tokens stand for themselves."""
        if not self.cut or not any(name in t for t in batch_texts for name in self.added):
            return super().encode(batch_texts)
        parted = [self.cut.split(t) for t in batch_texts]  # every second part is an added token
        coded = iter(super().encode([p for own in parted for p in own[::2]]))
        out = []
        for own in parted:
            runs = [next(coded) if k % 2 == 0 else np.array([self.added[p]], "<u4") for k, p in enumerate(own)]
            out.append(np.concatenate(runs))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the decoded text: the tokens' bytes, read as UTF-8 with U+FFFD for what isn't."""
        raw = self.bytes_of[gather_ragged(self.byte_start, self.byte_len, ids.astype(np.int64))].tobytes()
        return raw.decode(errors="replace").encode()


def trie_encoder(file: bytes) -> TrieEncoder:
    key = xxhash.xxh3_64_intdigest(file)
    return held_model(("trie", key), lambda: TrieEncoder(file))


def encode_by_trie(docs: DataFrame, tokenizer_file: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids (binary: little-endian unsigned 32-bit) and decoded (binary: UTF-8) of every row of docs.

    tokenizer_file: the content of a byte-level BPE file, broadcast (the vocabulary bounds its size). Added tokens in a text are tokens. A null or empty
    text has no ids. Rows are taken as they come: null or repeated ids and ties change nothing, and other columns don't matter, whatever
    their names; an empty table gives an empty one. Texts of any length are whole: a batch holds about 8 MB or one text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_file)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = trie_encoder(shared.value)
        for batch in pieces(batches, "text"):
            ids = encoder.encode(texts(batch, "text"))
            yield pa.record_batch({
                "id": batch.column("id"), "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids": pa.array([x.tobytes() for x in ids], pa.binary()), "decoded": pa.array([encoder.decode(x) for x in ids], pa.binary()),
            })

    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def op13_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        coded = encode_by_trie(table(spark, sf_dir, "documents"), f.read())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
