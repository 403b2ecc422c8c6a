"""Token ids of texts by a tokenizers file whose pre-tokenizer drops white space: words are encoded once per batch."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from gridmetric.llm.common import gather_ragged, held_model

#: Marks that may follow a word; an apostrophe isn't one of them, as the pattern knows its contractions.
_MARKS = ".,;:!?|)\"*"
#: Letters that Arrow lower-cases as the files do: those below U+0180 but for İ, of which a mark is a part that the pattern takes with what follows.
_CASED = r"^[\x{0}-\x{12F}\x{131}-\x{17F}]+$"
#: Texts on which a tokenizer file must encode as its words do.
_PROBES = ["Hello, World.  again\n\nNEW line", "don't STOP! (x) a.b,c; \"Été\" straße* y|z", "12 3.4 it's: end?", "ALİ. İ, i İ"]
#: Parts that a worker remembers in each of two generations.
REMEMBERED = 200_000


class WordTokenizer:
    """Ids of a text are those of its words end to end, as the file's BPE never crosses white space and drops it.

    A word of letters with punctuation after it is two parts to the file's pattern, so the letters are looked up alone, in lower case. Added tokens, which
    hold no white space, are tokens wherever they stand, as the library takes them. A file of which this doesn't hold is refused.
    """

    def __init__(self, file: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(file)
        suffix, vocab = json.loads(file)["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocab.values(), default=0) + 1, bool)  # tokens that end a word, if the file marks them
        self.word_end[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {}  # ids of parts that were met lately,
        self.old: dict[str, bytes] = {}  # and of those met before
        ids, sizes = self.encode(pa.array(_PROBES))
        want = [e.ids for e in self.tokenizer.encode_batch(_PROBES, add_special_tokens=False)]
        if [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] != want:
            raise ValueError("the tokenizer file doesn't lower-case words and drop white space between them")

    def forget(self) -> None:
        """Drops what was remembered, at the end of a task."""
        self.young, self.old = {}, {}

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of distinct parts that stand between white space."""
        young, old = self.young, self.old
        if len(young) > REMEMBERED:
            self.old, self.young = young, old = {}, young  # the parts not met since the last turn go
        out = list(map(young.get, parts))
        new = []
        for i, got in enumerate(out):
            if got is None:
                p = parts[i]
                got = old.get(p)
                if got is None:
                    new.append(i)
                else:
                    out[i] = young[p] = got
        single = [p.isalpha() and (p.isascii() or (max(p) < "\u0180" and "İ" not in p)) for p in map(parts.__getitem__, new)]
        for k in range(0, len(new), 20_000):
            some, plain = new[k : k + 20_000], single[k : k + 20_000]
            words = [i for i, yes in zip(some, plain) if yes]
            others = [i for i, yes in zip(some, plain) if not yes]
            for i, ids in zip(words, self._joined([parts[i] for i in words])):
                out[i] = young[parts[i]] = ids
            for i, e in zip(others, self.tokenizer.encode_batch_fast([parts[i] for i in others], add_special_tokens=False)):
                out[i] = young[parts[i]] = array("I", e.ids).tobytes()
        return out

    def _joined(self, words: list[str], run: int = 200) -> Iterator[bytes]:
        """Ids of words of letters, many in one text: a word's last token is the only one that ends one."""
        chunks = [words[k : k + run] for k in range(0, len(words), run)]
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(chunk) and ends[-1] == len(ids):
                raw = ids.tobytes()
                yield from (raw[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist()))
            else:
                yield from (array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(chunk, add_special_tokens=False))

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has."""
        letters = pc.utf8_rtrim(words, characters=_MARKS)
        cut = pc.and_(pc.utf8_is_alpha(letters), pc.match_substring_regex(letters, _CASED))
        marks = pa.array(np.where(cut.to_numpy(zero_copy_only=False), _lengths(words) - _lengths(letters), 0))
        both = pa.concat_arrays([pc.if_else(cut, pc.utf8_lower(letters), words), _ends(words, marks)]).dictionary_encode()
        runs = self.encode_parts(both.dictionary.to_pylist())
        counts = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        code = both.indices.to_numpy(zero_copy_only=False).reshape(2, -1)
        flat = np.frombuffer(b"".join(runs), "<u4")
        return flat[gather_ragged(np.cumsum(counts) - counts, counts, code.T.ravel())], counts[code].sum(axis=0)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (string array; null: empty) end to end, and how many each has."""
        if len(column) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        spaced = pc.replace_substring(pc.fill_null(column, "").cast(pa.large_string()), "\n", " ")
        found = pc.split_pattern(spaced, " ")
        coded = found.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat, counts = self.encode_words(coded.dictionary)
        ids = flat[gather_ragged(np.cumsum(counts) - counts, counts, codes)]
        ends = np.concatenate([[0], np.cumsum(counts[codes])])[np.asarray(found.offsets)[1:] - found.offsets[0].as_py()]
        return ids, np.diff(ends, prepend=0)


def _lengths(strings: pa.Array) -> np.ndarray:
    return pc.binary_length(strings).to_numpy(zero_copy_only=False)


def _ends(strings: pa.Array, sizes: pa.Array) -> pa.Array:
    """The last bytes of each string, as many as sizes has."""
    n, stop = sizes.to_numpy(), np.frombuffer(strings.buffers()[1], np.int64)[strings.offset + 1 : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    own = data[gather_ragged(stop - n, n, np.arange(len(n)))]
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int64)), pa.py_buffer(own.tobytes())])


def word_tokenizer(file: bytes) -> WordTokenizer:
    key = xxhash.xxh3_64_intdigest(file)
    return held_model(("words", key), lambda: WordTokenizer(file))
