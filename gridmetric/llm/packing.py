"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens at once.

Each task packs the rows it reads, window by window, so no row moves. Items are what is left of a text after its full sequences.
An open sequence takes the item whose demand has the largest dot product with what the sequence has left; when no item fits, one
is cut to fill the rest. What remains at the end of a task is cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.taskcontext import TaskContext

from gridmetric.llm.common import MB, give_back, pieces, quoted, table
from gridmetric.llm.tokens import word_tokenizer


class Packer:
    """Packs items (key, start, tokens, loss) into sequences; loss tokens of a cut item are shared in proportion, rounded up."""

    def __init__(self, tokens: int = 2048, segments: int = 256, loss: int = 2048):
        self.limit = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.pool: dict[tuple[int, int], list] = defaultdict(list)  # by (tokens, loss-bearing tokens)

    def add(self, key, start: int, tokens: int, loss: int) -> list[list[tuple]]:
        """Full sequences that a long item fills alone; the rest joins the pool."""
        out = []
        while tokens >= self.tokens and -(-loss * self.tokens // tokens) <= self.loss:
            part = -(-loss * self.tokens // tokens)
            out.append([(key, start, self.tokens)])
            start, tokens, loss = start + self.tokens, tokens - self.tokens, loss - part
        while tokens >= self.tokens or loss > self.loss:  # too many loss-bearing tokens for one sequence
            size = min(tokens, self.tokens, max(1, self.loss * tokens // max(1, loss)))
            part = min(loss, -(-loss * size // tokens), self.loss)
            self.pool[size, part].append((key, start))
            start, tokens, loss = start + size, tokens - size, loss - part
        if tokens:
            self.pool[tokens, loss].append((key, start))
        return out

    def pack(self, final: bool) -> list[list[tuple]]:
        """Sequences of the pool's items; without final, only those that came out full."""
        out, kinds = [], {k: len(v) for k, v in self.pool.items() if v}
        size = np.array([[t, 1, x] for t, x in kinds], float).reshape(-1, 3)
        names, left = list(kinds), np.array(list(kinds.values()), np.int64)
        index = {k: i for i, k in enumerate(names)}
        while left.any():
            room, seq = self.limit.copy(), []
            while room[0] > 0 and room[1] > 0:
                fits = (left > 0) & (size <= room).all(axis=1)
                if fits.any():
                    score = np.where(fits, (size / self.limit) @ (room / self.limit), -1.0)
                    i = int(score.argmax())
                    key, start = self.pool[names[i]].pop()
                    left[i] -= 1
                    seq.append((key, start, names[i][0], names[i][1]))
                    room -= size[i]
                    continue
                i = int(np.where((left > 0) & (size[:, 0] > room[0]), size[:, 0], -1.0).argmax())
                if left[i] == 0 or size[i, 0] <= room[0]:
                    break  # nothing left that tokens alone keep out
                t, x = names[i]
                part = int(room[0])
                own = -(-x * part // t)
                if own > room[2]:
                    break
                key, start = self.pool[names[i]].pop()
                left[i] -= 1
                seq.append((key, start, part, own))
                room -= (part, 1, own)
                rest = (t - part, x - own)
                self.pool[rest].append((key, start + part))
                if rest not in index:
                    index[rest] = len(names)
                    names.append(rest)
                    size, left = np.vstack([size, [rest[0], 1, rest[1]]]), np.append(left, 0)
                left[index[rest]] += 1
            if room[0] > 0 and not final:
                for key, start, t, x in seq:
                    self.pool[t, x].append((key, start))
                return out
            out += [[p[:3] for p in seq]] if room[0] == 0 else self._powers(seq)
        return out

    @staticmethod
    def _powers(seq: list[tuple]) -> list[list[tuple]]:
        """A sequence that isn't full, cut into sequences whose lengths are the powers of two in its length."""
        rest, out = [p[:3] for p in seq], []
        total = sum(p[2] for p in rest)
        while total:
            want, own = 1 << (total.bit_length() - 1), []
            total -= want
            while want:
                key, start, t = rest.pop(0)
                take = min(t, want)
                own.append((key, start, take))
                want -= take
                if take < t:
                    rest.insert(0, (key, start + take, t - take))
            out.append(own)
        return out


def pack_tokens(docs: DataFrame, tokenizer_file: bytes, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, tokens: int = 2048, segments: int = 256, loss: int = 2048, end_id: int = 1, window: int = 8192, window_tokens: int = 4_000_000) -> DataFrame:
    """Pieces of token sequences: id_col, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A row's ids are those of its whole text (null: none), then end_id. All its tokens bear loss, or with loss_col (boolean; null: no) only
    those of rows where it is true. Every id is in exactly one piece; sequences hold at most `tokens` tokens, `segments` pieces and
    `loss` loss-bearing tokens. Rows stand alone, so ids may be null or repeat and a text may have any length; sequence_id is the task's number
    times 2**36 plus a count, so an empty table gives an empty one. window, window_tokens: rows or tokens after which a task packs what it has, which bounds its memory; a
    single text may be larger. Columns of docs other than the named ones don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_file)
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_type = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches):
        tokenizer = word_tokenizer(shared.value)
        packer, count = Packer(tokens, segments, loss), TaskContext.get().partitionId() << 36
        held: dict[int, tuple] = {}  # number of the row: id, ids, tokens that are in no piece yet
        number = rows = held_tokens = 0

        def emit(sequences):
            nonlocal count
            cols = [[] for _ in range(7)]
            for seq in sequences:
                offset = 0
                for key, start, n in seq:
                    doc, ids, open_ = held[key]
                    for c, v in zip(cols, (doc, start, n, ids[start : start + n].tobytes(), len(ids), count, offset)):
                        c.append(v)
                    offset += n
                    if open_ == n:
                        del held[key]
                    else:
                        held[key] = (doc, ids, open_ - n)
                count += 1
            kinds = [arrow_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in pieces(batches, "text", 3 * MB):
            flat, sizes = tokenizer.encode(batch.column("text"))
            ends = np.cumsum(sizes)
            bears = batch.column("bears").to_pylist()
            full = []
            for doc, a, b, yes in zip(batch.column("id").to_pylist(), (ends - sizes).tolist(), ends.tolist(), bears):
                ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                held[number] = (doc, ids, len(ids))
                full += packer.add(number, 0, len(ids), len(ids) if yes else 0)
                number += 1
            rows, held_tokens = rows + batch.num_rows, held_tokens + len(flat)
            if rows >= window or held_tokens >= window_tokens:
                rows = held_tokens = 0
                full += packer.pack(final=False)
            if full:
                yield emit(full)
        last = packer.pack(final=True)
        if last:
            yield emit(last)
        tokenizer.forget()
        give_back()

    bears = F.lit(True) if loss_col is None else F.coalesce(quoted(loss_col), F.lit(False))
    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), bears.alias("bears"))
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        file = f.read()
    packed = pack_tokens(table(spark, sf_dir, "documents"), file)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
