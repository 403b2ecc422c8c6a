"""Language-model scoring by deleted interpolation of a word bigram model.

P(w | u) = a2[b] c(u w) / c(u) + a1[b] c(w) / N + a0[b] / (V + 1), where b is the frequency bucket (power of two) of the context u.
The weights of each bucket are learned by expectation-maximisation on a deleted part of the training documents, with counts from the
rest; scores then use the counts of all training documents.

Counting works on blocks of documents. A block sends each distinct n-gram once, to the bucket of keys that its hash names; the
bucket's task adds the counts up and answers each block. So an n-gram that a third of all texts hold is no hot key: it is one entry a block.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from gridmetric.llm.common import MB, Scratch, dictionary, mix64, pieces, quoted, shuffle_partitions, table, text_bytes, texts

END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLOCK_BYTES, BUCKET_BYTES = 8 * MB, 12 * MB
TRAIN, DELETED, HELD_OUT = 0, 1, 2
_DOWN, _UP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(a: np.ndarray, width: int = 4) -> bytes:
    """Unsigned integers below 256**width as compressed byte planes."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return _DOWN.compress(planes.tobytes())


def unsqueeze(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(_UP.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def words_of(text: str) -> list[bytes]:
    """Words between bytes 0x20 and 0x09-0x0D, A-Z lower-cased."""
    return text.encode().lower().split()


def tokenise(batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the block's distinct tokens in order, each token's place among them, and tokens of each text (its end among them)."""
    found = [words_of(t) for t in batch_texts]
    sizes = np.fromiter((len(f) + 1 for f in found), np.int64, len(found))
    codes, words = dictionary(list(chain.from_iterable(found)), pa.large_binary())
    own = np.concatenate([np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), [END]]).astype(np.uint64)
    hashes, place = np.unique(own, return_inverse=True)
    tokens = np.full(int(sizes.sum()), place[-1], np.int64)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(sizes) - 1] = False
    tokens[inner] = place[codes]
    return hashes, tokens, sizes


def bigrams(hashes: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit-per-bucket keys of the block's bigrams in order, and each token's place among them."""
    here = hashes[tokens]
    before = np.concatenate([[START], here[:-1]]).astype(np.uint64)
    before[np.cumsum(sizes) - sizes] = START
    with np.errstate(over="ignore"):
        keys = mix64(before * np.uint64(0x9E3779B97F4A7C15) + mix64(here))
    return np.unique(keys, return_inverse=True)


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Ends of the n buckets among ordered keys; a bucket is an even share of the range of keys."""
    edges = [-(-(i << 64) // n) for i in range(1, n)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]])


def deltas(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)).astype(np.uint64), 8)


def undelta(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unsqueeze(data, 8), dtype=np.uint64)


def _tokenised(docs: DataFrame, id_type: str) -> DataFrame:
    """One row a block of documents."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, "text", BLOCK_BYTES):
            hashes, tokens, sizes = tokenise(texts(batch, "text"))
            ids = batch.column("id")
            yield pa.record_batch({
                "block": pa.array([number], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "sizes": pa.array([squeeze(sizes)], pa.binary()),
                "fold": pa.array([squeeze(batch.column("fold").to_numpy(zero_copy_only=False), 1)], pa.binary()),
                "tokens": pa.array([squeeze(tokens)], pa.binary()),
                "words": pa.array([hashes.tobytes()], pa.binary()),
            })
            number += 1

    return docs.mapInArrow(run, f"block long, ids array<{id_type}>, sizes binary, fold binary, tokens binary, words binary")


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes = np.frombuffer(row["words"], np.uint64)
    return hashes, unsqueeze(row["tokens"]).astype(np.int64), unsqueeze(row["sizes"]).astype(np.int64), unsqueeze(row["fold"], 1)


def _sent(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """For each block and bucket: its keys with their counts in the block's retained and deleted training documents."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes, tokens, sizes, fold = _block(row)
                fold = np.repeat(fold, sizes)
                keys, place = bigrams(hashes, tokens, sizes)
                out = {"bucket": np.arange(n_buckets), "block": np.full(n_buckets, row["block"])}
                for name, k, p in (("uni", hashes, tokens), ("bi", keys, place)):
                    ends = cuts(k, n_buckets)
                    kept, gone = (np.bincount(p[fold == f], minlength=len(k)) for f in (TRAIN, DELETED))
                    spans = list(zip(ends, ends[1:]))
                    out[name] = [deltas(k[a:b]) for a, b in spans]
                    out[name + "_kept"] = [squeeze(kept[a:b]) for a, b in spans]
                    out[name + "_gone"] = [squeeze(gone[a:b]) for a, b in spans]
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    names = [f"{k}{x}" for k in ("uni", "bi") for x in ("", "_kept", "_gone")]
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in names)])
    return blocks.select("block", "sizes", "fold", "tokens", "words").mapInArrow(run, "bucket long, block long, " + ", ".join(f"{n} binary" for n in names))


def _answered(sent: DataFrame) -> DataFrame:
    """For each block and bucket: the counts of its keys over all blocks; types and tokens of the bucket once."""

    def merge(t: pa.Table) -> pa.Table:
        n = t.num_rows
        out = {"block": t["block"].to_pylist(), "bucket": t["bucket"].to_pylist()}
        for name in ("uni", "bi"):
            keys = [undelta(x) for x in t[name].to_pylist()]
            sizes = [len(k) for k in keys]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            kept, gone = (np.bincount(place, weights=np.concatenate([unsqueeze(x) for x in t[name + c].to_pylist()]), minlength=len(distinct)).astype(np.int64) for c in ("_kept", "_gone"))
            parts = np.split(place, np.cumsum(sizes)[:-1])
            out[name + "_kept"] = [squeeze(kept[p], 5) for p in parts]
            out[name + "_all"] = [squeeze((kept + gone)[p], 5) for p in parts]
            if name == "uni":
                first = [0] * (n - 1)
                out |= {"types": [int(((kept + gone) > 0).sum()), *first], "n_all": [int((kept + gone).sum()), *first], "n_kept": [int(kept.sum()), *first]}
        return pa.table(out, schema=schema)

    fields = [("block", "long"), ("bucket", "long"), *((f"{k}_{x}", "binary") for k in ("uni", "bi") for x in ("kept", "all")), ("types", "long"), ("n_all", "long"), ("n_kept", "long")]
    schema = pa.schema([(n, pa.binary() if k == "binary" else pa.int64()) for n, k in fields])
    return sent.groupBy("bucket").applyInArrow(merge, ", ".join(f"{n} {k}" for n, k in fields))


def _counted(blocks: DataFrame, answers: DataFrame, id_type: str) -> DataFrame:
    """Blocks with the counts of their tokens: of words by place, of bigrams by token."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            hashes, tokens, sizes, fold = _block(row)
            keys, place = bigrams(hashes, tokens, sizes)
            parts = right.sort_by("bucket")
            get = lambda c: np.concatenate([unsqueeze(x, 5) for x in parts[c].to_pylist()])
            got = {c: get(c) for c in ("uni_kept", "uni_all", "bi_kept", "bi_all")}
            if len(got["uni_all"]) != len(hashes) or len(got["bi_all"]) != len(keys):
                raise RuntimeError("counts and block differ")
            deleted = np.repeat(fold, sizes) == DELETED
            rows.append({k: row[k] for k in ("ids", "sizes", "fold", "tokens")} | {
                "end": int(np.searchsorted(hashes, END)),
                "word_kept": squeeze(got["uni_kept"], 5), "word_all": squeeze(got["uni_all"], 5),
                "bigram_kept": squeeze(got["bi_kept"][place[deleted]], 5), "bigram_all": squeeze(got["bi_all"][place], 5),
            })
        return pa.Table.from_pylist(rows, schema=pa.schema([left.schema.field("ids"), *((n, pa.binary()) for n in ("sizes", "fold", "tokens")), ("end", pa.int64()), *((n, pa.binary()) for n in counts)]))

    counts = ("word_kept", "word_all", "bigram_kept", "bigram_all")
    schema = f"ids array<{id_type}>, sizes binary, fold binary, tokens binary, end long, " + ", ".join(f"{n} binary" for n in counts)
    sides = blocks.groupBy("block"), answers.select("block", "bucket", "uni_kept", "uni_all", "bi_kept", "bi_all").groupBy("block")
    return sides[0].cogroup(sides[1]).applyInArrow(join, schema)


def _contexts(tokens: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Place of each token's context; a text begins after an end, as there are as many beginnings as ends."""
    before = np.concatenate([[end], tokens[:-1]])
    before[np.cumsum(sizes) - sizes] = end
    return before


def frequency_bucket(count: np.ndarray) -> np.ndarray:
    """0 for no occurrence, else 1 + floor(log2)."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


BUCKETS = 48


def _events(counted: DataFrame) -> DataFrame:
    """Held-out events of the deleted documents with the retained counts: bucket, bigram, context and word count, how often."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens, sizes = unsqueeze(row["tokens"]).astype(np.int64), unsqueeze(row["sizes"]).astype(np.int64)
                gone = np.repeat(unsqueeze(row["fold"], 1), sizes) == DELETED
                words = unsqueeze(row["word_kept"], 5).astype(np.int64)
                context = words[_contexts(tokens, sizes, row["end"])[gone]]
                seen = np.stack([unsqueeze(row["bigram_kept"], 5).astype(np.int64), context, words[tokens[gone]]])
                distinct, n = np.unique(seen, axis=1, return_counts=True) if seen.shape[1] else (seen, np.zeros(0, np.int64))
                yield pa.record_batch({"b": pa.array(frequency_bucket(distinct[1])), "c2": pa.array(distinct[0]), "cu": pa.array(distinct[1]), "c1": pa.array(distinct[2]), "n": pa.array(n, pa.int64())})

    got = counted.select("sizes", "fold", "tokens", "end", "word_kept", "bigram_kept").mapInArrow(run, "b long, c2 long, cu long, c1 long, n long")
    return got.groupBy("b", "c2", "cu", "c1").agg(F.sum("n").alias("n"))


def learn_weights(events: DataFrame, n_tokens: int, n_types: int, rounds: int = 8) -> np.ndarray:
    """Weights (bucket x bigram, word, uniform) by expectation-maximisation; the driver sees one row a bucket and round."""
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    p = (F.when(F.col("cu") > 0, F.col("c2") / F.col("cu")).otherwise(0.0), F.col("c1") / F.lit(float(max(1, n_tokens))), F.lit(1.0 / (n_types + 1)))
    for _ in range(rounds):
        own = [F.element_at(F.array(*map(F.lit, weights[:, k].tolist())), (F.col("b") + 1).cast("int")) * p[k] for k in range(3)]
        share = events.select("b", "n", *(x.alias(f"x{k}") for k, x in enumerate(own))).withColumn("x", F.col("x0") + F.col("x1") + F.col("x2"))
        got = share.groupBy("b").agg(*(F.sum(F.col("n") * F.col(f"x{k}") / F.col("x")).alias(f"s{k}") for k in range(3))).collect()
        if not got:
            break
        total = np.array([[r.s0, r.s1, r.s2] for r in got]).sum(axis=0)
        weights[:] = total / total.sum()  # of buckets without events
        weights[0] = [0.0, *(total[1:] / total[1:].sum())]
        for r in got:
            s = np.array([r.s0, r.s1, r.s2])
            weights[r.b] = s / s.sum()
    weights = np.maximum(weights, 1e-9)
    weights[0, 0] = 0.0
    return weights / weights.sum(axis=1, keepdims=True)


def _scored(counted: DataFrame, weights: np.ndarray, n: int, v: int, id_type: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            at = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                row = {c: a[k].as_py() for c, a in at.items() if c != "ids"}
                tokens, sizes = unsqueeze(row["tokens"]).astype(np.int64), unsqueeze(row["sizes"]).astype(np.int64)
                words = unsqueeze(row["word_all"], 5).astype(np.float64)
                c1, cu = words[tokens], words[_contexts(tokens, sizes, row["end"])]
                w = weights[frequency_bucket(cu)]
                p = w[:, 0] * unsqueeze(row["bigram_all"], 5) / np.maximum(cu, 1) + w[:, 1] * c1 / max(1, n) + w[:, 2] / (v + 1)
                begin = np.cumsum(sizes) - sizes
                sums = lambda x: np.add.reduceat(x, begin)
                fold = unsqueeze(row["fold"], 1)
                yield pa.RecordBatch.from_arrays([
                    at["ids"][k].values, pa.array(fold == HELD_OUT), pa.array(sizes), pa.array(sums((c1 > 0).astype(np.int64))), pa.array(np.full(len(sizes), n)),
                    pa.array(sums(np.log10((c1 + 0.5) / (n + 0.5 * (v + 1))))), pa.array(sums(np.log10(p))),
                ], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return counted.select("ids", "sizes", "fold", "tokens", "end", "word_all", "bigram_all").mapInArrow(run, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Learns from rows whose crc32(id as text) mod 5 isn't 1; of these, a tenth is deleted while the weights are learned. A null text is the empty
    one, whose only token is its end; a null id counts as the empty text. Rows stand alone: ids may repeat, texts may have any
    length, further columns change nothing. Without training rows every word is unknown and the model is uniform; an empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    crc = F.crc32(F.coalesce(quoted(id_col).cast("string"), F.lit("")).cast("binary"))
    fold = F.when(crc % 5 == 1, HELD_OUT).when(F.floor(crc / 5) % 10 == 0, DELETED).otherwise(TRAIN)
    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), fold.cast("int").alias("fold"))
    n_buckets = max(shuffle_partitions(spark), -(-text_bytes(source) // BUCKET_BYTES))
    scratch = Scratch(spark, "lm")
    blocks = scratch.keep(_tokenised(source, id_type), "blocks")
    answers = scratch.keep(_answered(_sent(blocks, n_buckets)), "answers")
    n = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "n_all", "n_kept"))).first()
    counted = scratch.keep(_counted(blocks, answers, id_type), "counted")
    scratch.drop(blocks)
    scratch.drop(answers)
    events = scratch.keep(_events(counted), "events")
    weights = learn_weights(events, n.n_kept, n.types)
    scratch.drop(events)
    return _scored(counted, weights, n.n_all, n.types, id_type).withColumnRenamed("id", id_col)


def op1_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
