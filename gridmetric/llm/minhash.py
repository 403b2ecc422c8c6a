"""Near-duplicates by bottom-k sketches from one hash function.

A document's sketch is the k least hashes of its word shingles. Inverted lists of retained values give candidates; a union-sketch
estimate drops most; exact Jaccard on full shingle sets confirms the rest. Copies with one shingle set are a single node.

Lists use the rarest retained values: two sketches of s values that share c of them must share one of each one's s - c + 1 rarest. c follows from
the similarity asked for, so that a linked pair shares fewer at a chance of one in a billion. Short lists are joined with themselves. Members of a long list first meet its leader; then only members of different
components are compared, in chunks, each two under the least value that they share, and a spanning forest of their links is kept, so that neither a
large group of near copies nor a passage in many documents makes a row for each pair.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmetric.llm.common import Scratch, mix64, pieces, quoted, table, texts
from gridmetric.llm.components import components

#: Retained values: KEYS of them make inverted lists; K are compared for a pair, WIDE within a chunk. Lists above LONG go by leader and chunks of CHUNK,
#: and of about CHUNK_BYTES where whole sets are compared.
KEYS, K, WIDE, LONG, CHUNK, CHUNK_BYTES = 32, 128, 512, 24, 1024, 8 << 20
#: Chance at which a linked pair may share fewer keys than asked for, and standard deviations that its estimate may lie too low.
MISS, SIGMAS = 1e-9, 6


def shared_keys(jaccard: float, keys: int = KEYS) -> int:
    """The most keys that a pair of this similarity has in common but for a chance of MISS (keys in common are binomial)."""
    total = 0.0
    for c in range(keys + 1):
        total += comb(keys, c) * jaccard**c * (1 - jaccard) ** (keys - c)
        if total > MISS:
            return max(1, c)
    return keys


def shingle_sets(batch_texts: list[str], width: int) -> list[np.ndarray]:
    """Ordered distinct hashes of each text's word shingles; fewer words than width are one shingle, none are none."""
    seen: dict[bytes, int] = {}
    out = []
    for t in batch_texts:
        words = t.encode().lower().split()
        ids = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            ids.append(h)
        if not ids:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.array(ids, np.uint64)
        k = min(width, len(h))
        n = len(h) - k + 1
        acc = np.full(n, np.uint64(k))
        with np.errstate(over="ignore"):
            for j in range(k):
                acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
        out.append(np.unique(acc))
    return out


def overlaps(sa: list[np.ndarray], sb: list[np.ndarray]) -> np.ndarray:
    """Common values of each of the sets sa (rows) and each of sb (columns)."""
    _, code = np.unique(np.concatenate([*sa, *sb]), return_inverse=True)
    row = np.repeat(np.arange(len(sa) + len(sb)), [len(s) for s in (*sa, *sb)])
    in_a = row < len(sa)
    shared = np.intersect1d(code[in_a], code[~in_a])
    common = np.zeros((len(sa), len(sb)), np.float32)
    if not len(shared):
        return common
    column = np.full(code.max() + 1, -1)
    column[shared] = np.arange(len(shared))
    col = column[code]
    for at in range(0, len(shared), 4096):
        part = (col >= at) & (col < at + 4096)
        width = min(4096, len(shared) - at)
        xa, xb = np.zeros((len(sa), width), np.float32), np.zeros((len(sb), width), np.float32)
        xa[row[part & in_a], col[part & in_a] - at] = 1
        xb[row[part & ~in_a] - len(sa), col[part & ~in_a] - at] = 1
        common += xa @ xb.T
    return common


def estimates(sa: list[np.ndarray], na: np.ndarray, sb: list[np.ndarray], nb: np.ndarray, jaccard: float, k: int, common: np.ndarray | None = None) -> np.ndarray:
    """Pairs (a rows, b rows) whose sketches allow the similarity, but for a chance of about one in a billion.

    Up to the lesser end of both sketches all values of both sets are known; the share of common ones among them estimates the
    similarity. A set no larger than k, the size of a sketch, is known whole.
    """
    top = np.uint64(2**64 - 1)
    end_a, end_b = (np.array([s[-1] if n > k else top for s, n in zip(x, sizes)], np.uint64) for x, sizes in ((sa, na), (sb, nb)))
    common = overlaps(sa, sb) if common is None else common
    count_a = np.stack([np.searchsorted(s, end_b, side="right") for s in sa])
    count_b = np.stack([np.searchsorted(s, end_a, side="right") for s in sb]).T
    seen = np.maximum(count_a + count_b - common, 1)
    union = (na[:, None] + nb[None, :]) / (1 + jaccard)
    spread = np.sqrt(jaccard * (1 - jaccard) / seen * np.maximum(0, 1 - seen / union))
    sizes = np.minimum(na[:, None], nb[None, :]) >= jaccard * np.maximum(na[:, None], nb[None, :])
    return sizes & (common / seen >= jaccard - SIGMAS * spread - np.where(seen < union, 1 / seen, 1e-6))


def _sets(docs: DataFrame, width: int, whole: bool, id_type: str) -> DataFrame:
    """id, n, node (hash of the set; null if empty) of each row, with its keys or its whole set."""

    def run(batches):
        for batch in pieces(batches, "text"):
            sets = shingle_sets(texts(batch, "text"), width)
            cols = {"id": batch.column("id"), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())}
            if whole:
                cols["full"] = pa.array([s.tobytes() for s in sets], pa.binary())  # a sketch is the beginning of it
            else:
                cols["keys"] = pa.array([s[:KEYS].view(np.int64).tolist() for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch(cols)

    return docs.mapInArrow(run, f"id {id_type}, n long, node binary, " + ("full binary" if whole else "keys array<long>"))


def _lists(reps: DataFrame, jaccard: float) -> DataFrame:
    """value, node, n: each node under the rarest of its keys that other nodes have too."""
    entries = reps.select("node", "n", F.size("keys").alias("s"), F.explode("keys").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    own = entries.join(shared, "value")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "value"))
    have = F.count("*").over(Window.partitionBy("node"))
    prefix = F.col("s") - F.greatest(F.lit(1), F.floor(F.col("s") * shared_keys(jaccard) / KEYS)) + 1  # of all keys; those that no other node has come first
    return own.select("value", "node", "n", "s", rank.alias("rank"), have.alias("have")).where(F.col("rank") <= prefix - (F.col("s") - F.col("have"))).select("value", "node", "n")


def _size_fits(jaccard: float):
    return F.least("na", "nb") >= jaccard * F.greatest("na", "nb")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity; a sketch estimate comes first."""

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                sa, sb = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("sa", "sb"))
                na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                keep = [bool(estimates(sa[i : i + 1], na[i : i + 1], sb[i : i + 1], nb[i : i + 1], percent / 100, K)[0, 0]) for i in range(batch.num_rows)]
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side, *cols: full.select(F.col("node").alias(side), *(F.col(c).alias(n) for c, n in cols))
    short = full.withColumn("sketch", F.expr(f"substring(full, 1, {8 * K})"))
    side = lambda x: short.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x))
    with_sketches = pairs.join(side("a"), "a").join(side("b"), "b")
    passed = with_sketches.mapInArrow(likely, "a binary, b binary")
    return passed.join(of("a", ("full", "fa")), "a").join(of("b", ("full", "fb")), "b").select("a", "b", "fa", "fb").mapInArrow(exact, "a binary, b binary")


def _chunk_pairs(members: DataFrame, percent: int, whole: bool) -> DataFrame:
    """value, a, b: links between members of different components in one long list, chunk against chunk.

    members: value, chunks (of its list), node, component, n, set (whole, or the WIDE least of it) and before (the lesser values that the member is listed
    under, in which it meets the others there). Of the links found under one value only a spanning forest is returned. Without whole sets, members of
    pairs that sketches don't decide come as rows (value, a, null), each once a chunk pair, so that rows never grow with the pairs.
    """
    dealt = members.withColumn("c", F.pmod(F.xxhash64("node"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("value", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "node", "component", "n", "set", "before")

    def compare(t: pa.Table) -> pa.Table:
        value, i, j = (t[x][0].as_py() for x in ("value", "i", "j"))
        c, node = t["c"].to_numpy(), t["node"].to_pylist()
        comp = np.unique(np.array(t["component"].to_pylist(), object), return_inverse=True)[1]
        sets, n = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()], t["n"].to_numpy().astype(float)
        before = [np.array(x, np.int64) for x in t["before"].to_pylist()]
        a, b = np.flatnonzero(c == i), np.flatnonzero(c == j)
        links, open_ = [], set()
        if len(a) and len(b):
            todo = (comp[a][:, None] != comp[b][None, :]) & (overlaps([before[x] for x in a], [before[x] for x in b]) == 0)
            a, b, todo = a[todo.any(axis=1)], b[todo.any(axis=0)], todo[todo.any(axis=1)][:, todo.any(axis=0)]
        if len(a) and len(b):
            sa, sb = [sets[x] for x in a], [sets[x] for x in b]
            common = overlaps(sa, sb)
            if not whole:
                todo &= estimates(sa, n[a], sb, n[b], percent / 100, WIDE, common)
            known = np.full(todo.shape, True) if whole else (n[a] <= WIDE)[:, None] & (n[b] <= WIDE)[None, :]
            sure = 100.0 * common >= percent * (n[a][:, None] + n[b][None, :] - common)
            root = list(range(int(comp.max()) + 1))

            def find(k):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for p, q in zip(*(x.tolist() for x in np.nonzero(todo & known & sure))):
                if (r := find(comp[a[p]])) != (s := find(comp[b[q]])):
                    links.append((node[a[p]], node[b[q]]))
                    root[r] = s
            for p, q in zip(*(x.tolist() for x in np.nonzero(todo & ~known))):
                if find(comp[a[p]]) != find(comp[b[q]]):
                    open_ |= {a[p], b[q]}
        left, right = [u for u, _ in links] + [node[x] for x in sorted(open_)], [v for _, v in links] + [None] * len(open_)
        return pa.table({"value": pa.array([value] * len(left), pa.int64()), "a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return dealt.groupBy("value", "i", "j").applyInArrow(compare, "value long, a binary, b binary")


def _long_links(members: DataFrame, full: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between members (value, node, component) of different components in long lists.

    Sketches come first. Those members alone that a sketch leaves open meet again with their whole sets, in chunks of bounded bytes.
    """

    def met(rows: DataFrame, of: str, chunks) -> DataFrame:
        sized = rows.join(full.select("node", "n"), "node")
        lists = sized.groupBy("value").agg(F.greatest(F.ceil(F.count("*") / CHUNK), chunks).cast("int").alias("chunks"))
        values = sized.join(lists, "value").groupBy("node", "component").agg(F.sort_array(F.collect_list(F.struct("value", "chunks"))).alias("in"))
        every = values.join(full.select("node", "n", F.expr(of).alias("set")), "node").select("*", F.posexplode("in").alias("nth", "one"))
        return every.select("one.*", "node", "component", "n", "set", F.transform(F.slice("in", 1, F.col("nth")), lambda x: x["value"]).alias("before"))

    found = scratch.keep(_chunk_pairs(met(members, f"substring(full, 1, {8 * WIDE})", F.lit(1)), percent, False), "found")
    links, open_ = found.where(F.col("b").isNotNull()), found.where(F.col("b").isNull()).select("value", F.col("a").alias("node")).distinct()
    again = met(members.join(open_, ["value", "node"]), "full", F.ceil(F.sum("n") * 8 / CHUNK_BYTES))
    out = scratch.keep(links.select("a", "b").union(_chunk_pairs(again, percent, True).select("a", "b")).distinct(), "more")
    scratch.drop(found)
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id and kept of every row.

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct word shingles (words: A-Z lower-cased, between
    bytes 0x20 and 0x09-0x0D; fewer than width words are one shingle). component_id is the least id reachable over links; kept: it is the row's own.
    A text that is null, empty or blank has no shingle and is linked with nothing. Rows with one set are linked, repeated ids among them; a row
    with a null id is linked with nothing. Texts may have any length, further columns change
    nothing, and an empty table gives an empty one.
    """
    spark, jaccard = docs.sparkSession, percent / 100
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    scratch = Scratch(spark, "minhash")
    sets = scratch.keep(_sets(source, width, False, id_type).withColumn("node", F.when(F.col("id").isNotNull(), F.col("node"))), "sets")
    nodes = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"))
    reps = sets.where(F.col("node").isNotNull()).join(nodes, ["node", "id"]).dropDuplicates(["node"])
    lists = scratch.keep(_lists(reps.select("node", "n", "keys"), jaccard), "lists")
    sizes = lists.groupBy("value").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("leader")).where(F.col("size") > 1)
    short = lists.join(sizes.where(F.col("size") <= LONG).select("value"), "value")
    left, right = (short.select("value", F.col("node").alias(x), F.col("n").alias("n" + x)) for x in "ab")
    pairs = left.join(right, "value").where((F.col("a") < F.col("b")) & _size_fits(jaccard)).select("a", "b")
    long = scratch.keep(lists.join(sizes.where(F.col("size") > LONG), "value").select("value", "node", "n", "size", "leader"), "long")
    led = long.select(F.col("leader.node").alias("a"), F.col("node").alias("b"), F.col("leader.n").alias("na"), F.col("n").alias("nb"))
    led = led.where((F.col("a") != F.col("b")) & _size_fits(jaccard)).select("a", "b")
    first = scratch.keep(pairs.union(led).distinct(), "pairs")
    # Whole sets and sketches of the nodes that may be linked.
    wanted = first.select(F.col("a").alias("node")).union(first.select("b")).union(long.select("node")).distinct()
    ids = wanted.join(nodes, "node").select("id", F.col("node").alias("wanted"))
    full = scratch.keep(_sets(source.join(ids.select("id").distinct(), "id").select("id", "text"), width, True, id_type).dropDuplicates(["node"]), "full")
    links = scratch.keep(_confirmed(first, full, percent), "links")
    if not long.isEmpty():
        of = scratch.keep(components(links, scratch), "components")
        members = long.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = members.groupBy("value").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("value")
        members = scratch.keep(members.join(mixed, "value").select("value", "node", "component"), "members")
        more = _long_links(members, full, percent, scratch)
        links = links.union(more)
        scratch.drop(of)
        scratch.drop(members)
    for done in (lists, long, first, full):
        scratch.drop(done)
    of = components(links, scratch)
    named = nodes.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    final = scratch.keep(named.join(least, "component").select("node", "component_id"), "final")
    out = sets.select("id", "n", "node").join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op6_bottom_k_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))
