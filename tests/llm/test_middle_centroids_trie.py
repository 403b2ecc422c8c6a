"""Fill-in-middle, centroid clustering and BPE over a trie: brute force, DuckDB and the library."""

import hashlib
import random
import re
from array import array

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridmetric.llm import centroids, fim, triebpe

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "<P>", "x <S> y", "a<M", "<", "<S<P", "naïve \U0001f469‍\U0001f467 é", "line\r\nline\x00\x1c", "long " * 30_000, "a" * 70_000]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _same(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'' if 'testdata' in folder else '/*.parquet'}'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, folder).toPandas()[list(want.columns)]
    key = list(want.columns)
    text = lambda f: sorted(tuple("null" if pd.isna(v) else str(int(v)) if isinstance(v, (float, np.floating, int, np.integer)) else str(v) for v in r) for r in f[key].itertuples(index=False))
    assert text(got) == text(want) and len(got)


# Fill-in-middle


def _middle(doc_id, text):
    """What the contract says, with slices of the whole text."""
    text = text or ""
    digest = _sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or h3 % 100 >= 90 or any(m in text for m in fim.MARKS):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("name,tables", [("op11_fill_in_middle", ["documents"]), ("op12_centroids", ["embeddings"])])
def test_queries_match_sql(spark, data, name, tables):
    _same(spark, data, name, tables)


def test_middles_of_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD * 6)] + [(None, "no id"), (7, "the same id"), (7, "the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a.b": F.lit(1), "output": F.lit("x"), "digest": F.lit("y"), "id": F.lit(2)})
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()]
    want = [(d, *_middle(d, t), t or "") for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    named = docs.select(F.col("doc_id").alias("the.id"), F.col("text").alias("a.text"))
    assert fim.fill_in_middle(named, "the.id", "a.text").columns[0] == "the.id"
    assert fim.fill_in_middle(named, "the.id", "a.text").where("form = 'psm'").count() == sum(r[2] == "psm" for r in want)


@pytest.mark.parametrize("unit", [fim.CODE_POINT, r"\S+", r"[^\n]*\n|[^\n]+", "ab?"])
def test_matcher_walks_as_single_matches_do(unit):
    matcher, one = fim.UnitMatcher(unit), re.compile(unit)
    rng = random.Random(3)
    for size in (0, 1, 5, 255, 256, 257, 513, 4000, 20_000):
        text = "".join(rng.choice("ab b\né") for _ in range(size))
        ends = [m.end() for m in one.finditer(text)]
        assert matcher.count(text) == len(ends)
        for _ in range(20):
            a, b = sorted((rng.randint(0, len(ends)), rng.randint(0, len(ends))))
            at = matcher.advance(text, 0, a)
            assert at == (ends[a - 1] if a else 0)
            assert matcher.advance(text, at, b - a) == (ends[b - 1] if b > a else at)


def test_words_as_units_and_refused_marks(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(700 + k))) for k in range(40)], "doc_id long, text string")
    made = fim.fill_in_middle(docs, unit=r"\S+", transformed=100).withColumn("again", fim.restored(F.col("output"), F.col("form")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in made.collect():
        assert r.n == 700 + r.doc_id and r.again == texts[r.doc_id] and not texts[r.doc_id][: r.prefix_chars].endswith(" ")
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "x"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, marks=bad)
    for bad in ("x*", "(a)b"):
        with pytest.raises(ValueError):
            fim.UnitMatcher(bad)


# Centroids


def _lloyd(rows, k=16, rounds=3, dims=64):
    """Python integers, all distances."""
    kept = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (_sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))
    c = [list(v) for _, v in order[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    for _ in range(rounds + 1):
        near = [min((far(v, w), j) for j, w in enumerate(c)) for _, v in kept]
        final = [list(w) for w in c]
        for j in range(len(c)):
            own = [v for (_, v), (_, m) in zip(kept, near) if m == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    inertia = {j: sum(d for d, m in near if m == j) for j in range(len(c))}
    return [(i, m, d, inertia[m], sum(inertia.values()), _sha(",".join(map(str, final[m])))) for (i, _), (d, m) in zip(kept, near)]


def _clustered(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"a.b": F.lit(1), "cluster": F.lit("x"), "id": F.lit(2), "v": F.lit(3)})
    got = centroids.cluster_vectors(frame)
    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string"))), 256)
    return [tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest).collect()]


def test_clusters_of_odd_rows_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    f32 = lambda a: [float(np.float32(x)) for x in a]
    rows = [(i, f32(rng.normal(size=64) + (i % 5))) for i in range(150)]
    rows += [(200 + i, f32(np.full(64, 0.5))) for i in range(40)] + [(3, rows[3][1]), (3, f32(np.ones(64))), (None, rows[0][1]), (None, None)]
    rows += [(300, None), (301, []), (302, f32(np.ones(63))), (303, f32(np.ones(65))), (304, [None] + f32(np.ones(63))), (305, [float("nan")] + f32(np.ones(63))), (306, [float("inf")] + f32(np.ones(63)))]
    rows += [(400, f32(np.zeros(64))), (401, f32(-np.ones(64) / 128)), (402, [float(np.float32(3e6))] + f32(np.ones(63)))]
    assert sorted(_clustered(spark, rows), key=str) == sorted(_lloyd(rows), key=str)


def test_few_equal_and_no_vectors(spark):
    one = [0.25] * 64
    for rows in ([(1, one)], [(i, one) for i in range(40)], [(i, [float(i)] * 64) for i in range(7)]):
        assert sorted(_clustered(spark, rows)) == sorted(_lloyd(rows))
    assert _clustered(spark, []) == [] and _clustered(spark, [(1, None), (2, [1.0])]) == []
    named = spark.createDataFrame([(1, one)], "`the.id` long, `a.v` array<float>")
    assert centroids.cluster_vectors(named, "the.id", "a.v").columns[0] == "the.id"


def test_partial_distances_give_the_nearest_with_less_work():
    rng = np.random.default_rng(8)
    x = rng.integers(-200, 200, (3000, 64)) * np.where(np.arange(64) < 16, 10, 1)
    c = np.concatenate([x[:15], x[3:4]])  # a centroid twice: ties go to the smaller number
    full = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    order = np.argsort(-x.var(axis=0))
    cluster, far, terms = centroids.nearest_centroid(x, c, order)
    assert (cluster == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()
    assert terms < 0.6 * x.size * len(c)
    for step in (1, 7, 64, 100):
        again = centroids.nearest_centroid(x, c, order[::-1], step)
        assert (again[0] == cluster).all() and (again[1] == far).all()


# BPE over a trie


@pytest.fixture(scope="module")
def coded():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return triebpe.TrieEncoder(f.read()), Tokenizer.from_file(path)


def _compare(coded, texts):
    encoder, library = coded
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = encoder.encode(texts)
    assert [(t, a.tolist()) for t, a in zip(texts, got)] == list(zip(texts, want))
    assert [encoder.decode(a) for a in got] == [library.decode(b, skip_special_tokens=False).encode() for b in want]


def test_trie_equals_library(coded, data):
    import pyarrow.parquet as pq

    rng = random.Random(4)
    _compare(coded, [t or "" for t in pq.read_table(f"{data}/documents.parquet")["text"].to_pylist()])
    pool = ["<|endoftext|>", "<|endof", "\x1c", " ", "  ", "\n", "\t", "'s", "'LL", "é", "ß", "İ", "՘", "\U0003d000", "Ᲊ", "aaaa", "hello", "Ġ", "½", "👩‍👧", "́", "----", "x" * 300, "ing", "\x00", "…", "한국", "日本語"]
    _compare(coded, ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(4000)])
    _compare(coded, ["".join(rng.choice("abelotinrs") for _ in range(rng.randint(1, 60))) for _ in range(4000)])
    _compare(coded, [a * n for a in ("a", "ab", " ", "-", "\n", "zzz1") for n in (1, 2, 3, 5, 17, 255, 256, 257, 1000, 4097)])


def test_trie_knows_the_librarys_letters(coded):
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0 or 0x10000 <= c < 0x20000)]
    for k in range(0, len(every), 20_000):
        _compare(coded, [f"a{chr(c)}1{chr(c)}.{chr(c)}\n{chr(c)} " for c in every[k : k + 20_000]])


def test_prefixes_are_shared_and_the_trie_is_bounded(coded, monkeypatch):
    trie = coded[0].trie
    trie.clear()
    list(trie.encode_sorted([b"straight", b"straightly", b"straighten", b"strain"]))
    assert len(trie.token) == 1 + len(b"straightly") + len(b"en") + len(b"n")
    monkeypatch.setattr(triebpe, "NODES", 50)
    words = [f"word{k}xyz".encode() for k in range(500)]
    small = dict(trie.encode_sorted(words))
    assert len(trie.token) < 100
    monkeypatch.undo()
    assert small == dict(trie.encode_sorted(words))


def test_words_are_forgotten_by_generations(coded, monkeypatch):
    monkeypatch.setattr(triebpe, "WORDS", 20)
    coded[0].young, coded[0].old = {}, {}
    rng = random.Random(6)
    for _ in range(30):
        _compare(coded, [" ".join(rng.choice(["hello", "there", f"w{rng.randint(0, 99)}", "ab" * rng.randint(1, 9)]) for _ in range(30)) for _ in range(5)])
        assert len(coded[0].old) < 200


def test_trie_rows(spark, coded):
    rows = [(k, t) for k, t in enumerate([*ODD, "see <|endoftext|> there", "<|endoftext|>"])] + [(None, "no id"), (7, "the same id"), (7, "the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a.b": F.lit(1), "ids": F.lit("x"), "id": F.lit(2), "decoded": F.lit(3)})
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        file = f.read()
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in triebpe.encode_by_trie(docs, file).collect()]
    want = []
    for d, t in rows:
        ids = coded[1].encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), array("I", ids).tobytes(), (t or "").encode()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert triebpe.encode_by_trie(docs.limit(0), file).count() == 0
    named = docs.select(F.col("doc_id").cast("string").alias("the.id"), F.col("text").alias("a.text"))
    out = triebpe.encode_by_trie(named, file, "the.id", "a.text")
    assert out.columns[0] == "the.id" and out.agg(F.sum("n_tokens")).first()[0] == sum(w[1] for w in want)


def test_other_files_are_refused():
    for name in ("word_bpe_49k.json",):
        with open(public_tokenizers.path(name), "rb") as f, pytest.raises(ValueError):
            triebpe.TrieEncoder(f.read())


def test_trie_query_reads_every_document(spark, data, coded):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in __spark_entry__.queries()["op13_trie_bpe"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    for r in docs:
        ids = coded[1].encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), _sha(r.text or ""))
    assert len(got) == len(docs)
