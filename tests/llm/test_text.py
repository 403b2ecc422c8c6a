"""Text operators against brute force, libraries and round trips, with nulls, empties, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridmetric.llm import bpe, components, langid, linededup, lm, minhash, packing, secrets, tokens
from gridmetric.llm.common import Scratch

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component long"
LONG = "Lorem ipsum dolor sit amet, consectetur. " * 4000
ODD = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "the quick brown fox jumps over the lazy dog"), (5, "the quick brown fox jumps over the lazy dog"), (6, "THE QUICK brown fox jumps over the lazy cat"),
       (7, "été déjà vu\x1c 日本語 🙂 \u3000x\u00a0y don't it's  double  spaces\r\n1234567"), (8, LONG), (None, "a row without an id but with text"), (9, "one"), (9, "one"), (10, "<|endoftext|> <s> |a|b|!!"), (11, "x" * 3000)]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else "fr", None, 0, 1.0, 5) for i, t in rows], DOCS)


def sample(spark, data, n=150):
    return spark.read.parquet(f"{data}/documents.parquet").where(F.col("doc_id") < n)


def words(t):
    return (t or "").encode().lower().split()


# BPE


def test_bpe_equals_the_library_and_decodes(spark, data):
    import base64

    import tiktoken

    raw = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    both = docs(spark).select("doc_id", "text").union(sample(spark, data, 60).select("doc_id", "text"))
    got = bpe.encode_documents(both, raw, P.PATTERN).toPandas()
    want = collections.Counter((r.doc_id, np.array(lib.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in both.collect())
    assert collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got.itertuples()) == want
    assert bpe.encode_documents(both.limit(0), raw, P.PATTERN).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert h.lookup(keys).tolist() == list(range(5000)) and sorted(h.slot_value.tolist()) == list(range(5000))
    assert (h.lookup([b"none", b""]) == -1).all()


# Packing


def _as_the_library(texts):
    """Ids as the file is loaded, nothing altered."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    ids, n = tokens.WordTokenizer(open(path, "rb").read()).encode(pa.array(texts))
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [(t, a) for t, a in zip(texts, got)] == list(zip(texts, want))


def test_word_tokenizer_equals_the_library(spark, data):
    some = [x or "" for _, x in ODD] + [r.text for r in sample(spark, data, 60).collect()] + ["DON'T 'S it's, (x) a.b,c", "ǅ ΣΑΣ İx straße éa ́x", "İ. ALİ. ALİ!", "a <|endoftext|> b<|startoftext|>c. <|ENDOFTEXT|>"]
    _as_the_library(some)


def test_word_tokenizer_on_random_texts():
    rng = random.Random(7)
    words = ["İ", "ALİ", "Straße", "Été", "ſ", "Σ", "ΑΣ", "don't", "'S", "x", "12", "½", "́", "\u0307", "<|endoftext|>", "<|startoftext|>", "<|end", "|>", "\t", "\n", "  ", " ", "\u00a0", "\x1c", ".", ",", "!", "|", "*", "\"", "ı", "ŉ", "ǰ", "é", "한", "🙂"]
    for _ in range(10):
        _as_the_library(["".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(10_000)])


def _check_packing(rows, limits=(2048, 256, 2048), loss_of=lambda d: True):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == list(itertools.accumulate([0] + [r.length for r in seq[:-1]]))
        assert sum(r.length for r in seq) <= limits[0] and len(seq) <= limits[1]
        assert sum(r.length for r in seq if loss_of(r.doc_id)) <= limits[2]
    return by_doc, by_seq


def test_packing_keeps_every_token_once(spark, data):
    file = open(P.path("word_bpe_49k.json"), "rb").read()
    source = sample(spark, data).union(docs(spark, [(1000 + k, t) for k, (_, t) in enumerate(ODD)]).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = packing.pack_tokens(source, file).collect()
    by_doc, by_seq = _check_packing(rows)
    t = tokens.WordTokenizer(file)
    for r in source.collect():
        own = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in own])
        assert ids.tolist() == [*t.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert [p.start for p in own] == list(itertools.accumulate([0] + [p.length for p in own[:-1]])) and own[0].doc_tokens == len(ids)
    lengths = [sum(r.length for r in s) for s in by_seq.values()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths)  # nothing is padded
    assert packing.pack_tokens(source.limit(0), file).count() == 0


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_packing_of_any_ids(spark, kind):
    file = open(P.path("word_bpe_49k.json"), "rb").read()
    df = spark.createDataFrame([(1, "a b", 3), (None, None, 4)], "n int, text string, length int").withColumn("doc_id", F.col("n").cast(kind))
    got = packing.pack_tokens(df, file)
    assert dict(got.dtypes)["doc_id"] == {"int": "int", "long": "bigint", "string": "string"}[kind]
    assert {r.doc_id: r.doc_tokens for r in got.collect()} == {(1 if kind != "string" else "1"): 3, None: 1}


def test_packing_in_small_windows(spark, data):
    file = open(P.path("word_bpe_49k.json"), "rb").read()
    rows = packing.pack_tokens(sample(spark, data), file, window_tokens=3000).collect()
    by_doc, by_seq = _check_packing(rows)
    assert all(sum(p.length for p in own) == own[0].doc_tokens for own in by_doc.values())
    lengths = [sum(r.length for r in s) for s in by_seq.values()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths)


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError, match="lower-case"):
        tokens.WordTokenizer(open(P.path("byte_bpe_50k.json"), "rb").read())


def test_packing_holds_all_limits(spark):
    file = open(P.path("word_bpe_49k.json"), "rb").read()
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["cat"] * int(rng.integers(0, 300))), bool(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bears boolean")
    got = packing.pack_tokens(df, file, loss_col="bears", tokens=512, segments=5, loss=200).collect()
    by_doc, _ = _check_packing(got, (512, 5, 200), lambda d: bool(d % 3))
    assert all(sum(p.length for p in by_doc[i]) == len(t.split()) + 1 for i, t, _ in rows)


# Language models and language ID


def test_lm_counts_and_gain(spark, data):
    source = sample(spark, data, 200).select("doc_id", "text")
    source = source.union(docs(spark, [(5000 + k, t) for k, (_, t) in enumerate(ODD)]).select("doc_id", "text"))
    got = lm.score_documents(source).toPandas()
    count = collections.Counter()
    for r in source.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            count.update([*words(r.text), None])
    n, v = sum(count.values()), len(count)
    want = {}
    for r in source.collect():
        w = [*words(r.text), None]
        want[r.doc_id] = (len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    for r in got.itertuples():
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and abs(r.base_score - want[r.doc_id][2]) < 1e-6 and r.train_tokens == n
    held = got[got.held_out]
    assert len(held) and held.score.sum() > held.base_score.sum() and (got.score < 0).all()


def test_lm_scores_equal_brute_force(spark, data, monkeypatch):
    """The mixture on counts of all training texts, with the weights that the operator learned."""
    learned = []
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a, **k: learned.append(learn(*a, **k)) or learned[-1])
    source = sample(spark, data, 120).select("doc_id", "text").union(docs(spark, [(5000 + k, t) for k, (_, t) in enumerate(ODD)]).select("doc_id", "text"))
    got = {r.doc_id: r.score for r in lm.score_documents(source).collect()}
    uni, bi, rows = collections.Counter(), collections.Counter(), source.collect()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            w = ["<s>", *words(r.text), "</s>"]
            uni.update(w[1:])
            bi.update(zip(w, w[1:]))
    uni["<s>"] = uni["</s>"]  # as many beginnings as ends
    n, v = sum(uni.values()) - uni["<s>"], len(uni) - 1
    for r in rows:
        w, total = ["<s>", *words(r.text), "</s>"], 0.0
        for u, x in zip(w, w[1:]):
            a = learned[0][0 if not uni[u] else 1 + int(math.log2(uni[u]))]
            total += math.log10(a[0] * bi[u, x] / max(1, uni[u]) + a[1] * uni[x] / n + a[2] / (v + 1))
        assert abs(got[r.doc_id] - total) < 1e-6 * max(1, abs(total))


def test_lm_without_rows(spark):
    assert lm.score_documents(docs(spark).limit(0)).count() == 0
    one = lm.score_documents(docs(spark, [(None, None), (None, "a b a b")])).toPandas().sort_values("n_tokens")
    assert one.n_tokens.tolist() == [1, 5] and one.doc_id.isna().all() and np.isfinite(one.score).all()


def test_em_finds_the_mixture(spark):
    rng = np.random.default_rng(0)
    rows = [(3, int(c2), 6, int(c1), 1) for c2, c1 in zip(rng.integers(0, 6, 500), rng.integers(1, 50, 500))]
    w = lm.learn_weights(spark.createDataFrame(rows, "b long, c2 long, cu long, c1 long, n long"), 1000, 100, 30)
    p = np.array([(c2 / 6, c1 / 1000, 1 / 101) for _, c2, _, c1, _ in rows])
    best = max(np.log(p @ np.array([a, b, 1 - a - b])).sum() for a in np.arange(0.01, 1, 0.03) for b in np.arange(0.01, 1 - a, 0.03))
    assert np.log(p @ w[3]).sum() >= best - 0.5 and abs(w[3].sum() - 1) < 1e-9


def _phrases(text, probe):
    n = i = 0
    while i < len(probe):
        k = 1
        while i + k <= len(probe) and probe[i : i + k] in text:
            k += 1
        n, i = n + 1, i + max(1, k - 1)
    return n


def test_suffix_automaton_phrases():
    text, probe = b"abracadabra alakazam", b"cadabram alaq bra"
    assert langid.CrossParser({"x": text}).phrases([probe]).tolist() == [[_phrases(text, probe)]]


@pytest.mark.parametrize("letters", ["ab", "abcdefg "])
def test_parses_go_on_over_lanes(letters):
    rng = np.random.default_rng(5)
    random = lambda n, of: "".join(rng.choice(list(of), n)).encode()
    samples = {"x": random(300, letters), "y": b"ab" * 100 + b"c" * 50}
    probes = [random(int(n), letters + "z") for n in rng.integers(1, 700, 30)] + [b"ab" * 2000, b"c" * 333, samples["x"] * 20, b"ba" * 200 + b"c" * 99]
    want = [[_phrases(samples[k], p) for k in "xy"] for p in probes]
    for block in (7, 64, langid.BLOCK):
        assert langid.CrossParser(samples).phrases(probes, block).tolist() == want


def test_letters_and_unequal_samples(spark):
    samples = {"a": b"the cat sat on the mat " * 400, "b": b"le chat est sur le tapis "}
    rows = [(1, "½ ②"), (2, "Ⅷ ³ 12"), (3, "le chat sur le tapis"), (4, "the cat on the mat"), (5, "一"), (6, "½a")]
    got = {r.doc_id: r for r in langid.identify(docs(spark, rows), samples).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].phrase_rate is None and got[1].score == 0
    assert got[3].lang_pred == "b" and got[4].lang_pred == "a" and got[5].lang_pred != "und" and got[6].lang_pred != "und"
    clean = langid.normalise(rows[2][1])
    parser = langid.CrossParser(samples)
    cost = {k: _phrases(samples[k], clean) * math.log2(len(samples[k])) for k in samples}
    assert np.allclose(parser.costs([clean])[0], [cost["a"], cost["b"]]) and got[3].lang_pred == min(cost, key=cost.get)


def test_samples_share_their_length(spark):
    assert langid._shared_out([100, 3, 50, 7], 40) == [15, 3, 15, 7] and langid._shared_out([2, 3], 40) == [2, 3] and langid._shared_out([], 5) == []
    rows = [(i, ("x" if i else "y ") * (10_000 if i == 0 else 30)) for i in range(0, 14, 2)]
    got = langid.learn_samples(docs(spark, rows), chars_per_language=400)
    assert got["fr"].count(b"x" * 30) == 6 and len(got["fr"]) == 406  # and a space between two texts
    rows = [(i, "the cat sat on the mat and the dog lay by the door " * 3) for i in range(0, 40, 2)] + [(40, "Это русский текст о погоде и людях, который никто не учил здесь никогда")]
    got = langid.learn_samples(docs(spark, rows))
    assert langid.normalise("русский") not in got["fr"] and got["fr"].count(b"the cat") == 60


def test_many_labels_and_repeated_ids(spark):
    """The most frequent labels are learned, and of an id's many rows no more than the sample wants."""
    rows = [(k, f"words of language number {k % 300} are {k % 300} times the same", f"l{k % 300:03}") for k in range(900)] + [(9000 + k, "more of these", "l299") for k in range(5)]
    samples = langid.learn_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(samples) == {f"l{k:03}" for k in [*range(255), 299]}
    same = spark.range(5000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("a text of its own "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    own = langid.learn_samples(same)["en"]
    assert len(own) <= 32_768 and own.count(b"text of its own") == langid.SAMPLE_DOCS


def test_rate_limits_reject_foreign_texts(spark, data):
    all_ = sample(spark, data, 200)
    samples = langid.learn_samples(all_, docs_per_language=20)
    own = all_.withColumn("id2", F.col("doc_id"))
    limits = {k: v for k, v in langid.learn_rate_limits(own, samples).items()}
    assert langid.learn_rate_limits(all_.limit(0), samples) == {} and all(v > 0 for v in limits.values())
    foreign = "Это русский текст о погоде и людях, который никто не учил здесь никогда прежде"
    r = langid.identify(docs(spark, [(1, foreign)]), samples).first()
    assert r.phrase_rate > max(limits.values(), default=0.6)


def test_language_id_held_out(spark, data):
    all_ = sample(spark, data, 200)
    samples = langid.learn_samples(all_.where(langid.fold("doc_id", 4) != 2))
    got = langid.identify(all_.where(langid.fold("doc_id", 4) == 2), samples).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    odd = {r.doc_id: r for r in langid.identify(docs(spark), samples).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[2].lang_pred == "und" and odd[0].score == 0 and odd[8].lang_pred != "und"
    assert langid.identify(docs(spark).limit(0), samples).count() == 0
    none = langid.identify(docs(spark), langid.learn_samples(docs(spark).limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


# Near duplicates


def _brute_components(rows, percent):
    sets = [(d, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset()) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and sets[i][0] is not None and sets[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
            parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        least[find(i)].append(d)
    return collections.Counter((d, len(s), min(least[find(i)]) if d is not None else None) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("percent", [85, 60])
def test_near_duplicates_equal_brute_force(spark, data, percent):
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(r.doc_id, r.text) for r in sample(spark, data, 120).collect()] + [(None if i is None else 1000 + i, t) for i, t in ODD]
    base = [vocab[i] for i in rng.integers(0, 400, 80)]
    for k in range(70):  # a group of near copies, long lists and chains
        w = list(base)
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, 80))] = f"n{rng.integers(0, 10**6)}"
        rows.append((2000 + k, " ".join(w)))
    passage = " ".join(vocab[i] for i in rng.integers(0, 400, 60))
    rows += [(3000 + k, passage + " " + " ".join(f"p{x}" for x in rng.integers(0, 10**6, int(rng.integers(5, 60))))) for k in range(50)]
    got = minhash.near_duplicates(docs(spark, rows), percent).collect()
    want = _brute_components(rows, percent)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(docs(spark).limit(0)).count() == 0
    assert [r.component_id for r in minhash.near_duplicates(docs(spark, [(3, None), (2, "")])).collect()] in ([3, 2], [2, 3])


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (50, 50)], "a long, b long")
    got = {r.node: r.component for r in components.components(links, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_shared_keys_are_seldom_missed():
    for jaccard in (0.85, 0.8, 0.6):
        c = minhash.shared_keys(jaccard)
        below = sum(math.comb(32, k) * jaccard**k * (1 - jaccard) ** (32 - k) for k in range(c))
        assert 1 <= c < 32 and below <= minhash.MISS


# Lines


def _brute_lines(rows, percent=80):
    lines = [(d, k, x, list(dict.fromkeys(w for w in x.lower().split(" ") if w))) for d, t in rows if d is not None and t is not None for k, x in enumerate(t.split("\n"))]
    part = [(d, k, frozenset(w)) for d, k, x, w in lines if re.search(r"[^ \t\n\x0b\f\r]", x)]
    gone = collections.defaultdict(set)
    part.sort(key=lambda r: r[:2])
    for j, (d, k, w) in enumerate(part):
        if any(100 * len(w & v) >= percent * len(w | v) for _, _, v in part[:j]):
            gone[d].add(k)
    return gone


def test_lines_equal_brute_force(spark, data):
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(r.doc_id, r.text) for r in sample(spark, data, 60).collect()] + [(1000 + i, t) for i, t in [x for x in ODD if x[0] is not None][:9]]
    base = [vocab[i] for i in rng.integers(0, 300, 40)]
    for k in range(120):  # a long list of near copies
        w = list(base)
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, 40))] = f"n{rng.integers(0, 10**6)}"
        rows.append((2000 + k, "head\n" + " ".join(w) + "\n\n" + " ".join(vocab[i] for i in rng.integers(0, 300, int(rng.integers(1, 90))))))
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    want = _brute_lines(rows)
    for d, t in rows:
        assert set(got[d].removed) == want[d], d
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d])
        assert got[d].text == kept and got[d].n_lines == (0 if t is None else len(t.split("\n")))


def test_short_lines_take_part(spark):
    rows = [(1, "Les.\nA\n\n \r\na b c d\nles."), (2, "Les.\n\n \r\nd c b a\na b c d e\nb a"), (3, "x\nA B\na b c")]
    got = {r.doc_id: (r.removed, r.text) for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: ([5], rows[0][1][: -len("\nles.")]), 2: ([0, 3, 4], "\n \r\nb a"), 3: ([1], "x\na b c")}
    cut = {r.doc_id: r.removed for r in linededup.dedup_lines(docs(spark, rows), min_chars=5).collect()}
    assert cut == {1: [], 2: [3, 4], 3: []}


def test_all_lines_equal_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in sample(spark, data, 200).collect()]
    part, want = [], collections.defaultdict(set)
    for d, k, w in sorted((d, k, sorted({w for w in x.lower().split(" ") if w})) for d, t in rows if t for k, x in enumerate(t.split("\n")) if x.strip()):
        w = frozenset(w)
        if any(100 * len(w & v) >= 80 * len(w | v) for v in part):
            want[d].add(k)
        part.append(w)
    got = {r.doc_id: set(r.removed) for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {d: want[d] for d, _ in rows}
    lines = {d: (t or "").split("\n") for d, t in rows}
    assert any(len(lines[d][k]) < 20 for d, at in want.items() for k in at)


def test_lines_with_clashing_columns(spark):
    rows = [(1, "a b c d e\nx", 1, "s", "t", "u"), (2, "a b c d e f\ny", 2, "s", "t", "u")]
    names = ["id", "text", "part", "stay_at", "row", "line"]
    got = linededup.dedup_lines(spark.createDataFrame([(*r[:3], *r[3:]) for r in rows], "id long, text string, part int, stay string, row string, line string").toDF(*["id", "text", "part", "stay", "row", "line"]), id_col="id").collect()
    assert {r.id: (r.removed, r.text, r.part, r.stay, r.row, r.line) for r in got} == {1: ([], rows[0][1], 1, "s", "t", "u"), 2: ([0], "y", 2, "s", "t", "u")}
    own = spark.createDataFrame([(r[0], r[1]) for r in rows], "`a.b` long, `t t` string").withColumn("n_lines", F.lit("old")).withColumn("stay_at", F.lit(1)).withColumn("_part", F.lit(2))
    got = linededup.dedup_lines(own, id_col="a.b", text_col="t t").collect()
    assert {r["a.b"]: (r["n_lines"], r["stay_at"], r["_part"], r["removed"]) for r in got} == {1: (2, 1, 2, []), 2: (2, 1, 2, [0])} and len(names) == 6


def test_long_lists_equal_brute_force(spark, monkeypatch):
    """Lists count as long from two members of the sample on, so leaders and the rest are both taken."""
    monkeypatch.setattr(linededup, "OFTEN", 2)
    monkeypatch.setattr(linededup, "LEADERS", 2)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for k in range(150):
        w = list(base)
        for at in rng.choice(30, int(rng.integers(0, 6)), replace=False):
            w[at] = f"v{rng.integers(0, 12)}"
        rows.append((k, " ".join(w) + "\n" + " ".join(f"u{x}" for x in rng.integers(0, 60, int(rng.integers(5, 12))))))
    got = {r.doc_id: set(r.removed) for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    want = _brute_lines(rows)
    assert got == {d: want[d] for d, _ in rows}


def test_lines_odd_rows(spark):
    got = linededup.dedup_lines(docs(spark)).collect()
    assert len(got) == len(ODD) and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "score", "component", "n_lines", "removed"}
    assert next(r for r in got if r.doc_id is None).text == "a row without an id but with text"
    assert linededup.dedup_lines(docs(spark).limit(0)).count() == 0


# Secrets


def test_forest_learns_and_redacts(spark):
    findings = secrets.made_findings(spark, 1500)
    forest = secrets.train_forest(findings.where(F.xxhash64("candidate") % 4 != 0))
    held = findings.where(F.xxhash64("candidate") % 4 == 0).collect()
    x = np.array([secrets.describe(r.candidate, r.before, r.after, r.path) for r in held])
    assert ((forest.prob(x) >= 0.5) == np.array([r.label == 1 for r in held])).mean() > 0.9
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'intro token = "{key}" end'), (2, None), (3, ""), (4, f"see commit {key} for more"), (5, f'{LONG} password = "{key}"'), (5, f'{LONG} password = "{key}"')]
    found = secrets.scan_secrets(docs(spark, rows), forest).collect()
    assert {r.doc_id for r in found if r.is_secret} == {1, 5} and sum(r.is_secret for r in found) == 3
    red = {r.doc_id: r.text for r in secrets.redact(docs(spark, rows), forest).collect()}
    assert red[1] == 'intro token = "<secret>" end' and red[2] is None and red[4] == rows[3][1] and key not in red[5]
    assert secrets.scan_secrets(docs(spark).limit(0), forest).count() == 0
    assert secrets.train_forest(findings.limit(0)).prob(x[:2]).tolist() == [0.5, 0.5]


def test_planted_secrets_of_documents(spark, data):
    """Keys assigned to a token are found; card numbers, which are planted too, are left alone."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lexicon = secrets.learn_lexicon(rows)
    assert len(lexicon.words) > 1000 and lexicon.covered("thethe" + "zzqx") >= 0
    forest = secrets.train_forest(secrets.made_findings(spark, lexicon=lexicon), lexicon=lexicon)
    found = secrets.scan_secrets(rows, forest).collect()
    said = {(r.doc_id, r.start): r for r in found}
    keys = numbers = caught = wrong = 0
    for r in rows.collect():
        for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or ""):
            keys, caught = keys + 1, caught + said[r.doc_id, m.start(1)].is_secret
        for m in re.finditer(r"(?<![\w/+-])\d{16}(?![\w/+=-])", r.text or ""):
            numbers, wrong = numbers + 1, wrong + said[r.doc_id, m.start()].is_secret
    assert keys and caught / keys >= 0.95 and (not numbers or wrong / numbers <= 0.05)
    clean = [r for r in found if re.fullmatch(r"[a-zé]+", r.candidate)]
    assert not clean or sum(r.is_secret for r in clean) / len(clean) < 0.2
    assert secrets.learn_lexicon(rows.limit(0)).words == secrets.COMMON.words


def test_short_and_letter_only_secrets_are_candidates(spark):
    forest = secrets.train_forest(secrets.made_findings(spark))
    held = ["qXvRkTzWbNmLpGhd", "hT7#kd92Qx", "zqxvkjwpbtgh"]
    rows = [(1, f'see token = "{held[0]}" there'), (2, f"set password = {held[1]}\nthen go"), (3, f"api_key: '{held[2]}'"), (4, "the internationalisation of words"), (5, 'password = "correct horse battery" and key = value'), (6, 'token = "abc.qXvRkTzWbNmLpGhd12/é"')]
    found = secrets.scan_secrets(docs(spark, rows), forest).collect()
    texts_ = {d: {r.candidate for r in found if r.doc_id == d} for d, _ in rows}
    assert texts_ == {1: {held[0]}, 2: {held[1]}, 3: {held[2]}, 4: {"internationalisation"}, 5: {"correct horse battery", "value"}, 6: {"abc.qXvRkTzWbNmLpGhd12/é", "qXvRkTzWbNmLpGhd12/"}}
    red = {r.doc_id: r.text for r in secrets.redact(docs(spark, rows), forest).collect()}
    assert all(h not in red[d] and "<secret>" in red[d] for d, h in zip((1, 2, 3), held)) and red[4] == rows[3][1] and held[0] not in red[6]
    assert secrets._merged([(0, 5), (3, 9), (9, 12)]) == [(0, 9), (9, 12)]
