"""Audio, URL and vector operators."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridmetric.llm import ann, audio, urls


def test_audio_is_lossless_and_repeats(spark):
    texts = [None, "", "x", "é" * 96, "y" * 192, "z" * 193, "long " * 50_000, "z" * 193]
    df = spark.createDataFrame([(i, t, "?", 1) for i, t in enumerate(texts)], "doc_id long, text string, media string, feature long").drop("media", "feature")
    got = {r.doc_id: r for r in audio.audio_features(audio.store_audio(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert audio.wav_samples(bytes(r.media))[0] == payload
        t = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        assert t["log_mel"].type.shape == [audio.FRAMES, audio.MELS] and t["start_s"][0].as_py() == 0
    assert got[5].feature == got[7].feature and got[0].feature == got[1].feature != got[5].feature
    assert audio.audio_features(audio.store_audio(df.limit(0))).count() == 0
    assert audio.audio_features(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().feature is None


def test_audio_reads_every_sample(spark):
    text = "wort " * 384  # 1920 bytes
    df = spark.createDataFrame([(0, text), (1, text[:-1] + "!"), (2, text[:-60] + "z" * 60), (3, text)], "doc_id long, text string")
    got = {r.doc_id: r.feature for r in audio.audio_features(audio.store_audio(df)).collect()}
    assert got[0] == got[3] and len({got[0], got[1], got[2]}) == 3


def test_audio_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "abc", "old", 5)], "doc_id int, text string, spans string, feature int")
    clips = audio.store_audio(df).withColumn("feature", F.lit(3)).withColumn("tensors", F.lit("x")).withColumn("spans", F.lit(1)).withColumn("batch", F.lit(2))
    got = audio.audio_features(clips)
    assert got.columns == ["doc_id", "n_bytes", "media", "batch", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "spans", "tensors"]
    r = got.first()
    assert r.batch == 2 and r.doc_id == 1 and r.feature.startswith("1x64x40") and dict(got.dtypes)["doc_id"] == "int"
    assert audio.audio_features(clips.limit(0)).count() == 0


def test_log_mel_equals_direct_computation():
    x = np.random.default_rng(3).normal(size=1003).astype(np.float32)
    got = audio.log_mel(x, 8000.0)
    bank = audio._mel_bank(8000.0)
    n = 1 + -(-(len(x) - audio.WINDOW) // audio.HOP)
    padded = np.concatenate([x, np.zeros(audio.WINDOW)])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.WINDOW) / (audio.WINDOW - 1))
    k, t = np.arange(audio.FFT // 2 + 1)[:, None], np.arange(audio.WINDOW)[None, :]
    dft = np.exp(-2j * np.pi * k * t / audio.FFT)
    want = [np.log(np.abs(dft @ (padded[i * audio.HOP :][: audio.WINDOW] * window)) ** 2 @ bank + 1e-6) for i in range(n)]
    assert got.shape == (n, audio.MELS) and np.abs(got - np.array(want)).max() < 1e-2


def test_resampled_sine():
    x = np.sin(np.arange(12_000) * 2 * np.pi * 440 / 12_000)
    y = audio.resample(x)
    assert len(y) == 8000 and np.abs(y[100:-100] - np.sin(np.arange(8000) * 2 * np.pi * 440 / 8000)[100:-100]).max() < 0.01


def test_mel_peak_and_segments():
    t = np.arange(16_000) / 8000
    low, high = (audio.log_mel(np.sin(2 * np.pi * f * t).astype(np.float32), 8000.0)[10].argmax() for f in (300, 2500))
    assert low < high
    assert audio.segments(np.array([0, 5, 9, 5, 0, 4.5, 0, 10, 0.0])) == [(1, 4), (7, 8)]
    assert audio.segments(np.ones(4)) == [(0, 4)]
    with pytest.raises(ValueError):
        audio.wav_samples(b"RIFFxxxxAVI ")


def test_url_parts_and_rules():
    parts = {None: ("", ""), "": ("", ""), "no scheme": ("", ""), "http://A.Ex.ORG": ("a.ex.org", ""), "x://H/P?q#f": ("h", "/P"), "a://b?c/d": ("b", ""), "a://b#/c": ("b", ""), "s://u://v/w": ("u:", "//v/w")}
    for url, want in parts.items():
        assert urls.split_url(url) == want
    r = urls.Rules(urls.RULES)
    assert r.judge("m.example.net", "/en/1") == ("example.net/en/", "allow") and r.judge("example.net", "/fr/") == ("net/", "block")
    assert r.judge("net", "/") == ("net/", "block") and r.judge("net", "") is None and r.judge("xexample.com", "/de/") is None
    assert r.judge("a.org", "/fr/x") == ("org/fr/", "allow") and r.judge("", "") is None
    with pytest.raises(ValueError):
        urls.Rules(urls.RULES, limit=2)


def test_url_model_learns(spark):
    good = [(f"http://site{i}.example.com/news/{i}", 0) for i in range(60)]
    bad = [(f"http://casino-win{i}.example.com/bonus/{i}?x", 1) for i in range(60)]
    m = urls.train_url_model(spark.createDataFrame([*good, *bad, (None, 1), ("x", None)], "url string, label int"))
    df = spark.createDataFrame([(1, "http://casino-win99.example.com/bonus/3", "h"), (2, "http://site77.example.com/news/9", "h"), (3, None, "h"), (3, None, "h")], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge_urls(df, urls.RULES, m).collect()}
    assert got[1].verdict == "block" and got[2].verdict == "allow" and got[3].host == "" and got[3].verdict in ("allow", "block")
    assert urls.judge_urls(df.limit(0), urls.RULES, m).count() == 0
    assert urls.train_url_model(df.limit(0).withColumn("label", F.lit(1))).prob("a", "b") == 0.5


def _brute(rows, k, is_query):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            seen[i, tuple(v)] = np.array(v, np.float64)
    out = {}
    for (i, key), v in seen.items():
        if is_query(i):
            cand = sorted((-float((v * w).sum()), j) for (j, other), w in seen.items() if j != i and len(w) == len(v))
            out[i] = [j for _, j in cand[:k]]
    return out


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=70) * rng.uniform(0.5, 2))]) for i in range(800)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, None), (2001, [0.0] * 70), (2002, [float("nan")] * 70), (2003, [None] * 70), (2020, [1.0, 2.0]), (2040, [2.0, 1.0]), (None, rows[0][1]), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = ann.nearest(df, F.col("id") % 20 == 0, block=200).toPandas()
    want = _brute(rows, 20, lambda i: i % 20 == 0)
    assert set(got.query_id) == {q for q, w in want.items() if w}
    hits = total = 0
    vec = {i: np.array(v, np.float64) for i, v in rows if v is not None and i is not None and None not in v}
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and len(g) == min(20, len(want[q]))
        assert np.allclose(g.score, [(vec[q] * vec[j]).sum() for j in g.vec_id]) and (np.diff(g.score) <= 1e-12).all()
        hits, total = hits + len(set(g.vec_id) & set(want[q])), total + len(want[q])
    assert hits / total > 0.99
    assert got[got.query_id == 1000].sort_values("rank").vec_id.tolist() == want[1000]  # ties by id
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_estimates_keep_their_bound():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(500, 100)), rng.normal(size=(20, 100))
    est, err = ann.Codes.of(x).estimate(q, 4.0)
    assert (np.abs(est - q @ x.T) <= err).mean() > 0.999


def test_few_vectors_are_reranked():
    """On the embeddings of sf0.1 the bounds leave less than a tenth of all products to compute, with nearly all neighbours found."""
    import pyarrow.parquet as pq

    x = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), float)
    q, codes = x[::20], ann.Codes.of(x)
    share = hits = 0
    for own, (found, score) in zip(q, ann.search_block(q, x, codes, 21, 3.0)):
        exact = (x * own).sum(axis=1)
        assert np.allclose(exact[found], score)
        share += len(found) / len(x) / len(q)
        hits += len(set(found[np.argsort(-score)[:21]]) & set(np.argsort(-exact)[:21])) / 21 / len(q)
    assert share < 0.10 and hits > 0.97


def test_neighbours_recall_on_embeddings(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in df.select("vec_id", "embedding").collect()]
    got = ann.nearest(df, F.col("id") % 20 == 0).toPandas()
    want = _brute(rows, 20, lambda i: i % 20 == 0)
    found = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    assert sum(len(found[q] & set(w)) for q, w in want.items()) / sum(map(len, want.values())) >= 0.9
