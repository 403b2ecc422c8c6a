"""The registered queries: columns, types, one row a document, and results against brute force."""

import collections
import re
import types
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridmetric.llm import common, secrets, urls

pytest.importorskip("public_tokenizers")

TYPES = {
    "op1": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op2": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op3": "page_id bigint, host string, path string, rule string, verdict string",
    "op4": "query_id bigint, rank int, vec_id bigint, score double",
    "op6": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op7": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9": "doc_id bigint, n_lines int, n_removed int, removed_md5 string",
    "op10": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op11": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op12": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


def _query(n):
    return next(f for name, f in __spark_entry__.queries().items() if name.startswith(f"{n}_"))


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 80")
    odd = spark.createDataFrame([(5000, None, None, None, 0), (5001, "", "en", "s", 0), (5002, "½ ②", "en", "s", 3)], docs.schema)
    docs.union(odd).write.parquet(str(path / "documents.parquet"))
    pages = spark.read.parquet(f"{data}/pages.parquet").where("page_id < 300")
    pages.union(spark.createDataFrame([(9000, None, None), (9001, "no scheme", None)], pages.schema)).write.parquet(str(path / "pages.parquet"))
    spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id < 300").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


@pytest.mark.parametrize("op", sorted(TYPES))
def test_columns_and_types(spark, folder, op):
    got = _query(op)(spark, folder)
    have = dict(got.dtypes)
    for column in TYPES[op].split(", "):
        name, kind = column.split(" ")
        assert have[name] == kind, (op, name)
    if op not in ("op3", "op4", "op10", "op12"):
        ids = [r.doc_id for r in got.select("doc_id").collect()]
        assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect())


def test_held_out_folds_and_und(spark, folder):
    for op, n, k in (("op1", 5, 1), ("op8", 4, 2)):
        for r in _query(op)(spark, folder).collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k)
            if op == "op8":
                assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in (5000, 5001, 5002))


def test_packed_pieces_cover_documents(spark, folder):
    rows = _query("op10")(spark, folder).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for own in by_doc.values():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]])) and sum(r.length for r in own) == own[0].doc_tokens
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]])) and sum(r.length for r in own) <= 2048


def _rule(host, path):
    best = None
    for rule, verdict in urls.RULES:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def test_url_verdicts_equal_brute_force(spark, folder):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r.page_id: r for r in _query("op3")(spark, folder).collect()}
    assert set(got) == set(pages)
    labelled = []
    for url in sorted({u for u in pages.values() if u}):
        hit = _rule(*urls.split_url(url))
        if hit:
            labelled.append((url, int(hit[1] == "block")))
    made = spark.createDataFrame(labelled, "url string, label int")
    model = urls.train_url_model(made)
    x = {g: i for i, g in enumerate(np.flatnonzero(model.weights))}
    assert x
    for page, url in pages.items():
        m = re.match(r"(?s)(?:(?!://).)*://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        hit, r = _rule(host, path), got[page]
        assert (r.host, r.path, r.rule) == (host, path, hit[0] if hit else None)
        want = hit[1] if hit else "block" if model.prob(host, path) >= 0.5 else "allow"
        assert r.verdict == want


def test_url_model_on_held_out_urls(spark):
    """Accuracy on thirds of the urls that the rules decide, each of a model of the others."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    labelled = sorted({(u, int(hit[1] == "block")) for (u,) in pages.select("url").distinct().collect() if u and (hit := _rule(*urls.split_url(u)))})
    assert len({y for _, y in labelled}) == 2
    assert np.mean([model_right(labelled, k, spark) for k in range(3)]) > 0.9


def model_right(labelled, k, spark):
    """Accuracy on a third of the labelled urls of a model of the others."""
    out = [x for i, x in enumerate(labelled) if i % 3 == k]
    rest = [x for i, x in enumerate(labelled) if i % 3 != k]
    m = urls.train_url_model(spark.createDataFrame(rest, "url string, label int"))
    return np.mean([(m.prob(*urls.split_url(u)) >= 0.5) == bool(y) for u, y in out])


def test_secret_findings_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lexicon = secrets.learn_lexicon(docs)
    count = collections.Counter(w for r in docs.collect() for w in (r.text or "").lower().replace("\n", " ").split(" ") if re.fullmatch("[a-z]{4,24}", w))
    most = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:4096]]
    assert set(lexicon.words) == {*secrets.DICTIONARY, *most}
    forest = secrets.train_forest(secrets.made_findings(spark, lexicon=lexicon), lexicon=lexicon)
    want = set()
    for r in docs.collect():
        t = r.text or ""
        for a, b in secrets._spans(t):
            x = np.array([secrets.describe(t[a:b], t[max(0, a - 48) : a], t[b : b + 2], r.source, lexicon)])
            votes = []
            for feature, threshold, left, value in forest.trees:
                at = 0
                while left[at] >= 0:
                    at = left[at] + int(x[0, feature[at]] > threshold[at])
                votes.append(value[at])
            want.add((r.doc_id, a, b, bool(np.mean(votes) >= 0.5)))
    got = _query("op5")(spark, folder).collect()
    assert {(r.doc_id, r.start, r.stop, r.is_secret) for r in got} == want and len(got) == len(want)


def test_scratch_needs_a_shared_folder():
    session = lambda master, **conf: types.SimpleNamespace(sparkContext=types.SimpleNamespace(master=master), conf=types.SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d), set=lambda k, v: None))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
    assert common.shared_dir(session("yarn", spark_checkpoint_dir="hdfs:///s")) == "hdfs:///s" and common.shared_dir(session("local[2]"))


def test_clashing_columns_change_nothing(spark, folder):
    """Every operator takes named columns, whatever others a table has."""
    from gridmetric.llm import ann, bpe, langid, lm, minhash, packing  # noqa: F401

    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 30")
    clash = docs.withColumns({c: F.lit("x") for c in ("id", "n", "node", "value", "fold", "score", "component_id", "kept", "ids", "bears", "n_tokens", "start", "candidate", "lang_pred")})
    assert sorted(map(tuple, lm.score_documents(clash).collect())) == sorted(map(tuple, lm.score_documents(docs).collect()))
    assert sorted(map(tuple, minhash.near_duplicates(clash).collect())) == sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    samples = langid.learn_samples(clash)
    assert samples == langid.learn_samples(docs)
    assert {r.doc_id: r.lang_pred for r in langid.identify(clash, samples).collect()} == {r.doc_id: r.lang_pred for r in langid.identify(docs, samples).collect()}
    forest = secrets.train_forest(secrets.made_findings(spark, 300))
    assert sorted(map(tuple, secrets.scan_secrets(clash, forest).collect())) == sorted(map(tuple, secrets.scan_secrets(docs, forest).collect()))


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_any_names(spark, folder, kind):
    """Columns with dots, ids of several types, an empty table: the rows are those of plain names."""
    import public_tokenizers as P

    from gridmetric.llm import ann, audio, bpe, fim, langid, linededup, lm, minhash, packing, triebpe

    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 25").select(F.col("doc_id").cast(kind).alias("doc_id"), "text", "lang", "source")
    named = docs.select(F.col("doc_id").alias("the.id"), F.col("text").alias("a.text"), F.col("lang").alias("its.lang"), F.col("source").alias("from.path"), F.lit(1).alias("x.y"))
    ids = {"id_col": "the.id", "text_col": "a.text"}
    read = lambda name: open(P.path(name), "rb").read()
    ranks, word_file, byte_file = read("byte_bpe_multi_50k.tiktoken"), read("word_bpe_49k.json"), read("byte_bpe_50k.json")
    samples = langid.learn_samples(docs)
    assert samples == langid.learn_samples(named, lang_col="its.lang", **ids)
    forest = secrets.train_forest(secrets.made_findings(spark, 300))
    packed = lambda d, **k: packing.pack_tokens(d, word_file, **k).drop("sequence_id", "offset", "start", "length", "ids").distinct()
    runs = {
        "op1": lambda d, **k: lm.score_documents(d, **k), "op2": lambda d, **k: audio.store_audio(d, **k), "op6": lambda d, **k: minhash.near_duplicates(d, **k),
        "op7": lambda d, **k: bpe.encode_documents(d, ranks, P.PATTERN, **k), "op9": lambda d, **k: linededup.dedup_lines(d, **k), "op10": packed,
        "op11": lambda d, **k: fim.fill_in_middle(d, **k), "op13": lambda d, **k: triebpe.encode_by_trie(d, byte_file, **k),
    }
    values = lambda d: sorted((tuple(map(str, r)) for r in d.collect()))
    for op, run in runs.items():
        plain, dotted = run(docs), run(named, **ids)
        back = dotted.toDF(*[{"the.id": "doc_id", "a.text": "text", "its.lang": "lang", "from.path": "source"}.get(c, c) for c in dotted.columns]).select(*plain.columns)
        assert values(plain) == values(back), op
        assert run(named.limit(0), **ids).count() == 0, op
    judged = langid.identify(named, samples, **ids)
    assert judged.columns == [*named.columns, "lang_pred", "score", "phrase_rate"]
    assert values(judged.select("lang_pred", "score")) == values(langid.identify(docs, samples).select("lang_pred", "score"))
    found = secrets.scan_secrets(named, forest, path_col="from.path", **ids)
    assert values(found) == values(secrets.scan_secrets(docs, forest))
    clean = secrets.redact(named, forest, text_col="a.text", path_col="from.path")
    assert clean.columns == named.columns and values(clean.drop("x.y")) == values(secrets.redact(docs, forest))
    media = audio.store_audio(docs).withColumnRenamed("media", "the.clip").withColumn("a.b", F.lit(1))
    assert [r.feature for r in audio.audio_features(media, "the.clip").orderBy("doc_id").collect()] == [r.feature for r in audio.audio_features(audio.store_audio(docs)).orderBy("doc_id").collect()]
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id < 60")
    near = ann.nearest(vectors.select(F.col("vec_id").cast("string" if kind == "string" else kind).alias("the.id"), F.col("embedding").alias("a.v"), F.lit(1).alias("x.y")), F.col("id") % 20 == 0, id_col="the.id", vector_col="a.v")
    assert values(near) == values(ann.nearest(vectors, F.col("id") % 20 == 0))
