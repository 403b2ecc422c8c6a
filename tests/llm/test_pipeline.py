"""Stages of the corpus pipeline against what they must do to planted rows."""

import numpy as np
import pytest

import corpus_pipeline as C

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    real = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60").collect()]
    last = real[0][1].split()
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    planted = [(900, None, "en", "s", 0), (901, "12345 !!", "en", "s", 8), (902, " ".join(last[:-3] + ["changed", "words", "here"]), real[0][2], "s", 0), (903, f'Thstorti ndhe token = "{key}" thhantou with the estatnd of erea.', "en", "s", 0)]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame([*real, *planted], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return str(path), key


def test_pipeline(spark, folder):
    path, key = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, path).persist()
        assert docs.columns == list(C.COLUMNS), name
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert {900, 901} & set(seen["language_id"]) == set() and len(seen["language_id"]) == 62
    assert 902 not in seen["near_dedup"]
    assert key in seen["near_dedup"][903] and key not in seen["secret_scan"][903] and "<secret>" in seen["secret_scan"][903]
    assert set(seen["secret_scan"]) == set(seen["near_dedup"])
    pieces = C.pack(spark, docs, path).collect()
    assert {p.doc_id for p in pieces} == set(seen["secret_scan"])
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    whole = C.run(spark, path).collect()
    assert np.sum([p.length for p in whole]) == np.sum([p.length for p in pieces])


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("first", [90_000, 91_000])  # with the first ids a planted text is in its language's sample
def test_language_stage_decides(spark, first):
    """A text of no learned language goes, a clear one gets its language whatever its label, and clean documents stay as they are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    german = docs.where("lang = 'de' AND length(text) > 600").orderBy("doc_id").first().text
    foreign = "Это русский текст о погоде и людях, который никто не учил здесь никогда прежде, и он довольно длинный"
    planted = spark.createDataFrame([(first + 1, foreign, "en", "s", 0), (first + 2, german, "en", "s", 0), (first + 3, german, None, "s", 0), (first + 4, "qwxz kjzqp vvxq zzkqj wqpx kkzv xqzj wvkq pzxk qjwv zkxq vjqz wkpx", "fr", "s", 0)], docs.schema)
    got = {r.doc_id: r.lang for r in C.language_id(spark, docs.union(planted), "").collect()}
    assert {first + 1, first + 4} & set(got) == set() and got[first + 2] == got[first + 3] == "de"
    clean = {r.doc_id: r.lang for r in docs.collect()}
    assert set(clean) <= set(got) and sum(clean[d] != got[d] for d in clean) <= 0.01 * len(clean)


def test_pipeline_equals_brute_force(spark, folder):
    """Every stage by plain Python on the rows that the stage before kept: costs of all parses, all pairs of lines, all pairs of texts, every candidate.

    What is learned (samples, limits and the forest) is taken from the operators, as each stage's rows give it.
    """
    from test_text import _brute_components, _brute_lines, _phrases
    from tokenizers import Tokenizer

    import public_tokenizers as P
    from gridmetric.llm import langid, secrets

    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 24 OR doc_id >= 900")
    rows = {r.doc_id: r for r in docs.collect()}
    # Language: the least cost, the clear label, and texts beyond their language's rate.
    samples = langid.learn_samples(docs)
    limits = langid.learn_rate_limits(docs, samples, least=C.LETTERS)
    lang, kept = {}, {}
    for d, r in rows.items():
        clean = langid.normalise(r.text) if r.text is not None and langid.has_letter(r.text) else b""
        if not clean:
            continue
        phrases = {k: _phrases(v, clean) for k, v in samples.items()}
        cost = {k: n * np.log2(len(samples[k])) for k, n in phrases.items()}
        order = sorted(cost, key=lambda k: (cost[k], k))
        score = min(1.0, 2 * (1 - cost[order[0]] / cost[order[1]]))
        if sum(c.isalpha() for c in r.text) >= C.LETTERS and phrases[order[0]] / len(clean) > limits.get(order[0], np.inf):
            continue
        lang[d], kept[d] = order[0] if score >= C.CLEAR or r.lang is None else r.lang, r.text
    # Lines similar to an earlier one, and documents of which nothing is left.
    gone = _brute_lines(sorted(kept.items()))
    cut = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in kept.items()}
    cut = {d: t for d, t in cut.items() if not gone[d] or t.replace("\n", " ").strip(" ")}
    # Of linked texts that of the least id.
    first = {d: c for d, _, c in _brute_components(sorted(cut.items()), 80)}
    single = {d: t for d, t in cut.items() if first[d] == d}
    # Secrets, by every candidate's own features.
    frame = spark.createDataFrame([(d, t, lang[d], rows[d].source, len(t)) for d, t in sorted(single.items())], docs.schema)
    lexicon = secrets.learn_lexicon(frame)
    forest = secrets.train_forest(secrets.made_findings(spark, lexicon=lexicon), lexicon=lexicon)
    clean = {}
    for d, t in single.items():
        spans = [(a, b) for a, b in secrets._spans(t) if forest.prob(np.array([secrets.describe(t[a:b], t[max(0, a - 48) : a], t[b : b + 2], rows[d].source, forest.lexicon)]))[0] >= 0.5]
        for a, b in reversed(secrets._merged(spans)):
            t = t[:a] + "<secret>" + t[b:]
        clean[d] = t
    at = docs
    for name, stage in C.STAGES[:-1]:
        at = stage(spark, at, path).persist()
    assert {r.doc_id: (r.text, r.lang, r.n_chars) for r in at.collect()} == {d: (t, lang[d], len(t)) for d, t in clean.items()}
    assert len(clean) < len(kept) < len(rows) and any(gone.values()) and any("<secret>" in t for t in clean.values())
    # Pieces end to end are the library's ids of each text, and lie without gaps in their sequences.
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = C.pack(spark, at, path).collect()
    for d, t in clean.items():
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        total = 0
        for offset, length in sorted(own):
            assert offset == total
            total += length
        assert total == 2048 or total & (total - 1) == 0
