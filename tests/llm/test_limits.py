"""Limits of phrase rates rest on all rows."""

import math
import random

from gridmetric.llm import langid


def test_rate_limits_count_every_row_but_those_of_samples(spark):
    rng = random.Random(7)
    words = {x: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(300)] for x, letters in (("aa", "abcdefgh"), ("bb", "mnopqrst"))}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 60))), lang) for k in range(1200) for lang in [("aa", "bb")[k % 4 == 0]]]
    docs = spark.createDataFrame([*rows, (None, "a", "aa"), (9001, None, "aa"), (9002, "abc", None)], "doc_id long, text string, lang string").repartition(3)
    samples = langid.learn_samples(docs)
    own = docs.withColumnsRenamed({"doc_id": "id"})
    held = set(langid._by_hash(own.dropna(), 1, langid.SAMPLE_DOCS))
    judged = [r for r in langid.identify(docs, samples).collect() if r.lang and r.lang == r.lang_pred and r.doc_id is not None and r.doc_id not in held and sum(c.isalpha() for c in r.text) >= 40]
    want = {}
    for lang in words:
        rates = sorted(math.ceil(r.phrase_rate * langid.RATES) for r in judged if r.lang == lang)
        want[lang] = 2.5 * rates[math.ceil(len(rates) * 95 / 100) - 1] / langid.RATES
    assert len(judged) > 2 * 256 and langid.learn_rate_limits(docs, samples) == want


def test_a_group_of_similar_lines_makes_few_pairs(spark, monkeypatch):
    """900 lines that are alike but for one word of forty: every later one goes, without a row for each two of them."""
    from gridmetric.llm import linededup

    made = []

    class Counted(linededup.Scratch):
        def keep(self, df, name="t"):
            out = super().keep(df, name)
            if name in ("pairs", "led", "rest"):
                made.append(out.count())
            return out

    monkeypatch.setattr(linededup, "Scratch", Counted)
    words = [f"w{i}" for i in range(40)]
    rows = [(k, " ".join([*words[: k % 40], f"x{k}", *words[k % 40 + 1 :]])) for k in range(900)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "removed").collect()
    assert sorted(r.doc_id for r in got if not r.removed) == [0]
    assert sum(made) < 50 * len(rows)


def test_long_lists_make_a_forest_of_links(spark, monkeypatch):
    """Long texts that share most of their shingles meet under many values: rows don't grow with the pairs, and no link is lost."""
    from gridmetric.llm import minhash

    made = {}

    class Counted(minhash.Scratch):
        def keep(self, df, name="t"):
            out = super().keep(df, name)
            made[name] = out.count()
            return out

    monkeypatch.setattr(minhash, "Scratch", Counted)
    rng = random.Random(3)
    passage, other = [f"p{i}" for i in range(1000)], [f"q{i}" for i in range(900)]
    rows = [(k, " ".join([*passage, *(f"d{k}x{i}" for i in range(150))])) for k in range(100)]
    for k in range(50):  # near the limit of 0.8 to each other
        words = list(other)
        for i in rng.sample(range(900), 10 + k % 2):
            words[i] = f"m{rng.random()}"
        rows.append((1000 + k, " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, percent=80).collect()}
    sets = {k: set(zip(*(t.split()[i:] for i in range(5)))) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for k in sets}
    assert max(made.get("found", 0), made["more"]) <= 2 * len(rows)


def test_a_worker_keeps_one_model():
    """Workers outlive the pipeline's stages: the parser of the first isn't kept beside the tokenizer of the last."""
    import weakref

    import public_tokenizers

    from gridmetric.llm import tokens

    parser = weakref.ref(langid._parser({"aa": b"some text", "bb": b"other words"}))
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        file = f.read()
    first = tokens.word_tokenizer(file)
    assert parser() is None and tokens.word_tokenizer(file) is first


def test_words_are_split_only_from_texts_that_hold_wanted_lines(spark):
    from pyspark.sql import functions as F

    from gridmetric.llm import linededup

    docs = spark.range(5000).select("id", F.lit("a b c d e\nf g h i j").alias("text"))
    members = spark.createDataFrame([(7, 1), (9, 0)], "id long, at int")
    held = docs.where(linededup._map_of(members, 1 << linededup.LEAST_MAP, "id"))
    assert {7, 9} <= {r.id for r in held.collect()} and held.count() < 50
    blank = spark.createDataFrame([(x,) for x in ("", " \t", "\x0b\f\r\n ", " ", "x", "  x", " ")], "s string")
    assert [r[0] for r in blank.select(linededup.takes_part(F.col("s"))).collect()] == [r[0] for r in blank.select(F.col("s").rlike(r"\S")).collect()]


def test_levels_of_tokens_make_no_large_literal(spark, monkeypatch):
    """The driver keeps a plan's literals as objects and as text: levels are a byte a bucket, and give the same order of tokens."""
    from pyspark.sql import functions as F

    from gridmetric.llm import linededup

    docs = spark.createDataFrame([(k, " ".join(["all", "of", f"w{k % 7}", f"x{k}"])) for k in range(200)], "doc_id long, text string")
    level = linededup.rarity(docs.select("text"))
    made = []
    monkeypatch.setattr(linededup.F, "lit", lambda x, lit=F.lit: made.append(x) or lit(x))
    lines = linededup.lines_of(docs, "doc_id", "text")
    sets = linededup.token_sets(lines, level, 50).select("id", "prefix").collect()
    monkeypatch.undo()
    assert len(level) == linededup.BUCKETS and sum(len(x) for x in made if isinstance(x, (str, bytes))) <= linededup.BUCKETS + 100
    names = ["all", "of", *(f"w{k}" for k in range(7)), *(f"x{k}" for k in range(200))]
    hashes = dict(spark.createDataFrame([(x,) for x in names], "w string").select("w", F.xxhash64("w")).collect())
    key = lambda w: (level[hashes[w] % linededup.BUCKETS] << 53) | (hashes[w] % (1 << 64) >> 11)
    assert len(sets) == 200
    for r in sets:  # of four tokens, the three rarest
        assert r.prefix == sorted(map(key, ["all", "of", f"w{r.id % 7}", f"x{r.id}"]))[:3]
