"""Secret scans: candidate strings from a pattern, and a random forest that removes false positives.

The forest sees a candidate's length, its character transitions, how much of it a dictionary covers, the path it comes from and the
words beside it. The dictionary holds the most frequent words of all documents besides common English ones; transitions are those of its words. The
forest is trained on a table of labelled findings, which is small, on the driver; scanning is a map over documents.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmetric.llm.common import numbered, pieces, quoted, table, texts

#: Runs that may be a secret: 16 or more characters of common encodings.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
#: Values of any length that something is assigned: within quotes, or up to a space, quote or separator.
ASSIGNED = re.compile(r"(?:=>|:=|[:=])[ \t]*+(?:[Bb]earer[ \t]++)?(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"'`;,:=][^\s\"'`;,]*))")
_WORD = re.compile(r"[A-Za-z]+")
# Common words of the dictionary, and words and path parts that speak for or against a secret.
DICTIONARY = ("about after again also another because been before below between call case change class code come could data date default description different does done each error even example field file find first following format from function give have here home html http https image index info input into just kind know last like line link list local long look made make many message more most much must name need never next node null number object only order other output over page param part path people place point print project public query read release request response return right same sample search second server service should some sort source start state string system table test text than that their them then there these they thing this time title true type under update user using value version view void want water well were what when where which while will with word work world would write year your").split()
FOR = ("token", "secret", "password", "passwd", "pwd", "apikey", "api", "key", "auth", "bearer", "credential", "private", "access")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "guid", "etag", "revision", "rev", "id", "build", "version", "placeholder", "sample", "dummy")
TEST_PATHS = ("test", "example", "sample", "mock", "fixture", "doc", "demo")
FEATURES = ("length", "entropy", "switches", "transition", "coverage", "distinct", "run", "hex", "digits", "test_path", "words_for", "words_against", "assigned")


class Lexicon:
    """A dictionary of lower-case ASCII words, and the transitions between their letters."""

    def __init__(self, words=()):
        self.words = tuple(dict.fromkeys([*DICTIONARY, *words]))
        counts = np.ones((26, 26))  # one of each pair is added
        for w in self.words:
            x = np.frombuffer(w.encode(), np.uint8) - 97
            np.add.at(counts, (x[:-1], x[1:]), 1)
        self.transitions = np.log(counts / counts.sum(axis=1, keepdims=True))
        self._finder = None

    def __getstate__(self):
        return {"words": self.words, "transitions": self.transitions, "_finder": None}

    def covered(self, low: str) -> int:
        """Characters of a lower-case string within words that don't overlap, the leftmost and longest first."""
        if self._finder is None:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            for w in self.words:
                self._finder.add_word(w, len(w))
            self._finder.make_automaton()
        return sum(n for _, n in self._finder.iter_long(low))


COMMON = Lexicon()


def learn_lexicon(docs: DataFrame, text_col: str = "text", size: int = 4096) -> Lexicon:
    """The `size` words of four ASCII letters or more that occur most in all texts (ties: by the word), besides the common ones.

    Words are counted over all rows; the driver gets `size` of them. Null and empty texts have none, and an empty table leaves the common words.
    """
    words = docs.select(F.explode(F.split(F.lower(F.replace(quoted(text_col), F.lit("\n"), F.lit(" "))), " ")).alias("w")).where(F.length("w").between(4, 24))
    counts = words.groupBy("w").count().where(F.col("w").rlike("^[a-z]+$"))
    return Lexicon([r.w for r in counts.orderBy(F.desc("count"), "w").limit(size).collect()])


def describe(candidate: str, before: str, after: str, path: str | None, lexicon: Lexicon = COMMON) -> list[float]:
    """Features of one candidate, with the text on both sides of it."""
    raw = np.frombuffer(candidate.encode(), np.uint8)
    kind = np.select([(raw >= 48) & (raw < 58), (raw >= 65) & (raw < 91), (raw >= 97) & (raw < 123)], [0, 1, 2], 3)
    share = np.bincount(raw, minlength=128) / len(raw)
    share = share[share > 0]
    low = np.frombuffer(candidate.lower().encode(), np.uint8).astype(int) - 97
    pair = (low[:-1] >= 0) & (low[:-1] < 26) & (low[1:] >= 0) & (low[1:] < 26)
    edges = np.flatnonzero(np.diff(raw.astype(int), prepend=-1, append=-1))
    words = [w.lower() for w in _WORD.findall(before)[-3:]]
    where = str(path or "").lower()
    return [
        float(len(raw)), float(-(share * np.log2(share)).sum()), float((np.diff(kind) != 0).mean()),
        float(lexicon.transitions[low[:-1][pair], low[1:][pair]].mean()) if pair.any() else -4.0,
        lexicon.covered(candidate.lower()) / len(raw), len(share) / len(raw), float(np.diff(edges).max()) / len(raw),
        float(re.fullmatch(r"[0-9a-fA-F]+", candidate) is not None), float((kind == 0).mean()), float(any(t in where for t in TEST_PATHS)),
        float(any(w in FOR for w in words)), float(any(w in AGAINST for w in words)), float(re.search(r"[:=]\s*[\"']?$", before) is not None and (after[:1] in "\"'\n ;," or not after)),
    ]


class Forest:
    """A random forest of binary trees as flat arrays: feature, threshold, left child (right is the next one), share of positives. It keeps the
    lexicon that its features rest on."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], lexicon: Lexicon = COMMON):
        self.trees, self.lexicon = trees, lexicon

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 8, seed: int = 5) -> Forest:
        rng, trees = np.random.default_rng(seed), []
        for _ in range(n_trees if len(y) else 0):
            pick = rng.integers(0, len(y), len(y))
            trees.append(cls._tree(x[pick], y[pick], depth, rng))
        return cls(trees)

    @staticmethod
    def _tree(x, y, depth, rng):
        feature, threshold, left, value = [-1], [0.0], [-1], [float(y.mean())]
        open_ = [(0, np.arange(len(y)), 0)]
        while open_:
            node, rows, level = open_.pop()
            value[node] = float(y[rows].mean())
            if level == depth or len(rows) < 4 or value[node] in (0.0, 1.0):
                continue
            best = (1e-9, None, None)
            n, total = len(rows), y[rows].sum()
            gini = 2 * total * (n - total) / n
            for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, c = x[order, f], np.cumsum(y[order])
                cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                if len(cut):
                    a = c[cut - 1]
                    after = 2 * a * (cut - a) / cut + 2 * (total - a) * (n - cut - total + a) / (n - cut)
                    k = int(after.argmin())
                    if gini - after[k] > best[0]:
                        best = (gini - after[k], f, (v[cut[k] - 1] + v[cut[k]]) / 2)
            if best[1] is None:
                continue
            feature[node], threshold[node], left[node] = int(best[1]), float(best[2]), len(feature)
            low = x[rows, best[1]] <= best[2]
            for part in (rows[low], rows[~low]):
                open_.append((len(feature), part, level + 1))
                feature.append(-1)
                threshold.append(0.0)
                left.append(-1)
                value.append(0.0)
        return np.array(feature), np.array(threshold), np.array(left), np.array(value)

    def prob(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives over the trees; one half without trees."""
        if not self.trees or not len(x):
            return np.full(len(x), 0.5)
        out = np.zeros(len(x))
        for feature, threshold, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := left[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] > threshold[at]
                at = np.where(inner, left[at] + go, at)
            out += value[at]
        return out / len(self.trees)


def train_forest(findings: DataFrame, max_rows: int = 6000, lexicon: Lexicon = COMMON) -> Forest:
    """A forest from labelled findings: candidate, before, after, path (strings) and label (1: a secret).

    The table is meant to be small; of a larger one, the max_rows least by hash count. Null candidates or labels don't count; nulls elsewhere are
    empty; repeated rows count as often as they occur. Without rows the forest says one half.
    """
    rows = findings.where((F.length("candidate") > 0) & F.col("label").isNotNull()).orderBy(F.xxhash64("candidate", "before"), "candidate", "before", "after", "path", "label").limit(max_rows).collect()
    x = np.array([describe(r.candidate, r.before or "", r.after or "", r.path, lexicon) for r in rows]).reshape(-1, len(FEATURES))
    forest = Forest.fit(x, np.array([float(r.label) for r in rows]))
    forest.lexicon = lexicon
    return forest


def made_findings(spark: SparkSession, n: int = 3000, seed: int = 3, lexicon: Lexicon = COMMON) -> DataFrame:
    """Labelled findings by rule: random strings beside words for a secret; placeholders, names, digests and numbers for the rest."""
    rng, rows, known = np.random.default_rng(seed), [], np.array(lexicon.words)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]
    rand = lambda k, size: "".join(rng.choice(list(alphabets[k]), size))
    word = lambda: str(known[rng.integers(0, len(known))])
    one = lambda x: str(rng.choice(list(x)))
    paths = ("src1", "src17", "app/config.py", "deploy/prod.env", "lib/client.js", "notes.txt", None)
    for i in range(n):
        quote, text = one(['"', "'", ""]), f"{word()} {word()} "
        if i % 2:
            before, path = text + one(FOR) + one([" = ", "=", ": ", ":"]) + quote, one([p or "" for p in paths])
            kind = i // 2 % 6
            if kind < 4:  # long keys
                value = rand(int(rng.integers(0, 4)), int(rng.integers(16, 64)))
            elif kind == 4:  # short values, some with marks
                value = rand(int(rng.integers(2, 4)), int(rng.integers(7, 15))) + one(["", "", "!", "#", "$", "@"])
            else:  # keys of letters alone
                value = "".join(rng.choice(list(one([string.ascii_lowercase, string.ascii_letters])), int(rng.integers(10, 40))))
        else:
            kind, path = i // 2 % 8, one([p or "" for p in paths] + ["tests/data/x.py", "docs/example.md"])
            before, value = text, ""
            if kind == 0:  # digests and revisions
                before, value = text + one(AGAINST) + one([" ", ": ", "="]), rand(0, int(rng.choice([32, 40, 64])))
            elif kind == 1:  # placeholders
                before, value = text + one(FOR) + " = " + quote, one([one("xX0_-") * int(rng.integers(16, 40)), "_".join(["your", word(), one(FOR), "here"]) + "_" + word(), "example-" + "-".join(word() for _ in range(3))])
            elif kind == 2:  # names and paths
                value = one("_-/").join(word() for _ in range(int(rng.integers(3, 7))))
            elif kind == 3:  # numbers
                value = "".join(rng.choice(list("0123456789"), int(rng.integers(16, 24))))
            elif kind == 4:  # long words
                value = "".join(word() for _ in range(int(rng.integers(3, 6))))
            elif kind == 5:  # plain words and settings
                before, value = text + one(FOR) + one([" = ", "=", ": ", ":"]) + quote, one([word(), word() + "_" + word(), f"{word()} {word()}", one(["none", "None", "null", "true", "false", "required", "string", "str"]), str(int(rng.integers(0, 10000)))])
            elif kind == 6:  # long words of no dictionary
                value = "".join(one(["th", "st", "r", "l", "nd", "m", "t", "s", "br", "ch"]) + one(["a", "e", "i", "o", "u", "ou"]) + one(["", "n", "r", "s"]) for _ in range(int(rng.integers(6, 10))))
            else:  # secrets of test files
                before, value, path = text + one(FOR) + " = " + quote, word() + rand(0, 14), one(["tests/fixture.py", "docs/sample.md", "mock/example.json"])
        if value:
            rows.append((value, before, quote, path, i % 2))
    return spark.createDataFrame(rows, "candidate string, before string, after string, path string, label int")


def _spans(text: str) -> list[tuple[int, int]]:
    """Candidates of a text, in order: all long runs, and what a name with a word for a secret is assigned. They may overlap."""
    found = {m.span() for m in CANDIDATE.finditer(text)}
    for m in ASSIGNED.finditer(text):
        if any(w.lower().endswith(FOR) for w in _WORD.findall(text[max(0, m.start() - 48) : m.start()])[-3:]):
            found.add(m.span(m.lastindex))
    return sorted(found)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ordered spans, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _judge(batch: pa.RecordBatch, forest: Forest) -> tuple[list[str], list[list[tuple[int, int, float]]]]:
    """Texts, and for each its candidates with start, stop and probability."""
    raw = texts(batch, "text")
    found = [_spans(t) for t in raw]
    paths = batch.column("path").to_pylist()
    x = [describe(t[a:b], t[max(0, a - 48) : a], t[b : b + 2], p, forest.lexicon) for t, spans, p in zip(raw, found, paths) for a, b in spans]
    prob = iter(forest.prob(np.array(x).reshape(-1, len(FEATURES))).tolist())
    return raw, [[(a, b, next(prob)) for a, b in spans] for spans in found]


def scan_secrets(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """id_col, start, stop (characters), candidate, probability and is_secret of every candidate in every whole text.

    A null or empty text has none; null paths count as empty; rows stand alone, so repeated rows or ids repeat their findings; further columns change
    nothing; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches, "text"):
            raw, found = _judge(batch, shared.value)
            rows = [(i, a, b, raw[i][a:b], p) for i, spans in enumerate(found) for a, b, p in spans]
            if rows:
                at, start, stop, candidate, prob = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(candidate), pa.array(prob), pa.array([p >= threshold for p in prob])], names=["id", "start", "stop", "candidate", "probability", "is_secret"])

    path = F.lit("") if path_col is None else quoted(path_col)
    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), path.cast("string").alias("path"))
    return source.mapInArrow(run, f"id {kind}, start int, stop int, candidate string, probability double, is_secret boolean").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, mark: str = "<secret>") -> DataFrame:
    """All columns of docs, with each secret in the text replaced by a mark; null texts stay null. Otherwise as scan_secrets."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    source, at = numbered(docs), docs.columns.index(text_col)
    where = None if path_col is None else docs.columns.index(path_col)

    def run(batches):
        for batch in pieces(batches, f"c{at}"):
            path = pa.nulls(batch.num_rows, pa.string()) if where is None else batch.column(where)
            raw, found = _judge(pa.record_batch({"text": batch.column(at), "path": path}), shared.value)
            out = []
            for t, spans in zip(raw, found):
                for a, b in reversed(_merged([(a, b) for a, b, p in spans if p >= threshold])):
                    t = t[:a] + mark + t[b:]
                out.append(t)
            valid = batch.column(at).is_valid().to_pylist()
            columns = list(batch.columns)
            columns[at] = pa.array([t if v else None for t, v in zip(out, valid)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return source.mapInArrow(run, source.schema).toDF(*docs.columns)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, judged by a forest of 40 trees trained on at most 6,000 labelled findings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lexicon = learn_lexicon(docs)
    found = scan_secrets(docs, train_forest(made_findings(spark, lexicon=lexicon), lexicon=lexicon))
    return found.select("doc_id", "start", "stop", F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")
