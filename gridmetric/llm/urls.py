"""URL filters: host and path rules, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmetric.llm.common import pieces, quoted, table, texts

_UPPER = {c: c + 32 for c in range(65, 91)}
_CUT = re.compile(r"[/?#]")
_QUERY = re.compile(r"[?#]")
#: Rules of op3: host and path as written, and what they decide.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = _CUT.search(rest)
    host, tail = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
    return host.translate(_UPPER), _QUERY.split(tail, maxsplit=1)[0]


class Rules:
    """Host and path rules; a rule fits its host and all subdomains where the path starts with the rule's. The longest wins."""

    def __init__(self, rules, limit: int = 100_000):
        if len(rules) > limit:
            raise ValueError(f"{len(rules)} rules; at most {limit} are meant to be sent to every task")
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        best, suffix = None, host
        while True:
            for start, rule, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            _, dot, suffix = suffix.partition(".")
            if not dot:
                return best


def features(host: str, path: str, sizes=(2, 3, 4), bits: int = 15) -> np.ndarray:
    """Distinct hashed n-grams of host and path, each with its ends marked."""
    mask, out = (1 << bits) - 1, set()
    for kind, part in ((b"h", f"^{host}$".encode()), (b"p", f"^{path}$".encode())):
        seed = zlib.crc32(kind)
        for n in sizes:
            out.update(zlib.crc32(part[i : i + n], seed + n) & mask for i in range(len(part) - n + 1))
    return np.fromiter(sorted(out), np.int64, len(out))


class UrlModel:
    """Weights of a logistic regression over 2**bits hashed n-grams."""

    def __init__(self, bits: int = 15):
        self.bits, self.weights, self.bias = bits, np.zeros(1 << bits), 0.0

    def fit(self, rows: list[tuple[str, str, int]], epochs: int = 12, rate: float = 0.5, l2: float = 1e-5) -> UrlModel:
        """rows: host, path, 1 for block. AdaGrad in a fixed order; classes weigh alike."""
        if not rows:
            return self
        xs = [features(h, p, bits=self.bits) for h, p, _ in rows]
        ys = np.array([y for *_, y in rows], float)
        weight = np.where(ys == 1, len(ys) / max(1.0, 2 * ys.sum()), len(ys) / max(1.0, 2 * (len(ys) - ys.sum())))
        seen, seen_bias = np.full(1 << self.bits, 1e-6), 1e-6
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            for i in rng.permutation(len(xs)):
                x = xs[i]
                g = weight[i] * (self._prob(x) - ys[i]) / np.sqrt(max(1, len(x)))
                seen[x] += g * g
                seen_bias += g * g
                self.weights[x] -= rate * (g / np.sqrt(seen[x]) + l2 * self.weights[x])
                self.bias -= rate * g / np.sqrt(seen_bias)
        return self

    def _prob(self, x: np.ndarray) -> float:
        z = self.weights[x].sum() / np.sqrt(max(1, len(x))) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def prob(self, host: str, path: str) -> float:
        return float(self._prob(features(host, path, bits=self.bits)))


def train_url_model(labelled: DataFrame, max_rows: int = 4000, bits: int = 15) -> UrlModel:
    """A model of a table (url string, label 0/1), 1 meaning block.

    The table is meant to be small; of a larger one, the max_rows urls least by hash count, evenly of both labels. Null urls
    or labels don't count, repeated urls count once; without rows the model says one half.
    """
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select("url", F.col("label").cast("int").alias("label")).distinct()
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("url"), "url"))
    got = rows.where(F.col("label").isin(0, 1)).withColumn("nth", nth).where(F.col("nth") <= max_rows // 2).orderBy("label", "nth").collect()
    return UrlModel(bits).fit([(*split_url(r.url), r.label) for r in got])


def judge_urls(pages: DataFrame, rules, model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule (null if none fits), verdict and block_prob (the model's) of every row.

    A rule's verdict stands; elsewhere the model blocks at a probability of one half or more. Null urls and urls without ://
    have empty host and path and go to the model. Rows are judged one by one: repeated rows, ties and further columns change
    nothing, and an empty table gives an empty one.
    """
    shared = pages.sparkSession.sparkContext.broadcast((tuple(rules), model))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        own, fitted = Rules(shared.value[0]), shared.value[1]
        for batch in pieces(batches, "url"):
            parts = [split_url(u) for u in texts(batch, "url")]
            hits = [own.judge(h, p) for h, p in parts]
            prob = [fitted.prob(h, p) for h, p in parts]
            yield pa.record_batch({
                "id": batch.column("id"),
                "host": pa.array([h for h, _ in parts], pa.string()),
                "path": pa.array([p for _, p in parts], pa.string()),
                "rule": pa.array([x[0] if x else None for x in hits], pa.string()),
                "verdict": pa.array([x[1] if x else "block" if p >= 0.5 else "allow" for x, p in zip(hits, prob)], pa.string()),
                "block_prob": pa.array(prob, pa.float64()),
            })

    source = pages.select(quoted(id_col).alias("id"), quoted(url_col).alias("url"))
    return source.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, block_prob double").withColumnRenamed("id", id_col)


def rule_labelled(pages: DataFrame, rules, url_col: str = "url") -> DataFrame:
    """A labelled table for training: the urls on which a rule decides, with 1 for block. Null urls and those that no rule fits are left out."""
    shared = pages.sparkSession.sparkContext.broadcast(tuple(rules))

    def run(batches):
        own = Rules(shared.value)
        for batch in pieces(batches, "url"):
            urls = texts(batch, "url")
            hits = [own.judge(*split_url(u)) for u in urls]
            rows = [(u, int(x[1] == "block")) for u, x in zip(urls, hits) if x]
            yield pa.record_batch({"url": pa.array([u for u, _ in rows], pa.string()), "label": pa.array([y for _, y in rows], pa.int32())})

    return pages.select(quoted(url_col).alias("url")).where(F.col("url").isNotNull()).mapInArrow(run, "url string, label int")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; the model learns from at most 4,000 urls that the rules themselves label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = train_url_model(rule_labelled(pages, RULES))
    return judge_urls(pages, RULES, model)
