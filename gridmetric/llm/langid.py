"""Language identification by cross-parsing entropy.

The labelled text of each language becomes a suffix automaton. A text is parsed against each automaton into longest matches
(phrases). A longest-match code names each phrase by its place in the sample, so a language's cost is phrases * log2(sample length)
bits; the language of the least cost wins, whatever the sizes of the samples.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridmetric.llm.common import held_model, numbered, pieces, quoted, table, texts

#: Symbols that one lane of the parser takes; a parse goes on over the borders of lanes.
BLOCK = 2048
#: Rows of each language that its sample is taken from.
SAMPLE_DOCS = 64


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """A letter (Unicode category L), and a run of anything else. \\w also has digits, marks such as ½ and ², and letter numbers."""
    numbers = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl")]
    ranges, begin = [], numbers[0]
    for a, b in zip(numbers, [*numbers[1:], "\U0010ffff"]):
        if ord(b) != ord(a) + 1:
            ranges.append(f"{begin}-{a}")
            begin = b
    other = rf"\W\d_{''.join(ranges)}"
    return re.compile(f"[^{other}]"), re.compile(f"[{other}]+")


def has_letter(text: str) -> bool:
    return _patterns()[0].search(text) is not None


def normalise(text: str) -> bytes:
    """Lower-cased letters; every run of other characters is one space."""
    return _patterns()[1].sub(" ", text.lower()).encode()


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of data; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


class CrossParser:
    """Automata of all languages as dense tables over the bytes seen in training; one more symbol stands for all others.

    A table has at most two rows a byte of the sample, each of one 32-bit entry a distinct byte: about 15 MB for a sample of 32,768 characters.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        seen = np.unique(np.frombuffer(b"".join(samples[x] for x in self.langs), np.uint8))
        self.symbol = np.full(256, len(seen), np.uint8)
        self.symbol[seen] = np.arange(len(seen), dtype=np.uint8)
        self.width = w = len(seen) + 1
        self.bits = np.log2([max(2, len(samples[x])) for x in self.langs])  # that name a place in the sample
        self.tables = []
        for lang in self.langs:
            go = suffix_automaton(samples[lang])
            # Entries: 2 * (next state * width), odd where no longer match exists and a new phrase begins with this symbol.
            # The row after the states' own is where a parse begins, and where a symbol that the sample lacks leads: it is a phrase alone.
            start = np.full(w, 2 * len(go) * w, np.int32)
            for c, s in go[0].items():
                start[self.symbol[c]] = 2 * s * w
            moves = np.tile(start + 1, (len(go) + 1, 1))
            rows = np.repeat(np.arange(len(go)), [len(g) for g in go])
            cols = self.symbol[np.fromiter((c for g in go for c in g), np.uint8, len(rows))]
            moves[rows, cols] = 2 * w * np.fromiter((s for g in go for s in g.values()), np.int32, len(rows))
            self.tables.append(moves.ravel())

    def phrases(self, data: list[bytes], block: int = BLOCK) -> np.ndarray:
        """Phrases of each text (rows) under each language (columns).

        Lanes of `block` symbols are parsed side by side, each as if a parse began there. Then each lane of a text is parsed again from the state in
        which the lane before it ended, only until both parses are in one state; from there on they are the same.
        """
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        flat = self.symbol[np.frombuffer(b"".join(data), np.uint8)].astype(np.int32)
        per = -(-sizes // block)
        owner = np.repeat(np.arange(len(data)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * block
        length = np.minimum(block, sizes[owner] - nth * block)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(nth > 0, place[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]  # the lane before, in order of length
        owner, begin, length = owner[order], begin[order], length[order]
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")  # lanes longer than k, for each k
        later = np.flatnonzero(before >= 0)
        row = np.zeros(len(owner), np.int64)  # of a later lane in path and counted
        row[later] = np.arange(len(later))
        open_ = np.searchsorted(later, active)  # later lanes longer than k: as lanes go by length, these are the first
        path = np.zeros((steps, len(later)), np.int32)
        counted = np.zeros((steps, len(later)), np.uint16 if block < 1 << 16 else np.int32)
        out = np.zeros((len(data), len(self.langs)), np.int64)
        for j, moves in enumerate(self.tables):
            at = np.full(len(owner), len(moves) - self.width, np.int32)
            count = np.zeros(len(owner), np.int32)
            for k in range(steps):
                n = active[k]
                entry = moves[at[:n] + flat[begin[:n] + k]]
                count[:n] += entry & 1
                at[:n] = entry >> 1
                if m := open_[k]:
                    path[k, :m], counted[k, :m] = at[later[:m]], count[later[:m]]
            todo, total, own = later, count.copy(), at.copy()
            while len(todo):
                rows, state, new, k = todo, at[before[todo]], np.zeros(len(todo), np.int32), 0
                moved = []
                while len(rows):
                    entry = moves[state + flat[begin[rows] + k]]
                    new, state = new + (entry & 1), entry >> 1
                    same = state == path[k, row[rows]]
                    met = rows[same]
                    total[met] = count[met] - counted[k, row[met]] + new[same]
                    moved.append(met[at[met] != own[met]])
                    at[met] = own[met]
                    k += 1
                    ended = ~same & (length[rows] == k)
                    if ended.any():  # the whole lane differs, and so does where the next one begins
                        done = rows[ended]
                        total[done] = new[ended]
                        moved.append(done[at[done] != state[ended]])
                        at[done] = state[ended]
                    rows, state, new = (x[~same & ~ended] for x in (rows, state, new))
                todo = later[np.isin(before[later], np.concatenate(moved))]
            out[:, j] = np.bincount(owner, weights=total, minlength=len(data))
        return out

    def costs(self, data: list[bytes]) -> np.ndarray:
        """Bits that each text (rows) takes under each language (columns)."""
        return self.phrases(data) * self.bits


def _parser(samples: dict[str, bytes]) -> CrossParser:
    key = xxhash.xxh3_64_intdigest(repr(sorted(samples.items())).encode())
    return held_model(("langid", key), lambda: CrossParser(samples))


def _shared_out(sizes: list[int], total: int) -> list[int]:
    """Even shares of the total for texts of these sizes; what a short text leaves goes to the rest."""
    out, left = [0] * len(sizes), total
    for rank, i in enumerate(sorted(range(len(sizes)), key=lambda i: (sizes[i], i))):
        out[i] = min(sizes[i], left // (len(sizes) - rank))
        left -= out[i]
    return out


def learn_samples(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = SAMPLE_DOCS, chars_per_language: int = 32_768, max_languages: int = 256, chars_in_all: int = 1 << 21
) -> dict[str, bytes]:
    """Normalised text of each language, from docs_per_language rows by order of a hash of the id, chars_per_language in all.

    The sample is bounded by these parameters, whatever the size of the table; its rows have even shares of it, and what short ones leave goes to
    the rest. Of more labels the max_languages most frequent are learned (ties: the first by name), and languages share chars_in_all evenly. Rows with a
    null language, text or id don't count; rows that repeat an id count each, those of the least hash of their text first.
    """
    labels = labelled.select(quoted(lang_col).alias("lang")).dropna().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    labelled, chars_per_language = labelled.where(quoted(lang_col).isin([r.lang for r in labels])), min(chars_per_language, chars_in_all // max(1, len(labels)))
    own = labelled.select(quoted(id_col).alias("id"), quoted(lang_col).alias("lang"), quoted(text_col).alias("text")).dropna()
    chosen = _by_hash(own, 1, docs_per_language)
    if not chosen:
        return {}
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))  # of an id's rows no more than are wanted
    found = own.where(F.col("id").isin(chosen)).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= docs_per_language)
    by_lang: dict[str, list] = {}
    for r in found.select("lang", "id", F.substring("text", 1, chars_per_language).alias("text")).collect():
        by_lang.setdefault(r.lang, []).append((xxhash.xxh3_64_intdigest(str(r.id).encode()), normalise(r.text)))
    out = {}
    for lang, rows in by_lang.items():
        parts = [t for _, t in sorted(rows)]
        out[lang] = [t[:n] for t, n in zip(parts, _shared_out([len(t) for t in parts], chars_per_language))]
    return {lang: b" ".join(parts) for lang, parts in _without_strangers(out).items()}


def _without_strangers(parts: dict[str, list[bytes]], least: int = 40, slack: float = 1.75) -> dict[str, list[bytes]]:
    """The samples without texts that aren't in the language of their label, as they would be accepted by themselves.

    Each half of a language's texts is parsed against the other halves. A text of `least` bytes or more goes if its phrase rate is beyond slack times
    the median of its language's, or if another language takes it at three quarters of the cost. Languages of fewer than eight texts stay as they are.
    """
    kept = {lang: list(own) for lang, own in parts.items() if len(own) < 8}
    judged = {lang: own for lang, own in parts.items() if len(own) >= 8}
    for half in (0, 1) if judged else ():
        parser = CrossParser({lang: b" ".join(own[1 - half :: 2] if lang in judged else own) for lang, own in parts.items()})
        for lang, own in judged.items():
            probes, me = own[half::2], parser.langs.index(lang)
            phrases = parser.phrases(probes)
            cost, rates = phrases * parser.bits, phrases[:, me] / np.maximum(1, np.fromiter(map(len, probes), float, len(probes)))
            most = slack * np.median(rates)
            fits = (rates <= most) & (cost.min(axis=1) >= 0.75 * cost[:, me])
            kept.setdefault(lang, []).extend(t for t, ok in zip(probes, fits) if ok or len(t) < least)
    return {lang: kept[lang] or own for lang, own in parts.items()}


def _by_hash(own: DataFrame, first: int, last: int) -> list:
    """Ids of the rows of each language from number first to last, in order of a hash of the id."""
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    return [r.id for r in own.select("id", "lang").withColumn("nth", F.row_number().over(rank)).where(F.col("nth").between(first, last)).select("id").collect()]


#: Parts of 1 in which phrase rates are counted.
RATES = 10_000


def learn_rate_limits(labelled: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = 40, slack: float = 2.5) -> dict[str, float]:
    """The phrase rate beyond which a text isn't in its language: rate_limits of all labelled rows, parsed for it."""
    own = labelled.select(quoted(id_col).alias("id"), quoted(lang_col).alias("lang"), quoted(text_col).alias("text"))
    return rate_limits(identify(own, samples, "id", "text"), samples, "id", "text", "lang", least, slack)


def rate_limits(judged: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = 40, slack: float = 2.5) -> dict[str, float]:
    """The phrase rate beyond which a text isn't in its language: slack times the 95th percentile of all rows that identify() gave their own label,
    but for those of which samples were made.

    A percentile, as a few of the rows may be in no language themselves. Rates are counted in parts of 1 / RATES, rounded up, so that the counts of
    any number of rows are a small table. Texts of fewer than `least` letters don't count; a language without any other has no limit.
    """
    own = judged.select(quoted(id_col).alias("id"), quoted(lang_col).alias("lang"), quoted(text_col).alias("text"), "lang_pred", "phrase_rate").dropna(subset=["id", "lang", "text"])
    own = own.where(F.col("lang").isin(sorted(samples)))
    chosen = _by_hash(own, 1, SAMPLE_DOCS)
    if not chosen or not samples:
        return {}
    held = own.where((F.col("lang") == F.col("lang_pred")) & ~F.col("id").isin(chosen) & (letters(F.col("text")) >= least))
    counts = held.groupBy("lang", F.ceil(F.col("phrase_rate") * RATES).alias("rate")).count()
    upto = F.sum("count").over(Window.partitionBy("lang").orderBy("rate"))
    ranked = counts.select("lang", "rate", upto.alias("upto"), F.sum("count").over(Window.partitionBy("lang")).alias("n"))
    got = ranked.where(F.col("upto") * 100 >= F.col("n") * 95).groupBy("lang").agg(F.min("rate").alias("rate")).collect()
    return {r.lang: slack * r.rate / RATES for r in got}


def letters(text: Column) -> Column:
    """Number of letters of a text."""
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def identify(docs: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs besides lang_pred, score and phrase_rate.

    lang_pred is the language of the least cost (ties: the first by name), `und` where the text is null or has no letter or
    nothing was learned. score is 1 - least / second least cost, scaled to 0-1 by doubling and cut at 1; 0 for `und`, 1
    with a single language. phrase_rate is the winner's phrases a byte of the normalised text (null for `und`). Columns of docs named as one of
    the three are replaced; any other name may occur. Whole texts are parsed, of any length;
    repeated rows and ids are judged row by row; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    kept = docs.drop("lang_pred", "score", "phrase_rate")
    source, text = numbered(kept), f"c{kept.columns.index(text_col)}"
    added = StructType.fromDDL("lang_pred string, score double, phrase_rate double")

    def run(batches):
        parser = _parser(shared.value)
        for batch in pieces(batches, text, 2 << 20):
            raw = texts(batch, text)
            clean = [normalise(t) if has_letter(t) else b"" for t in raw]
            known = np.fromiter((len(c) > 0 for c in clean), bool, len(clean)) & (len(parser.langs) > 0)
            pred, score, rate = np.full(len(raw), "und", object), np.zeros(len(raw)), np.full(len(raw), np.nan)
            if known.any():
                own = [c for c in clean if c]
                phrases = parser.phrases(own)
                cost = phrases * parser.bits
                best = cost.argmin(axis=1)
                pred[known] = np.array(parser.langs, object)[best]
                two = np.sort(cost, axis=1)[:, :2]
                score[known] = np.minimum(1.0, 2 * (1 - two[:, 0] / two[:, 1])) if cost.shape[1] > 1 else 1.0
                rate[known] = phrases[np.arange(len(own)), best] / np.fromiter(map(len, own), float, len(own))
            more = [pa.array(pred, pa.string()), pa.array(score), pa.array(rate, mask=np.isnan(rate))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score", "phrase_rate"])

    return source.mapInArrow(run, StructType([*source.schema.fields, *added.fields])).toDF(*kept.columns, *added.names)


def fold(id_col: str, n: int) -> Column:
    """crc32 of an id as text, modulo n (null id: that of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from the rows whose fold of four isn't 2."""
    docs = table(spark, sf_dir, "documents")
    samples = learn_samples(docs.where(fold("doc_id", 4) != 2))
    judged = identify(docs.select("doc_id", "text"), samples)
    return judged.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "phrase_rate")
