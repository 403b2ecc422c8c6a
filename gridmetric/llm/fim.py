"""Fill-in-middle: texts cut into prefix, middle and suffix by a two-pass streaming matcher.

The first pass counts a text's units. The second advances a lazy match iterator to the two ranks at which the text is cut. Neither pass keeps its
matches: besides the text, a text of any length needs the memory of one match.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmetric.llm.common import pieces, quoted, table, texts

#: A unit of one code point, whatever it is.
CODE_POINT = "(?s:.)"
#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Units that one step of a long walk takes.
STRIDE = 256


class UnitMatcher:
    """Walks over a text's units, the matches of a pattern from left to right; what lies between two matches goes with the later one.

    A step takes STRIDE units in one match, whose parts are atomic, so that it ends where as many single matches end.
    """

    def __init__(self, unit: str = CODE_POINT):
        self.one = re.compile(unit)
        if self.one.groups or self.one.match(""):
            raise ValueError("a unit has no capturing group and is never empty")
        self.many = re.compile(f"(?s:.{{{STRIDE}}})" if unit == CODE_POINT else f"(?:(?>(?s:.*?)(?:{unit}))){{{STRIDE}}}+")

    def count(self, text: str) -> int:
        """First pass: the number of units."""
        n = at = 0
        while found := self.many.match(text, at):
            n, at = n + STRIDE, found.end()
        return n + sum(1 for _ in self.one.finditer(text, at))

    def advance(self, text: str, at: int, units: int) -> int:
        """Second pass: where the given number of units from position `at` on ends."""
        for _ in range(units // STRIDE):
            at = self.many.match(text, at).end()
        for found in islice(self.one.finditer(text, at), units % STRIDE):
            at = found.end()
        return at


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks by which an output is read back: none begins in another, or overlaps the end of one, itself included."""
    for a in marks:
        for b in marks:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) or len(set(marks)) < 3:
                raise ValueError("marks must be distinct, not empty and must not overlap")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, marks: tuple[str, str, str] = MARKS, seed: str = "1", transformed: int = 90, suffix_first: int = 20) -> DataFrame:
    """id_col, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output of every row of docs.

    Four numbers h1 to h4, the first 8-digit groups of sha256(seed:id), decide on a row. It stays plain if its text is empty or null (an empty
    output), holds a mark, or h3 % 100 >= transformed; else its form is spm (suffix, prefix, middle) if h4 % 100 < suffix_first, or psm (prefix, suffix,
    middle). The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. What follows the last unit is part of
    the suffix. Rows stand alone: repeated ids are cut by the same numbers, a null id counts as the empty text; an empty table gives an empty one. Other
    columns of docs don't matter, whatever their names. Texts are whole: a batch holds about 8 MB or one text.
    """
    _checked(marks)
    kind = docs.schema[id_col].dataType.simpleString()
    p_mark, s_mark, m_mark = marks

    def run(batches):
        matcher = UnitMatcher(unit)
        for batch in pieces(batches, "text"):
            counts, forms, prefixes, middles, outputs = [], [], [], [], []
            for text, digest in zip(texts(batch, "text"), batch.column("digest").to_pylist()):
                h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
                n = matcher.count(text)
                counts.append(n)
                if not text or h3 % 100 >= transformed or any(m in text for m in marks):
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(text)
                    continue
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                a = matcher.advance(text, 0, low)
                b = matcher.advance(text, a, high - low)
                first = h4 % 100 < suffix_first
                forms.append("spm" if first else "psm")
                prefixes.append(a)
                middles.append(b - a)
                outputs.append(f"{s_mark}{text[b:]}{p_mark}{text[:a]}{m_mark}{text[a:b]}" if first else f"{p_mark}{text[:a]}{s_mark}{text[b:]}{m_mark}{text[a:b]}")
            yield pa.record_batch({
                "id": batch.column("id"), "n": pa.array(counts, pa.int64()), "form": pa.array(forms, pa.string()), "prefix_chars": pa.array(prefixes, pa.int64()),
                "middle_chars": pa.array(middles, pa.int64()), "output": pa.array(outputs, pa.string()),
            })

    key = F.coalesce(quoted(id_col).cast("string"), F.lit(""))
    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), key), 256).alias("digest"))
    out = source.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that fill_in_middle turned into this output: the marks, which its text doesn't hold, part it again."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks), -1)
    at = lambda k: F.element_at(parts, k)
    return F.when(form == "psm", F.concat(at(2), at(4), at(3))).when(form == "spm", F.concat(at(3), at(4), at(2))).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's output, and of the text that is restored from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    again = restored(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256"))


_H = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))

OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {_H} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM c
"""
