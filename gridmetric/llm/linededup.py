"""Line de-duplication as an exact set-similarity join, in DataFrame functions alone.

A line's tokens are its distinct lower-cased words. Lines of one token set are one set, which stands where it occurs first, by
document and line number. Distinct sets meet under their rarest tokens (prefix filter); length, position and a parity bitmap bound their
overlap; the Jaccard of the whole sets is verified. A line goes when an earlier line is similar, whether that one stays or not.

Rarity is the count of a token's hash bucket over all lines, so its table has a fixed size; any fixed order keeps the join exact.
Lists of more than about SAMPLE * OFTEN members under one token come first: each member meets the list's earliest members under one of its
tokens, and only lines without a match so far go through whole lists, so that a group of similar lines doesn't make a row for each pair.
Texts are split again for the words of those lines alone that the filters leave.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmetric.llm.common import Scratch, quoted, table

#: Hash buckets of token counts; members in a sample of one line in SAMPLE at which a token's list is long; leaders of a long list; rows that may
#: be broadcast.
BUCKETS, SAMPLE, OFTEN, LEADERS, SMALL = 1 << 18, 16, 32, 16, 20_000
#: Words of the bitmap.
BITMAP = ("s1", "s2")
#: Least and greatest size, as a power of two of bits, of the map of lines whose words are needed for verification (8 MB at most).
LEAST_MAP, LARGEST_MAP = 21, 26


def takes_part(line: Column, min_chars: int | None = None) -> Column:
    """Every line that isn't blank; with min_chars, only those of so many characters."""
    full = F.ltrim(line, F.lit(" \t\n\x0b\f\r")) != ""
    return full if min_chars is None else full & (F.length(line) >= min_chars)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).where(F.col("id").isNotNull())


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int | None = None) -> DataFrame:
    """id, at (number from 0) and line of every line that takes part; a row with a null text or id has none."""
    own = _own(docs, id_col, text_col)
    return own.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(takes_part(F.col("line"), min_chars))


def hashed_words(line: Column) -> Column:
    """The distinct lower-cased words of a line, as 64-bit hashes."""
    hashes = F.array_distinct(F.transform(F.split(F.lower(line), " "), lambda w: F.xxhash64(w)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))  # between two spaces, and at the ends


def rarity(texts: DataFrame) -> bytes:
    """Level of each hash bucket by the count of its words in the column text, in thirds of its binary logarithm: a byte below 128 for each,
    whatever the input."""
    words = F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")
    # Words are hashed as rows, in compiled code; only their numbers are shuffled.
    counts = texts.select(F.explode(words).alias("w")).groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).count()
    levels = counts.select("b", F.least(F.floor(3 * F.log2("count")), F.lit(127)).cast("int").alias("level"))
    packed = levels.groupBy(F.expr("CAST(b div 4096 AS INT)").alias("part")).agg(F.array_join(F.collect_list(F.concat_ws(":", "b", "level")), ",").alias("of"))
    out = bytearray(BUCKETS)
    for r in packed.collect():
        for pair in r.of.split(","):
            b, level = pair.split(":")
            out[int(b)] = int(level)
    return bytes(out)


def token_sets(lines: DataFrame, level: bytes, percent: int) -> DataFrame:
    """Each distinct token set where it occurs first: id, at, n (tokens), bitmap (s1, s2), prefix (rarest tokens as numbers)."""
    # A byte a bucket: the driver copies, compares and prints this literal again and again while it plans.
    lookup = F.lit(level)
    level_of = lambda h: F.ascii(F.substring(lookup, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int") + 1, 1).cast("string")).cast("long")
    # A token is its bucket's level and then the rest of its hash, so that numbers sort by rarity.
    key = lambda h: F.shiftleft(level_of(h), 53).bitwiseOR(F.shiftrightunsigned(h, 11))
    keyed = lines.select("id", "at", F.sort_array(F.transform(hashed_words(F.col("line")), key)).alias("keys")).withColumn("n", F.size("keys"))
    # Parities of the tokens on 64 places, for two halves of all tokens.
    bits = lambda half: F.expr(f"aggregate(keys, 0L, (a, k) -> IF((k & 64) = {half}, a ^ shiftleft(1L, CAST(k & 63 AS INT)), a))")
    full = keyed.select(
        F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2"), "id", "at", "n",
        bits(0).alias("s1"), bits(64).alias("s2"),
        F.slice("keys", 1, F.col("n") - _least(F.col("n"), percent) + 1).alias("prefix"))
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id", "at"))
    return full.withColumn("nth", nth).where(F.col("nth") == 1).select("id", "at", "n", *BITMAP, "prefix")


def _least(n: Column, percent: int) -> Column:
    """Least overlap of a set of n with any similar set."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _overlap(na: str, nb: str, percent: int) -> Column:
    """Least overlap of sets of na and nb that are similar: ceil(percent / (100 + percent) * (na + nb))."""
    return F.expr(f"({percent} * ({na} + {nb}) + {99 + percent}) div {100 + percent}")


def _apart() -> Column:
    """Bits in which the bitmaps of a and b differ: no more than the sets differ in tokens."""
    return sum(F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in BITMAP)


def _close(percent: int) -> Column:
    """Bitmap and position filters on a (columns of the one) and b (columns of the other) under a shared token."""
    need, c = _overlap("a.n", "b.n", percent), F.col
    position = F.least(c("a.n") - c("a.pos"), c("b.n") - c("b.pos")) >= need - F.least("a.pos", "b.pos")
    return (_apart() <= c("a.n") + c("b.n") - 2 * need) & position


def _earlier() -> Column:
    return F.struct("a.id", "a.at") < F.struct("b.id", "b.at")


PAIR = ("ida", "ata", "idb", "atb")
#: Shares of all keys that are joined one after the other: shuffles of one share at a time are on disk.
SHARES = 2


def _pair() -> list[Column]:
    return [F.col(f"{x}.{c}").alias(c + x) for x in "ab" for c in ("id", "at")]


def _listed_pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs of an a of the left list that is earlier than a b of the right one, under one key."""
    sizes = (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent)
    return left.alias("a").join(right.alias("b"), (F.col("a.key") == F.col("b.key")) & sizes & _close(percent) & _earlier()).select(*_pair())


def _short_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs under all keys of the entries, the earlier line as a.

    What is cheap and seldom true comes first. Of two sets the smaller one needs its first tokens up to the overlap with an equally large one.
    """
    sizes = (F.col("a.n") <= F.col("b.n")) & (F.col("b.n") * percent <= F.col("a.n") * 100)
    small = F.col("a.pos") <= F.col("a.n") - _overlap("a.n", "a.n", percent)
    once = (F.col("a.n") < F.col("b.n")) | _earlier()
    met = entries.alias("a").join(entries.alias("b"), (F.col("a.key") == F.col("b.key")) & sizes & small & _close(percent) & once).select(*_pair())
    swap = F.struct("ida", "ata") > F.struct("idb", "atb")
    turned = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("idb", "ida"), ("atb", "ata"), ("ida", "idb"), ("ata", "atb"))]
    return met.select(*turned)


def _kept_pairs(pairs_of: Callable[[Column], DataFrame], scratch: Scratch, gone: DataFrame | None = None) -> DataFrame:
    """The written pairs of shares of the keys (pairs_of: a condition on key), but for those whose b is gone; a pair may stand in each share."""
    kept = []
    for k in range(SHARES):
        met = pairs_of(F.pmod("key", F.lit(SHARES)) == k)
        if gone is not None:
            met = met.join(gone.select(F.col("id").alias("idb"), F.col("at").alias("atb")), ["idb", "atb"], "left_anti").select(*PAIR)
        kept.append(scratch.keep(met.distinct(), "pairs"))
    return reduce(DataFrame.union, kept)


def _map_of(members: DataFrame, bits: int, *of: str) -> Column:
    """A condition on the columns `of` that holds for all members and, by chance, for few others: a map of so many bits, a scalar subquery."""
    place = F.pmod(F.xxhash64(*of), F.lit(bits))
    words = members.select(place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("x"))
    every = members.sparkSession.range(bits // 64).withColumnRenamed("id", "w").join(words, "w", "left")
    ordered = F.sort_array(F.collect_list(F.struct("w", F.coalesce("x", F.lit(0).cast("long")).alias("x"))))
    word = F.get(every.agg(F.transform(ordered, lambda e: e["x"])).scalar(), F.expr(f"CAST(pmod(xxhash64({', '.join(of)}), {bits}) div 64 AS INT)"))
    return F.getbit(word, F.pmod(F.xxhash64(*of), F.lit(64)).cast("int")) == 1


def _words_of(pairs: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """The written table id, at, words (as 64-bit hashes) of the lines in the pairs, split again from the texts (own: id, text) that hold some."""
    members = scratch.keep(pairs.select(F.col("ida").alias("id"), F.col("ata").alias("at")).union(pairs.select("idb", "atb")).distinct(), "members")
    bits = 1 << min(LARGEST_MAP, max(LEAST_MAP, (8 * members.count()).bit_length()))
    lines = own.where(_map_of(members, bits, "id")).select("id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    hashed = lines.where(_map_of(members, bits, "id", "at")).select("id", "at", hashed_words(F.col("line")).alias("words"))
    found = scratch.keep(hashed.join(members, ["id", "at"], "left_semi"), "words")
    scratch.drop(members)
    return found


def _similar(pairs: DataFrame, words_of: DataFrame, percent: int) -> DataFrame:
    """id and at of every b of the pairs (ida, ata, idb, atb) whose words have the similarity to those of a."""
    side = lambda x: words_of.select(F.col("id").alias("id" + x), F.col("at").alias("at" + x), F.col("words").alias("w" + x))
    both = pairs.join(side("a"), ["ida", "ata"]).join(side("b"), ["idb", "atb"])
    common = F.size(F.array_intersect("wa", "wb"))
    return both.where(100 * common >= percent * (F.size("wa") + F.size("wb") - common)).select(F.col("idb").alias("id"), F.col("atb").alias("at")).distinct()


def _matched(pairs: DataFrame, own: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """id and at of every b that has a similar a. The earliest a is verified first; the others only where that one fails."""
    found = _words_of(pairs, own, scratch)
    first = pairs.groupBy("idb", "atb").agg(F.min(F.struct("ida", "ata")).alias("x")).select(F.col("x.ida").alias("ida"), F.col("x.ata").alias("ata"), "idb", "atb")
    done = scratch.keep(_similar(first, found, percent), "done")
    rest = pairs.select(*PAIR).join(done.select(F.col("id").alias("idb"), F.col("at").alias("atb")), ["idb", "atb"], "left_anti").join(first, [*PAIR], "left_anti")
    more = scratch.keep(_similar(rest, found, percent), "more")
    scratch.drop(found)
    return done.union(more)


def later_matches(docs: DataFrame, scratch: Scratch, percent: int, id_col: str, text_col: str, min_chars: int | None) -> tuple[DataFrame, DataFrame]:
    """The written table of distinct token sets (id, at of the first occurrence), and those (id, at) that an earlier line is similar to."""
    own = _own(docs, id_col, text_col)
    level = rarity(docs.select(quoted(text_col).alias("text")))
    sets = scratch.keep(token_sets(lines_of(docs, id_col, text_col, min_chars), level, percent), "sets")
    # A set of n is similar to no other set if even n of n + 1 tokens are too few in common: its only matches are equal sets, which are one already.
    joins = sets.where((F.col("n") + 1) * percent <= 100 * F.col("n"))
    listed = lambda rows: rows.select("id", "at", "n", *BITMAP, F.posexplode("prefix").alias("pos", "key"))
    entries = listed(joins)
    some = listed(joins.where(F.pmod(F.xxhash64("id", "at"), F.lit(SAMPLE)) == 0))
    long = scratch.keep(some.groupBy("key").count().where(F.col("count") >= OFTEN).select("key"), "long")
    n_long = long.count()
    marked = F.broadcast(long) if n_long <= SMALL else long
    lists = scratch.keep(entries.join(marked, "key"), "lists")
    # A member's least key comes with its least position, as prefixes are in order.
    one = lists.groupBy("id", "at", "n", *BITMAP).agg(F.min("key").alias("key"), F.min("pos").alias("pos"))
    first = F.min(F.struct("id", "at", "n", *BITMAP, "pos")).alias("x")
    leaders = one.groupBy("key", F.pmod(F.xxhash64("id", "at"), F.lit(LEADERS)).alias("c")).agg(first).select("key", "x.*")
    led = scratch.keep(_listed_pairs(leaders, one, percent).distinct(), "led")
    gone = scratch.keep(_matched(led, own, percent, scratch).distinct(), "gone")
    short = entries.join(marked, "key", "left_anti")
    left = lists.join(gone, ["id", "at"], "left_anti")
    pairs = _kept_pairs(lambda share: _short_pairs(short.where(share), percent), scratch, gone)
    rest = _kept_pairs(lambda share: _listed_pairs(lists.where(share), left.where(share), percent), scratch)
    scratch.drop(lists)
    return sets, gone.union(_matched(pairs.union(rest), own, percent, scratch)).distinct()


def dedup_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", min_chars: int | None = None) -> DataFrame:
    """All rows and columns of docs, with the text's later similar lines removed, besides n_lines and removed (numbers of the lines that went).

    Lines lie between line feeds; words between spaces. Blank lines (white space alone) stay, and with min_chars those of fewer characters. A
    text keeps its other lines in order. A null text stays null, with no lines; a row with a null id stays as it is and removes nothing. Equal
    lines count as similar, within one text too. Ids are meant to be unique: of rows that repeat an id, a line number stays if the line of any
    of them does. Columns named n_lines or removed are replaced; any other name may occur. Texts may have any length; an empty table gives an
    empty one.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "removed")
    sets, gone = later_matches(docs, scratch, percent, id_col, text_col, min_chars)
    stay = scratch.keep(sets.select("id", "at").join(gone, ["id", "at"], "left_anti").groupBy("id").agg(F.collect_set("at").alias("stay")), "stay")
    scratch.drop(sets)
    # The row's own columns travel as one struct, so that their names clash with none of these.
    split = F.split(quoted(text_col), "\n")
    part = F.array_compact(F.transform(split, lambda line, i: F.when(takes_part(line, min_chars), i)))
    n_lines = F.when(quoted(text_col).isNull(), 0).otherwise(F.size(split))
    own = docs.select(quoted(id_col).alias("id"), F.struct(*map(quoted, docs.columns)).alias("row"), part.alias("part"), n_lines.alias("n_lines")).join(stay, "id", "left")
    empty = F.array().cast("array<int>")
    removed = F.when(F.col("id").isNull() | F.col("part").isNull(), empty).otherwise(F.array_except("part", F.coalesce("stay", empty)))
    out = own.select("row", "n_lines", removed.alias("removed"))
    text = F.col("row").getField(text_col)
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("removed", i))
    text = F.when(F.size("removed") > 0, F.array_join(kept, "\n")).otherwise(text)
    return out.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns], "n_lines", "removed")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines before, lines removed, and a digest of the removed lines' numbers, of every document."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.md5(F.array_join("removed", ",")).alias("removed_md5"))


#: The same by brute force: every earlier line that shares a word is compared. A line takes part unless it is white space alone.
OP9_SQL = """
WITH l AS (
  SELECT doc_id, line_no - 1 AS line_no, list_distinct(list_filter(string_split(lower(line), ' '), lambda w: w <> '')) AS w,
    regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') AS part
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
), p AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS k, doc_id, line_no, w, len(w) AS n FROM l WHERE part),
t AS (SELECT k, n, unnest(w) AS x FROM p),
common AS (
  SELECT a.k AS ka, b.k AS kb, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), gone AS (SELECT DISTINCT kb FROM common WHERE 100 * c >= 80 * (na + nb - c)),
r AS (SELECT doc_id, count(*) AS n_removed, string_agg(line_no, ',' ORDER BY line_no) AS removed FROM p JOIN gone ON k = kb GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(coalesce(removed, '')) AS removed_md5
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
