"""A corpus for training from `documents`: language ID, line dedup, near-dedup, secret removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmetric.llm import langid, linededup, minhash, packing, secrets
from gridmetric.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars being that of the text as it is now."""
    return docs.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


#: Score from which a predicted language replaces the label, and letters from which a text's phrase rate can reject it.
CLEAR, LETTERS = 0.6, 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The language that parses best is written to lang where it is clear, or where lang is null.

    Documents without a letter (null texts among them) go, and so do those of 40 letters or more that their best language parses far worse than any
    held-out text of it, as they are in none of the languages. Shorter ones stay. Rows stand alone: repeated ids, ties and null ids change nothing.
    """
    samples = langid.learn_samples(docs)
    judged = Scratch(spark, "language").keep(langid.identify(docs.select(*COLUMNS), samples), "judged")  # all rows are parsed once, for limits and result
    limits = langid.rate_limits(judged, samples, least=LETTERS)
    judged = judged.where(F.col("lang_pred") != "und")
    beyond = F.lit(False)
    for lang, most in sorted(limits.items()):
        beyond = beyond | ((F.col("lang_pred") == lang) & (F.col("phrase_rate") > most))
    kept = judged.where(~(beyond & (langid.letters(F.col("text")) >= LETTERS)))
    lang = F.when((F.col("score") >= CLEAR) | F.col("lang").isNull(), F.col("lang_pred")).otherwise(F.col("lang"))
    return _columns(kept.withColumn("lang", lang))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go, and documents of which nothing is left. A row with a null id stays as it is; of rows that repeat an id, a
    line stays if that of any of them does."""
    done = linededup.dedup_lines(docs.select(*COLUMNS))
    return _columns(done.where((F.size("removed") == 0) | (F.trim(F.translate("text", "\n", " ")) != "")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 or more, that of the least id stays. Rows with a null id or no word stay; rows that repeat an id
    stay or go together."""
    judged = minhash.near_duplicates(docs.select("doc_id", "text"), percent=80)
    gone = judged.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays, with a null source as an empty path."""
    lexicon = secrets.learn_lexicon(docs)
    forest = secrets.train_forest(secrets.made_findings(spark, lexicon=lexicon), lexicon=lexicon)
    return _columns(secrets.redact(docs.select(*COLUMNS), forest))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: pieces with their token ids."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return packing.pack_tokens(docs, f.read())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: SQL can't express the trained models and the tokenizer; tests/llm compares the pipeline with a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
