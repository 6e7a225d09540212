"""The corpus pipeline: five stages over ``documents``, each written as Parquet before the next reads it.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
``documents`` as they are; the last adds ``size, source_size, target, taken`` and keeps the documents that the mix takes words of.

Defined cases, for every stage: a null text is an empty one. An empty table gives an empty result. Rows are judged by their
texts, so repeated rows and ties are judged alike; only near_dedup leaves one of them. Null and repeated ids are rows like others (a row of a
null id has no label). Very long texts are read whole. Columns besides ``doc_id, text, lang, source`` are carried along untouched, whatever
their names; only the last stage's four columns replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.llm.common import crc_mod, fresh, materialize
from gazeframe.llm.decontaminate import decontaminate
from gazeframe.llm.language_id import identify
from gazeframe.llm.language_id import train as train_language
from gazeframe.llm.mixing import mix_sources
from gazeframe.llm.near_dedup import drop_near_duplicates
from gazeframe.llm.toxicity import score_toxicity
from gazeframe.llm.toxicity import train as train_toxicity

#: Languages to keep; None: all that the training rows have.
LANGUAGES: tuple[str, ...] | None = None
#: The probability, on the mean of its letters, that a document's language must have at least.
LEAST_LANGUAGE = 0.5
#: Consecutive words of a benchmark item; a document that holds so many in a row goes, however long it is.
WINDOW = 13

#: SQL has no recurrent networks, nearest neighbours or suffix arrays; the pipeline is tested against brute force.
ORACLE_SQL = None

_ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", "_spans", "_items")


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns called like ``names`` renamed, and the columns that undo that."""
    clash = [c for c in docs.columns if c.lower() in names]
    new = dict(zip(clash, fresh(docs, *(f"{c}_" for c in clash)), strict=True))
    return docs.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (``und``), those predicted in another language than ``LANGUAGES``, and those whose
    language is less probable than ``LEAST_LANGUAGE`` (mixtures, or none of the learnt ones). Without any learnt language, all go."""
    lang, score = fresh(docs, "_lang", "_lang_score")
    got = identify(docs, train_language(docs, crc_mod("doc_id", 3) != 1), out=(lang, score))
    wanted = F.col(lang) != "und" if LANGUAGES is None else F.col(lang).isin(*LANGUAGES)
    return got.where(wanted & (F.col(score) >= LEAST_LANGUAGE)).select(*(f"`{c}`" for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted toxic; without any label, none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = fresh(docs, "_score", "_toxic", "_evidence")
    got = score_toxicity(docs, train_toxicity(docs, labels, crc_mod("doc_id", 4) != 2), out=tuple(out))
    return got.where(F.col(out[1]) == 0).select(*(f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: the one of the least id, null ids last."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ``WINDOW`` words of a benchmark item in a row, or of which a twentieth or more is passages of
    benchmark items (short items have less than a window)."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    own, back = _aside(docs, _ADDED)
    got = decontaminate(own, benchmark, window=WINDOW)
    return got.where(~(F.col("contaminated") | F.exists("spans", lambda x: x["end"] - x["start"] >= WINDOW))).select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights; documents that the mix takes nothing of go."""
    return mix_sources(docs).where("taken > 0")


STAGES = [("language_id", language), ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
