"""Cleaning and packing a corpus: language ID, near duplicates, benchmark passages, personal data, packing.

Each stage takes the rows that its predecessor kept, with any further columns, also those named as an operator's own, and returns
the same columns, but for the last. Null ids and labels stay as they are; rows with null, empty or wordless texts go in the first
stage. Repeated rows, of one id and text, pass singly from the second stage on. Texts are handled whole, however long. An empty
table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontam, jaccard, language, packing, pii
from tidelog.llm.common import Scratch, fresh, table

#: Score under which a prediction counts as a rejection, whatever the evidence. Texts of two learned languages share it out and stay:
#: with 0.5, 7 of the 51,282 rows of a test table would go, all of them such texts. Unlearned languages lack evidence.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or of no learned language go, all where nothing can be learned."""
    model = language.train(docs.select("doc_id", "text", "lang"))
    score, known = fresh(docs.columns, "score", "known")
    (lang,) = fresh([*docs.columns, score, known], "lang_pred")
    return language.predict(docs, model, (lang, score, known)).where(F.col(known) & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles (similarity 0.8 or more) join."""
    return jaccard.keep_one(docs, size=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    names = fresh(docs.columns, "n_words", "spans", "items")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), names=tuple(names))
    return found.where(F.size(names[1]) == 0).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and its place there."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Neither the learned classifier nor the packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; of the tables between them only the last is kept."""
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
