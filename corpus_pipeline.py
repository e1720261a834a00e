"""From raw documents to packed token sequences: five stages, each one operator over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.llm import private_data
from tallymark.llm.common import id_bucket, stage, table
from tallymark.llm.decontamination import leaks
from tallymark.llm.language import calibrate, identify, learn
from tallymark.llm.near_duplicates import near_duplicates
from tallymark.llm.packing import pack_documents


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """All columns of ``docs`` as one, beside those an operator reads: names of further columns cannot clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), *columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language would have written go; a missing language is filled in.

    Profiles are learned from four in five of the documents that state a language. A text goes if it has no letter, or if
    its score lies well below that of the nearest language's own texts of like length (``language.Floors``). With no
    document that states a language nothing can be told apart, and only texts without a letter go.
    """
    known = docs.filter(F.coalesce(id_bucket("doc_id", 5) != 0, F.lit(False)))
    profiles = learn(known)
    told = identify(_packed(docs, "text"), profiles, ["__doc"])
    if profiles.languages:
        told = told.filter(~calibrate(known, profiles).rejected("__doc.text"))
    else:
        told = told.filter(F.col("__doc.text").rlike(r"\p{L}"))
    lang = F.coalesce("__doc.lang", "lang_pred").alias("lang")
    return told.select(*[lang if c == "lang" else F.col(f"__doc.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id stays of each group; documents without an id stay, as nothing names them.

    Rows that share an id are one document and stay together.
    """
    keep = near_duplicates(docs).filter("kept").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a benchmark item away go; documents without an id are told apart by a hash of their text."""
    benchmark = table(spark, sf_dir, "benchmark")
    bad = leaks(docs, benchmark).select("doc_id").filter("doc_id IS NOT NULL").distinct()
    kept = docs.filter("doc_id IS NOT NULL").join(stage(bad), "doc_id", "left_anti")
    nameless = docs.filter("doc_id IS NULL").withColumn("__text", F.xxhash64("text"))
    if nameless.isEmpty():
        return kept
    found = leaks(nameless.select(F.col("__text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__text")).distinct()
    return kept.unionByName(nameless.join(stage(found), "__text", "left_anti").select(*docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets; ``n_chars`` follows the text. No document goes."""
    found = private_data.find(_packed(docs, "text"), ["__doc"])
    text = private_data.redacted(F.col("__doc.text"), F.col("spans"))
    clean = found.select("__doc", text.alias("__text"))
    changed = {"text": F.col("__text"), "n_chars": F.length("__text").cast(docs.schema["n_chars"].dataType)}
    return clean.select(*[changed[c].alias(c) if c in changed else F.col(f"__doc.`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents' tokens with their places in sequences of 2,048."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("private_data", redact),
    ("best_fit_packing", packing),
]

# The stages learn profiles, merge near copies and pack by best fit, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
