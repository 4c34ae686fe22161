"""A corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All
but the last return the columns of documents. Rows are told apart by their place in the table
that a stage reads, so that null and repeated doc_ids lose nothing; a stage's input must
therefore be a table that is read again unchanged, as run() sees to. Columns beside doc_id and
text travel in one struct, so that none of their names can clash with an operator's own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import _bloom, exact_dedup, near_dedup, packing, quality, suffix_dedup
from causeway.llm._io import keep, table

#: Tokens of a sequence.
SEQUENCE = 2048
#: What closes a document.
CLOSING = 1


def _folded(docs: DataFrame) -> DataFrame:
    """doc_id, text and others, which holds all other columns."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("others"))


def _unfolded(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from rows of doc_id, text and others."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose score is 0.5 or more; learnt from labels that aren't held out.

    Texts that are null or empty are scored like any other.
    """
    ranker = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _unfolded(quality.score(_folded(docs), ranker, carry=("doc_id", "text", "others")).where("predicted = 1"), docs)


def _numbered(docs: DataFrame) -> DataFrame:
    return _folded(docs).withColumn("__row", F.monotonically_increasing_id())


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest doc_id of those with equal texts (but for the case of A-Z).

    Null counts as the empty text; of rows that repeat doc_id and text one stays.
    """
    numbered = _numbered(docs)
    judged = exact_dedup.exact_duplicates(numbered.select(F.struct("doc_id", "__row").alias("key"), "text"), doc_id="key")
    return _unfolded(_bloom.without(numbered, "__row", judged.where("NOT kept").select("doc_id.__row")), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component of near copies: five-word shingles, similarity 0.8.

    Documents without words have no near copies and stay.
    """
    numbered = _numbered(docs)
    judged = near_dedup.near_duplicates(numbered.select("__row", "text"), words=5, percent=80, doc_id="__row")
    return _unfolded(_bloom.without(numbered, "__row", keep(judged.where("NOT kept").select("doc_id"), "dropped")), docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the strings of 200 bytes that start anywhere else too out of every text.

    Whole characters only; n_chars is counted anew where a text is cut. No document is dropped;
    a null text stays null.
    """
    key = F.struct("doc_id", "others", F.col("text").isNull().alias("no_text"))
    out = suffix_dedup.remove_repeats(_folded(docs).select(key.alias("key"), "text"), length=200, doc_id="key", whole_characters=True)
    text, others = F.when(~F.col("doc_id.no_text"), F.col("kept").cast("string")), F.col("doc_id.others")
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(others["n_chars"])
        others = others.withField("n_chars", counted)
    return _unfolded(out.select(F.col("doc_id.doc_id").alias("doc_id"), text.alias("text"), others.alias("others")), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2048, with lexical neighbours side by side.

    Null and empty texts have the closing token alone.
    """
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), CLOSING, SEQUENCE)
    return out.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", one_of_copies),
    ("near dedup", one_of_near_copies),
    ("suffix dedup", without_passages),
    ("packing", sequences),
]

#: Scores, suffix sorting and packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs, "stage")
    return docs
