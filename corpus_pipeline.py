"""From raw documents to packed windows: quality, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentide.llm.common import dropped, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or their language's perplexity band reject."""
    from lumentide.llm.perplexity import quality as judge

    return judge(docs, also=("text", "lang", "source", "n_chars")).where("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language; the model learns from the labels that documents carry. Without any label all stay."""
    from lumentide.llm.language import fit, predict

    model = fit(docs.select("text", "lang"))
    if not model.languages:
        return docs.select(*COLUMNS)
    return predict(docs.select(*COLUMNS), model).where("lang_pred <> 'und'").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least key, of each group linked by five-word shingles at 0.8.

    Where keys are null or repeated, rows are told apart by a stored number, which also decides between equal keys.
    """
    from lumentide.llm.jaccard import linked_components

    rows = docs.select(*COLUMNS)
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        others = stored(linked_components(docs, k=5, percent=80).where("component_id <> doc_id").select("doc_id"), "others")
        return rows.join(others, "doc_id", "left_anti").select(*COLUMNS)
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = linked_components(rows, k=5, percent=80, key="__row").join(rows.select("__row", "doc_id"), "__row")
    firsts = stored(found.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("s")).select("s.__row"), "firsts")
    return rows.join(firsts, "__row", "left_semi").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts; every document stays."""
    from lumentide.llm.private import redact

    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token ids into windows; one row for each piece, with its place in its window."""
    import public_tokenizers

    from lumentide.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [("quality rules", quality), ("language id", language), ("near duplicates", near_duplicates), ("personal data", private), ("packing", packing)]
#: Models and tokenizers can't be told in SQL; tests/llm holds each stage against a plain loop over the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to all that the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if i:
            dropped(before)
    return docs
