"""Audits of paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_audit(df: DataFrame, by: list[str], order: str, text: str, term: str, exempt: str) -> DataFrame:
    """Adds audit: hit where the term stands, exempt if the paragraph before fits the exempting pattern, else none."""
    before = F.lag(text).over(Window.partitionBy(*by).orderBy(order))
    hit = F.coalesce(F.col(text).rlike(term), F.lit(False))
    return df.withColumn("_x", F.coalesce(before.rlike(exempt), F.lit(False))).withColumn("audit", F.when(hit & ~F.col("_x"), "hit").when(hit, "exempt").otherwise("none")).drop("_x")


def paragraphs(df: DataFrame, key: str, xml: str) -> DataFrame:
    """The paragraphs of word-processor XML: key, place, text. Runs of a paragraph are joined; empty ones keep their place."""
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<w:p[ >].*?</w:p>|<w:p/>"), F.lit(0))
    d = df.select(key, F.posexplode(blocks).alias("place", "block"))
    runs = F.regexp_extract_all("block", F.lit(r"(?s)<w:t(?: [^>]*)?>(.*?)</w:t>"), F.lit(1))
    plain = F.concat_ws("", runs)
    for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(mark), F.lit(sign))
    return d.select(key, "place", plain.alias("text"))
