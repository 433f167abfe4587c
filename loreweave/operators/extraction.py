"""Text extraction: segments, entity mentions and candidate claims. Proposals only; nothing is asserted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENTITY_CONFIDENCE, CLAIM_CONFIDENCE = 0.55, 0.45


def segments(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, seg_no, byte_start, byte_end, segment): between full stops and line ends, trimmed, empty ones left out.

    seg_no counts from 0 the segments kept; offsets are bytes of the trimmed segment.
    """
    parts = F.split(text, r"[.\n]", -1)
    d = docs.select(key, parts.alias("parts"))
    each = d.select(key, F.posexplode("parts").alias("pos", "raw"))
    w = Window.partitionBy(key).orderBy("pos")
    before = F.coalesce(F.sum(F.octet_length("raw") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.octet_length("raw") - F.octet_length(F.regexp_replace("raw", r"^\s+", ""))
    seg = F.regexp_replace(F.regexp_replace("raw", r"^\s+", ""), r"\s+$", "")
    placed = each.withColumn("byte_start", before + lead).withColumn("segment", seg)
    kept = placed.where("segment <> ''")
    return kept.select(key, (F.row_number().over(w) - 1).alias("seg_no"), F.col("byte_start").cast("bigint").alias("byte_start"), (F.col("byte_start") + F.octet_length("segment")).cast("bigint").alias("byte_end"), "segment")


def entities(segs: DataFrame, key: str) -> DataFrame:
    """(key, seg_no, mention, n, confidence): capitalised tokens of at least two bytes, stripped of marks around them."""
    token = F.explode(F.split("segment", r"\s+")).alias("raw")
    t = segs.select(key, "seg_no", token).select(key, "seg_no", F.regexp_replace("raw", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("mention"))
    cap = F.col("mention").rlike(r"^\p{Lu}") & (F.octet_length("mention") >= 2)
    return t.where(cap).groupBy(key, "seg_no", "mention").agg(F.count("*").alias("n")).withColumn("confidence", F.lit(ENTITY_CONFIDENCE))


def claims(segs: DataFrame, key: str) -> DataFrame:
    """(key, seg_no, subject, predicate, object, confidence) of segments of three words or more: first, up to four between, last."""
    w = F.split("segment", r"\s+")
    c = segs.withColumn("w", w).where(F.size("w") >= 3).select(
        key, "seg_no", F.element_at("w", 1).alias("subject"),
        F.array_join(F.slice("w", F.lit(2), F.least(F.size("w") - 2, F.lit(4))), " ").alias("predicate"),
        F.element_at("w", -1).alias("object"), F.lit(CLAIM_CONFIDENCE).alias("confidence"))
    return c.where("subject <> object")
