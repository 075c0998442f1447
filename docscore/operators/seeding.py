"""Seeding truth: new documents found against those already in the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscore import schema as S
from docscore.functions import text as X


def new_documents(found: DataFrame, existing: DataFrame, overwrite: bool = False, most: int | None = None, key: str = "document_id") -> DataFrame:
    """Found documents whose id the manifest does not have; all of them when overwriting; at most ``most``."""
    rows = found if overwrite else found.join(existing.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return rows.orderBy(key).limit(most) if most is not None else rows


def seeded_entries(documents: DataFrame, extracted: DataFrame, seeded_by: str, sample_lines: int = 12) -> DataFrame:
    """Manifest entries with the extracted record as a proposal: every field UNREADABLE until someone adjudicates."""
    presence = F.create_map(*[x for f in S.BUSINESS_FIELDS for x in (F.lit(f), F.lit("UNREADABLE"))])
    record = F.struct(*[F.col(f"r.{k}").alias(k) for k in S.CANONICAL_KEYS])
    annotation = F.struct(
        presence.alias("field_presence"), F.lit("PENDING").alias("adjudication_status"), F.lit(seeded_by).alias("seeded_by"),
        F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("transcription_confidence"), X.top_lines(F.col("text"), sample_lines).alias("ocr_sample"),
    )
    rows = extracted.select("document_id", F.col("text"), F.struct(*[F.col(k) for k in S.CANONICAL_KEYS]).alias("r"))
    return documents.join(rows, "document_id").select("document_id", "source_file", "split", "language", "pages", "tags", record.alias("ground_truth"), annotation.alias("annotation"))


def document_id_of(path_col: str):
    """An id from the file name without its suffix."""
    return X.slug(F.regexp_replace(F.element_at(F.split(F.col(path_col), "/"), -1), r"\.[^.]*$", ""))
