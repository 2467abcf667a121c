"""Size, source and licence statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LICENSES = (
    ("MIT", r"(?i)\bMIT License\b|Permission is hereby granted, free of charge"),
    ("Apache-2.0", r"(?i)Apache License,? Version 2\.0|Licensed under the Apache License"),
    ("GPL-3.0-or-later", r"(?i)GNU General Public License"),
    ("BSD-3-Clause", r"(?i)Redistribution and use in source and binary forms"),
    ("CC-BY-4.0", r"(?i)Creative Commons Attribution|\bCC[ -]BY\b"),
    ("LicenseRef-proprietary", r"(?i)All rights reserved"),
)
COPYRIGHT = r"(?i)(?:copyright|\(c\)|©)\s*(?:\(c\)|©)?\s*[0-9]{4}(?:-[0-9]{4})?,?\s+([^\n.]{2,80})"


def doc_stats(docs: DataFrame) -> DataFrame:
    """Per document: characters, white-space tokens, length bucket and what is missing."""
    tokens = F.size(T.words(F.col("text"))).cast("long")
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    return docs.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("char_count"), tokens.alias("token_count"), T.length_bucket(tokens).alias("length_bucket"),
        *(blank(c).alias(f"missing_{c}") for c in ("timestamp", "url", "language", "source")), "source", "url", "language", "timestamp",
    )


def license_hits(docs: DataFrame) -> DataFrame:
    """Licence phrases by line: ``doc_id, spdx, line_no``."""
    line = docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("k", "line"))
    rules = F.filter(F.array(*(F.when(F.col("line").rlike(p), F.lit(name)) for name, p in LICENSES)), lambda x: x.isNotNull())
    return line.select("doc_id", F.explode(rules).alias("spdx"), (F.col("k") + 1).cast("long").alias("line_no"))


def license_audit(docs: DataFrame) -> DataFrame:
    """Per document: hits, distinct licences, copyright holders, flags."""
    line = F.transform(T.lines(F.col("text")), lambda x: F.filter(F.array(*(F.when(x.rlike(p), F.lit(n)) for n, p in LICENSES)), lambda y: y.isNotNull()))
    hits = F.flatten(line)
    holders = F.array_distinct(F.transform(F.regexp_extract_all(F.col("text"), F.lit(COPYRIGHT), F.lit(1)), T.strip))
    n = F.coalesce(F.size(hits), F.lit(0))
    return docs.select("doc_id", n.cast("long").alias("license_hit_count"), F.array_join(F.array_sort(F.array_distinct(hits)), ",").alias("licenses"), F.coalesce(F.array_join(F.array_sort(holders), ","), F.lit("")).alias("copyright_holders"), (n > 0).alias("has_license"), (F.coalesce(F.size(holders), F.lit(0)) > 0).alias("has_copyright"))
