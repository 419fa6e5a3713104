"""Per-product context: cross-section, advisor rows and the entry diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cross_section(products: DataFrame, parts: dict[str, DataFrame], key: str = "product") -> DataFrame:
    """One row per product with a struct per part (null where the part knows nothing)."""
    x = products.select(key)
    for name, df in parts.items():
        cols = [c for c in df.columns if c != key]
        x = x.join(df.select(key, F.struct(*cols).alias(name)), key, "left")
    return x


def context_rows(base: DataFrame, detected: str = "detected", texts: str = "texts", top: int = 3) -> DataFrame:
    """JSON context per product: all fields, the strongest `top` patterns and the latest texts."""
    fields = [c for c in base.columns if c not in (detected, texts, "product")]
    pat = F.transform(F.slice(F.coalesce(detected, F.array().cast(base.schema[detected].dataType)), 1, top), lambda p: p["name"])
    return base.select("product", F.to_json(F.struct(*fields, pat.alias("patterns"), F.coalesce(texts, F.array().cast("array<string>")).alias("texts"))).alias("context"))


def entry_diagnosis(df: DataFrame, gates: Sequence[tuple[str, Column]]) -> DataFrame:
    """The first gate in order that blocks each row, or ok."""
    reason = None
    for name, blocked in gates:
        hit = F.coalesce(blocked, F.lit(False))
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    return df.withColumn("blocked_by", reason.otherwise("ok"))
