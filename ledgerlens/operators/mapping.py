"""Matching the columns of a table to the canonical fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.numbers import ratio, rounded
from ledgerlens.functions.text import indel_ratio
from ledgerlens.plans import signatures as sig
from ledgerlens.plans.catalog import columns_of, distinct_counts, local_table, value_shapes

def type_scores(df: DataFrame) -> DataFrame:
    """(ordinal, column, id, date, numeric, email, text): how well all values of a column fit each type."""
    infos = columns_of(df)
    c = F.col
    table = value_shapes(df, infos).join(distinct_counts(df, infos), "ordinal", "left")
    string = c("kind") == "string"
    fits = {
        "id": F.when(ratio(c("distinct"), c("values")) > 0.9, 0.8).otherwise(0.5),
        "date": F.when(c("kind") == "temporal", 1.0).otherwise(c("dates")),
        "numeric": F.when(c("kind").isin("numeric", "boolean"), 1.0).otherwise(c("numbers")),
        "email": c("emails"),
        "text": F.when(~string, 0.3).when(c("width") > 3, 0.8).otherwise(0.4),
    }
    return table.select("ordinal", "column", *[F.when(c("values") == 0, 0.5).otherwise(s).alias(k) for k, s in fits.items()])


def field_scores(types: DataFrame) -> DataFrame:
    """(ordinal, column, position, field, score): fit of every column to every canonical field."""
    name = F.trim(F.lower(F.col("column")))
    fields = [
        F.struct(F.lit(i).alias("position"), F.lit(field).alias("field"), F.array(*[F.lit(v) for v in variants]).alias("variants"),
                 F.col(kind).cast("double").alias("fit"))
        for i, (field, variants, kind) in enumerate(sig.CANONICAL_FIELDS)
    ]
    named = types.select("ordinal", "column", F.inline(F.array(*fields))).select(
        "ordinal", "column", "position", "field", "fit", F.explode("variants").alias("variant"))
    return named.groupBy("ordinal", "column", "position", "field", "fit").agg(
        F.max(indel_ratio(name, F.col("variant"))).alias("named")
    ).select("ordinal", "column", "position", "field", F.round(F.col("named") * 0.6 + F.col("fit") * 0.4, 9).alias("score"))


def column_mapping(df: DataFrame) -> DataFrame:
    """Canonical field per column, each field used once, columns served in their order.

    The assignment is greedy by column order, not optimal.  It runs over the
    matrix of column and field scores, which holds names and scores only.
    """
    matrix = field_scores(type_scores(df)).collect()
    taken: set[str] = set()
    rows = []
    for ordinal, column in sorted({(m["ordinal"], m["column"]) for m in matrix}):
        free = [m for m in matrix if m["ordinal"] == ordinal and m["field"] not in taken and m["score"] > 0.4]
        best = max(free, key=lambda m: (m["score"], -m["position"]), default=None)
        if best:
            taken.add(best["field"])
        rows.append((ordinal, column, best["field"] if best else None, best["score"] if best else None))
    out = local_table(df.sparkSession, rows, "ordinal int, original_column string, canonical_field string, score double")
    return out.select("ordinal", "original_column", "canonical_field", rounded(F.col("score"), 2).alias("confidence"),
                      F.lit(False).alias("confirmed"))


def override_mappings(mappings: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace canonical fields; ``changes`` has original_column and canonical_field.  Changed rows are confirmed."""
    new = changes.select("original_column", F.col("canonical_field").alias("_field"), F.lit(True).alias("_changed"))
    changed = F.coalesce("_changed", F.lit(False))
    return mappings.join(F.broadcast(new), "original_column", "left").select(
        "ordinal", "original_column", F.when(changed, F.col("_field")).otherwise(F.col("canonical_field")).alias("canonical_field"),
        F.when(changed, 1.0).otherwise(F.col("confidence")).alias("confidence"), (F.col("confirmed") | changed).alias("confirmed"))


def confirm_mappings(mappings: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Confirm some columns, or all of them."""
    chosen = F.lit(True) if columns is None else F.col("original_column").isin(columns)
    return mappings.withColumn("confirmed", F.col("confirmed") | chosen)


def mapping_health(mappings: DataFrame, role: str) -> DataFrame:
    """Score 0-1: share of mapped columns less penalties for missing fields."""
    required, wanted = sig.REQUIRED_FIELDS.get(role, ()), sig.RECOMMENDED_FIELDS.get(role, ())
    rolled = mappings.agg(F.count(F.lit(1)).alias("n"), F.collect_set("canonical_field").alias("have"), F.count("canonical_field").alias("mapped"))

    def lacking(fields: tuple) -> Column:
        return F.array_except(F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>"), F.col("have"))

    rolled = rolled.withColumns({"r": lacking(required), "w": lacking(wanted)})
    score = F.size("have") / F.greatest(F.col("n"), F.lit(1)) - F.size("r") * 0.2 - F.size("w") * 0.05
    return rolled.select(
        rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("score"), F.array_join("r", ",").alias("missing_required"),
        F.array_join("w", ",").alias("missing_recommended"), (F.col("n") - F.col("mapped")).alias("unmapped"))


def mapping_warnings(mappings: DataFrame, role: str) -> DataFrame:
    """(type, message, severity) for missing fields, unsure mappings and many unmapped columns."""
    required, wanted = sig.REQUIRED_FIELDS.get(role, ()), sig.RECOMMENDED_FIELDS.get(role, ())
    rolled = mappings.agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("canonical_field").alias("have"), F.count_if(F.col("canonical_field").isNull()).alias("open"),
        F.count_if(F.col("confidence") < 0.6).alias("unsure"))

    def line(when: Column, kind: str, message: Column, severity: str) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), message.alias("message"), F.lit(severity).alias("severity")))

    lines = [line(~F.array_contains("have", f), f"missing_{f}", F.lit(f"Required field '{f}' is not mapped."), "error") for f in required]
    lines += [line(~F.array_contains("have", f), f"missing_{f}", F.lit(sig.FIELD_WARNINGS.get(f, f"'{f}' is not mapped.")), "warning") for f in wanted]
    lines.append(line(F.col("unsure") > 0, "low_confidence_mappings",
                      F.concat(F.col("unsure").cast("string"), F.lit(" column(s) have low confidence mappings. Please verify.")), "warning"))
    lines.append(line(F.col("open") > F.col("n") * 0.5, "high_unmapped_ratio",
                      F.concat(F.col("open").cast("string"), F.lit(" columns are not mapped. Some data may not be used.")), "info"))
    return rolled.select(F.explode(F.array_compact(F.array(*lines))).alias("w")).select("w.*")
