"""Counts and listings over matched records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.operators.lookups import join_per_key

DOC = ["doc_id"]


def _scope(keys: list[str] | None) -> list[str]:
    return DOC if keys is None else keys


def _is(*types: str) -> Column:
    return F.col("match_type").isin(*types)


def report(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total, matched and unmatched per document."""
    return matches.groupBy(*_scope(keys)).agg(
        F.count("*").alias("total_attributes"),
        F.count_if(~_is("unmatched")).alias("matched"),
        F.count_if(_is("unmatched")).alias("unmatched"))


def type_counts(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A1: records per match type."""
    return matches.groupBy(*_scope(keys), "match_type").agg(F.count("*").alias("n"))


def summary_cards(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A2: the headline numbers; containment types have their own column (Q7)."""
    return matches.groupBy(*_scope(keys)).agg(
        F.count("*").alias("total"),
        F.count_if(~_is("unmatched")).alias("matched"),
        F.count_if(_is("unmatched")).alias("unmatched"),
        F.count_if(_is("exact", "synonym")).alias("exact_synonym"),
        F.count_if(_is("fuzzy", "semantic")).alias("fuzzy_semantic"),
        F.count_if(_is("prefix", "abbrev")).alias("prefix_abbrev"))


def first_per_name(matches: DataFrame, keys: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """A3: the first result of every raw name; an aggregate, so repeated names combine map-side."""
    row = F.struct(pos, "canonical_attr", "match_type", "confidence", "matched_variation")
    best = matches.groupBy(*_scope(keys), "raw_attr").agg(F.min_by(row, pos).alias("_r"))
    return best.select(*_scope(keys), "raw_attr", "_r.*")


SERIAL_BLOCK = 65_536


def preview(records: DataFrame, pos: str = "pos") -> DataFrame:
    """A4: records with a name or a value, numbered from 1 per document.

    Numbers come from counts of position blocks plus the rank inside a block, so no task sorts a
    whole document. Needs a bigint ``pos`` unique in its document.
    """
    kept = records.filter((tx.strip("attribute") != "") | (tx.strip("value") != ""))
    kept = kept.withColumn("_block", F.col(pos) - F.pmod(F.col(pos), F.lit(SERIAL_BLOCK)))
    sizes = kept.groupBy("doc_id", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("doc_id", "_block").orderBy(pos)
    ranked = kept.withColumn("_rank", F.row_number().over(inside))
    numbered = ranked.join(offsets.select("doc_id", "_block", "_before"), ["doc_id", "_block"])
    return numbered.withColumn("serial_no", (F.col("_before") + F.col("_rank")).cast("bigint")).drop(
        "_block", "_rank", "_before")


def unmatched_names(matches: DataFrame, keys: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """A5: names whose first result is unmatched."""
    return first_per_name(matches, keys, pos).filter(_is("unmatched")).select(*_scope(keys), "raw_attr")


def distribution(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Title-cased match types with counts, most frequent first."""
    return type_counts(matches, keys).select(
        *_scope(keys), F.initcap("match_type").alias("match_type"), "n").orderBy(
        *_scope(keys), F.desc("n"), "match_type")


def confidence_table(matches: DataFrame, keys: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """Confidence of every distinct name in percent with one decimal."""
    return first_per_name(matches, keys, pos).select(
        *_scope(keys), "raw_attr", F.round(F.col("confidence") * 100, 1).alias("confidence_pct"),
        F.initcap("match_type").alias("match_type"))


def match_rate(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of matched records in percent, 0 without records."""
    total, matched = F.count("*"), F.count_if(~_is("unmatched"))
    rate = F.when(total > 0, matched / total * 100).otherwise(F.lit(0.0))
    return matches.groupBy(*_scope(keys)).agg(rate.alias("match_rate"))


def confidence_percent(confidence: Column | str) -> Column:
    """Whole percent between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(tx.col(confidence) * 100, 0))).cast("int")


def match_listing(matches: DataFrame, keys: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """The distinct names with their result; a dash where no spelling was matched."""
    return first_per_name(matches, keys, pos).select(
        *_scope(keys), pos, "raw_attr", "canonical_attr", "match_type",
        confidence_percent("confidence").alias("confidence_pct"),
        F.coalesce(F.when(F.col("matched_variation") != "", F.col("matched_variation")), F.lit("—")).alias("matched_variation"))


def diagnostics(matches: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document its format, structure, counts, match rate and output name.

    ``documents`` is ``(doc_id, path, input_format, doc_type)``.
    """
    ext = {"excel": "xlsx"}
    counts = report(matches)
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    out_ext = F.col("input_format")
    for fmt, suffix in ext.items():
        out_ext = F.when(F.col("input_format") == fmt, F.lit(suffix)).otherwise(out_ext)
    total, matched = F.coalesce("total_attributes", F.lit(0)), F.coalesce("matched", F.lit(0))
    rate = F.when(total > 0, matched / total * 100).otherwise(F.lit(0.0))
    return documents.join(counts, "doc_id", "left").select(
        "doc_id", F.upper("input_format").alias("format"), F.col("doc_type").alias("structure"),
        total.alias("total_attributes"), matched.alias("matched"), F.bround(rate, 0).cast("int").alias("match_rate_pct"),
        F.concat(stem, F.lit("_normalized."), out_ext).alias("output_name"))


def threshold_sweep(names_scores: DataFrame, thresholds: list[float], gap: float) -> DataFrame:
    """Accepted texts per threshold from one set of (text, best score, second score) rows."""
    accepted = [F.count_if((F.col("score") >= t) & ~(F.col("score") - F.coalesce("second", F.lit(float("-inf"))) < gap))
                for t in thresholds]
    counted = names_scores.agg(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), a.alias("accepted"))
                                         for t, a in zip(thresholds, accepted)]).alias("rows"))
    return counted.select(F.inline("rows"))
