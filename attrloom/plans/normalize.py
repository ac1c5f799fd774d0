"""Records in, records with canonical names and match columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.operators.lookups import fits_broadcast, join_heavy_split
from attrloom.operators.matching import (
    FUZZY_THRESHOLD, SEMANTIC_THRESHOLD, TIERS, choices, match_names, name_texts, resolve,
)
from attrloom.session import materialize
from attrloom.sources.dictionary import Dictionary
from attrloom.sources.tables import spread

MATCH_COLUMNS = ["raw_attr", "canonical_attr", "match_type", "confidence", "matched_variation"]


def map_names(names: DataFrame, dictionary: Dictionary, **options) -> DataFrame:
    """Tier candidates of distinct names (from ``name_texts``), with the tables between the tiers written once."""
    def keep(df: DataFrame, label: str) -> DataFrame:
        stored = materialize(df, label)
        return spread(stored, "text") if label == "texts" else stored

    return match_names(names, dictionary, keep=keep, **options)


def name_mapping(records: DataFrame, dictionary: Dictionary, name: str = "attribute", **options) -> DataFrame:
    """The schema mapping: tier candidates of every distinct name, written to the shared folder.

    Names repeat without bound while distinct names do not, so matching runs once per name here and
    is joined back per row. Writing it once cuts the lineage and makes its size known.
    """
    names = materialize(name_texts(records.select(F.coalesce(name, F.lit("")).alias(name)), name), "names")
    return materialize(map_names(names, dictionary, **options), "name-mapping")


def match_records(records: DataFrame, dictionary: Dictionary, name: str = "attribute", value: str = "value",
                  mapping: DataFrame | None = None, **options) -> DataFrame:
    """Every record with its match columns appended; name and value stay as they are.

    The stored mapping is broadcast when its checked size allows it; a larger one is joined by key
    with the heavy names split off.
    """
    if mapping is None:
        mapping = name_mapping(records, dictionary, name, **options)
    raw = tx.strip(F.coalesce(name, F.lit("")))
    keyed = records.withColumn("norm", tx.normalize(F.coalesce(name, F.lit(""))))
    side = mapping.select("norm", "n", *choices())
    if fits_broadcast(mapping.select("norm", *TIERS)):
        joined = keyed.join(F.broadcast(side.drop("n")), "norm", "left")
    else:
        joined = join_heavy_split(keyed, side, ["norm"], "n")
    matched = joined.withColumn("_m", resolve(raw, value))
    return matched.select(
        *[F.col(f"`{c}`") for c in records.columns], raw.alias("raw_attr"), F.col("_m.canonical").alias("canonical_attr"),
        "_m.match_type", "_m.confidence", F.col("_m.variation").alias("matched_variation"))


def mapping_counts(records: DataFrame, dictionary: Dictionary, name: str = "attribute", value: str = "value",
                   mapping: DataFrame | None = None, **options) -> DataFrame:
    """Rows and distinct values of every ``(raw_attr, canonical_attr, match_type)``.

    A match follows from the name and the value alone, so every pair of them is matched and shuffled once.
    """
    if mapping is None:
        mapping = name_mapping(records, dictionary, name, **options)
    pairs = records.groupBy(tx.strip(F.coalesce(name, F.lit(""))).alias(name), value).agg(F.count("*").alias("_rows"))
    matched = match_records(pairs, dictionary, name, value, mapping=mapping)
    return matched.groupBy("raw_attr", "canonical_attr", "match_type").agg(
        F.sum("_rows").alias("n"), F.count(value).alias("n_values"))


def normalize_records(records: DataFrame, dictionary: Dictionary, mapping: DataFrame | None = None,
                      fuzzy_threshold: float = FUZZY_THRESHOLD,
                      semantic_threshold: float = SEMANTIC_THRESHOLD, **options) -> DataFrame:
    """``attribute`` replaced by its canonical name, everything else kept, match columns added."""
    matched = match_records(records, dictionary, mapping=mapping, fuzzy_threshold=fuzzy_threshold,
                            semantic_threshold=semantic_threshold, **options)
    return matched.withColumn("attribute", F.col("canonical_attr"))
