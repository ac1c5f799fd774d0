"""A name mapping kept between batches, so that a name is matched once and not once per batch.

The folder holds one sub-folder per digest of the dictionary and the thresholds, and below it one part per
batch that brought new names. A part counts from the moment its ``_SUCCESS`` file is there, which the writer
sets last, so a failed or half-written part is not seen. Parts written at the same time may hold the same name;
they hold the same row for it, since a row follows from the name, the dictionary and the thresholds alone.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrloom.operators.matching import FUZZY_THRESHOLD, SEMANTIC_THRESHOLD, TIERS, CANDIDATE, name_texts
from attrloom.plans.normalize import map_names
from attrloom.session import materialize
from attrloom.sources.dictionary import Dictionary

COLUMNS = ["norm", "spaced", "expanded", *TIERS]
SCHEMA = ", ".join(["norm string", "spaced string", "expanded string", *(f"{t} {CANDIDATE}" for t in TIERS)])

#: Rises when a rule of the tiers changes, so that mappings of older rules are not read.
RULES = 1


def dictionary_digest(dictionary: Dictionary) -> str:
    """A digest of all entries in order, by one aggregate of two independent hashes."""
    row = F.struct("entry_no", "canonical", F.to_json(F.struct("variations")))
    hashes = [F.xxhash64(F.lit(seed), row).cast("decimal(38,0)") for seed in (1, 2)]
    totals = dictionary.entries.agg(F.count("*"), *[F.sum(h) for h in hashes]).first()
    return json.dumps([str(x) for x in (*totals, dictionary.max_grams)])


class MappingStore:
    """Mappings below ``path``, a folder all executors share, for one dictionary and one set of thresholds."""

    def __init__(self, spark: SparkSession, path: str, dictionary: Dictionary, fuzzy_threshold: float = FUZZY_THRESHOLD,
                 semantic_threshold: float = SEMANTIC_THRESHOLD, gap_scope: str = "text"):
        self.spark, self.dictionary = spark, dictionary
        self.options = {"fuzzy_threshold": fuzzy_threshold, "semantic_threshold": semantic_threshold, "gap_scope": gap_scope}
        key = json.dumps([RULES, dictionary_digest(dictionary), self.options], sort_keys=True)
        self.folder = f"{path.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"

    def _parts(self) -> list[str]:
        """Complete parts, by their markers."""
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*/_SUCCESS")
        found = marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(marker)
        return sorted(status.getPath().getParent().toString() for status in found or [])

    def mapping(self) -> DataFrame:
        """Every known name once."""
        parts = self._parts()
        known = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return known.dropDuplicates(["norm"]) if len(parts) > 1 else known

    def _append(self, rows: DataFrame) -> None:
        rows.select(*COLUMNS).write.parquet(f"{self.folder}/part-{uuid.uuid4().hex}")

    def extend(self, records: DataFrame, name: str = "attribute") -> DataFrame:
        """The mapping of the names of ``records``, with their row counts; names not yet known are matched and kept.

        The tiers do not run at all where every name is known.
        """
        names = materialize(name_texts(records.select(F.coalesce(name, F.lit("")).alias(name)), name), "names")
        unseen = materialize(names.join(self.mapping().select("norm"), "norm", "left_anti"), "unseen-names")
        if not unseen.isEmpty():
            self._append(map_names(unseen, self.dictionary, **self.options))
        return materialize(self.mapping().join(names.select("norm", "n"), "norm").select("norm", "spaced", "expanded", "n", *TIERS), "name-mapping")

    def compact(self) -> None:
        """One part in place of many; the old parts go after the new one is complete.

        Run it while no batch reads: a reader that has listed the old parts would miss their files.
        """
        old = self._parts()
        if len(old) > 1:
            self._append(self.mapping())
            for part in old:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(part)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
