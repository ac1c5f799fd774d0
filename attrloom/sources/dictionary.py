"""The dictionary of canonical names and the lookup tables built from it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrloom.functions import similarity as sim
from attrloom.functions import text as tx
from attrloom.functions.shapes import guard_kind
from attrloom.operators.lookups import BROADCAST_BYTES, stored_bytes
from attrloom.session import materialize

SEED_PATH = str(Path(__file__).resolve().parent.parent / "data" / "seed_dictionary.json")

# A lookup table is broadcast only when the dictionary behind it has at most this many texts; beyond
# that the joins shuffle on their keys. The largest table has about 50 short rows a text, so this
# stays near 50 MB.
BROADCAST_TEXTS = 10_000

MAX_GRAMS = 10_000

ENTRY_SCHEMA = "entry_no int, canonical string, variations array<string>"


@dataclass(eq=False)
class Dictionary:
    """Dictionary entries plus the derived lookup tables.

    Each table is built on first use and written to the shared folder, so every later plan reads a
    small file of known size instead of rebuilding it.
    """

    entries: DataFrame
    max_grams: int = MAX_GRAMS

    @cached_property
    def n_texts(self) -> int:
        return self.texts.count()

    def side(self, df: DataFrame) -> DataFrame:
        """A lookup table as a join side: broadcast only when its checked size allows it."""
        small = self.n_texts <= BROADCAST_TEXTS and stored_bytes(df) <= BROADCAST_BYTES
        return F.broadcast(df) if small else df

    @cached_property
    def texts(self) -> DataFrame:
        """Every spelling of every dictionary text, ``var_no`` giving the reading order."""
        listed = F.concat(F.array("canonical"), F.coalesce("variations", F.array().cast("array<string>")))
        raw = self.entries.select("entry_no", "canonical", F.posexplode(listed).alias("text_no", "text"))
        spelled = raw.select("entry_no", "canonical", "text_no", F.posexplode(tx.forms("text")).alias("form_no", "form"))
        var_no = F.shiftleft(F.col("entry_no").cast("bigint"), 32) + F.col("text_no").cast("bigint") * 4 + F.col("form_no")
        return materialize(spelled.select(
            var_no.alias("var_no"), "canonical", "form", (F.col("text_no") == 0).alias("is_canonical")), "dictionary-texts")

    @cached_property
    def exact(self) -> DataFrame:
        """Spelling -> canonical; the last entry wins."""
        last = self.texts.groupBy("form").agg(F.max_by("canonical", "var_no").alias("canonical"))
        return materialize(last.withColumn("guard", guard_kind("canonical")), "dictionary-exact")

    @cached_property
    def variations(self) -> DataFrame:
        """The searchable spellings. Those of canonical names always count, those of variations
        only the first time with that canonical."""
        first = (self.texts.groupBy("form", "canonical").agg(F.min("var_no").alias("var_no"))
                 .select("var_no"))
        listed = (self.texts.filter("is_canonical").select("var_no").union(first).distinct())
        rows = self.texts.join(listed, "var_no", "left_semi")
        return materialize(rows.select(
            "var_no", "form", "canonical", guard_kind("canonical").alias("guard"),
            tx.tokens("form").alias("tokens"), F.length("form").alias("form_length")), "dictionary-variations")

    @cached_property
    def token_index(self) -> DataFrame:
        """Token -> the spellings that contain it."""
        return materialize(self.variations.select(
            F.explode("tokens").alias("token"), "var_no", F.col("tokens").alias("var_tokens"),
            "form_length", "canonical", "guard"), "dictionary-token-index")

    @cached_property
    def fuzzy_texts(self) -> DataFrame:
        """Spellings with sorted words and the bit masks the ratio needs."""
        cut = self.variations.select("var_no", "form", "canonical", "guard",
                                     sim.sorted_words("form").alias("sorted"))
        cut = cut.select("*", sim.chars("sorted").alias("cs"))
        return materialize(cut.select(
            "var_no", "form", "canonical", "guard", "cs", F.size("cs").alias("len"),
            sim.position_masks("cs").alias("masks"), sim.block_tokens("cs").alias("block_tokens")), "dictionary-fuzzy-texts")

    def fuzzy_index(self, cut: float) -> DataFrame:
        """Blocks ``(q_len, block) -> var_no``: for every query length a spelling can still match at
        ``cut``, the leading tokens of the spelling one of which such a query must share."""
        return _fuzzy_index(self, cut)

    @cached_property
    def corpus(self) -> DataFrame:
        """Distinct spellings; the first canonical wins."""
        first = self.variations.groupBy("form").agg(
            F.min("var_no").alias("var_no"), F.min_by("canonical", "var_no").alias("canonical"))
        return materialize(first.withColumn("guard", guard_kind("canonical")), "dictionary-corpus")

    @cached_property
    def gram_idf(self) -> DataFrame:
        """N-gram -> smooth inverse document frequency, over the most frequent n-grams."""
        n = float(self.corpus.count())
        grams = self.corpus.select("var_no", F.explode(sim.ngrams("form")).alias("gram"))
        counted = (grams.groupBy("gram", "var_no").agg(F.count("*").alias("tf"))
                   .groupBy("gram").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")))
        kept = counted.orderBy(F.desc("tf"), "gram").limit(self.max_grams)
        idf = F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
        return materialize(kept.select("gram", "df", idf.alias("idf")), "dictionary-gram-idf")

    def unit_vectors(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """TF-IDF rows ``(key, gram, weight)`` of unit length."""
        unit = tx.explode_costly(self.vectors(texts, key, text), "vector", "g")
        return unit.select(key, "g.gram", "g.weight")

    def vectors(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """TF-IDF vectors ``(key, vector array<struct<df, gram, weight>>)`` of unit length, rarest n-gram
        first; n-grams unknown to the corpus are left out.

        The one shuffle groups the n-grams of a text. They are sorted before the length is summed, so
        the weights do not depend on the order rows arrive in.
        """
        spelled = texts.select(key, sim.ngrams(text).alias("_all"))
        grams = tx.explode_costly(spelled, F.array_distinct("_all"), "gram")
        tf = F.size(F.filter("_all", lambda g: g == F.col("gram")))
        raw = grams.join(self.side(self.gram_idf), "gram").select(key, F.struct("gram", (tf * F.col("idf")).alias("w"), "df").alias("g"))
        vectors = raw.groupBy(key).agg(F.array_sort(F.collect_list("g")).alias("gs"))
        length = F.sqrt(F.aggregate("gs", F.lit(0.0), lambda acc, g: acc + g["w"] * g["w"]))
        scaled = F.transform("gs", lambda g: F.struct(g["df"].alias("df"), g["gram"].alias("gram"), (g["w"] / F.col("norm")).alias("weight")))
        return vectors.withColumn("norm", length).select(key, F.array_sort(scaled).alias("vector"))

    @cached_property
    def corpus_vectors(self) -> DataFrame:
        """Unit-length TF-IDF vectors ``(var_no, vector)`` of the corpus."""
        return materialize(self.vectors(self.corpus, "var_no", "form"), "dictionary-vectors")

    @cached_property
    def gram_weights(self) -> DataFrame:
        """Unit-length TF-IDF rows ``(var_no, gram, weight)`` of the corpus."""
        rows = self.corpus_vectors.select("var_no", F.explode("vector").alias("g"))
        return materialize(rows.select("var_no", "g.gram", "g.weight"), "dictionary-gram-weights")

    def gram_index(self, cut: float) -> DataFrame:
        """Leading n-grams ``(gram, var_no)`` of every corpus vector: those one of which any vector with a
        cosine of at least ``cut`` must share."""
        return _gram_index(self, cut)

    @cached_property
    def token_counts(self) -> DataFrame:
        """Token -> number of spellings that contain it."""
        return materialize(self.token_index.groupBy("token").agg(F.count("*").alias("df")), "dictionary-token-counts")

    def profile(self, sample: int = 5) -> DataFrame:
        """A10: entries in order with their first variations, and the number of entries."""
        n = self.entries.count()
        shown = F.slice(F.coalesce("variations", F.array().cast("array<string>")), 1, sample)
        return self.entries.select("entry_no", "canonical", F.array_join(shown, ", ").alias("sample"),
                                   F.lit(n).cast("bigint").alias("entries"))


@lru_cache(maxsize=64)
def _gram_index(dictionary: Dictionary, cut: float) -> DataFrame:
    return materialize(dictionary.corpus_vectors.select(F.explode(sim.leading_grams("vector", cut)).alias("gram"), "var_no"),
                       "dictionary-gram-index")


@lru_cache(maxsize=64)
def _fuzzy_index(dictionary: Dictionary, cut: float) -> DataFrame:
    low = F.greatest(F.lit(1), sim.shortest_partner(F.col("len"), cut))
    sized = dictionary.fuzzy_texts.filter(F.col("len") > 0).select(
        "var_no", "len", "block_tokens",
        F.explode(F.sequence(low, F.greatest(low, sim.longest_partner(F.col("len"), cut)))).alias("q_len"))
    blocks = sim.blocks("block_tokens", F.col("len"), sim.shared_needed(F.col("q_len"), F.col("len"), cut), cut)
    return materialize(sized.select("q_len", F.explode(blocks).alias("block"), "var_no"), "dictionary-fuzzy-index")


def dictionary_from(entries: DataFrame, **options) -> Dictionary:
    """Dictionary over a DataFrame ``(entry_no, canonical, variations)``."""
    return Dictionary(entries.selectExpr(
        "cast(entry_no as int) entry_no", "canonical", "variations"), **options)


def load_dictionary(spark: SparkSession, path: str = SEED_PATH, **options) -> Dictionary:
    """Dictionary from a JSON file ``{"master_attributes": [{"canonical", "variations"}]}``."""
    schema = "master_attributes array<struct<canonical:string,variations:array<string>>>"
    raw = spark.read.json(path, schema=schema, multiLine=True)
    entries = raw.select(F.posexplode("master_attributes").alias("entry_no", "e"))
    return dictionary_from(entries.select("entry_no", "e.canonical", "e.variations"), **options)


_loaded: dict[tuple[str, str], Dictionary] = {}


def seed_dictionary(spark: SparkSession) -> Dictionary:
    """The shipped dictionary, built once per Spark application."""
    key = (spark.sparkContext.applicationId, SEED_PATH)
    if key not in _loaded:
        _loaded[key] = load_dictionary(spark)
    return _loaded[key]
