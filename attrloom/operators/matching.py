"""The tiers that map a name to a canonical name, and their cascade.

Every tier works on distinct texts and returns at most one row per text. Text-to-dictionary tiers
are equi-joins on a blocking key (a token, a numbered character, an n-gram) that provably keep every
dictionary text able to influence the outcome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrloom.functions import similarity as sim
from attrloom.functions import text as tx
from attrloom.functions.shapes import passes_guard
from attrloom.operators.vectors import embedding_scores
from attrloom.sources.dictionary import Dictionary

# Acceptance thresholds and the lead the best text must have over the next one.
FUZZY_THRESHOLD = 88.0
SEMANTIC_THRESHOLD = 0.72
FUZZY_GAP = 10.0
SEMANTIC_GAP = 0.10
SYNONYM_CONFIDENCE = 0.95

FIXED_POINT = float(2**52)
EPSILON = 1e-9

CANDIDATE = "struct<canonical:string,guard:string,match_type:string,confidence:double,variation:string>"
TIERS = ["exact", "prefix", "abbrev", "fuzzy_spaced", "fuzzy_expanded", "semantic_spaced", "semantic_expanded"]


def name_texts(names: DataFrame, name: str) -> DataFrame:
    """Distinct D1 spellings of a name column with their D2 and D3 texts and row counts.

    Rows are counted by the name as it stands, so that its spelling is worked out once per name and not per row.
    """
    written = names.groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("_rows"))
    distinct = written.groupBy(tx.normalize("_name").alias("norm")).agg(F.sum("_rows").alias("n"))
    spaced = distinct.withColumn("spaced", tx.snake_to_space("norm"))
    return spaced.withColumn("expanded", tx.expand_abbreviations("spaced"))


def exact_lookup(names: DataFrame, dictionary: Dictionary) -> DataFrame:
    """M1: the canonical of the first of the three spellings found in the exact table."""
    out = names
    for i, form in enumerate(["norm", "spaced", "expanded"]):
        table = dictionary.exact.select(
            F.col("form").alias(f"_f{i}"), F.struct("canonical", "guard").alias(f"_c{i}"))
        out = out.join(dictionary.side(table), F.col(form) == F.col(f"_f{i}"), "left")
    hit = F.coalesce("_c0", "_c1", "_c2")
    return out.select(*names.columns, hit["canonical"].alias("canonical"), hit["guard"].alias("guard"))


def containment(texts: DataFrame, dictionary: Dictionary) -> DataFrame:
    """M2, M3: the longest spelling containing every token of the text; ties go to the earliest.

    A spelling holding all tokens holds the rarest one too, so that single token is the join key. A text
    with a token no spelling has is out at once.
    """
    query = texts.select("text", tx.tokens("text").alias("tokens")).filter(F.size("tokens") > 0)
    counts = dictionary.token_counts.select(F.col("token").alias("_t"), "df")
    each = tx.explode_costly(query, "tokens", "_t").join(dictionary.side(counts), "_t", "left")
    rarest = (each.groupBy("text").agg(F.min(F.struct("df", "_t")).alias("r"), F.first("tokens").alias("tokens"), F.count_if(F.col("df").isNull()).alias("unknown"))
              .filter("unknown = 0").select("text", "tokens", F.col("r._t").alias("token")))
    hits = (rarest
            .join(dictionary.side(dictionary.token_index), "token")
            .filter(F.size(F.array_except("tokens", "var_tokens")) == 0))
    best = F.max_by(F.struct("canonical", "guard"), F.struct("form_length", -F.col("var_no")))
    return hits.groupBy("text").agg(best.alias("b")).select(
        "text", "b.canonical", "b.guard", F.lit(1.0).alias("confidence"), F.col("text").alias("variation"))


def _best_with_lead(scored: DataFrame, threshold: float, gap: float, gap_scope: str) -> DataFrame:
    """M8: the best text if it reaches the threshold and leads the next one by the gap.

    ``gap_scope='canonical'`` compares with the next text of another canonical only.
    """
    by_score = Window.partitionBy("text").orderBy(F.desc("score"), "var_no")
    if gap_scope == "canonical":
        keep = Window.partitionBy("text", "canonical").orderBy(F.desc("score"), "var_no")
        scored = scored.withColumn("_c", F.row_number().over(keep)).filter("_c = 1").drop("_c")
    elif gap_scope != "text":
        raise ValueError(f"gap_scope must be 'text' or 'canonical', not {gap_scope!r}")
    ranked = (scored.withColumn("_rn", F.row_number().over(by_score)).filter("_rn <= 2")
              .withColumn("second", F.lead("score").over(by_score)).filter("_rn = 1"))
    lead = F.col("score") - F.coalesce("second", F.lit(float("-inf")))
    return ranked.filter((F.col("score") >= threshold) & ~(lead < gap)).drop("_rn")


def fuzzy_scores(texts: DataFrame, dictionary: Dictionary, cut: float) -> DataFrame:
    """Every (text, spelling) pair whose token-sort ratio is at least ``cut``.

    Prefix filtering (Chaudhuri et al. 2006, Bayardo et al. 2007) on numbered characters: a pair of
    lengths a and b reaching the cut shares at least ``ceil(cut * (a + b) / 200)`` of them, so the two
    rarest-first lists already meet within their first ``length - shared + 1`` tokens, and in two of
    their first ``length - shared + 2``.
    """
    if not cut > 0:
        raise ValueError("the fuzzy threshold must exceed the gap")
    query = texts.select("text", sim.sorted_words("text").alias("sorted")).select("text", sim.chars("sorted").alias("q_cs"))
    query = query.filter(F.size("q_cs") > 0).select(
        "text", F.size("q_cs").alias("q_len"), sim.block_tokens("q_cs").alias("_tokens"))
    fewest = sim.shared_needed(F.col("q_len"), sim.shortest_partner(F.col("q_len"), cut), cut)
    prefix = sim.blocks("_tokens", F.col("q_len"), fewest, cut)
    if cut >= sim.PAIR_CUT:  # a partner that needs just one shared token is blocked by single tokens
        prefix = F.concat(prefix, F.when(fewest < 2, sim.blocks("_tokens", F.col("q_len"), F.lit(2), cut)).otherwise(F.array().cast("array<string>")))
    blocks = tx.explode_costly(query.withColumn("_prefix", prefix), "_prefix", "block").select("text", "q_len", "block")

    pairs = blocks.join(dictionary.side(dictionary.fuzzy_index(cut)), ["q_len", "block"]).select("text", "var_no").distinct()
    spelled = pairs.withColumn("q_cs", sim.chars(sim.sorted_words("text"))).withColumn("q_len", F.size("q_cs"))
    scored = spelled.join(dictionary.side(dictionary.fuzzy_texts.drop("block_tokens")), "var_no")
    lcs = F.when(F.col("masks").isNotNull(), sim.lcs_by_masks("q_cs", "masks", "len")).otherwise(
        sim.lcs_by_rows("q_cs", "cs"))
    return (scored.withColumn("score", sim.ratio(lcs, "q_len", "len")).filter(F.col("score") >= cut)
            .select("text", "var_no", "form", "canonical", "guard", "score"))


def fuzzy_match(texts: DataFrame, dictionary: Dictionary, threshold: float = FUZZY_THRESHOLD,
                gap: float = FUZZY_GAP, gap_scope: str = "text") -> DataFrame:
    """M4: best token-sort ratio. Pairs below ``threshold - gap`` cannot change the outcome."""
    scored = fuzzy_scores(texts, dictionary, threshold - gap)
    best = _best_with_lead(scored, threshold, gap, gap_scope)
    return best.select("text", "canonical", "guard", (F.col("score") / 100.0).alias("confidence"),
                       F.col("form").alias("variation"))


def tfidf_pairs(vectors: DataFrame, dictionary: Dictionary, cut: float) -> DataFrame:
    """(text, corpus spelling) pairs that may reach a cosine of ``cut``.

    N-grams are ordered from rare to frequent. A pair whose first common n-gram lies behind the leading
    ones of either side has too little left to reach the cut, so both sides join on leading n-grams only.
    """
    leading = tx.explode_costly(vectors.select("text", sim.leading_grams("vector", cut).alias("_l")), "_l", "gram").select("text", "gram")
    return leading.join(dictionary.side(dictionary.gram_index(cut)), "gram").select("text", "var_no").distinct()


def tfidf_scores(texts: DataFrame, dictionary: Dictionary, cut: float) -> DataFrame:
    """Cosine of every (text, corpus spelling) pair that reaches ``cut``.

    The sums add whole numbers of 2**-52, which makes them the same in any order.
    """
    vectors = dictionary.vectors(texts, "text", "text")
    rated = tfidf_pairs(vectors, dictionary, cut).join(vectors, "text").join(
        dictionary.side(dictionary.corpus_vectors.withColumnRenamed("vector", "other")), "var_no")
    other = F.map_from_entries(F.transform("other", lambda g: F.struct(g["gram"], g["weight"])))
    units = tx.let(other, lambda known: F.aggregate("vector", F.lit(0).cast("bigint"), lambda total, g: total + F.coalesce(
        F.round(g["weight"] * F.element_at(known, g["gram"]) * F.lit(FIXED_POINT)).cast("bigint"), F.lit(0).cast("bigint"))))
    return rated.select("text", "var_no", (units / F.lit(FIXED_POINT)).alias("score")).filter(F.col("score") >= cut)


def tfidf_match(texts: DataFrame, dictionary: Dictionary, threshold: float = SEMANTIC_THRESHOLD,
                gap: float = SEMANTIC_GAP, gap_scope: str = "text") -> DataFrame:
    """M5: best TF-IDF cosine. A pair sharing no n-gram scores 0, which only matters below the gap."""
    scored = tfidf_scores(texts, dictionary, max(threshold - gap, EPSILON)).join(dictionary.side(dictionary.corpus), "var_no")
    best = _best_with_lead(scored, threshold, gap, gap_scope)
    return best.select("text", "canonical", "guard", F.col("score").alias("confidence"),
                       F.col("form").alias("variation"))


def embedding_match(texts: DataFrame, corpus: DataFrame, threshold: float = SEMANTIC_THRESHOLD,
                    gap: float = SEMANTIC_GAP) -> DataFrame:
    """M6: best cosine of dense vectors.

    ``texts(text, vector)`` against ``corpus(var_no, form, canonical, guard, vector)``. Vectors below
    ``threshold - gap`` cannot change the outcome; of the others a pivot index finds the exact two best.
    """
    scored = embedding_scores(texts, corpus, threshold - gap - EPSILON)
    best = _best_with_lead(scored, threshold, gap, "text")
    return best.select("text", "canonical", "guard", F.col("score").alias("confidence"),
                       F.col("form").alias("variation"))


def semantic_match(texts: DataFrame, dictionary: Dictionary, corpus_vectors: DataFrame | None = None,
                   threshold: float = SEMANTIC_THRESHOLD, gap: float = SEMANTIC_GAP) -> DataFrame:
    """M7: dense vectors for the texts that have one, TF-IDF for the others."""
    if corpus_vectors is None:
        return tfidf_match(texts, dictionary, threshold, gap)
    dense = embedding_match(texts, corpus_vectors, threshold, gap)
    sparse = tfidf_match(texts.filter(F.col("vector").isNull()), dictionary, threshold, gap)
    return dense.unionByName(sparse)


def _candidate(match_type: Column | str) -> Column:
    kind = F.lit(match_type) if isinstance(match_type, str) else match_type
    return F.struct("canonical", "guard", kind.alias("match_type"), "confidence", "variation").cast(CANDIDATE)


def _fuzzy_label() -> Column:
    """A fuzzy hit of at least 0.95 counts as a synonym."""
    return F.when(F.col("confidence") >= SYNONYM_CONFIDENCE, F.lit("synonym")).otherwise(F.lit("fuzzy"))


def _unguarded(hits: DataFrame) -> DataFrame:
    """Texts whose hit holds for every value, so that no later tier is ever asked."""
    return hits.filter(F.col("guard").isNull()).select("text")


def match_names(names: DataFrame, dictionary: Dictionary, fuzzy_threshold: float = FUZZY_THRESHOLD,
                semantic_threshold: float = SEMANTIC_THRESHOLD, gap_scope: str = "text",
                text_vectors: DataFrame | None = None, corpus_vectors: DataFrame | None = None,
                keep: Callable[[DataFrame, str], DataFrame] = lambda df, label: df) -> DataFrame:
    """M9 per name: one candidate column per tier for the distinct names of ``name_texts``.

    The tiers run on distinct texts, and a costly tier sees only texts that no earlier tier settles
    for every value. Intermediate tables are read twice; ``keep(table, label)`` may store them, which
    also keeps the plans short.
    """
    exact_hit = F.struct("canonical", "guard", F.lit("exact").alias("match_type"), F.lit(1.0).alias("confidence"),
                         F.col("spaced").alias("variation")).cast(CANDIDATE)
    exact = exact_lookup(names, dictionary).select(
        *names.columns, F.when(F.col("canonical").isNotNull(), exact_hit).alias("exact"))
    open_names = exact.filter(F.col("exact").isNull() | F.col("exact.guard").isNotNull())
    texts = keep(open_names.select(F.explode(F.array("spaced", "expanded")).alias("text")).distinct(), "texts")

    contained = keep(containment(texts, dictionary), "containment")
    open1 = texts.join(_unguarded(contained), "text", "left_anti")
    fuzzy = keep(fuzzy_match(open1, dictionary, fuzzy_threshold, gap_scope=gap_scope), "fuzzy")
    open2 = open1.join(_unguarded(fuzzy), "text", "left_anti")
    if text_vectors is not None:
        semantic = semantic_match(open2.join(text_vectors, "text", "left"), dictionary, corpus_vectors, semantic_threshold)
    else:
        semantic = tfidf_match(open2, dictionary, semantic_threshold, gap_scope=gap_scope)

    tiers = {"contain": (contained, "prefix"), "fuzzy": (fuzzy, _fuzzy_label()), "semantic": (semantic, "semantic")}
    long = None
    for tier, (hits, label) in tiers.items():
        part = hits.select("text", F.lit(tier).alias("tier"), _candidate(label).alias("hit"))
        long = part if long is None else long.unionByName(part)
    per_text = keep(long.groupBy("text").agg(
        *[F.first(F.when(F.col("tier") == t, F.col("hit")), ignorenulls=True).alias(t) for t in tiers]), "per-text")
    first = per_text.select(F.col("text").alias("spaced"), F.col("contain").alias("prefix"),
                            F.col("fuzzy").alias("fuzzy_spaced"), F.col("semantic").alias("semantic_spaced"))
    second = per_text.select(F.col("text").alias("expanded"),
                             F.col("contain").withField("match_type", F.lit("abbrev")).alias("abbrev"),
                             F.col("fuzzy").alias("fuzzy_expanded"), F.col("semantic").alias("semantic_expanded"))
    out = exact.join(first, "spaced", "left").join(second, "expanded", "left")
    differs = F.col("expanded") != F.col("spaced")
    for tier in ["abbrev", "fuzzy_expanded", "semantic_expanded"]:
        out = out.withColumn(tier, F.when(differs & F.col(tier).isNotNull(), F.col(tier)))
    return out.select("norm", "spaced", "expanded", "n", *TIERS)


def choices() -> tuple[Column, Column]:
    """The tiers of a name as ``(settled, choices)``: the candidate that holds for every value, or else the candidates to ask.

    Candidates stand in tier order. Those behind one that holds for every value are never asked, nor is one of a shape
    that was asked before it, since both would ask the value the same.
    """
    hits = F.array_compact(F.array(*TIERS))
    none = F.array().cast(f"array<{CANDIDATE}>")
    asked = F.aggregate(hits, none, lambda got, t: F.when(
        F.exists(got, lambda g: g["guard"].isNull() | (g["guard"] == t["guard"])), got).otherwise(F.concat(got, F.array(t))))
    first = F.get(hits, F.lit(0))
    return F.when(first["guard"].isNull(), first).alias("settled"), F.when(first["guard"].isNotNull(), asked).alias("choices")


def resolve(name: Column | str, value: Column | str) -> Column:
    """M9 per row with the columns of ``choices``: the first candidate that accepts the value, else the unmatched result.

    The choices are a fold and not seven spelled-out branches, whose generated code would be too long for the JVM to compile.
    """
    accepted = F.aggregate("choices", F.lit(None).cast(CANDIDATE), lambda got, t: F.when(got.isNotNull(), got).when(
        passes_guard(t["guard"], value), t))
    none = F.struct(tx.col(name).alias("canonical"), F.lit(None).cast("string").alias("guard"),
                    F.lit("unmatched").alias("match_type"), F.lit(0.0).alias("confidence"),
                    F.lit(None).cast("string").alias("variation")).cast(CANDIDATE)
    return F.coalesce("settled", accepted, none)
