"""Cases M1-M12, N1, N2, A1-A12 on attribute names derived from the orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.operators import matching as mt
from attrloom.plans import report as rp
from attrloom.plans.normalize import mapping_counts, match_records, normalize_records
from attrloom.sources.dictionary import seed_dictionary
from suite import sqlparts as q
from suite.registry import Tables, case, order_records

SEED = q.dictionary_ctes(q.seed_entries())
NAMES = q.names_ctes(q.order_names(q.DUCK))


def _names(t: Tables):
    return mt.name_texts(t.sql(q.order_names(q.SPARK)), "attribute")


def _texts(t: Tables):
    return _names(t).select(F.explode(F.array("spaced", "expanded")).alias("text")).distinct()


def _matched(t: Tables, **options):
    return match_records(t.sql(q.order_names(q.SPARK)), seed_dictionary(t.spark), **options)


@case("m01_exact_lookup", f"WITH {SEED}, {NAMES}, {q.EXACT_HITS} SELECT norm, canonical FROM h_exact WHERE canonical IS NOT NULL")
def m01(t: Tables):
    return mt.exact_lookup(_names(t), seed_dictionary(t.spark)).filter("canonical is not null").select("norm", "canonical")


@case("m02_containment", f"WITH {SEED}, {NAMES}, {q.contain_ctes('(SELECT DISTINCT spaced AS text FROM n_names)')} SELECT text, canonical FROM h_contain")
def m02(t: Tables):
    texts = _names(t).select(F.col("spaced").alias("text")).distinct()
    return mt.containment(texts, seed_dictionary(t.spark)).select("text", "canonical")


@case("m03_abbreviation_containment", f"""
    WITH {SEED}, {NAMES}, {q.contain_ctes('(SELECT DISTINCT expanded AS text FROM n_names WHERE expanded <> spaced)')} SELECT text, canonical FROM h_contain""")
def m03(t: Tables):
    texts = _names(t).filter("expanded <> spaced").select(F.col("expanded").alias("text")).distinct()
    return mt.containment(texts, seed_dictionary(t.spark)).select("text", "canonical")


@case("m04_fuzzy", f"""
    WITH {SEED}, {NAMES}, {q.fuzzy_ctes('n_texts')}
    SELECT text, form, canonical, round(score, 6) AS score FROM {q.best_with_lead('f_scores', '88.0', '10.0')} b""")
def m04(t: Tables):
    return mt.fuzzy_match(_texts(t), seed_dictionary(t.spark)).select(
        "text", F.col("variation").alias("form"), "canonical", F.round(F.col("confidence") * 100, 6).alias("score"))


@case("m05_tfidf", f"""
    WITH {SEED}, {NAMES}, {q.tfidf_ctes('n_texts')}, s AS (SELECT text, w.var_no, form, canonical, score FROM w_scores w JOIN d_corpus USING (var_no))
    SELECT text, form, canonical, round(score, 6) AS score FROM {q.best_with_lead('s', '0.72', '0.10')} b""")
def m05(t: Tables):
    return mt.tfidf_match(_texts(t), seed_dictionary(t.spark)).select(
        "text", F.col("variation").alias("form"), "canonical", F.round("confidence", 6).alias("score"))


# The corpus of the dense tier: the mean vector of every label. Labels are a small fixed vocabulary.
CENTROIDS = """
    v_dim AS (SELECT label, i, avg(embedding[i]::double) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) q GROUP BY 1, 2),
    v_corpus AS (SELECT cast(label AS bigint) AS var_no, 'label ' || cast(label AS varchar) AS form, list(x ORDER BY i) AS vector FROM v_dim GROUP BY label),
    v_q AS (SELECT vec_id AS text, list_transform(embedding, lambda x_: x_::double) AS qv FROM embeddings),
    v_scores AS (SELECT text, var_no, form, form AS canonical, list_cosine_similarity(qv, vector) AS score FROM v_q, v_corpus)"""


def _centroids(t: Tables):
    dims = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    form = F.concat(F.lit("label "), F.col("label").cast("string"))
    return packed.select(F.col("label").cast("bigint").alias("var_no"), form.alias("form"), form.alias("canonical"),
                         F.lit(None).cast("string").alias("guard"), "vector")


@case("m06_embedding", f"""
    WITH {CENTROIDS} SELECT text, form, round(score, 6) AS score FROM {q.best_with_lead('v_scores', '0.30', '0.05')} b""")
def m06(t: Tables):
    texts = t.embeddings.select(F.col("vec_id").alias("text"), F.col("embedding").alias("vector"))
    return mt.embedding_match(texts, _centroids(t), 0.30, 0.05).select(
        "text", F.col("variation").alias("form"), F.round("confidence", 6).alias("score"))


# Names whose order number meets a vector id have a dense vector, the others fall back to TF-IDF.
@case("m07_backend_choice", f"""
    WITH {SEED}, {NAMES}, {CENTROIDS}, {q.tfidf_ctes('n_texts')},
    named AS (SELECT {q.d2('attribute')} AS text, min(pos) AS first_pos FROM n_rows GROUP BY 1),
    dense AS (SELECT n.text, var_no, s.form, s.canonical, score FROM named n JOIN v_scores s ON s.text = n.first_pos),
    sparse AS (SELECT w.text, w.var_no, form, canonical, score FROM w_scores w JOIN d_corpus USING (var_no)
               WHERE w.text IN (SELECT text FROM named WHERE first_pos NOT IN (SELECT vec_id FROM embeddings)))
    SELECT text, form, round(score, 6) AS score FROM {q.best_with_lead('dense', '0.72', '0.10')} b
    UNION ALL SELECT text, form, round(score, 6) FROM {q.best_with_lead('sparse', '0.72', '0.10')} b""")
def m07(t: Tables):
    named = t.sql(q.order_names(q.SPARK)).groupBy(tx.snake_to_space("attribute").alias("text")).agg(F.min("pos").alias("vec_id"))
    texts = named.join(t.embeddings.select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left").select("text", "vector")
    return mt.semantic_match(texts, seed_dictionary(t.spark), _centroids(t)).select(
        "text", F.col("variation").alias("form"), F.round("confidence", 6).alias("score"))


@case("m08_runner_up_gap", f"""
    WITH {SEED}, {NAMES}, {q.fuzzy_ctes('n_texts')},
    r AS (SELECT text, score, lead(score) OVER w AS second, row_number() OVER w AS rn FROM f_scores WHERE score >= 78
          WINDOW w AS (PARTITION BY text ORDER BY score DESC, var_no))
    SELECT text, round(score, 6) AS best, round(coalesce(second, 0), 6) AS second, NOT (score - coalesce(second, 0) < 10) AS leads FROM r WHERE rn = 1""")
def m08(t: Tables):
    w = Window.partitionBy("text").orderBy(F.desc("score"), "var_no")
    scored = mt.fuzzy_scores(_texts(t), seed_dictionary(t.spark), 78.0)
    ranked = scored.withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return ranked.select("text", F.round("score", 6).alias("best"), F.round("second", 6).alias("second"),
                         (~(F.col("score") - F.col("second") < 10)).alias("leads"))


CASCADE = f"WITH {q.cascade_ctes(q.order_names(q.DUCK))}"


@case("m09_cascade", f"""{CASCADE}
    SELECT doc_id, pos, raw_attr, canonical_attr, match_type, round(confidence, 6) AS confidence, matched_variation FROM matched""")
def m09(t: Tables):
    return _matched(t).select("doc_id", "pos", "raw_attr", "canonical_attr", "match_type",
                              F.round("confidence", 6).alias("confidence"), "matched_variation")


@case("m10_match_labels", f"""{CASCADE}
    SELECT match_type, count(*) AS n, count(DISTINCT raw_attr) AS names, round(min(confidence), 6) AS low, round(max(confidence), 6) AS high
    FROM matched GROUP BY match_type""")
def m10(t: Tables):
    return _matched(t).groupBy("match_type").agg(
        F.count("*").alias("n"), F.countDistinct("raw_attr").alias("names"),
        F.round(F.min("confidence"), 6).alias("low"), F.round(F.max("confidence"), 6).alias("high"))


@case("m11_batch_match", f"""
    WITH {q.cascade_ctes(q.order_records(q.DUCK))}
    SELECT doc_id, pos, raw_attr, canonical_attr, match_type FROM matched""")
def m11(t: Tables):
    records = order_records(t)
    return match_records(records, seed_dictionary(t.spark)).select("doc_id", "pos", "raw_attr", "canonical_attr", "match_type")


SWEEP = [60.0, 75.0, 88.0, 95.0]


@case("m12_threshold_sweep", f"""
    WITH {SEED}, {NAMES}, {q.fuzzy_ctes('n_texts')}, th AS (SELECT unnest({SWEEP})::double AS threshold),
    r AS (SELECT text, score, lead(score) OVER w AS second, row_number() OVER w AS rn FROM f_scores
          WINDOW w AS (PARTITION BY text ORDER BY score DESC, var_no))
    SELECT threshold, cast(count(*) FILTER (WHERE score >= threshold AND NOT (score - coalesce(second, 0) < 10)) AS bigint) AS accepted
    FROM r, th WHERE rn = 1 GROUP BY threshold""".replace("least(ql, vl) / (ql + vl) >= 70", "least(ql, vl) / (ql + vl) >= 45"))
def m12(t: Tables):
    w = Window.partitionBy("text").orderBy(F.desc("score"), "var_no")
    scored = mt.fuzzy_scores(_texts(t), seed_dictionary(t.spark), min(SWEEP) - mt.FUZZY_GAP)
    best = scored.withColumn("second", F.lead("score").over(w)).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return rp.threshold_sweep(best.select("text", "score", "second"), SWEEP, mt.FUZZY_GAP)


@case("n01_normalize", f"{CASCADE} SELECT doc_id, pos, canonical_attr AS attribute, value FROM matched")
def n01(t: Tables):
    return normalize_records(t.sql(q.order_names(q.SPARK)), seed_dictionary(t.spark)).select("doc_id", "pos", "attribute", "value")


@case("n02_report", f"""{CASCADE}
    SELECT doc_id, count(*) AS total_attributes, cast(count(*) FILTER (WHERE match_type <> 'unmatched') AS bigint) AS matched,
           cast(count(*) FILTER (WHERE match_type = 'unmatched') AS bigint) AS unmatched FROM matched GROUP BY doc_id""")
def n02(t: Tables):
    return rp.report(_matched(t))


@case("a01_type_counts", f"{CASCADE} SELECT doc_id, match_type, count(*) AS n FROM matched GROUP BY doc_id, match_type")
def a01(t: Tables):
    return rp.type_counts(_matched(t))


def _count(types: str) -> str:
    return f"cast(count(*) FILTER (WHERE match_type IN ({types})) AS bigint)"


@case("a02_summary_cards", f"""{CASCADE}
    SELECT doc_id, count(*) AS total, cast(count(*) FILTER (WHERE match_type <> 'unmatched') AS bigint) AS matched,
      {_count("'unmatched'")} AS unmatched, {_count("'exact', 'synonym'")} AS exact_synonym,
      {_count("'fuzzy', 'semantic'")} AS fuzzy_semantic, {_count("'prefix', 'abbrev'")} AS prefix_abbrev FROM matched GROUP BY doc_id""")
def a02(t: Tables):
    return rp.summary_cards(_matched(t))


FIRST = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, raw_attr ORDER BY pos) AS rn FROM matched) q WHERE rn = 1)"


@case("a03_first_per_name", f"{CASCADE}, {FIRST} SELECT doc_id, raw_attr, pos, canonical_attr, match_type, round(confidence, 6) AS confidence, matched_variation FROM firsts")
def a03(t: Tables):
    return rp.first_per_name(_matched(t)).withColumn("confidence", F.round("confidence", 6))


@case("a04_preview", f"""
    SELECT doc_id, pos, attribute, value, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS serial_no
    FROM ({q.order_names(q.DUCK)}) t WHERE {q.strip('attribute')} <> '' OR {q.strip('value')} <> ''""")
def a04(t: Tables):
    return rp.preview(t.sql(q.order_names(q.SPARK)))


@case("a05_unmatched_names", f"{CASCADE}, {FIRST} SELECT doc_id, raw_attr FROM firsts WHERE match_type = 'unmatched'")
def a05(t: Tables):
    return rp.unmatched_names(_matched(t))


TITLE = "upper(match_type[1]) || match_type[2:]"


@case("a06_distribution", f"{CASCADE} SELECT {TITLE} AS match_type, count(*) AS n FROM matched GROUP BY 1")
def a06(t: Tables):
    return rp.distribution(_matched(t), keys=[])


@case("a07_confidence_table", f"{CASCADE}, {FIRST} SELECT doc_id, raw_attr, round(confidence * 100, 1) AS confidence_pct, {TITLE} AS match_type FROM firsts")
def a07(t: Tables):
    return rp.confidence_table(_matched(t))


@case("a08_match_rate", f"""{CASCADE}
    SELECT doc_id, round(count(*) FILTER (WHERE match_type <> 'unmatched') * 100.0 / count(*), 6)::double AS match_rate FROM matched GROUP BY doc_id""")
def a08(t: Tables):
    return rp.match_rate(_matched(t)).withColumn("match_rate", F.round("match_rate", 6))


@case("a09_percent_clamp", f"{CASCADE} SELECT pos, cast(greatest(0, least(100, round_even(confidence * 100, 0))) AS bigint) AS pct FROM matched")
def a09(t: Tables):
    return _matched(t).select("pos", rp.confidence_percent("confidence").cast("bigint").alias("pct"))


@case("a11_match_listing", f"""{CASCADE}, {FIRST}
    SELECT doc_id, pos, raw_attr, canonical_attr, match_type, cast(round_even(confidence * 100, 0) AS bigint) AS confidence_pct,
           coalesce(matched_variation, '—') AS matched_variation FROM firsts""")
def a11(t: Tables):
    return rp.match_listing(_matched(t)).withColumn("confidence_pct", F.col("confidence_pct").cast("bigint"))


@case("a12_diagnostics", f"""{CASCADE},
    docs AS (SELECT c_custkey AS doc_id, '/in/' || c_mktsegment || '/v1.' || cast(c_custkey AS varchar) || (CASE WHEN c_custkey % 2 = 0 THEN '.csv' ELSE '.XLSX' END) AS path FROM customer),
    r AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE match_type <> 'unmatched') AS ok FROM matched GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN 'CSV' ELSE 'EXCEL' END AS format, 'keyvalue' AS structure,
      cast(coalesce(total, 0) AS bigint) AS total_attributes, cast(coalesce(ok, 0) AS bigint) AS matched,
      cast(coalesce(round_even(ok * 100.0 / total, 0), 0) AS bigint) AS match_rate_pct,
      'v1.' || cast(d.doc_id AS varchar) || '_normalized.' || (CASE WHEN d.doc_id % 2 = 0 THEN 'csv' ELSE 'xlsx' END) AS output_name
    FROM docs d LEFT JOIN r USING (doc_id)""")
def a12(t: Tables):
    from attrloom.sources.files import file_format
    ext = F.when(F.col("c_custkey") % 2 == 0, F.lit(".csv")).otherwise(F.lit(".XLSX"))
    docs = t.customer.select(F.col("c_custkey").alias("doc_id"), F.concat(
        F.lit("/in/"), "c_mktsegment", F.lit("/v1."), F.col("c_custkey").cast("string"), ext).alias("path"))
    docs = docs.withColumn("input_format", file_format("path")).withColumn("doc_type", F.lit("keyvalue"))
    return rp.diagnostics(_matched(t), docs).withColumn("match_rate_pct", F.col("match_rate_pct").cast("bigint"))


@case("flagship_normalize_orders", f"""
    WITH {q.cascade_ctes(q.order_records(q.DUCK))}
    SELECT raw_attr, canonical_attr, match_type, count(*) AS n, count(DISTINCT value) AS n_values FROM matched GROUP BY 1, 2, 3""")
def flagship(t: Tables):
    """Unpivot the orders, map every column name, accept by value shape, and report the mapping."""
    return mapping_counts(order_records(t), seed_dictionary(t.spark))
