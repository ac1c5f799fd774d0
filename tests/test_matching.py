"""The tiers against brute-force restatements, and the cascade on a dictionary of traps."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attrloom.functions import similarity as sim
from attrloom.operators import matching as mt
from attrloom.plans.normalize import match_records, normalize_records
from attrloom.sources.dictionary import dictionary_from


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def sort_ratio(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    total = len(a) + len(b)
    return (1 - (total - 2 * lcs(a, b)) / total) * 100


def grams(text):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        out += [w[i:i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return out


NAMES = ["custmer name", "warehous", "ordr date", "totalprice", "line satus", "price unit", "unit cst", "a", "zq", "departmnt",
         "billing docno", "sttlement kind", "requested delivery dat", "e mail", "serial unit code extra long name of a thing",
         "x" * 80, "freigt charge", "supplier nme", "overall amuont", "kind of items", "discount raet", "placed on date day"]


def as_texts(spark, names):
    return spark.createDataFrame([(n,) for n in names], "text string")


@pytest.mark.parametrize("cut", [40.0, 78.0, 90.0])
def test_fuzzy_blocking_loses_no_pair(spark, dictionary, cut):
    forms = [(r["var_no"], r["form"]) for r in dictionary.variations.collect()]
    expected = {(n, v): sort_ratio(n, f) for n in NAMES for v, f in forms if sort_ratio(n, f) >= cut}
    got = {(r["text"], r["var_no"]): r["score"] for r in mt.fuzzy_scores(as_texts(spark, NAMES), dictionary, cut).collect()}
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], abs_tol=1e-9) for k in got)


def test_lcs_of_long_texts_without_masks(spark):
    long_text = "requested delivery date of the goods in the third warehouse of the northern region of sales"
    d = dictionary_from(spark.createDataFrame([(0, long_text, ["short one"])], "entry_no int, canonical string, variations array<string>"))
    name = long_text.replace("third", "thrid").replace("sales", "sale")
    got = mt.fuzzy_scores(as_texts(spark, [name]), d, 78.0).collect()
    assert len(got) == 1 and math.isclose(got[0]["score"], sort_ratio(name, long_text), abs_tol=1e-9)


def test_tfidf_matches_brute_force(spark, dictionary):
    corpus = [(r["var_no"], r["form"]) for r in dictionary.corpus.collect()]
    df = Counter(g for _, f in corpus for g in set(grams(f)))
    idf = {g: math.log((1 + len(corpus)) / (1 + n)) + 1 for g, n in df.items()}

    def vector(text):
        w = {g: c * idf[g] for g, c in Counter(grams(text)).items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    vectors = {v: vector(f) for v, f in corpus}
    for cut in (0.05, 0.4, 0.62):
        want = {}
        for name in NAMES:
            q = vector(name)
            for v, other in vectors.items():
                score = sum(x * other.get(g, 0) for g, x in q.items())
                if score >= cut:
                    want[name, v] = score
        got = {(r["text"], r["var_no"]): r["score"] for r in mt.tfidf_scores(as_texts(spark, NAMES), dictionary, cut).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)


def test_tfidf_candidates_are_few(spark, dictionary):
    names = as_texts(spark, NAMES)
    pairs = mt.tfidf_pairs(dictionary.vectors(names, "text", "text"), dictionary, 0.62).count()
    assert pairs < 0.1 * len(NAMES) * dictionary.corpus.count()


def test_short_words_give_no_four_grams(spark):
    got = spark.createDataFrame([("a bc",)], "t string").select(sim.ngrams("t").alias("g")).first()["g"]
    assert sorted(got) == sorted(grams("a bc"))


def test_containment_prefers_longest_then_first(spark, dictionary):
    forms = [(r["var_no"], r["form"], r["canonical"]) for r in dictionary.variations.collect()]
    tok = lambda s: {t for t in s.split() if len(t) > 1}
    names = ["date", "name", "number", "order", "machine", "pay", "key", "price", "a", "date order", "nothing here"]
    expected = {}
    for n in names:
        hits = [(len(f), -v, c) for v, f, c in forms if tok(n) and tok(n) <= tok(f)]
        if hits:
            expected[n] = max(hits)[2]
    got = {r["text"]: r["canonical"] for r in mt.containment(as_texts(spark, names), dictionary).collect()}
    assert got == expected


TRAPS = [
    ("Order Number", ["order code"]), ("Order Date", ["placed on"]), ("Total Order Value", ["grand sum"]), ("Phone Number", ["phone"]),
    ("Email Address", ["mail"]), ("Customer Name", ["client"]), ("Status", ["service status"]), ("Maintenance Status", ["service status"]),
    ("Shipping Cost", ["freight"]), ("Department", ["division"]), ("Warehouse", ["depot"]), ("Status", ["state"]),
    ("Insurance Status", ["cover state"]), ("Unit Price", ["unit cost"]), ("Settlement Kind", []), ("Settlement Kinds", []),
]
CASES = [  # name, value, match type, canonical
    ("Order Code", "ORD-7", "exact", "Order Number"),
    ("Order Code", "12345", "unmatched", "Order Code"),
    ("ship cost", "45", "exact", "Shipping Cost"),
    ("service_status", "ok", "exact", "Maintenance Status"),
    ("date", "2024-01-15", "prefix", "Order Date"),
    ("date", "tomorrow", "unmatched", "date"),
    ("order no", "", "exact", "Order Number"),
    ("cust", "x", "abbrev", "Customer Name"),
    ("Departmnt", "", "fuzzy", "Department"),
    ("insurance statu", "", "synonym", "Insurance Status"),
    ("unit cst", "3", "fuzzy", "Unit Price"),
    # Fuzzy leads by 3.2 points only, the TF-IDF cosine by 0.13: the later tier decides.
    ("Settlemnt Kind", "", "semantic", "Settlement Kind"),
    ("phone", "12345", "unmatched", "phone"),
    ("phone", "+49 170 1234567", "exact", "Phone Number"),
    # Listed twice, "status" ties with itself in the fuzzy tier; the corpus of the next tier has it once.
    ("statuss", "x", "semantic", "Status"),
    ("zzz", "q", "unmatched", "zzz"),
]


@pytest.fixture(scope="module")
def traps(spark):
    rows = [(i, c, v) for i, (c, v) in enumerate(TRAPS)]
    return dictionary_from(spark.createDataFrame(rows, "entry_no int, canonical string, variations array<string>"))


def trap_records(spark):
    return spark.createDataFrame([(1, i, n, v) for i, (n, v, _, _) in enumerate(CASES)], "doc_id long, pos long, attribute string, value string")


def test_cascade_on_traps(spark, traps):
    got = match_records(trap_records(spark), traps).orderBy("pos").collect()
    assert [(r["raw_attr"], r["value"], r["match_type"], r["canonical_attr"]) for r in got] == CASES


def test_canonical_gap_scope_ignores_spellings_of_the_same_name(spark):
    d = dictionary_from(spark.createDataFrame([(0, "Customer Name", ["customers name", "custom name"]), (1, "Unrelated", [])], "entry_no int, canonical string, variations array<string>"))
    texts = as_texts(spark, ["custmer name"])
    assert mt.fuzzy_match(texts, d).count() == 0
    assert [r["canonical"] for r in mt.fuzzy_match(texts, d, gap_scope="canonical").collect()] == ["Customer Name"]
    with pytest.raises(ValueError):
        mt.fuzzy_match(texts, d, gap_scope="other")
    with pytest.raises(ValueError):
        mt.fuzzy_match(texts, d, threshold=5.0)


def test_repeated_text_of_two_canonicals_never_wins_fuzzy(spark, traps):
    assert mt.fuzzy_match(as_texts(spark, ["service statu"]), traps).count() == 0


def test_every_dictionary_text_is_exact_and_normalizing_is_idempotent(spark, dictionary):
    records = dictionary.texts.select(F.lit(1).alias("doc_id"), F.col("var_no").alias("pos"), F.col("form").alias("attribute"), F.lit("").alias("value"))
    once = normalize_records(records, dictionary)
    assert {r["match_type"] for r in once.select("match_type").distinct().collect()} == {"exact"}
    again = normalize_records(once.select("doc_id", "pos", "attribute", "value"), dictionary)
    assert again.filter("attribute <> canonical_attr or match_type <> 'exact'").count() == 0


def test_result_does_not_depend_on_partitioning(spark, traps):
    base = sorted(map(tuple, match_records(trap_records(spark), traps).collect()))
    shuffled = trap_records(spark).orderBy(F.desc("pos")).repartition(7)
    assert sorted(map(tuple, match_records(shuffled, traps).collect())) == base


def test_large_dictionaries_and_mappings_take_the_shuffle_way(spark, traps, monkeypatch):
    from attrloom.operators import lookups
    from attrloom.sources import dictionary as module
    base = sorted(map(tuple, match_records(trap_records(spark), traps).collect()))
    monkeypatch.setattr(module, "BROADCAST_TEXTS", 0)
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, match_records(trap_records(spark), traps).collect())) == base


def test_rows_keep_their_own_casing(spark, traps):
    records = spark.createDataFrame([(1, 0, "ZZ top", "a"), (1, 1, "zz TOP", "a")], "doc_id long, pos long, attribute string, value string")
    assert [r["attribute"] for r in normalize_records(records, traps).orderBy("pos").collect()] == ["ZZ top", "zz TOP"]


def test_embedding_match_is_exact_over_several_blocks(spark, monkeypatch):
    import random

    from attrloom.operators import vectors as vc
    rnd = random.Random(3)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(8)]
    corpus = [(i, f"f{i}", f"c{i}", None, vec()) for i in range(40)]
    texts = [(f"t{i}", vec()) for i in range(30)] + [("zero", [0.0] * 8), ("none", None)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))
    expected = {}
    for name, v in texts[:30]:
        best, second = sorted((cos(v, c[4]) for c in corpus), reverse=True)[:2]
        if best >= 0.6 and best - second >= 0.05:
            expected[name] = best
    monkeypatch.setattr(vc, "CORPUS_BLOCK", 7)
    got = mt.embedding_match(spark.createDataFrame(texts, "text string, vector array<double>"),
                             spark.createDataFrame(corpus, "var_no long, form string, canonical string, guard string, vector array<double>"), 0.6, 0.05)
    rows = {r["text"]: r["confidence"] for r in got.collect()}
    assert rows.keys() == expected.keys() and all(math.isclose(rows[k], expected[k], abs_tol=1e-9) for k in rows)
