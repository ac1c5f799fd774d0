"""Cases T1-T10 on the documents and on sentences built from orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.operators import freetext as ft
from attrloom.plans import documents as dc
from suite import sqlparts as q
from suite.grid_cases import DOCX, PDF, _narrative, _table_rows, _text_lines
from suite.registry import Tables, case


def _lines_count(cond: str) -> str:
    return f"cast(len(list_filter(ls, lambda x_: {cond})) AS bigint)"


_WORDS = f"len({q.words('x_')})"
FACTS = f"""
    f0 AS (SELECT doc_id, {q.lines('text')} AS ls FROM documents),
    f1 AS (SELECT doc_id, cast(len(ls) AS bigint) AS n_lines, cast(coalesce(list_sum(list_transform(ls, lambda x_: {_WORDS})), 0) AS bigint) AS n_words,
        {_lines_count(_WORDS + ' >= 10')} AS long_lines,
        {_lines_count("regexp_matches(x_, '[:=\\-]') AND " + _WORDS + " <= 12")} AS kv_lines,
        cast(coalesce(list_sum(list_transform(ls, lambda x_: length(x_) - length(regexp_replace(x_, '[.?!]', '', 'g')))), 0) AS bigint) AS marks FROM f0),
    facts AS (SELECT *, n_lines > 0 AND ((n_lines <= 5 AND n_words / n_lines >= 12) OR (long_lines >= greatest(2, n_lines // 2) AND kv_lines = 0)
        OR (marks >= 2 AND kv_lines = 0 AND n_words / n_lines >= 8)) AS is_narrative FROM f1)"""


@case("t01_narrative", f"WITH {FACTS} SELECT * FROM facts")
def t01(t: Tables):
    return ft.narrative_facts(t.documents.select("doc_id", "text")).drop("text")


COUNTS = "SELECT doc_id, count(*) AS n_records FROM (SELECT item_id AS doc_id FROM benchmark UNION ALL SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) c GROUP BY doc_id"


@case("t02_route", f"""
    WITH {FACTS}, counts AS ({COUNTS})
    SELECT doc_id, coalesce(n_records, 0) AS n_records, is_narrative AND coalesce(n_records, 0) <= 1 AS to_free_text FROM facts LEFT JOIN counts USING (doc_id)""")
def t02(t: Tables):
    ids = (t.benchmark.select(F.col("item_id").alias("doc_id")).union(t.labels.filter("quality = 1").select("doc_id"))
           .union(t.labels.filter("toxic = 1").select("doc_id")))
    counts = ids.groupBy("doc_id").agg(F.count("*").alias("n_records"))
    return ft.route_to_free_text(t.documents.select("doc_id", "text"), counts).select("doc_id", "n_records", "to_free_text")


def chunk_ctes(src: str) -> str:
    """Chunks by a recursive query; positions count from 0."""
    def last(mark: str) -> str:
        n = {"chr(10)": 1}.get(mark, 2)
        rev = f"reverse({mark})"
        return f"CASE WHEN strpos(reverse(w), {rev}) > 0 THEN length(w) - strpos(reverse(w), {rev}) - {n - 1} ELSE -1 END"
    return f"""
    k_docs AS (SELECT doc_id, {q.strip('text')} AS t FROM {src}),
    k_cut(doc_id, t, n, no, start, stop) AS (
      SELECT doc_id, t, length(t), 0, 0, (SELECT CASE WHEN length(t) <= 2200 THEN length(t) WHEN c > 1320 THEN c + 1 ELSE 2200 END FROM
          (SELECT greatest({last('chr(10)')}, {last("'. '")}, {last("'; '")}) AS c FROM (SELECT substr(t, 1, 2200) AS w) z) y) FROM k_docs WHERE t <> ''
      UNION ALL
      SELECT doc_id, t, n, no + 1, s, (SELECT CASE WHEN s + 2200 >= n THEN n WHEN c > 1320 THEN s + c + 1 ELSE s + 2200 END FROM
          (SELECT greatest({last('chr(10)')}, {last("'. '")}, {last("'; '")}) AS c FROM (SELECT substr(t, s + 1, 2200) AS w) z) y)
      FROM (SELECT *, greatest(stop - 250, start + 1) AS s FROM k_cut WHERE stop < n) p),
    chunked AS (SELECT doc_id, no AS chunk_no, start, {q.strip('substr(t, start + 1, stop - start)')} AS text FROM k_cut)"""


@case("t04_chunks", f"WITH RECURSIVE {chunk_ctes('documents')} SELECT doc_id, cast(chunk_no AS bigint) AS chunk_no, cast(start AS bigint) AS start, text FROM chunked")
def t04(t: Tables):
    out = ft.chunks(t.documents)
    return out.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("start").cast("bigint").alias("start"), "text")


KV = rf"^([A-Za-z][^:=\-]{{1,80}}?)[{q.W}]*[:=\-]+[{q.W}]*(.*)$"
# Find-all rules for sentences (attribute, pattern).
SENTENCE_RULES = [
    ("Total Order Value", r"(?i)\btotal billed amount\b.*?(\d+(?:\.\d+)?\s*rupees?)"),
    ("Total Order Value", r"(?i)\btotal amount\b.*?(\d+(?:\.\d+)?\s*rupees?)"),
    ("Total Order Value", r"(?i)\bamount\b.*?(\d+(?:\.\d+)?\s*rupees?)"),
    ("Quantity", r"(?i)\bfor\s+(\d+)\s+(?:units?|pcs?|pieces?|items?)\b"),
    ("Order Date", r"(?i)\bon\s+(\d{1,2}\s+[A-Za-z]+\s+\d{4})\b"),
    ("Payment Method", r"(?i)\bpayment.*?\b(UPI|Cash|Card|Net Banking)\b"),
    ("Address", r"(?i)\bdelivery city is\s+([A-Za-z ]+?)(?:\s+and|\.$)"),
    ("Order Number", r"(?i)\border reference\s+is\s+([A-Z0-9\-]+)"),
]
CUSTOMER = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s+placed an order"
PRODUCT = r"(?i)\bfor\s+\d+\s+(?:units?|pcs?|pieces?|items?)\s+of\s+([A-Za-z0-9 ]+?)(?:\.| at | worth )"


def sentence_sql(x: str) -> str:
    """List of [attribute, value] pairs of one text, in rule order."""
    pair = lambda a, v: f"[{a}, {q.strip(v)}]"
    kv = f"list_transform(list_filter({q.lines(x)}, lambda l2_: regexp_matches(l2_, '{KV}')), lambda l2_: [{q.strip(f'regexp_extract(l2_, {q.lit(KV)}, 1)')}, {q.strip(f'regexp_extract(l2_, {q.lit(KV)}, 2)')}])"
    rules = ", ".join(f"list_transform(regexp_extract_all({x}, {q.lit(p)}, 1), lambda v_: {pair(q.lit(a), 'v_')})" for a, p in SENTENCE_RULES)
    one = lambda a, p: f"CASE WHEN regexp_extract({x}, {q.lit(p)}, 1) <> '' THEN [{pair(q.lit(a), f'regexp_extract({x}, {q.lit(p)}, 1)')}] ELSE [] END"
    return f"flatten([{kv}, {rules}, {one('Customer Name', CUSTOMER)}, {one('Product Name', PRODUCT)}])"


def deduped(src: str, order: str, keys: str = "doc_id, lower(attribute), value", usable: bool = True) -> str:
    cond = f"attribute <> '' AND value <> ''" + (f" AND NOT {q.is_header('attribute', 'value')} AND NOT {q.numeric_only('attribute')}" if usable else "")
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rk FROM {src} WHERE {cond}) z WHERE rk = 1)"""


@case("t05_sentence_rules", f"""
    WITH s AS ({q.sentences(q.DUCK)}), p AS (SELECT doc_id, {sentence_sql('text')} AS ps FROM s),
    u AS (SELECT doc_id, i, ps[i][1] AS attribute, ps[i][2] AS value FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p) x)
    SELECT doc_id, attribute, value FROM {deduped('u', 'i')} d""")
def t05(t: Tables):
    return ft.extract_sentences(t.sql(q.sentences(q.SPARK))).drop("pos")


@case("t06_chunked_extraction", f"""
    WITH RECURSIVE src AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM ({q.sentences(q.DUCK)}) s), {chunk_ctes('src')},
    p AS (SELECT doc_id, chunk_no, {sentence_sql('text')} AS ps FROM chunked),
    u AS (SELECT doc_id, chunk_no, i, ps[i][1] AS attribute, ps[i][2] AS value FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p) x)
    SELECT doc_id, attribute, value FROM {deduped('u', 'chunk_no, i')} d""")
def t06(t: Tables):
    docs = t.documents.select("doc_id", "text").union(t.sql(q.sentences(q.SPARK)).select(-1 - F.col("doc_id"), "text"))
    return ft.extract_chunked(docs).drop("pos")


# Find-all rules for fields (attribute, pattern, group, suffix).
FIELD_RULES = [
    ("Workorder Number", r"(?i)\bWO[- ]?\d+\b", 0, ""), ("Purchase Order Number", r"(?i)\bPO[- ]?\d+\b", 0, ""),
    ("Invoice Number", r"(?i)\bINV[- ]?\d+\b", 0, ""), ("Equipment ID", r"(?i)\bEQ[- ]?\d+\b", 0, ""),
    ("Tracking ID", r"(?i)\bTRK[- ]?\d+\b", 0, ""), ("Maintenance Date", r"\b\d{4}[-/]\d{2}[-/]\d{2}\b", 0, ""),
    ("Temperature", r"(?i)\b(\d+(?:\.\d+)?)\s*(?:°?\s*C|celcius|celsius)\b", 1, " C"), ("Pressure", r"(?i)\b(\d+(?:\.\d+)?)\s*PSI\b", 1, " PSI"),
    ("Engine Capacity", r"(?i)\b(\d{3,5})\s*CC\b", 1, " CC"), ("Mileage", r"(?i)\b(\d+(?:\.\d+)?)\s*KMPL\b", 1, " KMPL"),
    ("Phone Number", r"\+?\d[\d\-\s]{8,}\d", 0, ""), ("Email Address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0, ""),
    ("Final Amount", r"(?i)(₹\s?\d[\d,]*|\b\d[\d,]*\s?INR\b)", 0, ""),
]


# First-match rules for phrases (attribute, pattern with one group).
PHRASE_RULES = (
    ("Site", r"\bfor\s+(Plant\s+[A-Z0-9]+|Warehouse\s+\d+|Site\s+[A-Z0-9]+)\b"),
    ("Customer Name", r"(?:customer|custmer full name|customer name)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z.]+)+)"),
    ("Assigned Engineer", r"(?:assigned enginer|assigned engineer|engineer|technician|tecnician|account mngr"
                          r"|account manager)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z.]+)+)"),
    ("Machine Type", r"(?:machin type|machine type|equipment type|device type)\s*(?:is|was|:)?\s*"
                     r"([A-Za-z][A-Za-z0-9\-\s]{2,40})"),
    ("Model Number", r"(?:model nummber|model number|model no|model)\s*(?:recorded.*?as|appears as|is|was|:)?\s*"
                     r"([A-Za-z0-9\-]+)"),
    ("Payment Method", r"(?:payment methd|payment method|pay method|mode of payment|preffered payment methd)\s*"
                       r"(?:was|is|will be|:)?\s*(bank transfer|upi|cash|credit card|debit card|net banking)"),
    ("Payment Status", r"(?:payment stat|payment status|pay status)\s*(?:was|is|still|marked as|:)?\s*"
                       r"(pending|approved|rejected|completed|closed|open|scheduled|in progress|paid|active|inactive)"),
    ("Order Status", r"(?:current ordeer status|current order status|order status)\s*(?:was|is|marked as|:)?\s*"
                     r"(pending|approved|rejected|completed|closed|open|scheduled|in progress|paid|active|inactive)"),
    ("Delivery Status", r"(?:delivary status|delivery status|shipping status|dispatch status)\s*(?:was|is|marked as|after|:)?\s*"
                        r"(pending|approved|rejected|completed|closed|open|scheduled|in progress|active|inactive)"),
    ("Billing Entity", r"(?:billing entitty|billing entity|billing company|bill to company)\s*"
                       r"(?:should remain|is|was|:)?\s*([A-Z][A-Za-z0-9&.\-\s]{2,60})"),
    ("Shipping Address", r"(?:shpping addres|shipping address|delivery address)\s*(?:is|was|:)?\s*"
                         r"([A-Za-z0-9,\-\s]{5,90})"),
    ("Fuel Type", r"(?:fuel typ|fuel type)\s*(?:for.*?\s)?(?:was|is|:)?\s*(diesel|petrol|electric|cng)"),
    ("Vehicle Type", r"(?:vehcle type|vehicle type)\s*(?:was|is|:)?\s*([A-Za-z][A-Za-z\s\-]{2,40})"),
    ("Insurance Status", r"(?:insurence status|insurance status)\s*(?:is|was|:)?\s*"
                         r"(pending|approved|rejected|completed|closed|open|scheduled|in progress|active|inactive)"),
    ("Ownership Type", r"(?:ownership typ|ownership type)\s*(?:is|was|:)?\s*([A-Za-z][A-Za-z\s\-]{2,40})"),
    ("Remarks", r"(?:remarks|comment)\s*(?:saying|says|is|:)?\s*['\"]?([^'\"]{5,120})"),
)


def field_sql(x: str) -> str:
    return "flatten([" + ", ".join(f"list_transform(regexp_extract_all({x}, {q.lit(p)}, {g}), lambda v_: [{q.lit(a)}, {q.collapse('v_')} || {q.lit(s)}])"
                                   for a, p, g, s in FIELD_RULES) + "])"


def phrase_sql(x: str) -> str:
    return "flatten([" + ", ".join(f"CASE WHEN regexp_extract({x}, {q.lit('(?i)' + p)}, 1) <> '' THEN [[{q.lit(a)}, {q.strip(f'regexp_extract({x}, ' + q.lit('(?i)' + p) + ', 1)')}]] ELSE [] END"
                                   for a, p in PHRASE_RULES) + "])"


# Every note is a text of its own, so the oracle numbers the rows.
NOTES = f"n0 AS (SELECT doc_id * 10 + part_no AS doc_id, {q.collapse('text')} AS text FROM ({q.service_notes(q.DUCK)}) s UNION ALL SELECT -1 - doc_id, {q.collapse('text')} FROM documents), n AS (SELECT *, row_number() OVER () AS rid FROM n0)"


def _notes(t: Tables):
    notes = t.sql(q.service_notes(q.SPARK)).select((F.col("doc_id") * 10 + F.col("part_no")).alias("doc_id"), "text")
    return notes.union(t.documents.select(-1 - F.col("doc_id"), "text"))


def _rule_oracle(pairs: str) -> str:
    return f"""WITH {NOTES}, p AS (SELECT rid, doc_id, {pairs} AS ps FROM n),
    u AS (SELECT rid, doc_id, i, ps[i][1] AS attribute, ps[i][2] AS value FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p) x)
    SELECT doc_id, attribute, value FROM {deduped('u', 'i', 'rid, lower(attribute), lower(value)', usable=False)} d"""


URGENT = "CASE WHEN regexp_matches(text, '(?i)\\burgent\\b') THEN [['Priority Level', 'Urgent']] ELSE [] END"


@case("t07_field_patterns", _rule_oracle(field_sql("text")))
def t07(t: Tables):
    return ft.extract_fields(_notes(t), rules=("field",)).drop("pos")


@case("t08_phrases", _rule_oracle(phrase_sql("text")))
def t08(t: Tables):
    return ft.extract_fields(_notes(t), rules=("phrase",)).drop("pos")


@case("t09_keyword_flag", _rule_oracle(URGENT))
def t09(t: Tables):
    return ft.extract_fields(_notes(t), rules=("keyword",)).drop("pos")


@case("t10_fields_deduplicated", _rule_oracle(f"flatten([{field_sql('text')}, {phrase_sql('text')}, {URGENT}])"))
def t10(t: Tables):
    return ft.extract_fields(_notes(t)).drop("pos")


# Documents read as one-cell CSV lines: prose goes to free-text extraction, the rest has no pairs.
CSV_TEXTS = f"""
    cl AS (SELECT doc_id, i, {q.clean('ls[i]')} AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {q.lines('text')} AS ls FROM documents) d) u),
    {_narrative('cl', 'cv')},
    src AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM cl JOIN cv USING (doc_id) WHERE is_narrative AND line <> '' GROUP BY doc_id)"""
CSV_FREE = f"""{CSV_TEXTS}, {chunk_ctes('src')},
    p AS (SELECT doc_id, chunk_no, {sentence_sql('text')} AS ps FROM chunked),
    u AS (SELECT doc_id, chunk_no, i, ps[i][1] AS attribute, ps[i][2] AS value FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p) x)"""


def _csv_plan(t: Tables):
    grid = tx.explode_costly(t.documents.select("doc_id", "text"), tx.lines("text"), "line", "row_no")
    return dc.csv_records(grid.select("doc_id", F.lit("").alias("sheet"), F.col("row_no").cast("bigint").alias("row_no"), F.array("line").alias("cells")))


@case("t03_routed_csv_records", f"WITH RECURSIVE {CSV_FREE} SELECT doc_id, attribute, value FROM {deduped('u', 'chunk_no, i')} d")
def t03_csv(t: Tables):
    return _csv_plan(t)[0].select("doc_id", "attribute", "value")


@case("n03_narrative_csv_documents", f"""
    WITH RECURSIVE {CSV_FREE}, c AS (SELECT doc_id, count(*) AS n FROM {deduped('u', 'chunk_no, i')} d GROUP BY doc_id), ids AS (SELECT DISTINCT doc_id FROM cl)
    SELECT doc_id, CASE WHEN coalesce(is_narrative, false) THEN 'unstructured' ELSE 'keyvalue' END AS doc_type, coalesce(n, 0) AS n_records
    FROM ids LEFT JOIN cv USING (doc_id) LEFT JOIN c USING (doc_id)""")
def n03_csv(t: Tables):
    records, docs = _csv_plan(t)
    counted = records.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.join(counted, "doc_id", "left").select("doc_id", "doc_type", F.coalesce("n", F.lit(0)).alias("n_records"))


@case("t03_routed_pdf_records", f"""
    WITH RECURSIVE {PDF}, src AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM ln JOIN nv USING (doc_id) WHERE is_narrative GROUP BY doc_id), {chunk_ctes('src')},
    p AS (SELECT doc_id, chunk_no, {sentence_sql('text')} AS ps FROM chunked),
    u AS (SELECT doc_id, chunk_no, i, ps[i][1] AS attribute, ps[i][2] AS value FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p) x)
    SELECT doc_id, attribute, value FROM kept UNION ALL SELECT doc_id, attribute, value FROM {deduped('u', 'chunk_no, i')} d""")
def t03_pdf(t: Tables):
    """Records of page documents after routing: structured ones, and free-text records of the narrative ones."""
    rows, lines = t.sql(_table_rows(q.SPARK)), t.sql(_text_lines(q.SPARK))
    verdict = dc.line_verdicts(lines)
    records, docs = dc.pdf_records(rows, lines, verdict)
    return dc.route_lines(records, docs, dc.pdf_text(lines), lines, verdict)[0].select("doc_id", "attribute", "value")


@case("t03_routed_docx_records", f"""
    WITH RECURSIVE {DOCX}, n AS (SELECT doc_id, count(*) AS n FROM rec GROUP BY doc_id), routed AS (SELECT doc_id FROM nv WHERE is_narrative),
    parts AS (SELECT doc_id, 0 AS s, 0 AS a, pos AS b, line FROM ln UNION ALL SELECT doc_id, 1, table_no, row_no, array_to_string(list_filter({q.clean_list('cells')}, lambda x_: x_ <> ''), ' | ') FROM tr),
    src AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY s, a, b) AS text FROM parts JOIN routed USING (doc_id) WHERE line <> '' GROUP BY doc_id), {chunk_ctes('src')},
    p AS (SELECT doc_id, chunk_no, {sentence_sql('text')} AS ps FROM chunked),
    u AS (SELECT doc_id, chunk_no, i, ps[i][1] AS attribute, ps[i][2] AS value FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p) x)
    SELECT doc_id, attribute, value FROM rec WHERE doc_id NOT IN (SELECT doc_id FROM routed) UNION ALL SELECT doc_id, attribute, value FROM {deduped('u', 'chunk_no, i')} d""")
def t03_docx(t: Tables):
    """Records of word-processor documents after routing."""
    rows, lines = t.sql(_table_rows(q.SPARK)), t.sql(_text_lines(q.SPARK))
    verdict = dc.line_verdicts(lines)
    records, docs = dc.docx_records(rows, lines, verdict)
    return dc.route_lines(records, docs, dc.docx_text(rows, lines), lines, verdict)[0].select("doc_id", "attribute", "value")
