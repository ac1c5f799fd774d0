"""SQL texts shared by the cases.

``Dialect`` writes the input derivations once for both engines; everything else here is DuckDB SQL
that restates the operators independently for the oracles.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from attrloom.functions.shapes import GUARDS
from attrloom.functions.text import ABBREVIATIONS
from attrloom.sources.dictionary import SEED_PATH


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def duck(self) -> bool:
        return self.name == "duck"

    def table(self, t: str) -> str:
        return t if self.duck else "{" + t + "}"

    def arr(self, *items: str) -> str:
        return f"[{', '.join(items)}]" if self.duck else f"array({', '.join(items)})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))" if self.duck else f"(({a}) div ({b}))"

    def at(self, items: str, zero_based: str) -> str:
        return f"({items})[({zero_based}) + 1]" if self.duck else f"get({items}, cast(({zero_based}) as int))"

    def text(self, x: str) -> str:
        return f"cast({x} as varchar)" if self.duck else f"cast({x} as string)"

    def money(self, x: str) -> str:
        return self.text(f"cast({x} as decimal(18,2))")

    def day(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m-%d')" if self.duck else f"date_format({x}, 'yyyy-MM-dd')"

    def longday(self, x: str) -> str:
        return f"strftime({x}, '%-d %B %Y')" if self.duck else f"date_format({x}, 'd MMMM yyyy')"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ derived inputs (both engines)

PHRASES = [
    "Order Number", "order date", "Total Order Value", "customer name", "Market Segment", "account balance",
    "Phone Number", "Email Address", "Supplier Name", "product name", "Unit Price", "ordered qty", "Discount Rate",
    "Tax Amount", "Requested Delivery Date", "shipping addr", "Tracking ID", "Warehouse", "inv code", "Billing Entity",
    "pay stat", "settlement kind", "Maintenance Status", "service state", "equipment class", "Department",
    "free note", "machine", "date", "pay mode", "supplying party", "apparatus kind",
]


def order_names(d: Dialect) -> str:
    """Misspelled and restyled attribute names with values of many shapes, one per order."""
    n = str(len(PHRASES))
    k = "o_orderkey"
    p = d.arr(*[lit(x) for x in PHRASES])
    return f"""
    SELECT doc_id, pos, attribute, value FROM (
      SELECT o_custkey AS doc_id, {k} AS pos,
        CASE kind
          WHEN 0 THEN replace(phrase, ' ', '_')
          WHEN 1 THEN substr(phrase, 1, cast(cut AS int)) || substr(phrase, cast(cut AS int) + 2)
          WHEN 2 THEN substr(phrase, 1, cast(cut AS int)) || substr(phrase, cast(cut AS int) + 1, 1) || substr(phrase, cast(cut AS int) + 1)
          WHEN 3 THEN upper(replace(phrase, ' ', '-'))
          WHEN 4 THEN ' ' || replace(phrase, ' ', '  ') || ' '
          WHEN 5 THEN replace(phrase, ' ', '')
          ELSE phrase || ' ' || lower(o_orderpriority)
        END AS attribute,
        CASE {k} % 8
          WHEN 0 THEN ''
          WHEN 1 THEN 'ORD-' || {d.text(k)}
          WHEN 2 THEN {d.day('o_orderdate')}
          WHEN 3 THEN {d.money('o_totalprice')}
          WHEN 4 THEN '98765' || lpad({d.text(k)}, 7, '0')
          WHEN 5 THEN 'buyer' || {d.text('o_custkey')} || '@example.com'
          WHEN 6 THEN o_orderstatus
          ELSE ' ' || o_orderpriority || ' '
        END AS value
      FROM (SELECT *, {d.idiv(k, n)} % 7 AS kind, {d.at(p, f'{k} % {n}')} AS phrase,
                   {d.idiv(k, f'7 * {n}')} % length({d.at(p, f'{k} % {n}')}) AS cut FROM {d.table('orders')}) o) x"""


def order_records(d: Dialect) -> str:
    """Orders unpivoted for the oracles: one record per column, names without the column prefix."""
    cells = [("orderkey", d.text("o_orderkey")), ("custkey", d.text("o_custkey")), ("orderstatus", "o_orderstatus"),
             ("totalprice", d.money("o_totalprice")), ("orderdate", d.day("o_orderdate")), ("orderpriority", "o_orderpriority")]
    parts = [f"SELECT o_orderkey AS doc_id, cast({i} AS bigint) AS pos, {lit(a)} AS attribute, {v} AS value FROM {d.table('orders')}"
             for i, (a, v) in enumerate(cells)]
    return " UNION ALL ".join(parts)


def sentences(d: Dialect) -> str:
    """One order sentence per order, followed by key/value lines."""
    k = d.text("o_orderkey")
    return f"""
    SELECT o_orderkey AS doc_id,
      CASE o_orderkey % 4
        WHEN 0 THEN 'Anna Berg placed an order for ' || {d.text('o_custkey % 90 + 1')} || ' units of blue widget at our store on '
                    || {d.longday('o_orderdate')} || '. The total amount is ' || {d.money('o_totalprice')} || ' rupees. Payment came by Net Banking.'
        WHEN 1 THEN 'Order reference is ORD-' || {k} || '. Delivery city is New Town and the total billed amount was ' || {d.money('o_totalprice')}
                    || ' rupees for ' || {d.text('o_custkey % 9 + 2')} || ' pcs of ring worth more.'
        WHEN 2 THEN 'Status: ' || o_orderstatus || chr(10) || 'Priority = ' || o_orderpriority || chr(10) || 'name: skipped' || chr(10) || 'Order Key - ' || {k}
                    || chr(10) || 'status: ' || o_orderstatus
        ELSE 'For order ' || {k} || ' the amount came to ' || {d.money('o_totalprice')} || ' rupees, paid with UPI; delivery city is Port Royal.'
      END AS text
    FROM {d.table('orders')}"""


def service_notes(d: Dialect) -> str:
    """One service note per line item, with identifiers, measures and status phrases."""
    k = d.text("l_orderkey")
    day = d.day("l_shipdate")
    return f"""
    SELECT l_orderkey AS doc_id, cast(l_linenumber AS bigint) AS part_no, l_partkey AS part_key, l_suppkey AS supp_key,
      CASE (l_orderkey + l_linenumber) % 6
        WHEN 0 THEN 'WO-' || {k} || ' and wo-' || {k} || ' for Plant A' || {d.text('l_suppkey')} || ' on ' || {day} || ', urgent. Pressure ' || {d.text('l_linenumber')} || '5.5 psi.'
        WHEN 1 THEN 'Invoice INV ' || {k} || ' of ' || {day} || ' over ₹ ' || {d.text('l_partkey')} || ',000 or ' || {d.text('l_partkey')} || ' INR; payment status is marked as paid.'
        WHEN 2 THEN 'Customer Maria Lopez asked; technician  Jan Novak came. Machine type: lathe mk' || {d.text('l_linenumber')} || '. Model no LX-' || {d.text('l_partkey')} || ' at 45.5 °C'
        WHEN 3 THEN 'Tracking TRK' || {k} || ', delivery status is in progress. Shipping address: ' || {d.text('l_suppkey')} || ' Harbour Road, Old Town'
        WHEN 4 THEN 'EQ-' || {d.text('l_partkey')} || ' runs 1500 cc at 18.5 KMPL; fuel type is diesel, insurance status was active. Remarks: ''call ' || {d.text('l_suppkey')} || ' first'''
        ELSE 'PO ' || {k} || ' paid: payment method was upi, mail ops' || {d.text('l_suppkey')} || '@depot.example.com or phone +49 170 55' || lpad({d.text('l_partkey')}, 6, '0') || '.'
      END AS text
    FROM {d.table('lineitem')}"""


def sheets(d: Dialect) -> str:
    """Workbook-like grids: one document per nation, one sheet per market segment, three layouts."""
    label = d.at(d.arr(*[lit(x) for x in PHRASES]), f"c_custkey % {len(PHRASES)}")
    doc, sheet = "cast(c_nationkey AS bigint) AS doc_id", "c_mktsegment AS sheet"
    none = "cast(NULL AS varchar)" if d.duck else "cast(NULL AS string)"
    head0 = d.arr("'Note'", "'Key'", "'Note'", none, "'Value'", none)
    head1 = d.arr("'Item'", "'Amount'", "'Remark'", "'Remark'", "''", none)
    row = lambda a, v: d.arr(a, v, "'₹' || " + d.money("c_acctbal"), "CASE WHEN c_custkey % 3 = 0 THEN 'NaN' ELSE ' n' || " + d.text("c_custkey % 4") + " END", "'  '", none)
    swapped = d.arr("'₹' || " + d.money("c_acctbal"), label, "'note'", "'N/A'", "c_name", none)
    pair = d.arr(none, f"CASE WHEN c_custkey % 9 = 0 THEN 'Field Label' WHEN c_custkey % 9 = 1 THEN '1,200' ELSE {label} END",
                 f"CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE {d.text('c_custkey % 20')} END", none)
    c = d.table("customer")
    return f"""
    SELECT cast(c_nationkey AS bigint) AS doc_id, c_mktsegment AS sheet, min(c_custkey) AS row_no,
           CASE WHEN c_nationkey % 4 = 0 THEN {head0} ELSE {head1} END AS cells
      FROM {c} WHERE c_nationkey % 4 < 2 GROUP BY c_nationkey, c_mktsegment
    UNION ALL
    SELECT {doc}, {sheet}, c_custkey + 1 AS row_no,
           CASE c_nationkey % 4 WHEN 0 THEN {swapped} WHEN 3 THEN {pair} ELSE {row(label, 'c_name')} END AS cells FROM {c}"""


# ------------------------------------------------------------------ DuckDB restatements

W = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{W}]+|[{W}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({strip(x)}, '[{W}]+', ' ', 'g')"


def clean(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    return f"(CASE WHEN lower({s}) IN ('nan', 'none') THEN '' ELSE {s} END)"


def clean_list(xs: str) -> str:
    return f"list_transform({xs}, lambda c_: {clean('c_')})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{W}]+'), lambda w_: w_ <> '')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '{BREAK}'), lambda l_: {strip('l_')}), lambda l_: l_ <> '')"


def col_name(x: str) -> str:
    return strip(f"regexp_replace(lower({clean(x)}), '[_{W}-]+', ' ', 'g')")


def d1(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), '[{W}]+', ' ', 'g')"


def d2(x: str) -> str:
    return d1(f"regexp_replace({x}, '[_\\-]+', ' ', 'g')")


def d3(spaced: str) -> str:
    table = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in ABBREVIATIONS.items()) + "}"
    return f"array_to_string(list_transform({words(spaced)}, lambda t_: coalesce({table}[t_], t_)), ' ')"


def tokens(x: str) -> str:
    return f"list_distinct(list_filter({words(x)}, lambda t_: length(t_) > 1))"


HEADER = rf"(?i)^(?:field[{W}]*label|attribute|key|column|header|name|label|field|value|#|no\.?)$"


def is_header(a: str, v: str) -> str:
    return (f"({a} = '' OR regexp_matches({a}, '{HEADER}') OR (lower({a}) IN ('field label', 'attribute', 'name') "
            f"AND lower({v}) IN ('value', 'values')))")


def numeric_only(a: str) -> str:
    return rf"regexp_full_match({a}, '[\d{W}.,]+')"


DATE = (rf"\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}[{W}]+[A-Za-z]+[{W}]+\d{{4}}\b"
        rf"|\b[A-Za-z]+[{W}]+\d{{1,2}},[{W}]*\d{{4}}\b")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def shape(kind: str, v: str) -> str:
    return {
        "date": f"regexp_matches({v}, '{DATE}')",
        "phone": f"(length(regexp_replace({v}, '\\D', '', 'g')) BETWEEN 10 AND 15)",
        "email": f"regexp_matches({v}, '{EMAIL}')",
        "amount": rf"regexp_matches(lower({v}), '(₹|\$|rs\.?|rupees?|inr|\d+(?:,\d{{3}})*(?:\.\d+)?)')",
        "id": rf"regexp_matches({v}, '\b[A-Z]{{1,}}[A-Z0-9\-]*\d+[A-Z0-9\-]*\b')",
    }[kind]


def guard_of(canonical: str) -> str:
    table = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in GUARDS.items()) + "}"
    return f"{table}[lower({canonical})]"


def guard_ok(kind: str, value: str) -> str:
    v = strip(f"coalesce({value}, '')")
    arms = " ".join(f"WHEN {kind} = {lit(k)} THEN {shape(k, v)}" for k in ("phone", "email", "date", "amount", "id"))
    return f"(CASE WHEN {kind} IS NULL OR {v} = '' THEN true {arms} ELSE true END)"


def friendly(path: str) -> str:
    kept = f"list_filter(string_split({strip(path)}, '.'), lambda p_: lower(p_) NOT IN ('data', 'root', 'record', 'records'))"
    spaced = "regexp_replace(regexp_replace(p_, '[_-]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')"
    return f"array_to_string(list_filter(list_transform({kept}, lambda p_: {strip(f'lower({spaced})')}), lambda p_: p_ <> ''), ' ')"


def seed_entries() -> str:
    with open(SEED_PATH, encoding="utf-8") as f:
        data = json.load(f)["master_attributes"]
    rows = ", ".join(f"({i}, {lit(e['canonical'])}, [{', '.join(lit(v) for v in e['variations'])}])" for i, e in enumerate(data))
    return f"SELECT * FROM (VALUES {rows}) t(entry_no, canonical, variations)"


def dictionary_ctes(entries: str) -> str:
    """CTEs d_texts, d_exact, d_var and d_corpus over ``(entry_no, canonical, variations)``."""
    return f"""
    d_entries AS ({entries}),
    d_list AS (SELECT entry_no, canonical, list_prepend(canonical, variations) AS vs FROM d_entries),
    d_raw AS (SELECT entry_no, canonical, k, vs[k + 1] AS t FROM (SELECT *, unnest(range(len(vs))) AS k FROM d_list) q),
    d_f12 AS (SELECT *, {d1('t')} AS f1, {d2('t')} AS f2 FROM d_raw),
    d_f AS (SELECT *, {d3('f2')} AS f3 FROM d_f12),
    d_texts AS (
      SELECT cast(entry_no AS bigint) * 4294967296 + k * 4 AS var_no, canonical, f1 AS form, k = 0 AS is_canonical FROM d_f
      UNION ALL SELECT cast(entry_no AS bigint) * 4294967296 + k * 4 + 1, canonical, f2, k = 0 FROM d_f WHERE f2 <> f1
      UNION ALL SELECT cast(entry_no AS bigint) * 4294967296 + k * 4 + 1 + (CASE WHEN f2 <> f1 THEN 1 ELSE 0 END), canonical, f3, k = 0
        FROM d_f WHERE f3 <> f2 AND f3 <> f1),
    d_exact AS (SELECT form, max_by(canonical, var_no) AS canonical FROM d_texts GROUP BY form),
    d_var AS (SELECT var_no, form, canonical FROM (
        SELECT *, row_number() OVER (PARTITION BY form, canonical ORDER BY var_no) AS rn FROM d_texts) q
      WHERE is_canonical OR rn = 1),
    d_corpus AS (SELECT form, min(var_no) AS var_no, min_by(canonical, var_no) AS canonical FROM d_var GROUP BY form)"""


def grams(x: str) -> str:
    per_n = ", ".join(
        f"list_transform(range(1, greatest(1, length(w_) + {4 - n})), lambda i_: substr(' ' || w_ || ' ', i_, {n}))" for n in (2, 3, 4))
    return f"flatten(list_transform({words(f'lower({x})')}, lambda w_: flatten([{per_n}])))"


def tfidf_ctes(texts: str) -> str:
    """CTEs for D9 and the cosine of ``texts(text)`` with the corpus: w_idf, w_var, w_scores."""
    return f"""
    g_var AS (SELECT var_no, unnest({grams('form')}) AS gram FROM d_corpus),
    g_tf AS (SELECT var_no, gram, count(*) AS tf FROM g_var GROUP BY 1, 2),
    w_idf AS (SELECT gram, count(*) AS df, ln((1.0 + (SELECT count(*) FROM d_corpus)) / (1.0 + count(*))) + 1.0 AS idf
              FROM g_tf GROUP BY gram ORDER BY sum(tf) DESC, gram LIMIT 10000),
    w_raw AS (SELECT var_no, gram, tf * idf AS w FROM g_tf JOIN w_idf USING (gram)),
    w_var AS (SELECT var_no, gram, w / sqrt(sum(w * w) OVER (PARTITION BY var_no)) AS weight FROM w_raw),
    q_gram AS (SELECT text, unnest({grams('text')}) AS gram FROM {texts}),
    q_tf AS (SELECT text, gram, count(*) AS tf FROM q_gram GROUP BY 1, 2),
    q_raw AS (SELECT text, gram, tf * idf AS w FROM q_tf JOIN w_idf USING (gram)),
    q_w AS (SELECT text, gram, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS w FROM q_raw),
    w_scores AS (SELECT text, var_no, sum(w * weight) AS score FROM q_w JOIN w_var USING (gram) GROUP BY 1, 2)"""


def fuzzy_ctes(texts: str) -> str:
    """CTE f_scores: token-sort ratio of every (text, spelling) pair."""
    srt = lambda x: f"array_to_string(list_sort({words(x)}), ' ')"
    mask = ("map_from_entries(list_transform(list_distinct(cs), lambda c_: {'k': c_, 'v': list_sum(list_transform(range(len(cs)), "
            "lambda j_: CASE WHEN cs[j_ + 1] = c_ THEN (1::bigint << j_::int)::bigint ELSE 0::bigint END))::bigint}))")
    step = ("list_reduce(qc, lambda v_, c_: (((v_ + (v_ & coalesce(masks[c_::varchar], 0::bigint))) | (v_ & ~coalesce(masks[c_::varchar], 0::bigint)))"
            " & full_mask)::bigint, full_mask)")
    return f"""
    f_var0 AS (SELECT var_no, form, canonical, string_split({srt('form')}, '') AS cs FROM d_var),
    f_var AS (SELECT *, len(cs) AS vl, {mask} AS masks, ((1::bigint << len(cs)::int) - 1)::bigint AS full_mask FROM f_var0),
    f_q AS (SELECT text, string_split({srt('text')}, '') AS qs, length({srt('text')}) AS ql FROM {texts}),
    f_pairs AS (SELECT text, ql, var_no, form, canonical, vl, full_mask, masks, qs FROM f_q, f_var
                WHERE 200.0 * least(ql, vl) / (ql + vl) >= 70),
    f_codes AS (SELECT *, list_transform(qs, lambda c_: coalesce(masks[c_], 0::bigint)) AS ms FROM f_pairs),
    f_lcs AS (SELECT text, ql, var_no, form, canonical, vl,
        vl - bit_count(list_reduce(ms, lambda v_, m_: (((v_ + (v_ & m_)) | (v_ & ~m_)) & full_mask)::bigint, full_mask)) AS lcs FROM f_codes),
    f_scores AS (SELECT text, var_no, form, canonical, (1.0 - (ql + vl - 2 * lcs)::double / (ql + vl)) * 100.0 AS score FROM f_lcs)"""


def best_with_lead(scores: str, threshold: str, gap: str) -> str:
    return f"""(SELECT text, form, canonical, score FROM (
        SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM {scores}
        WINDOW w AS (PARTITION BY text ORDER BY score DESC, var_no)) b
      WHERE rn = 1 AND score >= {threshold} AND NOT (score - coalesce(second, 0) < {gap}))"""


def names_ctes(names_sql: str) -> str:
    """CTEs n_names(norm, spaced, expanded) and n_texts(text) of a name column ``attribute``."""
    return f"""
    n_rows AS ({names_sql}),
    n_norm AS (SELECT DISTINCT {d1('attribute')} AS norm FROM n_rows),
    n_sp AS (SELECT norm, {d2('norm')} AS spaced FROM n_norm),
    n_names AS (SELECT *, {d3('spaced')} AS expanded FROM n_sp),
    n_texts AS (SELECT spaced AS text FROM n_names UNION SELECT expanded FROM n_names)"""


EXACT_HITS = """
    h_exact AS (SELECT n.norm, coalesce(a.canonical, b.canonical, c.canonical) AS canonical FROM n_names n
      LEFT JOIN d_exact a ON a.form = n.norm LEFT JOIN d_exact b ON b.form = n.spaced LEFT JOIN d_exact c ON c.form = n.expanded)"""


def contain_ctes(texts: str) -> str:
    return f"""
    c_var AS (SELECT *, {tokens('form')} AS vt FROM d_var),
    c_q AS (SELECT text, {tokens('text')} AS qt FROM {texts}),
    h_contain AS (SELECT text, canonical, form FROM (
        SELECT text, canonical, form, row_number() OVER (PARTITION BY text ORDER BY length(form) DESC, var_no) AS rn
        FROM c_q, c_var WHERE len(qt) > 0 AND list_has_all(vt, qt)) q WHERE rn = 1)"""


def cascade_ctes(names_sql: str, fuzzy: float = 88.0, semantic: float = 0.72) -> str:
    """CTE matched: every row of ``names_sql(doc_id, pos, attribute, value)`` with its match columns."""
    tiers = [("x.canonical", "'exact'", "1.0", "n.spaced"),
             ("p1.canonical", "'prefix'", "1.0", "n.spaced"),
             ("p2.canonical", "'abbrev'", "1.0", "n.expanded"),
             ("f1.canonical", "CASE WHEN f1.score / 100.0 >= 0.95 THEN 'synonym' ELSE 'fuzzy' END", "f1.score / 100.0", "f1.form"),
             ("f2.canonical", "CASE WHEN f2.score / 100.0 >= 0.95 THEN 'synonym' ELSE 'fuzzy' END", "f2.score / 100.0", "f2.form"),
             ("s1.canonical", "'semantic'", "s1.score", "s1.form"),
             ("s2.canonical", "'semantic'", "s2.score", "s2.form")]
    def pick() -> str:
        arms = " ".join(f"WHEN {t[0]} IS NOT NULL AND {guard_ok(guard_of(t[0]), 'r.value')} THEN {n}" for n, t in enumerate(tiers))
        return f"CASE {arms} ELSE -1 END"
    cols = ", ".join([f"{t[0]} AS c{n}, {t[1]} AS k{n}, cast({t[2]} AS double) AS s{n}, {t[3]} AS v{n}" for n, t in enumerate(tiers)])
    of = lambda p, other: "CASE tier " + " ".join(f"WHEN {n} THEN {p}{n}" for n in range(7)) + f" ELSE {other} END"
    return f"""{dictionary_ctes(seed_entries())}, {names_ctes(names_sql)}, {EXACT_HITS}, {contain_ctes('n_texts')},
    {fuzzy_ctes('n_texts')}, {tfidf_ctes('n_texts')},
    h_fuzzy AS (SELECT * FROM {best_with_lead('f_scores', str(fuzzy), '10.0')} q),
    s_scores AS (SELECT text, s.var_no, form, canonical, score FROM w_scores s JOIN d_corpus USING (var_no)),
    h_sem AS (SELECT * FROM {best_with_lead('s_scores', str(semantic), '0.10')} q),
    m_pick AS (SELECT r.*, {strip('r.attribute')} AS raw_attr, {pick()} AS tier, {cols}
      FROM n_rows r JOIN n_names n ON n.norm = {d1('r.attribute')}
      LEFT JOIN h_exact x ON x.norm = n.norm
      LEFT JOIN h_contain p1 ON p1.text = n.spaced LEFT JOIN h_contain p2 ON p2.text = n.expanded AND n.expanded <> n.spaced
      LEFT JOIN h_fuzzy f1 ON f1.text = n.spaced LEFT JOIN h_fuzzy f2 ON f2.text = n.expanded AND n.expanded <> n.spaced
      LEFT JOIN h_sem s1 ON s1.text = n.spaced LEFT JOIN h_sem s2 ON s2.text = n.expanded AND n.expanded <> n.spaced),
    matched AS (SELECT doc_id, pos, value, raw_attr, {of('c', 'raw_attr')} AS canonical_attr, {of('k', "'unmatched'")} AS match_type,
      {of('s', '0.0')} AS confidence, {of('v', 'NULL')} AS matched_variation FROM m_pick)"""
