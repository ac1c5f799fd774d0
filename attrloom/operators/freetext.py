"""Routing, chunking and rule-based extraction of free text.

All rules of a document run on its own row in one batch function, duplicates are dropped there too, and only
found records leave it: one narrow pass over the text, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attrloom.functions import text as tx
from attrloom.functions import textrules
from attrloom.functions.textrules import triggered as _if_triggered

# The rules go to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(textrules)

MAX_CHARS = 2200
OVERLAP = 250

# Find-all rules for sentences about an order (attribute, pattern with one group).
SENTENCE_RULES = (
    ("Total Order Value", r"\btotal billed amount\b.*?(\d+(?:\.\d+)?\s*rupees?)"),
    ("Total Order Value", r"\btotal amount\b.*?(\d+(?:\.\d+)?\s*rupees?)"),
    ("Total Order Value", r"\bamount\b.*?(\d+(?:\.\d+)?\s*rupees?)"),
    ("Quantity", r"\bfor\s+(\d+)\s+(?:units?|pcs?|pieces?|items?)\b"),
    ("Order Date", r"\bon\s+(\d{1,2}\s+[A-Za-z]+\s+\d{4})\b"),
    ("Payment Method", r"\bpayment.*?\b(UPI|Cash|Card|Net Banking)\b"),
    ("Address", r"\bdelivery city is\s+([A-Za-z ]+?)(?:\s+and|\.$)"),
    ("Order Number", r"\border reference\s+is\s+([A-Z0-9\-]+)"),
)
CUSTOMER_AT_START = r"\A([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s+placed an order"
PRODUCT_IN_ORDER = r"\bfor\s+\d+\s+(?:units?|pcs?|pieces?|items?)\s+of\s+([A-Za-z0-9 ]+?)(?:\.| at | worth )"

# Find-all rules for identifiers and measures (attribute, pattern, group, suffix, flags).
FIELD_RULES = (
    ("Workorder Number", r"\bWO[- ]?\d+\b", 0, "", "i"),
    ("Purchase Order Number", r"\bPO[- ]?\d+\b", 0, "", "i"),
    ("Invoice Number", r"\bINV[- ]?\d+\b", 0, "", "i"),
    ("Equipment ID", r"\bEQ[- ]?\d+\b", 0, "", "i"),
    ("Tracking ID", r"\bTRK[- ]?\d+\b", 0, "", "i"),
    ("Maintenance Date", r"\b\d{4}[-/]\d{2}[-/]\d{2}\b", 0, "", ""),
    ("Temperature", r"\b(\d+(?:\.\d+)?)\s*(?:°?\s*C|celcius|celsius)\b", 1, " C", "i"),
    ("Pressure", r"\b(\d+(?:\.\d+)?)\s*PSI\b", 1, " PSI", "i"),
    ("Engine Capacity", r"\b(\d{3,5})\s*CC\b", 1, " CC", "i"),
    ("Mileage", r"\b(\d+(?:\.\d+)?)\s*KMPL\b", 1, " KMPL", "i"),
    ("Phone Number", r"\+?\d[\d\-\s]{8,}\d", 0, "", ""),
    ("Email Address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0, "", ""),
    ("Final Amount", r"(₹\s?\d[\d,]*|\b\d[\d,]*\s?INR\b)", 0, "", "i"),
)

# Words one of which a text must contain for the rule of that attribute to match; a plain substring
# search on the folded text that saves the pattern on most texts.
SENTENCE_TRIGGERS = {
    "Total Order Value": ("rupee",), "Quantity": ("for",), "Order Date": ("on",), "Payment Method": ("payment",),
    "Address": ("delivery city",), "Order Number": ("order reference",),
}
FIELD_TRIGGERS = {
    "Workorder Number": ("wo",), "Purchase Order Number": ("po",), "Invoice Number": ("inv",), "Equipment ID": ("eq",),
    "Tracking ID": ("trk",), "Maintenance Date": ("-", "/"), "Temperature": ("c",), "Pressure": ("psi",),
    "Engine Capacity": ("cc",), "Mileage": ("kmpl",), "Phone Number": (), "Email Address": ("@",), "Final Amount": ("₹", "inr"),
}
PHRASE_TRIGGERS = {
    "Site": ("plant", "warehouse", "site"),
    "Customer Name": ("customer", "custmer"),
    "Assigned Engineer": ("engin", "technician", "tecnician", "account m"),
    "Machine Type": ("machin type", "machine type", "equipment type", "device type"),
    "Model Number": ("model",),
    "Payment Method": ("payment meth", "pay method", "mode of payment"),
    "Payment Status": ("payment stat", "pay status"),
    "Order Status": ("order status", "ordeer status"),
    "Delivery Status": ("delivary status", "delivery status", "shipping status", "dispatch status"),
    "Billing Entity": ("billing entit", "billing company", "bill to company"),
    "Shipping Address": ("shpping addres", "shipping address", "delivery address"),
    "Fuel Type": ("fuel typ",),
    "Vehicle Type": ("vehcle type", "vehicle type"),
    "Insurance Status": ("insurence status", "insurance status"),
    "Ownership Type": ("ownership typ",),
    "Remarks": ("remarks", "comment"),
}

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


# ---------------------------------------------------------------- routing


def _line_facts(line: Column) -> dict[str, Column]:
    """Counts of one stripped non-blank line; whitespace then stands between words only."""
    # Words are one more than the gaps. ``F.split`` would compile its pattern for every line.
    gaps = F.regexp_replace(line, f"[{tx.WS}]+", " ")
    n_words = F.length(gaps) - F.length(F.replace(gaps, F.lit(" "), F.lit(""))) + 1
    return {
        "n_lines": F.lit(1),
        "n_words": n_words,
        "long_lines": (n_words >= 10).cast("int"),
        "kv_lines": (line.rlike(r"[:=\-]") & (n_words <= 12)).cast("int"),
        # Looking a mark up is cheap, dropping it looks at every character.
        "marks": F.when(line.rlike("[.?!]"), F.length(line) - F.length(F.translate(line, ".?!", ""))).otherwise(F.lit(0)),
    }


def _narrative(n_lines: Column, n_words: Column, long_lines: Column, kv_lines: Column, marks: Column) -> Column:
    average = n_words / F.greatest(n_lines, F.lit(1))
    half = F.greatest(F.lit(2), F.floor(n_lines / 2))
    few_long = (n_lines <= 5) & (average >= 12)
    mostly_long = (long_lines >= half) & (kv_lines == 0)
    sentences = (marks >= 2) & (kv_lines == 0) & (average >= 8)
    return (n_lines > 0) & (few_long | mostly_long | sentences)


def narrative_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """T1 on text rows: line statistics and the narrative verdict, inside the row."""
    with_lines = docs.withColumn("_lines", tx.lines(F.coalesce(text, F.lit(""))))
    facts = F.transform("_lines", lambda ln: F.struct(*[v.alias(k) for k, v in _line_facts(ln).items()]))
    with_facts = with_lines.withColumn("_facts", facts)
    names = ["n_lines", "n_words", "long_lines", "kv_lines", "marks"]
    for name in names:
        with_facts = with_facts.withColumn(name, F.aggregate(
            F.col(f"_facts.{name}"), F.lit(0).cast("bigint"), lambda total, x: total + x))
    return with_facts.withColumn("is_narrative", _narrative(*[F.col(n) for n in names])).drop("_lines", "_facts")


def narrative_lines(lines: DataFrame, line: str = "line", keys: list[str] | None = None) -> DataFrame:
    """T1 on line tables: the same verdict as sums per document, without assembling the text."""
    keys = keys or ["doc_id"]
    kept = tx.compute_once(lines.select(*keys, tx.col(line).alias("_text")), tx.strip("_text"), "_line").filter(F.col("_line") != "")
    facts = _line_facts(F.col("_line"))
    sums = kept.select(*keys, *[v.cast("bigint").alias(k) for k, v in facts.items()]).groupBy(*keys).agg(
        *[F.sum(k).alias(k) for k in facts])
    return sums.withColumn("is_narrative", _narrative(*[F.col(n) for n in facts]))


def route_to_free_text(docs: DataFrame, counts: DataFrame, text: str = "text") -> DataFrame:
    """Documents with at most one structured record and a narrative text.

    ``counts`` is ``(doc_id, n_records)`` with one row per document that has records. The verdict is taken
    before the join, so no text is shuffled; callers read the texts of the routed documents again.
    """
    facts = narrative_facts(docs, text).drop(text)
    facts = facts.join(counts, "doc_id", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    return facts.withColumn("to_free_text", (F.col("n_records") <= 1) & F.col("is_narrative"))


# ---------------------------------------------------------------- chunking


CHUNKS = "array<struct<start:int,text:string>>"


def chunk_array(text: Column | str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """T4: overlapping chunks ``array<struct(start, text)>`` of an already stripped text.

    A fold over as many steps as the text can need: each cut lies beyond 60 % of the window, which
    bounds how little a step advances. The text is cut once into pieces as long as a window, so that a
    step looks at two of them and not at the text from its start.
    """
    t = tx.col(text)
    pieces = F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % max_chars), F.lit(0))
    n = F.length(t)
    earliest = int(max_chars * 0.6)
    steps = F.sequence(F.lit(1), F.ceil(n / F.lit(max(1, earliest + 2 - overlap))).cast("int") + 1)
    kind = f"struct<start:int,done:boolean,chunks:{CHUNKS}>"
    state = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"), F.array().alias("chunks")).cast(kind)

    def last_cut(window: Column) -> Column:
        def at(backwards: Column, mark: str) -> Column:
            found = F.instr(backwards, mark[::-1])
            return F.when(found > 0, F.length(backwards) - found - F.lit(len(mark) - 1)).otherwise(F.lit(-1))
        return tx.let(F.reverse(window), lambda b: F.greatest(at(b, "\n"), at(b, ". "), at(b, "; ")))

    def part(cut: Column, start: Column, length: Column) -> Column:
        """At most ``max_chars`` characters from ``start`` on."""
        at = (start / F.lit(max_chars)).cast("int")
        near = F.concat(F.get(cut, at), F.coalesce(F.get(cut, at + 1), F.lit("")))
        return F.substring(near, start % F.lit(max_chars) + 1, length)

    def step(pieces: Column, s: Column) -> Column:
        start = s["start"]

        def grow(end: Column) -> Column:
            chunk = tx.strip(part(pieces, start, end - start))
            added = tx.let(chunk, lambda c: F.when(c != "", F.array_append(
                s["chunks"], F.struct(start.alias("start"), c.alias("text")))).otherwise(s["chunks"]))
            return F.struct(F.greatest(end - F.lit(overlap), start + 1).cast("int").alias("start"),
                            (end >= n).alias("done"), added.alias("chunks")).cast(kind)

        cut = last_cut(part(pieces, start, F.lit(max_chars)))
        end = F.when(start + F.lit(max_chars) >= n, n).otherwise(tx.let(
            cut, lambda c: F.when(c > earliest, start + c + 1).otherwise(start + F.lit(max_chars))))
        return F.when(s["done"], s).otherwise(tx.let(end.cast("int"), grow))

    whole = F.array(F.struct(F.lit(0).alias("start"), t.alias("text"))).cast(CHUNKS)
    return (F.when(n == 0, F.array().cast(CHUNKS)).when(n <= max_chars, whole)
            .otherwise(tx.let(pieces, lambda cut: F.aggregate(steps, state, lambda s, _: step(cut, s), lambda s: s["chunks"]))))


def chunks(docs: DataFrame, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """T4: ``(doc_id, chunk_no, start, text)``."""
    stripped = docs.select("doc_id", tx.strip(F.coalesce(text, F.lit(""))).alias("_t"))
    out = tx.explode_costly(stripped, chunk_array("_t", max_chars, overlap), "c", "chunk_no")
    return out.select("doc_id", "chunk_no", "c.start", "c.text")


# ---------------------------------------------------------------- rules


def _rules(found: tuple, firsts: tuple = ()) -> Callable:
    """Pairs of one text by find-all rules, then by first-match rules; the trigger test is looked up when the plan is made."""
    return textrules.matches([*found, *firsts], _if_triggered)


def sentence_pairs() -> Callable:
    """T5 before the dedupe: key/value lines, find-all rules, then the two first-match rules."""
    found = [(a, SENTENCE_TRIGGERS[a], textrules.compiled(p), 1, "", False) for a, p in SENTENCE_RULES]
    firsts = [("Customer Name", ("placed an order",), textrules.compiled(CUSTOMER_AT_START, ignore_case=False), 1, "", True),
              ("Product Name", ("for",), textrules.compiled(PRODUCT_IN_ORDER), 1, "", True)]
    lines, rules = textrules.key_value_pairs, _rules(found, firsts)
    return lambda text: chain(lines(text), rules(text))


def field_pairs() -> Callable:
    """Find-all rules on a collapsed text."""
    return _rules([(a, FIELD_TRIGGERS[a], textrules.compiled(p, i == "i"), group, suffix, False) for a, p, group, suffix, i in FIELD_RULES])


def phrase_pairs() -> Callable:
    """First-match rules on a collapsed text."""
    return _rules([], [(a, PHRASE_TRIGGERS[a], textrules.compiled(p), 1, "", True) for a, p in PHRASE_RULES])


def keyword_pairs() -> Callable:
    """The word "urgent" sets a priority."""
    fold, pattern = textrules.folded, textrules.URGENT
    return lambda text: [("Priority Level", "Urgent")] if "urgent" in fold(text) and pattern.search(text) else []


def _usable_of(pairs: Callable) -> Callable:
    usable = textrules.usable_pairs()
    return lambda text: [p for p in pairs(text or "") if usable(*p)]


def _found(docs: DataFrame, text: str, cell: Column, pairs: Callable, fold_value: bool = False) -> DataFrame:
    """The first of the pairs that a function finds in every ``cell``; all columns of ``docs`` but the text stay."""
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = StructType([*rest, *StructType.fromDDL("pos bigint, attribute string, value string").fields])
    cells = docs.select(*[F.col(f"`{f.name}`") for f in rest], cell.alias("_cell"))
    return cells.mapInArrow(textrules.first_pairs(pairs, "_cell", fold_value), schema)


def extract_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """T5: records of the sentence rules, first (lower-cased name, value) per row."""
    return _found(docs, text, F.make_valid_utf8(text), _usable_of(sentence_pairs()))


def extract_chunked(docs: DataFrame, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunk, extract from each chunk, merge in chunk order with one dedupe per document."""
    stripped = docs.withColumn(text, tx.strip(F.coalesce(F.make_valid_utf8(text), F.lit(""))))
    texts = F.transform(chunk_array(text, max_chars, overlap), lambda c: c["text"])
    pairs = _usable_of(sentence_pairs())
    return _found(stripped, text, texts, lambda chunks: chain.from_iterable(map(pairs, chunks)))


def extract_fields(docs: DataFrame, text: str = "text", rules: tuple[str, ...] = ("field", "phrase", "keyword")) -> DataFrame:
    """Records of the field and phrase rules, deduplicated without regard to case."""
    kinds = {"field": field_pairs, "phrase": phrase_pairs, "keyword": keyword_pairs}
    parts = [kinds[r]() for r in rules]

    def pairs(text):
        flat = " ".join((text or "").split())
        cleaned = ((attribute, " ".join(value.split())) for part in parts for attribute, value in part(flat))
        return [p for p in cleaned if p[1]]

    return _found(docs, text, F.make_valid_utf8(text), pairs, fold_value=True)
