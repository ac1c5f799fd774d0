"""Record-level operators: line rule, dedupe, broken-table detection, unpivot of wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.functions.text import WS
from attrloom.operators.lookups import first_per_key, join_per_key

# Fixed value: a "key: value" line.
KEY_VALUE_LINE = r"(?d)\A([A-Za-z][^:=\-]{1,80}?)[%s]*[:=\-]+[%s]*(.*)\z" % (WS, WS)

RECORD_COLUMNS = ["doc_id", "pos", "attribute", "value"]


def split_key_value(line: Column | str) -> Column:
    """``struct(attribute, value)`` of a stripped line, null when it is not a key/value line."""
    c = tx.col(line)
    pair = F.struct(
        tx.strip(F.regexp_extract(c, KEY_VALUE_LINE, 1)).alias("attribute"),
        tx.strip(F.regexp_extract(c, KEY_VALUE_LINE, 2)).alias("value"))
    return F.when(c.rlike(KEY_VALUE_LINE), pair)


def key_value_lines(lines: DataFrame, line: str = "line", min_length: int = 3) -> DataFrame:
    """One record per key/value line; header lines go, empty values stay, nothing is deduped."""
    stripped = tx.compute_once(lines, tx.strip(line), "_line").filter(F.length("_line") >= min_length)
    found = tx.compute_once(stripped, split_key_value("_line"), "_pair").filter(
        F.col("_pair").isNotNull() & ~tx.is_header_row("_pair.attribute", "_pair.value"))
    return found.select(*[c for c in lines.columns if c != line], "_pair.attribute", "_pair.value")


def usable(df: DataFrame) -> DataFrame:
    """Records with a name and a value whose name is neither a header word nor a number."""
    a, v = tx.strip("attribute"), tx.strip("value")
    return df.filter((a != "") & (v != "") & ~tx.is_header_row("attribute", "value") & ~tx.is_numeric_only(a))


def usable_pair(p: Column) -> Column:
    """``usable`` for a struct with an attribute and a value."""
    a, v = tx.strip(p["attribute"]), tx.strip(p["value"])
    return (a != "") & (v != "") & ~tx.is_header_row(a, v) & ~tx.is_numeric_only(a)


def name_value_key(p: Column) -> Column:
    """E8 key of a struct: lower-cased name and value."""
    return F.concat(F.lower(tx.strip(p["attribute"])), F.lit("\0"), tx.strip(p["value"]))


def first_places(items: Column, key) -> Column:
    """Places, from 1, of the first item of every key. Equal keys stand together after a sort, so the work grows with
    n log n of the items."""
    def places(keys):
        numbered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        firsts = tx.let(numbered, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"])))
        # Most documents repeat nothing; a set of the keys tells so without the sort.
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.transform(keys, lambda k, i: i + 1)).otherwise(
            F.transform(firsts, lambda x: x["i"] + 1)).cast("array<int>")

    return tx.let(F.transform(items, key), places)


def explode_first(docs: DataFrame, items: str, key) -> DataFrame:
    """E8, T10 for documents held in one row: the first item of every key as a row.

    Duplicates go before the items leave the row, so nothing is shuffled. ``pos`` is the index in the
    array; the fields of the items become columns.
    """
    out = tx.explode_costly(docs.withColumn("_kept", first_places(F.col(items), key)), "_kept", "_at")
    rest = [c for c in docs.columns if c != items]
    picked = out.select(*rest, (F.col("_at") - 1).cast("bigint").alias("pos"), F.get(F.col(items), F.col("_at") - 1).alias("_item"))
    return picked.select(*rest, "pos", "_item.*")


def dedupe_records(df: DataFrame, scope: list[str] | None = None, pos: str = "pos",
                   ignore_value_case: bool = False, also: list[str] | None = None) -> DataFrame:
    """The first record per (scope, lower-cased name, value).

    ``ignore_value_case`` also folds the value (T10); ``also`` adds columns to the key (E1).
    """
    value = tx.strip("value")
    keys = [F.col(c) for c in (scope or ["doc_id"])]
    keys += [F.lower(tx.strip("attribute")), F.lower(value) if ignore_value_case else value]
    keys += [F.col(c) for c in (also or [])]
    return first_per_key(df, keys, pos)


def clean_records(df: DataFrame, scope: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """Usable records, first one per (scope, lower-cased name, value)."""
    return dedupe_records(usable(df), scope, pos)


def broken_table_flags(records: DataFrame, pos: str = "pos", sample: int = 20) -> DataFrame:
    """Per document, whether the first records look like a wrongly cut table.

    The rank filter is applied on the map side too (window group limit), so a document of any size
    sends at most ``sample`` rows per map task.
    """
    attr, val = tx.strip("attribute"), tx.strip("value")
    odd_name = attr.rlike(r"(?U)\A\d+\z") | (F.length(attr) <= 2)
    odd_value = (F.length(val) - F.length(F.replace(val, F.lit("="), F.lit("")))) >= 2
    marked = records.select("doc_id", pos, odd_name.cast("int").alias("odd_name"), odd_value.cast("int").alias("odd_value"))
    order = Window.partitionBy("doc_id").orderBy(pos)
    top = marked.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= sample)
    n = F.count("*")
    least = F.greatest(F.lit(2), F.floor(n / 3))
    return top.groupBy("doc_id").agg(
        n.alias("sampled"), F.sum("odd_name").alias("odd_names"), F.sum("odd_value").alias("odd_values"),
        ((F.sum("odd_name") >= least) | (F.sum("odd_value") >= least)).alias("is_broken"))


def unpivot_table(df: DataFrame, doc_id: Column | str, columns: dict[str, Column] | None = None,
                  strip_prefix: str | None = r"^[a-z]{1,2}_") -> DataFrame:
    """

    ``columns`` maps attribute names to value expressions; by default every column as a string.
    ``pos`` is the column number.
    """
    values = columns or {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    labels = F.array(*[F.lit(c) if strip_prefix is None else F.regexp_replace(F.lit(c), strip_prefix, "") for c in values])
    texts = [F.coalesce(v.cast("string"), F.lit("")).alias(str(i)) for i, v in enumerate(values.values())]
    # Where only the names are asked for, no value is computed or read.
    long = df.select(tx.col(doc_id).alias("doc_id"), *texts).unpivot("doc_id", [str(i) for i in range(len(values))], "_at", "value")
    return long.select("doc_id", F.col("_at").cast("bigint").alias("pos"), F.get(labels, F.col("_at").cast("int")).alias("attribute"), "value")
