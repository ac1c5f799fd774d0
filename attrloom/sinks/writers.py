"""K1-K5: output projections and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrloom.functions import text as tx
from attrloom.operators.lookups import join_per_key
from attrloom.session import materialize

CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
ENGINE_COLUMNS = ("doc_id", "sheet", "pos", "extras", "raw_attr", "canonical_attr", "match_type", "confidence",
                  "matched_variation")


def extra_columns(records: DataFrame) -> list[str]:
    """Names of the extra source columns, in header order, for callers that want each as a column of
    its own. The names come to the driver, as every plan's columns do."""
    keys = records.select(F.posexplode(F.map_keys("extras")).alias("at", "key")).groupBy("key").agg(F.min("at").alias("at"))
    return [r["key"] for r in keys.orderBy("at", "key").collect()]


def output_projection(records: DataFrame, extras: list[str] | None = None) -> DataFrame:
    """K1: ``Output Attribute`` and ``Value`` first, then the remaining source columns.

    ``extras`` lists the extra source columns to spread out; without it they stay one map column, however
    many there are.
    """
    lead = [F.col("attribute").alias("Output Attribute"), F.col("value").alias("Value")]
    plain = [c for c in records.columns if c not in ("attribute", "value", *ENGINE_COLUMNS)]
    rest = [F.col(f"`{c}`") for c in plain]
    if "extras" in records.columns:
        names = [] if extras is None else extras
        rest += [F.col("extras")] if extras is None else []
        rest += [F.element_at("extras", F.lit(n)).alias(n) for n in names if n not in ("attribute", "value")]
    return records.select(*lead, *rest)


def _placed(table: DataFrame, keys: list[str], folders: bool):
    """A writer of rows ordered by ``keys``: a fixed number of files with the keys as columns, which holds any
    number of documents and splits a large one between files. ``folders`` gives every value of the first key
    a folder instead, for few documents with short names."""
    if folders:
        return table.sortWithinPartitions(*keys).drop(*keys[1:]).write.partitionBy(keys[0])
    return table.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys[1:]).write


def write_csv(records: DataFrame, path: str, keep: list[str] | None = None, folders: bool = False) -> None:
    """K2: K1 as CSV with a header and the document; ``keep`` lists extra source columns, else none is written."""
    out = output_projection(records, keep or []).columns
    projected = records.select("doc_id", F.col("pos").alias("_pos"), *output_projection_columns(records, out))
    _placed(projected, ["doc_id", "_pos"], folders).csv(path, **CSV_OPTIONS)


def output_projection_columns(records: DataFrame, names: list[str]) -> list[Column]:
    known = {"Output Attribute": F.col("attribute"), "Value": F.col("value")}
    return [known.get(n, F.col(f"`{n}`") if n in records.columns else F.element_at("extras", F.lit(n))).alias(n) for n in names]


def json_documents(records: DataFrame, pos: str = "pos") -> DataFrame:
    """K3: one JSON array of attribute/value objects per document, in record order."""
    item = F.struct(F.coalesce("attribute", F.lit("")).alias("attribute"), F.coalesce("value", F.lit("")).alias("value"))
    gathered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), item.alias("item"))))
    docs = records.groupBy("doc_id").agg(gathered.alias("rows"))
    return docs.select("doc_id", F.to_json(F.transform("rows", lambda r: r["item"])).alias("json"))


def write_json(records: DataFrame, path: str, folders: bool = False) -> None:
    """K3 for documents of any size: one attribute/value object per line, with its document, in order."""
    lines = records.select("doc_id", F.col("pos").alias("_pos"), F.coalesce("attribute", F.lit("")).alias("attribute"),
                           F.coalesce("value", F.lit("")).alias("value"))
    _placed(lines, ["doc_id", "_pos"], folders).json(path)


def _escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_tag(part: Column | str) -> Column:
    """K4: lower-cased name with underscores, made a legal XML name (Q9)."""
    safe = F.regexp_replace(F.lower(tx.col(part)), "[^a-z0-9_.-]", "_")
    return F.when(safe.rlike("^[a-z_]"), safe).otherwise(F.concat(F.lit("_"), safe))


XML_HEAD = "<?xml version='1.0' encoding='utf-8'?>\n<normalized_records>"
XML_FOOT = "</normalized_records>"


def _xml_rows(records: DataFrame, pos: str) -> DataFrame:
    """Every record as an element, with the tags of its parents."""
    named = records.select("doc_id", F.col(pos).alias("pos"), tx.strip("attribute").alias("_a"), tx.strip(F.coalesce("value", F.lit(""))).alias("_v"))
    named = named.filter(F.col("_a") != "").withColumn("_tags", F.transform(F.split("_a", r"\."), xml_tag))
    leaf = F.element_at("_tags", -1)
    element = F.concat(F.lit("<"), leaf, F.lit(">"), _escape(F.col("_v")), F.lit("</"), leaf, F.lit(">"))
    return named.select("doc_id", "pos", element.alias("piece"), F.slice("_tags", F.lit(1), F.size("_tags") - 1).alias("parents"))


def _xml_tags(tags: Column, mark: str) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit(mark), t, F.lit(">"))), "")


def xml_pieces(records: DataFrame, pos: str = "pos") -> DataFrame:
    """K4 as ordered pieces ``(doc_id, place, piece)``; dots in a name nest elements.

    Records under the same parents stand together, at the place of the first of them. Head, foot and
    the tags around a group are pieces of their own, so no document is gathered anywhere. The rendered
    records are stored once, since every kind of piece reads them.
    """
    place = lambda part, group, step, no: F.struct(
        F.lit(part).alias("part"), group.cast("bigint").alias("group"), F.lit(step).alias("step"), no.cast("bigint").alias("no")).alias("place")
    zero = F.lit(0)
    rows = materialize(_xml_rows(records, pos), "xml-rows")

    flat = rows.filter(F.size("parents") == 0).select("doc_id", place(1, F.col("pos"), 1, zero), "piece")
    inner = rows.filter(F.size("parents") > 0)
    groups = inner.groupBy("doc_id", "parents").agg(F.min("pos").alias("first"), F.count("*").alias("_n"))
    members = join_per_key(inner, groups, ["doc_id", "parents"], "_n").select("doc_id", place(1, F.col("first"), 1, F.col("pos")), "piece")
    opened = groups.select("doc_id", place(1, F.col("first"), 0, zero), _xml_tags(F.col("parents"), "<").alias("piece"))
    closed = groups.select("doc_id", place(1, F.col("first"), 2, zero), _xml_tags(F.reverse("parents"), "</").alias("piece"))
    docs = rows.select("doc_id").distinct()
    head = docs.select("doc_id", place(0, zero, 0, zero), F.lit(XML_HEAD).alias("piece"))
    foot = docs.select("doc_id", place(2, zero, 0, zero), F.lit(XML_FOOT).alias("piece"))
    return head.union(flat).union(opened).union(members).union(closed).union(foot)


def xml_documents(records: DataFrame, pos: str = "pos") -> DataFrame:
    """K4: one XML text per document, for documents that fit a cell.

    Records under the same parents are gathered first, then the groups of a document: two aggregates, nothing is stored
    or joined. A record without parents is a group of its own.
    """
    members = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    groups = _xml_rows(records, pos).groupBy("doc_id", "parents").agg(F.min("pos").alias("first"), members.alias("members"))
    text = F.concat(_xml_tags(F.col("parents"), "<"), F.array_join(F.col("members.piece"), ""), _xml_tags(F.reverse("parents"), "</"))
    inner = F.array(F.struct(F.col("first").alias("pos"), text.alias("piece")))
    items = F.when(F.size("parents") == 0, F.col("members")).otherwise(inner)
    whole = F.array_sort(F.flatten(F.collect_list("_items")))
    return groups.select("doc_id", items.alias("_items")).groupBy("doc_id").agg(whole.alias("_p")).select(
        "doc_id", F.concat(F.lit(XML_HEAD), F.array_join(F.col("_p.piece"), ""), F.lit(XML_FOOT)).alias("xml"))


def write_xml(records: DataFrame, path: str, folders: bool = False) -> None:
    """K4 for documents of any size: the pieces of each document's XML text in order, as JSON lines of
    document and piece. A range partitioning splits a large document between files at a piece. With
    ``folders`` every document gets a folder whose text files in name order are its XML text."""
    pieces = xml_pieces(records)
    if not folders:
        _placed(pieces, ["doc_id", "place"], False).json(path)
        return
    ordered = pieces.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    ordered.select("doc_id", "piece").write.partitionBy("doc_id").text(path)


def sheet_name(c: Column | str) -> Column:
    """K5: sheet names hold at most 31 characters."""
    return F.substring(tx.col(c), 1, 31)


def write_tabular(records: DataFrame, path: str, sheet: str = "sheet", extras: list[str] | None = None, folders: bool = False) -> None:
    """K5: K1 with the cut sheet name, rows of a sheet together and in order."""
    names = output_projection(records, extras or []).columns
    rows = records.select(sheet_name(sheet).alias("sheet_name"), F.col("doc_id").alias("_doc"), F.col("pos").alias("_pos"), *output_projection_columns(records, names))
    _placed(rows, ["sheet_name", "_doc", "_pos"], folders).csv(path, **CSV_OPTIONS)


def column_widths(table: DataFrame, keys: list[str] | None = None, padding: int = 4, widest: int = 45) -> DataFrame:
    """K5: display width per column: longest text or header plus padding, bounded."""
    keys = keys or []
    names = [c for c in table.columns if c not in keys]
    longest = [F.struct(F.lit(c).alias("column"), F.greatest(
        F.lit(len(c)), F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0))).alias("w")) for c in names]
    out = table.groupBy(*keys).agg(F.array(*longest).alias("cols")).select(*keys, F.inline("cols"))
    return out.select(*keys, "column", F.least(F.col("w") + padding, F.lit(widest)).alias("width"))
