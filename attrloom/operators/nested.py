"""Nested documents to records."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrloom.functions import jsonleaves, textrules, xmlleaves
from attrloom.functions import text as tx
from attrloom.operators.lookups import first_per_key
from attrloom.operators.records import first_places, name_value_key, usable_pair

# The readers go to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(jsonleaves)
cloudpickle.register_pickle_by_value(textrules)
cloudpickle.register_pickle_by_value(xmlleaves)

# An array of objects inside other text, and the keys that may hold the list.
JSON_ARRAY = r"(?s)\[[%s]*\{.*\}[%s]*\]" % (tx.WS, tx.WS)
LIST_KEYS = ("records", "items", "data", "attributes")
BEGINS_WITH_LETTER = r"\A[ \t\r\n]*[A-Za-z]"


def scalar_text(v: Column, null_text: str = "") -> Column:
    """Text of a JSON scalar: booleans capitalised, whole decimals with ``.0``."""
    return _worded(F.schema_of_variant(v), F.try_variant_get(v, "$", "string"), null_text)


def _worded(kind: Column, plain: Column, null_text: str) -> Column:
    """``scalar_text`` of a scalar's schema and plain text."""
    short = F.regexp_replace(plain, r"\.0E", "E")
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        short, r"E-(\d)$", "e-0$1"), r"E-", "e-"), r"E(\d+)$", "e+$1")
    fraction = kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT")
    return (F.when(kind == "VOID", F.lit(null_text))
            .when(kind == "BOOLEAN", F.initcap(plain))
            .when(fraction & plain.contains("E"), exponent)
            .when(fraction & ~plain.contains("."), F.concat(plain, F.lit(".0")))
            .otherwise(plain))


LEAF = "array<struct<attribute:string,value:string,raw_attribute:string>>"


# Bytes from which on a document is read in pieces, and bytes of a piece.
PIECED_BYTES = 64 << 10
PIECE_BYTES = 16 << 10

_ITEM = "array<struct<pos:bigint,path:string,value:string,literal:string,name:string>>"


def _short_reader(keep, noise: tuple[str, ...]):
    """Leaves of whole texts, named and filtered where a document is plain; null where a text is malformed."""
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        storable, named, parse = jsonleaves.storable, jsonleaves.naming(keep, noise), jsonleaves.parser()
        for batch in batches:
            documents, bad, plain = [], [], []
            for text in batch.column("text").to_pylist():
                found = jsonleaves.whole_leaves(text, parse)
                bad.append(found is None)
                ready = named(found or ())
                plain.append(ready is not None)
                leaves = [(*x, None) for x in found or ()] if ready is None else ready
                # Only an escape makes a lone surrogate.
                documents.append(leaves if not leaves or "\\u" not in text else [tuple(map(storable, x)) for x in leaves])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), jsonleaves.leaf_lists(documents), pa.array(plain, pa.bool_()), pa.array(bad, pa.bool_())],
                                             names=["doc_id", "leaves", "plain", "malformed"])

    return read


def _piece_reader(batches: Iterator) -> Iterator:
    """Leaves of texts that come in pieces, as rows; one row without a path says that a text is malformed."""
    import pyarrow as pa

    names = ["doc_id", "_row", "order", "path", "value", "literal"]

    def rows(key, leaves):
        doc, row = key
        clean = jsonleaves.storable
        columns = [[x[1] for x in leaves], *([clean(x[k]) for x in leaves] for k in (2, 3, 4))]
        arrays = [pa.array([doc] * len(leaves), id_type), pa.array([row] * len(leaves), pa.int64()), pa.array(columns[0], pa.binary()),
                  *(pa.array(c, pa.string()) for c in columns[1:])]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def read(key, pieces):
        found = jsonleaves.read_pieces(pieces)
        if found is None:
            yield rows(key, [(0, b"", None, None, None)])
        else:
            yield from (rows(key, leaves) for leaves in found if leaves)

    held, pieces, id_type = None, [], None
    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for doc, row, piece in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_row", "piece")), strict=True):
            if held != (doc, row):
                if held is not None:
                    yield from read(held, pieces)
                held, pieces = (doc, row), []
            pieces.append(piece)
    if held is not None:
        yield from read(held, pieces)


def _sized(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Short and long documents."""
    size = F.coalesce(F.octet_length(tx.col(text)), F.lit(0))
    slim = docs.select("doc_id", tx.col(text).alias("text"), (size >= PIECED_BYTES).alias("_long"))
    return slim.filter("NOT _long").drop("_long"), slim.filter("_long").drop("_long")


def _short_leaves(docs: DataFrame, strip_headers: bool = True) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keep = textrules.usable_name if strip_headers else lambda name: name.strip() != ""
    return docs.mapInArrow(_short_reader(keep, tx.PATH_NOISE), f"doc_id {id_type}, leaves {_ITEM}, plain boolean, malformed boolean")


def _long_leaves(docs: DataFrame) -> DataFrame:
    """Narrow: a document's pieces follow each other in the task that has read it."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # The bytes are made once for a document; a piece copies no more than itself and no row holds them all again.
    raw = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.col("text").cast("binary").alias("raw"))
    starts = F.sequence(F.lit(1), F.length("raw"), F.lit(PIECE_BYTES))
    pieces = raw.select("doc_id", "_row", "raw", F.explode(starts).alias("at"))
    return (pieces.select("doc_id", "_row", F.substring("raw", F.col("at"), F.lit(PIECE_BYTES)).alias("piece"))
            .mapInArrow(_piece_reader, f"doc_id {id_type}, _row long, order binary, path string, value string, literal string"))


def _leaf(path: Column, value: Column, literal: Column) -> Column:
    """A record of a leaf; numbers are worded as the values of a variant are."""
    return F.struct(tx.friendly_name(path).alias("attribute"),
                    F.coalesce(value, scalar_text(F.try_parse_json(literal)), literal).alias("value"), path.alias("raw_attribute"))


def _named_items(held: DataFrame, keep) -> DataFrame:
    """The leaves of documents in rows ``(doc_id, leaves, plain)`` as rows ``x``, the first of each name and value."""
    def firsts(leaves: Column) -> Column:
        item = lambda n, at: F.struct(at.cast("bigint").alias("pos"), n["raw_attribute"].alias("path"), n["value"].alias("value"),
                                      F.lit(None).cast("string").alias("literal"), n["attribute"].alias("name"))
        return F.transform(first_places(leaves, name_value_key), lambda at: item(F.get(leaves, at - 1), at - 1)).cast(_ITEM)

    # What the reader has left to Spark is named here, and its repeats fall away.
    odd = F.filter(F.transform("leaves", lambda n: _leaf(n["path"], n["value"], n["literal"])).cast(LEAF), keep)
    return tx.explode_costly(held, F.when(F.col("plain"), F.col("leaves")).otherwise(tx.let(odd, firsts)), "x")


def flatten_json(docs: DataFrame, text: str = "text", strip_headers: bool = True) -> DataFrame:
    """Records of JSON documents, friendly names, first (name, value) per document.

    A short document becomes a row with its leaves; the reader names and filters them unless a path is not ASCII or a name
    repeats, which Spark does inside the row. A long one, of up to what a cell
    holds and of any depth, is read in pieces; its leaves are rows, which Spark numbers by path and reduces. Malformed
    documents give nothing and are listed by ``unparsable_json``.
    """
    filled = lambda p: (tx.strip(p["attribute"]) != "") & (tx.strip(p["value"]) != "")
    keep = usable_pair if strip_headers else filled
    short, long = _sized(docs, text)
    held = _short_leaves(short, strip_headers).filter("NOT malformed")

    parsed = _named_items(held, keep).select("doc_id", "x.*", F.try_parse_json("x.literal").alias("_number"))
    from_short = parsed.select("doc_id", "pos", F.col("name").alias("attribute"), F.coalesce("value", scalar_text(F.col("_number")), "literal").alias("value"),
                               F.col("path").alias("raw_attribute"))
    rows = _long_leaves(long).filter("path IS NOT NULL").select(
        "doc_id", "_row", "order", _leaf(F.col("path"), F.col("value"), F.col("literal")).alias("leaf"))
    numbered = rows.filter(keep(F.col("leaf"))).withColumn(
        "pos", F.row_number().over(Window.partitionBy("doc_id", "_row").orderBy("order")).cast("bigint") - 1)
    first = first_per_key(numbered.select("doc_id", "_row", "pos", "leaf.*"), [F.col("doc_id"), F.col("_row"), name_value_key(F.struct("attribute", "value"))], "pos")
    return from_short.unionByName(first.drop("_row"))


def unparsable_json(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents S3 cannot read, with the reason as ``error``. Empty and null texts are malformed too."""
    short, long = _sized(docs, text)
    bad = short.mapInArrow(jsonleaves.malformed_ids, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}").unionByName(
        _long_leaves(long).filter("path IS NULL").select("doc_id"))
    return docs.join(bad.distinct(), "doc_id", "left_semi").withColumn("error", F.lit("malformed"))


def _read_xml(docs: DataFrame, text: str, reader, columns: str = "") -> DataFrame:
    slim = docs.select("doc_id", tx.col(text).alias("text"))
    return slim.mapInArrow(reader, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {columns}error string")


def xml_leaves(docs: DataFrame, text: str = "text") -> DataFrame:
    """Attributes and element texts of every document in reading order; ``error`` for unreadable ones.

    Parsing one document is the only step Spark has no typed-as-text operator for, so it runs in an
    Arrow batch function; everything after it is built from DataFrame operators.
    """
    found = _read_xml(docs, text, xmlleaves.leaf_reader(), f"leaves {_ITEM}, plain boolean, ")
    return found.select("doc_id", F.transform("leaves", lambda n: F.struct(n["path"].alias("raw_attribute"), n["value"].alias("value"))).alias("leaves"), "error")


def flatten_xml(docs: DataFrame, text: str = "text") -> DataFrame:
    """Records of XML documents, friendly names, first (name, value) per document.

    The reader names and filters the leaves unless a path is not ASCII, which Spark does inside the row.
    """
    read = _read_xml(docs, text, xmlleaves.leaf_reader(textrules.usable_name, tx.PATH_NOISE), f"leaves {_ITEM}, plain boolean, ")
    return _named_items(read.filter(F.col("error").isNull()), usable_pair).select(
        "doc_id", "x.pos", F.col("x.name").alias("attribute"), "x.value", F.col("x.path").alias("raw_attribute"))


def unparsable_xml(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents S4 cannot read, with the reason."""
    return _read_xml(docs, text, xmlleaves.unreadable)


def salvage_list(text: Column | str) -> Column:
    """The list a model response holds: the whole text, a list under a known key, or the first
    bracketed run of objects.

    Every text is parsed once, and one that begins with a letter, which holds no list as a whole, not at all: a
    malformed text costs an exception each time it is parsed.
    """
    c = tx.col(text)
    whole = F.try_parse_json(F.when(~c.rlike(BEGINS_WITH_LETTER), c))
    as_list = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    found = tx.let(F.regexp_extract(c, JSON_ARRAY, 0), lambda f: as_list(F.try_parse_json(F.when(f != "", f)), "$"))
    return F.coalesce(tx.let(whole, lambda w: F.coalesce(as_list(w, "$"), *[as_list(w, f"$.{k}") for k in LIST_KEYS])), found)


def salvaged_records(responses: DataFrame, text: str = "response") -> DataFrame:
    """One record per salvaged object with a name and a value."""
    rest = [c for c in responses.columns if c != text]

    def member(item: Column, key: str) -> Column:
        def worded(value: Column) -> Column:
            parts = F.struct(F.schema_of_variant(value).alias("kind"), F.try_variant_get(value, "$", "string").alias("plain"))
            return F.when(value.isNull(), F.lit("")).otherwise(tx.let(parts, lambda p: tx.strip(_worded(p["kind"], p["plain"], "None"))))
        return tx.let(F.try_variant_get(item, f"$.{key}", "variant"), worded)

    # An item that is no object has no member, so its name is empty. Names and values are made inside the row: a filter
    # over them behind the explode would be pushed below and make them twice.
    named = F.transform(salvage_list(text), lambda item: F.struct(
        member(item, "attribute").alias("attribute"), member(item, "value").alias("value")))
    items = tx.explode_costly(responses, named, "item", "pos")
    found = items.select(*[F.col(f"`{c}`") for c in rest], F.col("pos").cast("bigint").alias("pos"), "item.attribute", "item.value")
    return found.filter((F.col("attribute") != "") & (F.col("value") != ""))
