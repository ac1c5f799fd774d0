"""One plan from documents of any format to normalized records, a document table and an error table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrloom.operators.lookups import if_few
from attrloom.operators.nested import unparsable_json, unparsable_xml
from attrloom.plans import documents as dc
from attrloom.plans.normalize import normalize_records
from attrloom.session import materialize
from attrloom.sources.dictionary import Dictionary
from attrloom.sources.files import file_format

RECORD = ("doc_id", "sheet", "pos", "attribute", "value", "extras")


@dataclass
class DocumentInputs:
    """What the readers give. ``paths(doc_id, path)`` names every document; the others hold the extracted
    cells, rows, lines and texts of those formats that have them, and may be left out."""

    paths: DataFrame
    grid: DataFrame | None = None
    rows: DataFrame | None = None
    lines: DataFrame | None = None
    texts: DataFrame | None = None


def _shaped(records: DataFrame) -> DataFrame:
    kinds = {"sheet": "string", "extras": "map<string,string>"}
    have = records.columns
    return records.select(*[F.col(c) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in RECORD])


def _by_format(table: DataFrame, named: DataFrame, formats: tuple[str, ...], label: str) -> Callable[[str], DataFrame]:
    """The rows of documents of ``formats``, joined with their formats and written once; a function to those of one format.

    A document named with several formats is in each of them, and lies in a part of its own for their combination.
    """
    bits = {fmt: 1 << k for k, fmt in enumerate(formats)}
    bit = F.element_at(F.create_map(*[F.lit(x) for kv in bits.items() for x in kv]), F.col("input_format"))
    ids = materialize(named.filter(F.col("input_format").isin(*formats)).groupBy("doc_id").agg(F.bit_or(bit).alias("_formats")), "ids")
    of_formats = table.join(if_few(ids), "doc_id")
    stored = materialize(of_formats, label, apart="_formats")
    return lambda fmt: stored.filter(F.col("_formats").bitwiseAND(F.lit(bits[fmt])) != 0).drop("_formats")


def document_records(inputs: DocumentInputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, documents and errors of all documents, each read by the plan of its format.

    The format comes from the suffix. A document of an unknown format, one whose text cannot be parsed, and
    one that was named but has no cells, rows, lines or text are rows of ``errors(doc_id, input_format,
    error)``; they neither fail the job nor pass as documents without records.
    """
    named = materialize(inputs.paths.select("doc_id", file_format("path", strict=False).alias("input_format")), "formats")

    records, docs, unreadable = [], [], []

    def take(got: tuple[DataFrame, DataFrame]) -> None:
        records.append(_shaped(got[0]))
        docs.append(got[1])

    if inputs.grid is not None:
        of = _by_format(inputs.grid, named, ("excel", "csv"), "grid")
        take(dc.excel_records(of("excel")))
        take(dc.csv_records(of("csv")))
    if inputs.rows is not None and inputs.lines is not None:
        rows_of, lines_of = (_by_format(table, named, ("pdf", "docx"), label) for table, label in ((inputs.rows, "rows"), (inputs.lines, "lines")))
        for fmt, plan, text in (("pdf", dc.pdf_records, lambda r, ln: dc.pdf_text(ln)), ("docx", dc.docx_records, dc.docx_text)):
            rows, lines = rows_of(fmt), lines_of(fmt)

            def texts(ids, rows=rows, lines=lines, text=text):
                return text(rows.join(ids, "doc_id", "left_semi"), lines.join(ids, "doc_id", "left_semi"))

            verdict = dc.line_verdicts(lines)
            take(dc.route_lines(*plan(rows, lines, verdict), texts, lines, verdict))
    if inputs.texts is not None:
        of = _by_format(inputs.texts, named, ("json", "xml"), "texts")
        for fmt, plan, broken in (("json", dc.json_records, unparsable_json), ("xml", dc.xml_records, unparsable_xml)):
            texts = of(fmt)
            bad = materialize(broken(texts).select("doc_id", F.lit(fmt).alias("input_format"), "error"), "unreadable")
            unreadable.append(bad)
            take(plan(texts.join(if_few(bad.select("doc_id")), "doc_id", "left_anti")))

    errors = [*unreadable, named.filter("input_format IS NULL").withColumn("error", F.lit("unknown format"))]
    missing = named.filter("input_format IS NOT NULL")
    # A document with cells, rows, lines or a text is among the documents or the unreadable ones.
    if docs:
        missing = missing.join(reduce(DataFrame.union, [read.select("doc_id") for read in [*docs, *unreadable]]).distinct(), "doc_id", "left_anti")
    errors.append(missing.withColumn("error", F.lit("nothing was read")))
    union = lambda frames: None if not frames else frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    spark = inputs.paths.sparkSession
    id_type = named.schema["doc_id"].dataType.simpleString()
    none = spark.createDataFrame([], f"doc_id {id_type}, sheet string, pos long, attribute string, value string, extras map<string,string>")
    no_docs = spark.createDataFrame([], f"doc_id {id_type}, input_format string, doc_type string, n_records long")
    return (union(records) if records else none), (union(docs) if docs else no_docs), union(errors)


def normalize_documents(inputs: DocumentInputs, dictionary: Dictionary, **settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalized records, documents and errors; ``settings`` go to ``normalize_records``."""
    records, docs, errors = document_records(inputs)
    return normalize_records(records, dictionary, **settings), docs, errors
