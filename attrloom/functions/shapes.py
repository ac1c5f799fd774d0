"""V1-V6: the shapes a value may have, and the guard a canonical name puts on its values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attrloom.functions.text import WS, col, strip

# Patterns of dates, e-mail addresses, amounts and identifiers.
DATE_PATTERNS = (
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}[%s]+[A-Za-z]+[%s]+\d{4}\b" % (WS, WS),
    r"\b[A-Za-z]+[%s]+\d{1,2},[%s]*\d{4}\b" % (WS, WS),
)
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
AMOUNT_PATTERN = r"(?:₹|\$|rs\.?|rupees?|inr|\d)"
ID_PATTERN = r"\b[A-Z]{1,}[A-Z0-9\-]*\d+[A-Z0-9\-]*\b"

# Lower-cased canonical names whose values must have a shape.
GUARDS = {
    "phone number": "phone",
    "email address": "email",
    "order date": "date",
    "requested delivery date": "date",
    "maintenance date": "date",
    "total order value": "amount",
    "shipping cost": "amount",
    "tax amount": "amount",
    "unit price": "amount",
    "order number": "id",
    "invoice number": "id",
    "tracking id": "id",
    "workorder number": "id",
    "equipment id": "id",
    "employee id": "id",
    "serial number": "id",
    "model number": "id",
    "operator id": "id",
}


def is_date(value: Column | str) -> Column:
    return col(value).rlike("(?U)" + "|".join(DATE_PATTERNS))


def is_phone(value: Column | str) -> Column:
    return F.length(F.regexp_replace(col(value), r"(?U)\D", "")).between(10, 15)


def is_email(value: Column | str) -> Column:
    return col(value).rlike(EMAIL_PATTERN)


def is_amount(value: Column | str) -> Column:
    return F.lower(col(value)).rlike("(?U)" + AMOUNT_PATTERN)


def is_id_like(value: Column | str) -> Column:
    return col(value).rlike("(?U)" + ID_PATTERN)


SHAPES = {"phone": is_phone, "email": is_email, "date": is_date, "amount": is_amount, "id": is_id_like}


def guard_kind(canonical: Column | str) -> Column:
    """Shape a canonical name asks of its values; null when any value is welcome."""
    table = F.create_map(*[F.lit(x) for kv in GUARDS.items() for x in kv])
    return F.element_at(table, F.lower(strip(canonical)))


def passes_guard(kind: Column | str, value: Column | str) -> Column:
    """V6: a blank value or an unguarded name passes; otherwise the value must have the shape."""
    v = strip(F.coalesce(col(value), F.lit("")))
    verdict = F.when(col(kind).isNull() | (v == ""), F.lit(True))
    for name, shape in SHAPES.items():
        verdict = verdict.when(col(kind) == name, shape(v))
    return verdict.otherwise(F.lit(True))
