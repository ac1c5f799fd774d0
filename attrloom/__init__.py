"""Attribute-name standardization as Spark jobs.

Semi-structured and free-text documents become attribute/value records, every raw attribute name
is mapped to a canonical name from a dictionary, and per-document match reports come out.
"""

from attrloom.operators.matching import match_names
from attrloom.plans.normalize import normalize_records
from attrloom.session import configure
from attrloom.sources.dictionary import Dictionary, load_dictionary

__all__ = ["Dictionary", "configure", "load_dictionary", "match_names", "normalize_records"]
