"""Attributes and element texts of XML texts, applied to Arrow batches.

The module is shipped to the workers by value; they need no copy of the package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from attrloom.functions.jsonleaves import leaf_lists, naming


def roots(batch) -> Iterator:
    """Root and error of every text, one of which is None."""
    import xml.etree.ElementTree as ET

    for text in batch.column("text").to_pylist():
        try:
            found = ET.fromstring(text or ""), None
        except ET.ParseError as problem:
            found = None, str(problem)
        yield found


def leaves(root) -> list[tuple[str, str, None]]:
    """``(path, value, None)`` in reading order: the attributes of an element, its text, its children."""
    found, stack = [], [(root, root.tag)]
    while stack:
        node, path = stack.pop()
        found += [(f"{path}.{key}", value, None) for key, value in node.attrib.items()]
        text = node.text and node.text.strip()
        if text:
            found.append((path, text, None))
        stack.extend((child, f"{path}.{child.tag}") for child in reversed(node))
    return found


def leaf_reader(keep: Callable | None = None, noise: tuple[str, ...] = ()) -> Callable[[Iterator], Iterator]:
    """A batch function: leaves and errors of texts; with ``keep`` the leaves of a plain document are named and filtered."""
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        named = naming(keep, noise, repeats=True) if keep else lambda found: None
        for batch in batches:
            documents, plain, errors = [], [], []
            for root, error in roots(batch):
                found = () if root is None else leaves(root)
                ready = named(found)
                documents.append([(*x, None) for x in found] if ready is None else ready)
                plain.append(ready is not None)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), leaf_lists(documents), pa.array(plain, pa.bool_()), pa.array(errors, pa.string())],
                                             names=["doc_id", "leaves", "plain", "error"])

    return read


def unreadable(batches: Iterator) -> Iterator:
    """Ids and errors of the texts that cannot be parsed."""
    import pyarrow as pa

    for batch in batches:
        errors = pa.array([error for _, error in roots(batch)], pa.string())
        found = pa.RecordBatch.from_arrays([batch.column("doc_id"), errors], names=["doc_id", "error"])
        yield found.filter(errors.is_valid())
