"""Keyed scalars of a JSON text, read token by token from stretches of it.

One expression per token finds brackets, strings and scalars; a stack holds what is open. Nothing of the
document but the open containers is kept, no tree is built and nothing recurses, so neither size nor depth matters.
The module is shipped to the workers by value; they need no copy of the package.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array

BLANKS = " \t\n\r"
TOKEN = re.compile(r'[ \t\n\r]*+(?:([{}\[\],:])|"((?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+)"|(true|false|null)'
                   r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+))")
#: What may follow a number that the end of a stretch has cut.
UNFINISHED = re.compile(r"\.?|[eE][+-]?")
PLAIN = {"true": "True", "false": "False", "null": ""}
#: What may come next.
VALUE, VALUE_OR_END, KEY, KEY_OR_END, COLON, MORE_OR_END, NOTHING = range(7)
STRETCH = 1 << 20


def spoken(inner: str) -> str:
    """The text between the quotes of a JSON string."""
    if "\\" not in inner:
        return inner
    return json.loads(f'"{inner}"')


class LeafReader:
    """Takes a document in stretches and gives its leaves.

    A leaf is ``(number, order, path, value, literal)``: the number counts them in reading order, ``order`` sorts them by path (keys
    as UTF-16, list items by number), and numbers have a ``literal`` instead of a ``value``. Of a key that repeats in an object the last member
    counts; ``dead`` lists the stretches of leaf numbers that fall away for it (keys are compared by 64-bit hash).
    """

    def __init__(self):
        self.rest, self.state, self.failed, self.number = "", VALUE, False, 0
        self.is_object, self.path, self.order, self.blank, self.item = False, "", b"", True, 0
        self.keys, self.starts = array("q"), array("q")
        self.stack: list[tuple] = []
        # What every open container adds to path and order; they are joined only where a leaf needs them.
        self.names: list[str] = []
        self.orders: list[bytes] = []
        self.dead: list[tuple[int, int]] = []

    def _open(self, is_object: bool) -> None:
        name, order, blank = "", b"", True
        if self.stack and self.is_object:
            name, order, blank = self.key if self.blank else f".{self.key}", self._key_order(), self.blank and not self.key
        elif self.stack:
            self.item += 1
            name, order, blank = f"{'item' if self.blank else ''}_{self.item}", self.item.to_bytes(4), False
        self.stack.append((self.is_object, self.path, self.order, self.blank, self.item, self.keys, self.starts))
        self.names.append(name)
        self.orders.append(order)
        self.is_object, self.path, self.order, self.blank, self.item = is_object, None, None, blank, 0
        self.keys, self.starts = array("q"), array("q")
        self.state = KEY_OR_END if is_object else VALUE_OR_END

    def _key_order(self) -> bytes:
        return self.key.encode("utf-16-be", "replace") + b"\0\0"

    def _close(self) -> None:
        if len(self.keys) > 1 and len(set(self.keys)) < len(self.keys):
            last = {key: k for k, key in enumerate(self.keys)}
            ends = [*self.starts[1:], self.number]
            self.dead += [(self.starts[k], ends[k]) for k, key in enumerate(self.keys) if last[key] != k and self.starts[k] < ends[k]]
        self.names.pop()
        self.orders.pop()
        self.is_object, self.path, self.order, self.blank, self.item, self.keys, self.starts = self.stack.pop()
        self.state = MORE_OR_END if self.stack else NOTHING

    def feed(self, text: str, last: bool) -> list[tuple[int, bytes, str, str | None, str | None]]:
        """The leaves that end in the next stretch. After ``last`` the document is whole or has ``failed``."""
        buffer = self.rest + text if self.rest else text
        found, scanner, at, size = [], TOKEN.scanner(buffer), 0, len(buffer)
        while not self.failed:
            token = scanner.match()
            kind = token.lastindex if token else 0
            if not kind or (kind == 4 and not last and size - token.end() < 3 and UNFINISHED.fullmatch(buffer, token.end())):
                break
            at, state = token.end(), self.state
            if kind == 1:
                mark = token[1]
                if mark == ",":
                    self.state = (KEY if self.is_object else VALUE) if state == MORE_OR_END else NOTHING
                    self.failed = state != MORE_OR_END
                elif mark == ":":
                    self.failed, self.state = state != COLON, VALUE
                elif mark in "}]":
                    fits = state in (MORE_OR_END, KEY_OR_END, VALUE_OR_END) and self.stack and self.is_object == (mark == "}")
                    if fits:
                        self._close()
                    self.failed = not fits
                elif state == VALUE or state == VALUE_OR_END:
                    self._open(mark == "{")
                else:
                    self.failed = True
            elif state == VALUE or state == VALUE_OR_END:
                if self.is_object:
                    if self.path is None:
                        self.path, self.order = "".join(self.names), b"".join(self.orders)
                    path = f"{self.path}.{self.key}" if self.path else self.key
                    value = spoken(token[2]) if kind == 2 else PLAIN[token[3]] if kind == 3 else None
                    found.append((self.number, self.order + self._key_order(), path, value, token[4]))
                    self.number += 1
                else:
                    self.item += 1
                self.state = MORE_OR_END if self.stack else NOTHING
            elif kind == 2 and (state == KEY or state == KEY_OR_END):
                self.key = spoken(token[2])
                self.keys.append(hash(self.key))
                self.starts.append(self.number)
                self.state = COLON
            else:
                self.failed = True
        self.rest = buffer[at:]
        if last:
            self.failed = self.failed or self.state != NOTHING or self.rest.strip(BLANKS) != ""
        return found


class Literal(str):
    """A number as it is written."""


def no_number(name: str):
    raise ValueError(name)


def in_order(members: dict) -> list[str]:
    names = sorted(members)
    return names if "".join(names).isascii() else sorted(names, key=lambda k: k.encode("utf-16-be", "replace"))


def parser(number=Literal) -> json.JSONDecoder:
    """The interpreter's parser with numbers as they are written; making one costs as much as a short document."""
    return json.JSONDecoder(parse_float=number, parse_int=number, parse_constant=no_number)


def malformed(text: str | None, parse: json.JSONDecoder) -> bool:
    """Whether a short document has no leaves for ``whole_leaves``; none are made."""
    try:
        parse.decode(text or "")
    except ValueError:
        return True
    except RecursionError:
        reader = LeafReader()
        reader.feed(text, True)
        return reader.failed
    return False


def whole_leaves(text: str | None, parse: json.JSONDecoder | None = None) -> list[tuple[str, str | None, str | None]] | None:
    """``(path, value, literal)`` of a short document's leaves in the order of their paths; None if it is malformed.

    The interpreter's parser makes a tree, which for a short document is small. What nests deeper than it takes goes
    through the reader. ``parse`` is the ``parser`` of a caller with many documents.
    """
    try:
        leaves = []
        walk((parse or parser()).decode(text or ""), "", leaves)
    except ValueError:
        return None
    except RecursionError:
        reader = LeafReader()
        found = reader.feed(text, True)
        gone = {n for start, stop in reader.dead for n in range(start, stop)}
        return None if reader.failed else [x[2:] for x in sorted(found, key=lambda x: x[1]) if x[0] not in gone]
    return leaves


def walk(node, path: str, leaves: list) -> None:
    """Adds the leaves below a node of the parser's tree; scalars in a list and a scalar document are none."""
    if type(node) is dict:
        for key in in_order(node):
            child, at = node[key], f"{path}.{key}" if path else key
            kind = type(child)
            if kind is str:
                leaves.append((at, child, None))
            elif kind is Literal:
                leaves.append((at, None, str(child)))
            elif kind is dict or kind is list:
                walk(child, at, leaves)
            else:
                leaves.append((at, "" if child is None else str(child), None))
    elif type(node) is list:
        for number, child in enumerate(node, 1):
            if type(child) is dict or type(child) is list:
                walk(child, f"{path or 'item'}_{number}", leaves)


#: Boundary between words of a name, and numbers whose text is the text of their value.
HUMP = re.compile("([a-z])([A-Z])")
AS_WRITTEN = re.compile(r"(?!-0$)-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{0,2}[1-9])?")
KNOWN_PATHS = 4096


def friendly(path: str, noise: tuple[str, ...]) -> str:
    """Readable name of an ASCII path."""
    parts = (HUMP.sub(r"\1 \2", p.replace("_", " ").replace("-", " ")).lower().strip() for p in path.strip().split(".") if p.lower() not in noise)
    return " ".join(p for p in parts if p)


def naming(keep, noise: tuple[str, ...], repeats: bool = False):
    """Leaves with names: a function to ``(path, value, literal, name)`` of the leaves with a value and a name that ``keep`` takes.

    None where that is left to Spark: a path is not ASCII or a name repeats. With ``repeats`` the leaves with such a name are
    compared here, unless it has a number that Spark words, and one that repeats the name and value of one before is None in
    the list. A name's verdict is remembered.
    """
    known: dict[str, tuple[str, bool]] = {}

    def named(leaves):
        out, names = [], set()
        for path, value, literal in leaves:
            name = known.get(path)
            if name is None:
                if not path.isascii():
                    return None
                if len(known) >= KNOWN_PATHS:
                    known.clear()
                text = friendly(path, noise)
                name = known[path] = (text, keep(text))
            if name[1] and (value is None or value.strip()):
                if literal is not None and AS_WRITTEN.fullmatch(literal):
                    value, literal = literal, None
                out.append((path, value, literal, name[0]))
                names.add(name[0])
        return out if len(names) == len(out) else first_leaves(out) if repeats else None

    return named


def first_leaves(leaves: list[tuple]) -> list[tuple | None] | None:
    """Named leaves with those left out that repeat the name and value of one before."""
    seen, known, unworded = set(), set(), set()
    out = []
    for leaf in leaves:
        _, value, _, name = leaf
        if name in unworded or (value is None and name in known):
            return None
        if value is None:
            unworded.add(name)
            out.append(leaf)
            continue
        known.add(name)
        key = f"{name}\0{storable(value).strip()}"
        out.append(None if key in seen else leaf)
        seen.add(key)
    return out


def storable(text: str | None) -> str | None:
    """Text without lone surrogates, which have no UTF-8 form."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode()


def stretches(pieces):
    """Text of at least ``STRETCH`` bytes at a time, and whether it is the last."""
    decode, held, size = codecs.getincrementaldecoder("utf-8")("replace").decode, [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= STRETCH:
            yield decode(b"".join(held)), False
            held, size = [], 0
    yield decode(b"".join(held), True), True


def read_pieces(pieces: list[bytes]):
    """Leaves of a document given as pieces of its bytes, in reading order and some at a time; nothing if it is malformed.

    The first reading finds out whether the document is whole and which members repeat, the second gives the leaves.
    """
    def read(reader):
        waiting, need = [], 0
        for text, last in stretches(pieces):
            waiting.append(text)
            need -= len(text)
            if last or need <= 0:
                yield reader.feed("".join(waiting), last)
                # A token longer than a stretch is looked at again only when there is twice as much of it.
                waiting, need = [], len(reader.rest)
            if reader.failed:
                return

    first = LeafReader()
    for _ in read(first):
        pass
    if first.failed:
        return None
    dead = []
    for start, stop in sorted(first.dead):
        if dead and start <= dead[-1][1]:
            dead[-1][1] = max(dead[-1][1], stop)
        else:
            dead.append([start, stop])

    def kept():
        gone = 0
        for found in read(LeafReader()):
            if not dead:
                yield found
                continue
            alive = []
            for leaf in found:
                while gone < len(dead) and dead[gone][1] <= leaf[0]:
                    gone += 1
                if gone == len(dead) or leaf[0] < dead[gone][0]:
                    alive.append(leaf)
            yield alive

    return kept()


def leaf_lists(documents: list[list]):
    """Arrow lists of ``(pos, path, value, literal, name)`` from the leaves ``(path, value, literal, name)`` of each document.

    ``pos`` is a leaf's place in its document; those left out are None.
    """
    import pyarrow as pa

    ends, places, rows = [0], [], []
    for leaves in documents:
        if None in leaves:
            places += [pos for pos, leaf in enumerate(leaves) if leaf is not None]
            rows += [leaf for leaf in leaves if leaf is not None]
        else:
            places += range(len(leaves))
            rows += leaves
        ends.append(len(rows))
    columns = [pa.array(places, pa.int64()), *(pa.array([x[k] for x in rows], pa.string()) for k in range(4))]
    items = pa.StructArray.from_arrays(columns, names=["pos", "path", "value", "literal", "name"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


def malformed_ids(batches: Iterator) -> Iterator:
    """Ids of malformed whole texts."""
    import pyarrow as pa

    # Nothing is made of a number.
    parse = parser(str)
    for batch in batches:
        bad = [malformed(text, parse) for text in batch.column("text").to_pylist()]
        yield batch.select(["doc_id"]).filter(pa.array(bad, pa.bool_()))
