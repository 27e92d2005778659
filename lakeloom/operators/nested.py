"""Deeply nested JSON records as related flat tables.

Objects get Merkle identities: each is written canonically with its child objects replaced by their hashes, from the
innermost outwards, and that text is hashed. Equal subtrees so have one identity whatever record they come from. Three
written tables hold all: `objects` has each distinct object once; `bridge` has, once for each distinct document (the identity of
its root), every occurrence of an object with its parent occurrence, the key and the ordinal under that key;
`deliveries` says which record delivered which document. Sections, links and documents are joins of the three: places in a document
follow from the parents and ordinals of the bridge.

Defined results: a null payload and one that is no JSON (`NaN` and `Infinity` are none) give no rows; any depth is read; a scalar
or list at the top is the root, without fields; for a key given twice the last value holds; a string that holds a JSON object or
array counts as that value; a number of any length is a number, never equal to a string of its digits; equal deliveries count
once, unlike ones of one record are told apart by `document_hash`. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import join_one, materialize

SECTION_KEYS = ("sections", "children")
#: What may be read from an object besides its canonical text.
FIELDS = ("heading", "content", "href", "text", "title", "link")
NODE_SCHEMA = "raw_id bigint, document_hash string, occ int, parent_occ int, key string, ordinal int, object_hash string, is_section boolean, body string, " + ", ".join(f"{f} string" for f in FIELDS)
#: Documents a task remembers to have sent.
REMEMBERED = 200_000


class _Digits(str):
    """A whole number too long to be an int."""


def _no_constant(name: str):
    raise ValueError(name)


def _int(token: str):
    return int(token) if len(token) < 4000 else _Digits(token)


_decoder = json.JSONDecoder(parse_constant=_no_constant, parse_int=_int, strict=True)
_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?|true|false|null", re.ASCII)
_NAMED = {"true": True, "false": False, "null": None}


def _parse_deep(s: str):
    """The value of a JSON text nested too deeply for the recursive parser."""
    skip = lambda i: _SPACE.match(s, i).end()

    def key_at(i: int) -> tuple[str, int]:
        if s[i : i + 1] != '"':
            raise ValueError("a key is missing")
        k, i = scanstring(s, i + 1, True)
        i = skip(i)
        if s[i : i + 1] != ":":
            raise ValueError("a colon is missing")
        return k, skip(i + 1)

    around: list[tuple] = []
    i = skip(0)
    while True:
        c = s[i : i + 1]
        if c and c in "{[":
            i = skip(i + 1)
            empty = s[i : i + 1] == ("}" if c == "{" else "]")
            if not empty:
                key = None
                if c == "{":
                    key, i = key_at(i)
                around.append(({} if c == "{" else [], key))
                continue
            value, i = {} if c == "{" else [], i + 1
        elif c == '"':
            value, i = scanstring(s, i + 1, True)
        else:
            m = _SCALAR.match(s, i)
            if not m:
                raise ValueError("a value is missing")
            value, i = _NAMED[m[0]] if m[0] in _NAMED else _int(m[1]) if not m[2] and not m[3] else float(m[0]), m.end()
        while True:  # a value has ended
            i = skip(i)
            if not around:
                if i < len(s):
                    raise ValueError("more follows")
                return value
            box, key = around.pop()
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            c = s[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if isinstance(box, dict):
                    key, i = key_at(i)
                around.append((box, key))
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("a bracket is missing")
            value, i = box, i + 1


def _parse(text: str):
    """(ok, value)."""
    try:
        try:
            return True, _decoder.decode(text)
        except RecursionError:
            return True, _parse_deep(text)
    except ValueError:
        return False, None


def _open(value):
    """A string holding an object or array, as that value; encoded more than once too."""
    seen = value
    while isinstance(seen, str) and (head := seen.lstrip()[:1]) and head in '{["':
        ok, inner = _parse(seen)
        if not ok:
            return value
        seen = inner
    return seen if isinstance(seen, (dict, list)) else value


def _text(value) -> str | None:
    """Readable text of a heading or content in any of its shapes."""
    if isinstance(value, str):
        return str(value)
    parts, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo.append(x.get("text"))
        elif isinstance(x, list):
            todo.extend(reversed(x))
        elif x is not None and not isinstance(x, bool) and x != "":
            parts.append(str(x))
    return "\n".join(parts) if parts else None


def written(value, identity: dict[int, str]) -> str:
    """A value canonically, objects as references."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, tuple):
            out.append(v[0])
        elif isinstance(v, dict):
            out.append('{"$ref":"' + identity[id(v)] + '"}')
        elif isinstance(v, list):
            out.append("[")
            todo.append(("]",))
            for i in range(len(v) - 1, -1, -1):
                todo.append(v[i])
                if i:
                    todo.append((",",))
        else:
            out.append(str(v) if isinstance(v, _Digits) else json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _hash(body: str) -> str:
    return hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def shred_payload(payload: str | None) -> list[dict] | None:
    """The root and every object of one payload, parents before children; None if it is no JSON."""
    if payload is None:
        return None
    ok, root = _parse(payload)
    if not ok:
        return None
    root = _open(root)
    nodes: list[dict] = []
    if not isinstance(root, dict):
        nodes.append({"value": root, "parent": None, "key": None, "ordinal": 0, "section": False})
    # value, parent's number, key, ordinal under the key, is it a section
    todo = [(root, 0 if nodes else None, None, 0, False)]
    while todo:
        value, parent, key, ordinal, section = todo.pop()
        down = []
        if isinstance(value, dict):
            me = len(nodes)
            nodes.append({"value": value, "parent": parent, "key": key, "ordinal": ordinal, "section": section})
            for k, v in value.items():
                v = value[k] = _open(v)
                if isinstance(v, dict):
                    down.append((v, me, k, 0, k in SECTION_KEYS))
                elif isinstance(v, list):
                    for i, x in enumerate(v):
                        x = v[i] = _open(x)
                        if isinstance(x, (dict, list)):
                            down.append((x, me, k, i, k in SECTION_KEYS and isinstance(x, dict)))
        elif isinstance(value, list):
            for i, x in enumerate(value):
                x = value[i] = _open(x)
                if isinstance(x, (dict, list)):
                    down.append((x, parent, key, i, False))
        todo.extend(reversed(down))
    identity: dict[int, str] = {}
    for n in reversed(nodes):  # children come after their parents
        v = n["value"]
        n["body"] = "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(v[k], identity)}" for k in sorted(v)) + "}" if isinstance(v, dict) else written(v, identity)
        n["hash"] = identity[id(v)] = _hash(n["body"])
    return nodes


def _clean(s: str | None) -> str | None:
    return s if s is None else s.encode("utf-8", "replace").decode("utf-8")


def shred(df: DataFrame, id_col: str = "raw_id", payload_col: str = "payload") -> DataFrame:
    """A row without an occurrence for each delivery; a row for each occurrence in a document, which a task sends once."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in NODE_SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[str] = set()
        for batch in batches:
            out: list[tuple] = []
            for raw_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not (nodes := shred_payload(payload)):
                    continue
                root = nodes[0]["hash"]
                out.append((raw_id, root) + (None,) * (len(schema) - 2))
                if root in sent:
                    continue
                if len(sent) > REMEMBERED:  # some are then sent again
                    sent.clear()
                sent.add(root)
                for i, n in enumerate(nodes):
                    v = n["value"]
                    fields = (_clean(_text(v[f])) if isinstance(v, dict) and f in v else None for f in FIELDS)
                    out.append((None, root, i, n["parent"], n["key"] and _clean(n["key"]), n["ordinal"], n["hash"], n["section"], _clean(n["body"]), *fields))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []
            cols = list(zip(*out, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, schema.types, strict=True)], schema=schema)

    return df.select(F.col(id_col).cast("bigint").alias("raw_id"), F.col(payload_col).cast("string").alias("payload")).filter("payload is not null").mapInArrow(run, NODE_SCHEMA)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From bridge rows in the order of document and occurrence: the path of the innermost section at and around each."""
    root, path = None, {}
    for b in batches:
        mine, around = [], []
        for doc, occ, parent, ordinal, section in zip(*(b.column(n).to_pylist() for n in ("document_hash", "occ", "parent_occ", "ordinal", "is_section")), strict=True):
            if doc != root:
                root, path = doc, {}
            up = path.get(parent)
            path[occ] = up if not section else str(ordinal) if up is None else f"{up}/{ordinal}"
            mine.append(path[occ])
            around.append(up)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mine, pa.string()), pa.array(around, pa.string())], names=[*b.schema.names, "section_path", "parent_path"])


@dataclass(frozen=True)
class Shredded:
    """Written tables: deliveries (raw_id, document_hash), bridge, objects (object_hash, body and fields)."""

    deliveries: DataFrame
    bridge: DataFrame
    objects: DataFrame

    def delivered(self, rows: DataFrame) -> DataFrame:
        """`rows` of documents, for every record that delivered the document. A document is one row here, so a frequent one is no hot key."""
        others = [c for c in rows.columns if c != "document_hash"]
        whole = materialize(rows.groupBy("document_hash").agg(F.collect_list(F.struct(*others)).alias("rows")), "documents")
        return join_one(self.deliveries, whole, "document_hash").select("raw_id", "document_hash", F.explode("rows").alias("x")).select("raw_id", "document_hash", "x.*")

    def with_fields(self, rows: DataFrame, *fields: str) -> DataFrame:
        return join_one(rows, self.objects.select("object_hash", *fields), "object_hash")


def shredded(df: DataFrame) -> Shredded:
    """All payloads, read once."""
    rows = materialize(shred(df), "shred")
    deliveries = rows.filter("occ is null").select("raw_id", "document_hash").distinct()
    there = rows.filter("occ is not null")
    bridge = there.select("document_hash", "occ", "parent_occ", "key", "ordinal", "object_hash", "is_section").distinct()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bridge.schema)
    bridge = bridge.repartition("document_hash").sortWithinPartitions("document_hash", "occ").mapInArrow(_places, f"{kinds}, section_path string, parent_path string")
    objects = there.groupBy("object_hash").agg(F.min(F.struct("body", *FIELDS)).alias("o")).select("object_hash", "o.*")
    return Shredded(materialize(deliveries, "deliveries"), materialize(bridge, "bridge"), materialize(objects, "objects"))


def nested_sections(s: Shredded) -> DataFrame:
    """Sections of every delivered document: raw_id, document_hash, section_path, parent_path (null at the outermost), key, ordinal, object_hash, heading, content."""
    rows = s.with_fields(s.bridge.filter("is_section").select("document_hash", "section_path", "parent_path", "key", "ordinal", "object_hash"), "heading", "content")
    return s.delivered(rows)


def section_paths(s: Shredded) -> DataFrame:
    """raw_id, section_path of the sections of every delivered document."""
    return s.delivered(s.bridge.filter("is_section").select("document_hash", "section_path")).select("raw_id", "section_path").distinct()


def nested_links(s: Shredded) -> DataFrame:
    """Links inside sections of every delivered document: the section's path, the ordinal, href and text."""
    rows = s.bridge.filter("key = 'links' and section_path is not null").select("document_hash", "occ", "section_path", "ordinal", "object_hash")
    return s.delivered(s.with_fields(rows, "href", "text")).drop("occ").withColumnRenamed("text", "link_text")


def nested_documents(s: Shredded) -> DataFrame:
    """A row for each delivered document: its identity, the title and link found outside sections and links, how many objects and sections it has."""
    outside = F.col("section_path").isNull() & (F.coalesce("key", F.lit("")) != "links")
    rows = s.with_fields(s.bridge.select("document_hash", "key", "section_path", "is_section", "object_hash"), "title", "link")
    whole = rows.groupBy("document_hash").agg(
        F.min(F.when(outside, F.col("title"))).alias("title"), F.min(F.when(outside, F.col("link"))).alias("link"), F.count("*").alias("n_objects"), F.sum(F.col("is_section").cast("int")).alias("n_sections")
    )
    return join_one(s.deliveries, materialize(whole, "documents"), "document_hash")
