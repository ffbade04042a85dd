"""Deeply nested JSON records as related flat tables (problem 2)."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.runtime import latest_rows, materialize

_AT, _FIELD = "_at", "f"
Path = tuple[str, ...]


def decode(value):
    """What a JSON text encodes; text that encodes an object or array counts as that, however often it is wrapped."""
    while isinstance(value, str):
        s = value.strip()
        if not s or s[0] not in '{["':
            return value
        try:
            inner = json.loads(s)
        except (ValueError, RecursionError):
            return value
        probe = inner
        while isinstance(probe, str) and probe.strip()[:1] in ("{", "[", '"') and probe.strip():
            try:
                probe = json.loads(probe)
            except (ValueError, RecursionError):
                break
        if not isinstance(probe, (dict, list)):
            return value
        value = probe
    return value


def read(text: str | None):
    """The root object or array of a record, None if the text is null, blank, unreadable or a scalar."""
    if not text or not text.strip():
        return None
    try:
        value = decode(json.loads(text))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, (dict, list)) else None


#: Stands in a path for the elements of an array that lies directly in an array.
INNER = "\0inner"


def _columns(value: dict) -> tuple[dict[str, dict], dict]:
    """({row key: {column: value}}, what is left) of an object of columns, each an object by row key."""
    rows: dict[str, dict] = {}
    rest = {}
    for column, cells in value.items():
        cells = decode(cells)
        if isinstance(cells, dict):
            for key, cell in cells.items():
                rows.setdefault(key, {})[column] = cell
        elif cells is not None:
            rest[column] = cells
    return rows, rest


def _kinds(value, path: Path, columnar: frozenset[Path], out: set[tuple[Path, str]]) -> None:
    """Adds what ``value`` is at ``path``: 'object', 'leaf', 'array', and of an array's elements 'rows' (objects) or 'items' (scalars)."""
    value = decode(value)
    if isinstance(value, dict) and path in columnar:
        rows, rest = _columns(value)
        out.add((path, "rows"))
        out.update(((*path, c), "leaf") for cells in rows.values() for c in cells)
        if rest:
            out.add((path, "leaf"))
    elif isinstance(value, dict):
        out.add((path, "object"))
        for name, v in value.items():
            _kinds(v, (*path, name), columnar, out)
    elif isinstance(value, list):
        out.add((path, "array"))
        for element in map(decode, value):
            if isinstance(element, dict):
                out.add((path, "rows"))
                for name, v in element.items():
                    _kinds(v, (*path, name), columnar, out)
            elif isinstance(element, list):
                out.add((path, "items"))
                _kinds(element, (*path, INNER), columnar, out)
            elif element is not None:
                out.add((path, "items"))
    elif value is not None:
        out.add((path, "leaf"))


def merged_schema(texts: DataFrame, columnar: frozenset[Path]) -> dict[Path, set[str]]:
    """All paths of all records and the kinds of values found there.

    Each batch sends the distinct pairs it saw, so what is shuffled and collected has the size of the schema (at most
    ``200_000`` pairs, else the records hold data in their names and this raises; name such objects in ``columnar``).
    """

    def run(frames):
        for frame in frames:
            seen: set[tuple[Path, str]] = set()
            for text in frame["text"]:
                root = read(text)
                if root is not None:
                    _kinds(root, (), columnar, seen)
            yield pd.DataFrame([(json.dumps(p), k) for p, k in seen], columns=["path", "kind"])

    rows = texts.select("text").mapInPandas(run, "path string, kind string").distinct().limit(200_001).collect()
    if len(rows) > 200_000:
        raise ValueError("more than 200,000 distinct paths: objects that are keyed by data must be named in columnar")
    kinds: dict[Path, set[str]] = {}
    for r in rows:
        kinds.setdefault(tuple(json.loads(r["path"])), set()).add(r["kind"])
    return kinds


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class Shape:
    """The merged schema as a tree: every node is a table ('rows'), a struct ('object') or a leaf.

    Fields are numbered. A struct or table row has _v, the text of a scalar that stands where others have an object or as
    an element of the array; a table row also has _at, its place, and _in, the elements of an array that is the element.
    """

    def __init__(self, kinds: dict[Path, set[str]], columnar: frozenset[Path]):
        self.kinds, self.columnar = kinds, columnar
        self.children: dict[Path, list[str]] = {}
        for path in sorted(kinds):
            if path and path[-1] != INNER:
                self.children.setdefault(path[:-1], []).append(path[-1])

    def kind(self, path: Path) -> str:
        found = self.kinds.get(path, set())
        if found & {"rows", "items"} or (path[-1:] == (INNER,)) or {"array", "object"} <= found:
            return "rows"
        return "object" if "object" in found else "leaf"

    def inner(self, path: Path) -> bool:
        return (*path, INNER) in self.kinds

    def type(self, path: Path) -> T.DataType:
        kind = self.kind(path)
        if kind == "leaf":
            return T.StringType()
        fields = [T.StructField("_v", T.StringType()), *(T.StructField(f"{_FIELD}{i}", self.type((*path, name))) for i, name in enumerate(self.children.get(path, ())))]
        if kind == "object":
            return T.StructType(fields)
        inside = [T.StructField("_in", self.type((*path, INNER)))] if self.inner(path) else []
        return T.ArrayType(T.StructType([T.StructField(_AT, T.StringType()), *fields, *inside]))

    def canonical(self, value, path: Path):
        """``value`` in the form of ``type(path)``: text decoded, bare objects and scalars made arrays, fields numbered, rows given their place."""
        value = decode(value)
        kind = self.kind(path)
        if value is None:
            return None
        if kind == "leaf":
            return _text(value)
        if kind == "object":
            return self.fields(value, path) if isinstance(value, dict) else {"_v": _text(value)}
        if isinstance(value, dict) and path in self.columnar:
            rows, rest = _columns(value)
            return [{_AT: at} | self.fields(row, path) for at, row in rows.items()] + ([{_AT: None, "_v": _text(rest)}] if rest else [])
        out = []
        for at, element in enumerate(map(decode, value if isinstance(value, list) else [value])):
            if isinstance(element, dict):
                out.append({_AT: str(at)} | self.fields(element, path))
            elif isinstance(element, list):
                out.append({_AT: str(at), "_in": self.canonical(element, (*path, INNER))})
            elif element is not None:
                out.append({_AT: str(at), "_v": _text(element)})
        return out

    def fields(self, value: dict, path: Path) -> dict:
        out = {}
        for i, name in enumerate(self.children.get(path, ())):
            if value.get(name) is not None:
                out[f"{_FIELD}{i}"] = self.canonical(value[name], (*path, name))
        return out


def _unclashing(names: list[str], taken: list[str]) -> list[str]:
    """Column names that differ from each other and from ``taken`` without regard to case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        candidate, n = name or "value", 1
        while candidate.lower() in used:
            n += 1
            candidate = f"{name or 'value'}_{n}"
        used.add(candidate.lower())
        out.append(candidate)
    return out


KEYS = ["document_id", "node_path", "parent_path", "ordinal"]


class Tables(dict):
    """The flat tables by path of names; ``records`` has (document_id, node_path, parent_path) of all objects in arrays."""

    def __init__(self):
        super().__init__()
        self.records: list[DataFrame] = []


def flatten(df: DataFrame, id_col: str = "id", json_col: str = "reference_content", order_col: str | None = "created_at", columnar: tuple[str, ...] = ()) -> Tables:
    """Flat tables of nested JSON records: one for the roots ('') and one for each array, by its path of names.

    Every table has document_id, node_path (the surrogate key within the document: names and positions from the root,
    joined by '/'), parent_path (the node_path of the row's parent, '' for the root), ordinal (the position in the array)
    and a text column for each scalar field; fields of inner structs are joined by '.', and names that clash, also by
    case, get _2, _3 and so on. Elements of an array that are scalars are rows with their text in ``element``; elements
    that are arrays are rows too, and their own elements are rows of a further table (the path and '[]') with ordinals of
    their own. Nothing a record holds is left out but nulls.
    Records are read once to merge their schema, rewritten in its form, and the arrays are then exploded level by level,
    each child from its parent's row; the scan of each table reads only its own fields. Objects named in ``columnar``
    (fields of the root) hold one object per column, each keyed by row: they give one row per row key, with a null
    ordinal unless it is a number; columns that aren't objects are one row with a null place.
    Text that encodes JSON counts as what it encodes; a bare object or scalar where other records have an array counts as
    element 0, a scalar where others have an object as a text column of the object's name; null elements keep their
    positions and give no rows. Null, blank and unreadable records give a root row without fields and no other rows. Rows
    of one id count once (the latest by ``order_col``); null ids are left out; an empty table gives empty tables; other
    columns don't matter.
    """
    named = df.select(df[id_col].alias("id"), (df[order_col] if order_col else F.lit(0)).alias("at"), df[json_col].alias("text")).where("id is not null")
    texts = latest_rows(named, "id", "at").select("id", "text")
    named_columnar = frozenset((c,) for c in columnar)
    shape = Shape(merged_schema(texts, named_columnar), named_columnar)
    array_root = "array" in shape.kinds.get((), set())
    id_type = texts.schema["id"].dataType.simpleString()

    def rewrite(frames):
        for frame in frames:
            out = []
            for text in frame["text"]:
                root = read(text)
                whole: dict = {}
                if isinstance(root, dict):
                    whole["o"] = shape.fields(root, ())
                elif isinstance(root, list):
                    whole["a"] = shape.canonical(root, ())
                out.append(json.dumps(whole, ensure_ascii=False))
            yield pd.DataFrame({"id": frame["id"], "record": out})

    inner = [T.StructField(f"{_FIELD}{i}", shape.type((name,))) for i, name in enumerate(shape.children.get((), ()))]
    root_fields = [T.StructField("o", T.StructType(inner or [T.StructField("_v", T.StringType())]))]
    as_rows = shape.type(()) if array_root and shape.kind(()) == "rows" else None
    parsed = texts.mapInPandas(rewrite, f"id {id_type}, record string")
    schema = T.StructType([*root_fields, *([T.StructField("a", as_rows)] if as_rows else [])])
    parsed = materialize(parsed.select(F.col("id").alias("document_id"), F.from_json("record", schema).alias("r")), "nested")

    tables = Tables()

    def walk(rows: DataFrame, path: Path, table: str, items: bool) -> None:
        """Emits the table of ``rows`` (document_id, node_path, parent_path, record_path, at, e) and descends into its arrays."""
        leaves: list[tuple[str, Column]] = []
        arrays: list[tuple[Path, Path, Column]] = []

        def fields(at: Path, prefix: Path, e: Column) -> None:
            for i, name in enumerate(shape.children.get(at, ())):
                kind, column = shape.kind((*at, name)), e.getField(f"{_FIELD}{i}")
                if kind == "leaf":
                    leaves.append((".".join((*prefix, name)), column))
                elif kind == "object":
                    if "leaf" in shape.kinds[(*at, name)]:
                        leaves.append((".".join((*prefix, name)), column.getField("_v")))
                    fields((*at, name), (*prefix, name), column)
                else:
                    arrays.append(((*at, name), (*prefix, name), column))

        fields(path, (), F.col("e"))
        if items:
            leaves.insert(0, ("element", F.col("e._v")))
        names = _unclashing([n for n, _ in leaves], KEYS)
        flat = rows.select("document_id", "node_path", "parent_path", F.col("at").try_cast("int").alias("ordinal"), *[c.alias(n) for n, (_, c) in zip(names, leaves)])
        tables[table] = flat if table not in tables else tables[table].unionByName(flat, allowMissingColumns=True)

        def descend(at: Path, name: str, column: Column, parent: DataFrame) -> None:
            child = parent.select("document_id", F.col("node_path").alias("parent_path"), "record_path", F.explode(column).alias("e"))
            step = F.coalesce(F.concat(F.lit(name + "/" if name else ""), F.col(f"e.{_AT}")), F.lit(name))
            key = F.when(F.col("parent_path") == "", step).otherwise(F.concat("parent_path", F.lit("/"), step))
            placed = child.select("document_id", key.alias("node_path"), "parent_path", "record_path", F.col(f"e.{_AT}").alias("at"), "e")
            enter(placed, at, f"{table}/{name or '[]'}" if table else name)

        inside = rows.withColumn("record_path", F.col("node_path"))
        for at, prefix, column in arrays:
            descend(at, "/".join(prefix), column, inside)
        if items and shape.inner(path):
            descend((*path, INNER), "", F.col("e._in"), rows)

    def enter(rows: DataFrame, path: Path, table: str) -> None:
        """The rows of one array: those that are objects are records."""
        found = shape.kinds.get(path, set())
        items = bool(found & {"items", "leaf"})
        record = F.col("e._v").isNull() & (F.col("e._in").isNull() if shape.inner(path) else F.lit(True))
        if found & {"rows", "object"}:
            tables.records.append((rows.where(record) if items else rows).select("document_id", "node_path", F.col("record_path").alias("parent_path")))
        walk(rows, path, table, items)

    root = F.lit(None).cast("string")
    walk(parsed.select("document_id", F.lit("").alias("node_path"), root.alias("parent_path"), F.lit("").alias("record_path"), root.alias("at"), F.col("r.o").alias("e")), (), "", False)
    if as_rows:
        top = parsed.select("document_id", F.explode("r.a").alias("e"))
        at, nothing = F.col(f"e.{_AT}"), F.lit("")
        own = dict(tables)
        tables.clear()
        enter(top.select("document_id", at.alias("node_path"), nothing.alias("parent_path"), nothing.alias("record_path"), at.alias("at"), "e"), (), "[]")
        tables.update(own)
    return tables


def nodes(tables: Tables) -> DataFrame:
    """(document_id, node_path, parent_path) of all objects that are elements of arrays; parent_path names the nearest enclosing one, '' at the root."""
    if tables.records:
        return reduce(DataFrame.unionByName, tables.records)
    return tables[""].select("document_id", "node_path", "parent_path").limit(0)
