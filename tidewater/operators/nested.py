"""Flat, linked tables from nested records by shared inlining.

The schema of the records is a graph of types. A singleton object is inlined into the table that owns it; a type
gets a table of its own if it is repeated (array elements, map entries), reached from several parents, or recursive.
Every row carries the key of its record, the path of its parent row, its own path and its position, so the nesting
can be rebuilt.

Two front ends share the rules:

* `inline_typed` for columns with a Spark schema: generators and projections only, no shuffle and no Python;
* `json_tables` for JSON text whose shape varies from line to line: `json_rows` emits linked rows in Arrow batches,
  `json_schema` sums up their types, and `json_plan` gives each type its table.

Defined results: null arrays, maps and structs have no rows; null elements keep a row (is_null true); empty arrays
have no rows; repeated records keep separate rows under their own keys; an empty input gives empty tables. Other
columns of the input are ignored, whatever their names. Lines that are no JSON object (broken, null, scalars,
arrays, nested beyond the parser's depth) have no rows.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.runtime import cut, spread

# ---------------------------------------------------------------- schema graph


@dataclass
class Node:
    """A type of the schema graph. `name` is its label, `shape` its field names (empty for scalars)."""

    name: str
    shape: frozenset[str] = frozenset()
    parents: set[str] = field(default_factory=set)
    repeated: bool = False
    recursive: bool = False

    @property
    def owns_table(self) -> bool:
        return self.repeated or self.recursive or (bool(self.shape) and len(self.parents) > 1)


def schema_graph(paths: Iterable[tuple[str, str, tuple[str, ...]]]) -> dict[str, Node]:
    """Nodes by label from (normalised path, kind, field names); `[]` ends the path of an array element, `{}` of a
    map entry. Labels are field names; a label met again below itself is recursive."""
    nodes: dict[str, Node] = {}
    for path, kind, fields in paths:
        steps = [s for s in path.replace("[]", ".[]").replace("{}", ".{}").split(".") if s]
        names = [s for s in steps if s not in ("[]", "{}")]
        if not names:
            continue
        label, above = names[-1], names[:-1]
        if kind != "object" and steps[-1] not in ("[]", "{}"):
            continue  # scalars are attributes of their owner
        node = nodes.setdefault(label, Node(label))
        node.repeated |= steps[-1] in ("[]", "{}")
        node.recursive |= label in above
        node.shape |= frozenset(fields)
        if kind == "object":
            node.parents.add(above[-1] if above else "")
    return nodes


# ---------------------------------------------------------------- typed columns


def _is_container(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType))


def _typed_paths(name: str, t: T.DataType, path: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    if isinstance(t, T.StructType):
        yield path, "object", tuple(t.fieldNames())
        for f in t.fields:
            yield from _typed_paths(f.name, f.dataType, f"{path}.{f.name}")
    elif isinstance(t, T.ArrayType):
        if not isinstance(t.elementType, T.StructType):
            yield f"{path}[]", "scalar", ()
        yield from _typed_paths(name, t.elementType, f"{path}[]")
    elif isinstance(t, T.MapType):
        yield f"{path}{{}}", "scalar", ()


LINKS = ("record_key", "parent_path", "path", "position", "is_null")


def _named(cols: list[tuple[str, Column]]) -> list[Column]:
    """Attributes under names of their own: a name that a link or an earlier attribute bears gets a suffix."""
    taken = set(LINKS)
    out = []
    for name, col in cols:
        own, n = name, 2
        while own in taken:
            own, n = f"{name}_{n}", n + 1
        taken.add(own)
        out.append(col.alias(own))
    return out


def inline_typed(df: DataFrame, key: str, columns: list[str]) -> dict[str, DataFrame]:
    """Tables for the nested `columns` of `df`; `records` holds the inlined singletons of each row.

    Each other table: record_key, parent_path, path, position (null for singletons), is_null and the inlined fields
    (`value` for scalar elements, `name` and `value` for map entries). A struct that several parents hold has one
    table under its own name, whichever way it is reached. Every scalar of the input stands in exactly one column.
    """
    schema = df.schema
    graph = schema_graph(p for c in columns for p in _typed_paths(c, schema[c].dataType, c))
    parts: dict[str, list[DataFrame]] = defaultdict(list)
    # clashing names of other columns never matter: only the key and the named columns are read, under private names
    base = df.select(F.col(f"`{key}`").alias("record_key"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(columns)])

    def shared(label: str, t: T.DataType) -> bool:
        return isinstance(t, T.StructType) and label in graph and len(graph[label].parents) > 1

    def inlined(col: Column, t: T.DataType, name: str, label: str, root: bool = False) -> list[tuple[str, Column]]:
        """Scalar attributes, through singleton structs that have no table of their own."""
        if isinstance(t, T.StructType):
            if not root and shared(label, t):
                return []
            return [x for f in t.fields for x in inlined(col[f.name], f.dataType, f"{name}_{f.name}" if name else f.name, f.name)]
        return [] if _is_container(t) else [(name, col)]

    def element(rows: DataFrame, t: T.DataType, name: str, label: str, extra: list[tuple[str, Column]]) -> None:
        """The table of repeated values `__value` and what lies below them."""
        value = F.col("__value")
        own = extra + ([] if isinstance(t, (T.ArrayType, T.MapType)) else inlined(value, t, "" if isinstance(t, T.StructType) else "value", label, root=True))
        parts[label if shared(label, t) else name].append(rows.select(*LINKS, *_named(own)))
        if isinstance(t, T.StructType):
            below(rows.select("record_key", F.col("path").alias("__at"), "__value"), value, t, name, F.col("__at"), F.col("__at"))
        elif _is_container(t):
            emit(rows.select("record_key", F.col("path").alias("__at"), "__value"), value, t, f"{name}_item", label, F.col("__at"), F.col("__at"))

    def below(at: DataFrame, col: Column, t: T.StructType, name: str, parent: Column, path: Column) -> None:
        for f in t.fields:
            if _is_container(f.dataType):
                emit(at, col[f.name], f.dataType, f"{name}_{f.name}" if name else f.name, f.name, parent, F.concat_ws(".", path, F.lit(f.name)))

    def emit(at: DataFrame, col: Column, t: T.DataType, name: str, label: str, parent: Column, path: Column) -> None:
        """Tables of a container `col`; `at` has record_key and what `col` and `path` refer to."""
        if isinstance(t, T.StructType):
            if not shared(label, t):
                return below(at, col, t, name, parent, path)
            rows = at.filter(col.isNotNull()).select("record_key", parent.alias("parent_path"), path.alias("path"), F.lit(None).cast("int").alias("position"), F.lit(False).alias("is_null"), col.alias("__value"))
            return element(rows, t, name, label, [])
        many = isinstance(t, T.MapType)
        names = ("__pos", "__name", "__value") if many else ("__pos", "__value")
        rows = at.select("record_key", parent.alias("parent_path"), path.alias("__base"), F.posexplode(col).alias(*names))
        step = F.col("__name").cast("string") if many else (F.col("__pos") + 1).cast("string")
        rows = rows.select(
            "record_key", "parent_path", F.concat_ws(".", "__base", step).alias("path"), (F.col("__pos") + 1).alias("position"), F.col("__value").isNull().alias("is_null"), *names[1:]
        )
        element(rows, t.valueType if many else t.elementType, name, label, [("name", F.col("__name"))] if many else [])

    singles: list[tuple[str, Column]] = []
    for i, c in enumerate(columns):
        t = schema[c].dataType
        singles += inlined(F.col(f"__{i}"), t, c, c)
        if _is_container(t):
            emit(base, F.col(f"__{i}"), t, c, c, F.lit(""), F.lit(c))
    out = {}
    for name, tables in parts.items():
        out[name] = tables[0]
        for more in tables[1:]:
            out[name] = out[name].unionByName(more, allowMissingColumns=True)
    out["records"] = base.select("record_key", *_named(singles))
    return out


# ---------------------------------------------------------------- JSON text

JSON_ROW = T.StructType(
    [
        T.StructField("record_key", T.LongType()),
        T.StructField("type_path", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("is_null", T.BooleanType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("shapes", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _step(name: str) -> str:
    """A field name as one step of an attribute's name."""
    return name.replace("\\", "\\\\").replace(".", "\\.")


def _text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False)


def walk_json(raw: str | None, arrays: frozenset[str], nested_text: frozenset[str], shared: frozenset[str] = frozenset()) -> list[tuple]:
    """Linked rows of one line: (type_path, parent_path, path, position, is_null, fields, shapes); [] if the line is
    no object. Attributes are named by their steps, joined by dots (dots inside a name escaped), so no two of them clash.
    `arrays` are fields whose object stands for an array of one, `nested_text` fields whose text is JSON.
    Objects named in `shared`, or met again below an object of their own name, get rows of their own (position null).
    A work list instead of recursion keeps deep records off the Python stack."""
    if raw is None:
        return []
    try:
        root = json.loads(raw)
    except (ValueError, RecursionError):
        return []
    if not isinstance(root, dict):
        return []
    out: list[tuple] = []
    todo: list[tuple] = [("", "", "", None, root)]  # type path, parent row, path, position, value
    while todo:
        kind, parent, path, pos, value = todo.pop()
        fields: dict[str, str | None] = {}
        shapes: dict[str, str] = {}
        inner = [("", kind, path, value)]  # prefix, type path, path, value of singletons inlined into this row
        while inner:
            prefix, k, p, v = inner.pop()
            if isinstance(v, dict):
                shapes[k] = "object:" + ",".join(sorted(v))
                for name, x in v.items():
                    if name in nested_text and isinstance(x, str):
                        try:
                            x = json.loads(x)
                        except (ValueError, RecursionError):
                            pass
                    if name in arrays and isinstance(x, dict):
                        x = [x]
                    below, at = f"{k}.{name}" if k else name, f"{p}.{name}" if p else name
                    if isinstance(x, dict) and (name in shared or name in k.replace("[]", "").split(".")):
                        todo.append((below, path, at, None, x))
                    else:
                        inner.append((f"{prefix}.{_step(name)}" if prefix else _step(name), below, at, x))
            elif isinstance(v, list):
                for i in range(len(v), 0, -1):
                    todo.append((f"{k}[]", path, f"{p}.{i}", i, v[i - 1]))
            else:
                fields[prefix or "value"] = _text(v)
                if not prefix:
                    shapes[k] = "scalar"
        out.append((kind, parent if path else None, path, pos, value is None, fields, shapes))
    return out


def json_rows(df: DataFrame, key: str, raw: str, arrays: Iterable[str] = (), nested_text: Iterable[str] = (), shared: Iterable[str] = ()) -> DataFrame:
    """All linked rows of the JSON lines in column `raw`; the record's own row has an empty path. `shared`: object
    labels that a first pass over `json_schema` found below several parents."""
    many, text, own = frozenset(arrays), frozenset(nested_text), frozenset(shared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, line in zip(b["k"], b["raw"]) for r in walk_json(line, many, text, own)]
            yield pd.DataFrame(rows, columns=JSON_ROW.fieldNames())

    picked = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{raw}`").cast("string").alias("raw"))
    return spread(picked.filter(F.col("k").isNotNull()), "k").mapInPandas(run, JSON_ROW)


def json_schema(rows: DataFrame) -> DataFrame:
    """(type_path, kind, fields): one row per type and kind of the schema graph, and one of kind 'columns' with the
    attributes that rows of a type really have. Field names that stand for data (maps keyed by ids) would make it grow
    with the data, so it stays a DataFrame."""
    shapes = rows.select(F.explode("shapes").alias("type_path", "shape")).distinct()
    split = shapes.select("type_path", F.split("shape", ":", 2).alias("s"))
    names = split.select("type_path", F.col("s")[0].alias("kind"), F.explode_outer(F.split(F.get("s", F.lit(1)), ",")).alias("name"))
    columns = rows.select("type_path", F.lit("columns").alias("kind"), F.explode(F.map_keys("fields")).alias("name")).distinct()
    return names.unionByName(columns).groupBy("type_path", "kind").agg(F.sort_array(F.collect_set("name")).alias("fields"))


@dataclass
class TablePlan:
    name: str
    type_paths: list[str]
    columns: list[str]


@dataclass
class JsonTables:
    """Linked rows and the plan that says to which table each type of row belongs."""

    rows: DataFrame
    plans: dict[str, TablePlan]

    def table(self, name: str) -> DataFrame:
        return json_table(self.rows, self.plans[name])

    def elements(self) -> DataFrame:
        """Every row of every table, with the table's name."""
        owner = F.create_map(*[F.lit(x) for p in self.plans.values() for t in p.type_paths for x in (t, p.name)])
        return self.rows.withColumn("table", owner[F.col("type_path")]).filter("table IS NOT NULL")


def _read_schema(schema: DataFrame, limit: int) -> list[tuple[str, str, tuple[str, ...]]]:
    got = schema.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} types: object keys are data here; use json_rows as it is")
    return [(r["type_path"], r["kind"], tuple(x for x in r["fields"] if x)) for r in got]


def json_tables(df: DataFrame, key: str, raw: str, arrays: Iterable[str] = (), nested_text: Iterable[str] = (), limit: int = 10_000) -> JsonTables:
    """Shared inlining of JSON lines: a first pass analyses the schema graph; where it finds objects below several
    parents, a second pass gives them rows of their own; then every type is given its table.

    The driver reads the graph only if it has at most `limit` rows; a larger one means keys that are data."""
    arrays, nested_text = tuple(arrays), tuple(nested_text)
    rows = cut(json_rows(df, key, raw, arrays, nested_text))
    paths = _read_schema(json_schema(rows), limit)
    graph = schema_graph(p for p in paths if p[1] != "columns")
    own = sorted(k for k, n in graph.items() if n.shape and len(n.parents) > 1)
    if own and any(_label(p) in own and not p.endswith("[]") for p, k, _ in paths if k == "object"):
        rows = cut(json_rows(df, key, raw, arrays, nested_text, own))
        paths = _read_schema(json_schema(rows), limit)
    return JsonTables(rows, json_plan(paths))


def _label(path: str) -> str:
    return path.replace("[]", "").rpartition(".")[2]


def json_plan(paths: list[tuple[str, str, tuple[str, ...]]]) -> dict[str, TablePlan]:
    """Tables from the types of the schema graph: types that share a label and several parents, or that are recursive,
    share a table under that label; every other type of rows has the table of its path."""
    graph = schema_graph(p for p in paths if p[1] != "columns")
    owned: dict[str, set[str]] = defaultdict(set)
    columns: dict[str, set[str]] = defaultdict(set)
    # a type has rows if it is the record, is repeated, or has attributes or objects that no row above it took in
    with_rows = {p for p, k, _ in paths if k == "columns" or p.endswith("[]") or not p}
    for path in sorted(with_rows):
        node = graph.get(_label(path))
        one = node is not None and bool(node.shape) and (node.recursive or len(node.parents) > 1)
        name = "records" if not path else _label(path) if one else path.replace("[]", "").replace(".", "_")
        owned[name].add(path)
        columns[name] |= {c for p, k, fields in paths if k == "columns" and p == path for c in fields}
    return {n: TablePlan(n, sorted(o), sorted(columns[n])) for n, o in owned.items()}


def json_table(rows: DataFrame, plan: TablePlan) -> DataFrame:
    """One table of the plan, its attributes as columns (prefixed `f_` so that none clashes with the links)."""
    cols = _named([(f"f_{c.replace('.', '_')}", F.col("fields")[c]) for c in plan.columns])
    return rows.filter(F.col("type_path").isin(plan.type_paths)).select(*LINKS, F.col("type_path").alias("parent_type"), *cols)
