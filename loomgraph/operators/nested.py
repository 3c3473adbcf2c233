"""Problem 7: deeply nested records as related flat tables.

A bottom-up tree automaton gives every JSON value a state from its fields and the
states of its children: a node, a node with its attributes in an object of their own,
an edge, a graph, a map and so on. The state of a value and the role in which its
parent holds it (a member of nodes, of edges, or anything) are looked up in one table
of routes, which sends nodes and edges of each variant to the typed subtype rows; these
keep the record id, the path of their parent and the common supertype key. A value
whose state has no route in its role gives no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.runtime import ship, spread

_NODES, _EDGES = ("nodes",), ("edges", "links")
_MEMBERS = _NODES + _EDGES
_SCALAR, _HELD = {"text", "number"}, {"object", "map", "lists", "empty", "node", "wrapped", "edge", "joined", "loose", "graph"}


def read_json(raw: str | None):
    """The value of a JSON text, also of one stored as a JSON string, however often; None where it cannot be read as a whole."""
    v = raw
    while isinstance(v, str):  # every reading shortens the text
        if not v.strip():
            return None
        try:
            v = json.loads(v)
        except (ValueError, RecursionError):
            return None
    return v


def _text(v) -> str | None:
    """A scalar id or label as text; None for anything else."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return str(v)
    return None


def leaf_state(v) -> str:
    """State of a value without children."""
    if v is None:
        return "null"
    return "flag" if isinstance(v, bool) else "text" if isinstance(v, str) else "number"


def object_state(fields: dict[str, str]) -> str:
    """Transition of the automaton at an object, from its fields' states.

    edge: both ends are scalars; joined: an end is an object with an id; loose: an end
    is neither; graph: it holds members; node: it has an id; wrapped: besides the id an
    object ``data``; map: all values are objects or NULL; lists: all are lists.
    """
    if "source" in fields and "target" in fields:
        ends = (fields["source"], fields["target"])
        return "edge" if _SCALAR.issuperset(ends) else "joined" if all(e in _SCALAR or e in ("node", "wrapped") for e in ends) else "loose"
    if any(fields.get(k) in _HELD or fields.get(k) == "list" for k in _MEMBERS):
        return "graph"
    if fields.get("id") in _SCALAR:
        return "wrapped" if fields.get("data") in _HELD else "node"
    if not fields:
        return "empty"
    kinds = set(fields.values())
    if kinds & _HELD and kinds <= _HELD | {"null"} and "id" not in fields:
        return "map"
    return "lists" if kinds == {"list"} else "object"


def states(v) -> dict[int, str]:
    """State of every object and list in ``v``, by identity, children first."""
    got: dict[int, str] = {}
    todo: list[tuple[object, bool]] = [(v, False)]
    while todo:
        x, seen = todo.pop()
        if not isinstance(x, (dict, list)):
            continue
        if not seen:
            todo.append((x, True))
            todo += [(y, False) for y in (x.values() if isinstance(x, dict) else x)]
        elif isinstance(x, list):
            got[id(x)] = "list"
        else:
            got[id(x)] = object_state({k: got[id(y)] if isinstance(y, (dict, list)) else leaf_state(y) for k, y in x.items()})
    return got


#: What becomes of a value of a state in a role; a pair that is not here gives nothing.
ROUTES = {
    ("any", "edge"): "edge", ("any", "joined"): "edge", ("any", "graph"): "members", ("any", "list"): "each", ("any", "text"): "reread",
    ("any", "node"): "inside", ("any", "wrapped"): "inside", ("any", "map"): "inside", ("any", "lists"): "inside", ("any", "object"): "inside",
    ("nodes", "list"): "each", ("nodes", "node"): "node", ("nodes", "wrapped"): "node", ("nodes", "edge"): "node", ("nodes", "joined"): "node", ("nodes", "loose"): "node",
    ("nodes", "graph"): "members", ("nodes", "map"): "keyed", ("nodes", "lists"): "grouped",
    ("edges", "list"): "each", ("edges", "edge"): "edge", ("edges", "joined"): "edge", ("edges", "graph"): "members",
    ("edges", "map"): "labelled", ("edges", "lists"): "labelled", ("edges", "object"): "labelled",
}


def _held(own: dict) -> dict:
    return {k: _text(own.get(k)) for k in ("type", "text", "community")}


def _rest(x: dict, **columns) -> str | None:
    """The fields of ``x`` that no column of the same name holds unchanged, as a JSON object; None where there are none."""
    r = {k: y for k, y in x.items() if not (isinstance(y, str) and k in columns and columns[k] == y)}
    return json.dumps(r, ensure_ascii=False, sort_keys=True) if r else None


def _number(v) -> str | None:
    return str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _edge_row(x: dict, path: str, given: str, got: dict[int, str]):
    a, b = (_text(e.get("id")) if isinstance(e, dict) else _text(e) for e in (x["source"], x["target"]))
    label = _text(x.get("label"))
    label = given if label is None else label
    weight = _number(x.get("weight"))
    kept = {k: y for k, y in x.items() if k != "weight" or weight is None}
    return "edge", _variant(x, got), path, f"{a}>{b}>{label}", a, b, label, _text(x.get("community")), None, weight, _rest(kept, source=a, target=b, label=label)


def _node_row(x: dict, own: dict, key: str, path: str, group: str | None, variant: str):
    """``own`` holds the attributes: the object itself, or the one within it."""
    t = _held(own)
    return "node", variant, path, key, t["type"] or "", t["text"], "", t["community"], group, None, _rest(x, id=key, **(t if own is x else {}))


def walk(v) -> Iterator[tuple[str, str, str, str, str, str | None, str, str | None, str | None, str | None, str | None]]:
    """(child, variant, path, key, a, b, label, community, grp, weight, rest) of every node and edge, at any depth.

    For a node: key = id, a = type, b = text, grp = the group it is listed in. For an
    edge: a = source, b = target. rest holds all fields that have no column, and those
    whose value a column cannot hold as it is (a number, an object, NULL).
    """
    got = states(v)
    todo: list[tuple[object, str, str, str, str | None]] = [(v, "$", "any", "", None)]  # value, path, role, label given by an enclosing map, group
    while todo:
        x, path, role, given, group = todo.pop()
        route = ROUTES.get((role, got[id(x)] if isinstance(x, (dict, list)) else leaf_state(x)))
        if route == "each":
            todo += [(y, f"{path}[{i}]", role, given, group) for i, y in reversed(list(enumerate(x)))]
        elif route == "reread":  # a graph stored as text within the record
            y = read_json(x) if x[:1] in "{[" else None
            if isinstance(y, (dict, list)):
                yield from ((c, n, path + p[1:], *r) for c, n, p, *r in walk(y))
        elif route == "edge":
            yield _edge_row(x, path, given, got)
        elif route == "node":
            key = _text(x.get("id"))
            if key is not None:
                yield _node_row(x, x["data"] if isinstance(x.get("data"), dict) else x, key, path, group, _variant(x, got))
        elif route == "keyed":  # id -> attributes
            for k, y in x.items():
                yield _node_row(y or {}, y or {}, k, f"{path}.{k}", group, "map:" + _variant(y or {}, got))
        elif route == "grouped":  # group -> nodes
            todo += [(y, f"{path}.{k}", role, given, k) for k, y in x.items()]
        elif route == "labelled":  # label -> edges
            todo += [(y, f"{path}.{k}", role, k, None) for k, y in x.items()]
        elif route == "members":
            own = _text(x.get("group")) if role == "nodes" else group
            for k, y in x.items():
                member = k in _MEMBERS and isinstance(y, (dict, list))
                todo.append((y, f"{path}.{k}", ("nodes" if k in _NODES else "edges") if member else "any", "", own if member else None))
        elif route == "inside":
            todo += [(y, f"{path}.{k}", "any", "", None) for k, y in x.items()]


def _variant(x: dict, got: dict[int, str]) -> str:
    """Name of the structural variant: the fields and the states of their values."""
    return ",".join(f"{k}:{got[id(y)] if isinstance(y, (dict, list)) else leaf_state(y)}" for k, y in sorted(x.items()))


_SCHEMA = pa.schema([(c, pa.string()) for c in ("record_id", "child", "child_key", "variant", "path", "a", "b", "label", "community", "grp", "weight", "rest")])
_DDL = ", ".join(f"{c} string" for c in _SCHEMA.names)


def graph_children(df: DataFrame, key: str = "id", raw: str = "g_raw") -> DataFrame:
    """Typed child rows of the JSON graphs in ``raw``, one per distinct child of a record.

    A graph that is NULL, blank or cannot be read as a whole gives no row; nodes
    without an id and edges without ends give none; a missing label is empty. A
    record delivered twice counts once. Extra columns are ignored.
    """
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in _SCHEMA.names]
            for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = read_json(r)
                if v is None or i is None:
                    continue
                seen = set()
                for child, variant, path, k, *fields in walk(v):
                    if (child, k) not in seen:
                        seen.add((child, k))
                        for col, x in zip(cols, (i, child, k, variant, path, *fields)):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], schema=_SCHEMA)

    return spread(df.select(F.col(key).cast("string"), raw)).mapInArrow(run, _DDL).dropDuplicates(["record_id", "child", "child_key"])


def node_table(children: DataFrame) -> DataFrame:
    """Subtype table of the nodes: supertype key, parent link, type, text, community, group, and all other fields as JSON."""
    return children.where("child = 'node'").selectExpr("record_id", "child_key", "path AS parent_path", "variant", "a AS node_type", "b AS text", "community", "grp AS node_group", "rest")


def edge_table(children: DataFrame) -> DataFrame:
    """Subtype table of the edges: supertype key, parent link, ends, label, weight, and all other fields as JSON."""
    return children.where("child = 'edge'").selectExpr("record_id", "child_key", "path AS parent_path", "variant", "a AS source", "b AS target", "label", "cast(weight AS double) AS weight", "community", "rest")


def _blank(c):
    return F.coalesce(F.regexp_replace(c, r"[\s\p{Z}\x{200B}\x{FEFF}]+", ""), F.lit("")) == ""


def element_state(value, **optional):
    """The automaton's transition at a list element whose schema is known, as a column: null, blank, whole, or without the optional fields it lacks."""
    lacks = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(k)) for k, c in optional.items()])) if optional else F.array().cast("array<string>")
    return F.when(value.isNull(), "null").when(_blank(value), "blank").when(F.size(lacks) == 0, "whole").otherwise(F.concat(F.lit("without "), F.array_join(lacks, ",")))


_NO_ROW = ("null", "blank")  # states of elements that are routed nowhere


def paragraph_table(df: DataFrame, key: str = "id") -> DataFrame:
    """(record_id, child_key, variant, idx, title, paragraph_text, is_supporting): the paragraphs of a question table.

    NULL lists, NULL elements and blank texts give no row; the position in the
    stored list is the key. A record delivered twice counts once.
    """
    p = df.select(F.col(key).cast("string").alias("record_id"), F.posexplode("paragraphs").alias("pos", "x")).where("record_id is not null")
    state = element_state(F.col("x.paragraph_text"), idx=F.col("x.idx"), title=F.col("x.title"), is_supporting=F.col("x.is_supporting"))
    p = p.withColumn("variant", state).where(~F.col("variant").isin(*_NO_ROW))
    return p.select("record_id", F.col("pos").cast("string").alias("child_key"), "variant", "x.idx", "x.title", "x.paragraph_text", "x.is_supporting").dropDuplicates(["record_id", "child_key"])


def alias_table(df: DataFrame, key: str = "id") -> DataFrame:
    """(record_id, child_key, alias): the answer aliases of a question table, by the rules of `paragraph_table`."""
    a = df.select(F.col(key).cast("string").alias("record_id"), F.posexplode("answer_aliases").alias("pos", "x")).where("record_id is not null")
    return a.where(~element_state(F.col("x")).isin(*_NO_ROW)).select("record_id", F.col("pos").cast("string").alias("child_key"), F.col("x").alias("alias")).dropDuplicates(["record_id", "child_key"])


def list_children(df: DataFrame, key: str = "id") -> DataFrame:
    """(record_id, child, child_key) of the paragraph and alias rows (all built-in operators)."""
    one = lambda t, child: t.select("record_id", F.lit(child).alias("child"), "child_key")
    return one(paragraph_table(df, key), "paragraph").unionByName(one(alias_table(df, key), "alias"))


def found(musique: DataFrame, eval_dump: DataFrame) -> DataFrame:
    """(record_id, child, child_key): every distinct child of both tables."""
    return list_children(musique).unionByName(graph_children(eval_dump).select("record_id", "child", "child_key"))
