"""Nested records as flat related tables, by way of an adjacency table.

Every value of a record becomes a node row (node, parent, label, ordinal,
kind, scalar); a node's name is the places on the way to it, so ``0.2.1`` lies
below ``0.2``. Structured columns are shredded by JVM expressions, JSON text by
one parse a record. Object nodes meet their members in one aggregation that
pivots them into a row an object; entity tables are these rows linked through
the lists they lie in.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.session import written

NODES = "record_table string, record_id long, node string, parent string, label string, ordinal int, kind string, scalar string"
_ARROW = pa.schema([("record_table", pa.string()), ("record_id", pa.int64()), ("node", pa.string()), ("parent", pa.string()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())])
_ROWS = 50_000


class _Digits(str):
    """An integer of more digits than Python converts, as its text."""


def _integer(digits: str) -> int | _Digits:
    most = sys.get_int_max_str_digits()
    return _Digits(digits) if most and len(digits.lstrip("-")) > most else int(digits)


_SPACE = re.compile(r"[ \t\n\r]*")


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_strict = json.JSONDecoder(parse_constant=_no_constant)
_scan = json.JSONDecoder(parse_int=_integer, parse_constant=_no_constant).scan_once


def _parse(text: str) -> object:
    """What ``json.loads`` gives, for any depth and any number of digits."""

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def scalar(i: int) -> tuple[object, int]:
        try:
            return _scan(text, i)
        except StopIteration:
            raise ValueError(f"no value at {i}") from None

    def member(i: int) -> int:
        """Puts the name at ``i`` on ``names``; where its value begins."""
        if text[i : i + 1] != '"':
            raise ValueError(f"no name at {i}")
        name, i = scalar(i)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"no colon at {i}")
        names.append(name)
        return skip(i + 1)

    above: list[dict | list] = []
    names: list[str] = []
    i = skip(0)
    while True:
        first = text[i : i + 1]
        if first in ("{", "["):
            above.append({} if first == "{" else [])
            i = skip(i + 1)
            if text[i : i + 1] != ("}" if first == "{" else "]"):
                i = member(i) if first == "{" else i
                continue
            value, i = above.pop(), i + 1
        else:
            value, i = scalar(i)
        while True:
            i = skip(i)
            if not above:
                if i < len(text):
                    raise ValueError(f"more text at {i}")
                return value
            last, named = above[-1], isinstance(above[-1], dict)
            if named:
                last[names.pop()] = value
            else:
                last.append(value)
            mark = text[i : i + 1]
            if mark == ",":
                i = skip(i + 1)
                i = member(i) if named else i
                break
            if mark != ("}" if named else "]"):
                raise ValueError(f"no end at {i}")
            value, i = above.pop(), i + 1


def _loads(text: str) -> object:
    try:
        return _strict.decode(text)
    except json.JSONDecodeError:
        raise
    except (ValueError, RecursionError):  # too many digits, too deep
        return _parse(text)


def document_nodes(text: str | None) -> list[tuple]:
    """Nodes of one JSON object; nothing for any other text.

    Of members with one name the last counts. Any depth and any number of digits will do.
    """
    try:
        root = _loads(text) if text else None
    except ValueError:
        return []
    if not isinstance(root, dict):
        return []
    out: list[tuple] = []
    stack: list[tuple] = [(root, "0", None, None, None)]
    while stack:
        value, node, parent, label, ordinal = stack.pop()
        if isinstance(value, dict):
            out.append((node, parent, label, ordinal, "object", None))
            stack.extend((v, f"{node}.{i}", node, k, None) for i, (k, v) in enumerate(value.items()))
        elif isinstance(value, list):
            out.append((node, parent, label, ordinal, "array", None))
            stack.extend((v, f"{node}.{i}", node, None, i) for i, v in enumerate(value))
        elif value is None:
            out.append((node, parent, label, ordinal, "null", None))
        elif isinstance(value, _Digits):
            out.append((node, parent, label, ordinal, "number", str(value)))
        elif isinstance(value, str):
            # A lone surrogate cannot be stored; it becomes a question mark.
            out.append((node, parent, label, ordinal, "string", value.encode("utf-8", "replace").decode()))
        elif isinstance(value, bool):
            out.append((node, parent, label, ordinal, "boolean", "true" if value else "false"))
        else:
            out.append((node, parent, label, ordinal, "number", repr(value)))
    return out


def _shred_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(8)]
        for name, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            for node in document_nodes(text):
                for c, v in zip(cols, (name, key, *node)):
                    c.append(v)
            if len(cols[0]) >= _ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
                cols = [[] for _ in range(8)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def adjacency(df: DataFrame, record_table: str, record_id: str, payload: Column) -> DataFrame:
    """The node table of ``payload`` (JSON text) of every row; NULL, empty and broken payloads give no nodes."""
    return df.select(F.lit(record_table).alias("record_table"), F.col(record_id).cast("long").alias("record_id"), payload.alias("payload")).mapInArrow(_shred_batches, NODES)


_REC = ["record_table", "record_id"]


def _none() -> Column:
    return F.lit(None).cast("string")


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    if isinstance(dtype, T.ArrayType):
        return "array"
    return "boolean" if isinstance(dtype, T.BooleanType) else "number" if isinstance(dtype, T.NumericType) else "string"


def struct_adjacency(df: DataFrame, record_table: str, record_id: str, record: Column) -> DataFrame:
    """The node table of the struct ``record`` of every row, whatever its nesting; NULL is an absent member, but counts as a place of a list.

    Each level of lists is one generator; a level that a reader does not ask for is pruned.
    """
    rows = df.select(F.lit(record_table).alias("record_table"), F.col(record_id).cast("long").alias("record_id"), record.alias("v"))
    out: list[DataFrame] = []

    def level(frame: DataFrame, dtype: T.DataType, node: Column, parent: Column, label: Column, ordinal: Column) -> None:
        """Rows of the values ``v`` of ``frame`` down to the next lists, and the levels below those."""
        here: list[Column] = []
        lists: list[tuple[Column, T.DataType, Column]] = []

        def visit(v: Column, dtype: T.DataType, node: Column, parent: Column, label: Column, ordinal: Column) -> None:
            nested = isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))
            row = F.struct(node.alias("node"), parent.alias("parent"), label.alias("label"), ordinal.cast("int").alias("ordinal"), F.lit(_kind(dtype)).alias("kind"), (_none() if nested else v.cast("string")).alias("scalar"))
            here.append(F.when(v.isNotNull(), row))
            if isinstance(dtype, T.StructType):
                for i, f in enumerate(dtype.fields):
                    visit(v.getField(f.name), f.dataType, F.concat(node, F.lit(f".{i}")), node, F.lit(f.name), F.lit(None))
            elif nested:
                lists.append((v, dtype, node))

        visit(F.col("v"), dtype, node, parent, label, ordinal)
        if len(here) == 1:
            out.append(frame.where("v is not null").select(*_REC, here[0].alias("x")).select(*_REC, "x.*"))
        else:
            out.append(frame.select(*_REC, F.explode(F.array_compact(F.array(*here))).alias("x")).select(*_REC, "x.*"))
        for v, dtype, node in lists:
            if isinstance(dtype, T.MapType):
                below = frame.select(*_REC, node.alias("up"), F.posexplode(v).alias("i", "k", "v"))
                level(below, dtype.valueType, F.concat_ws(".", "up", "i"), F.col("up"), F.col("k").cast("string"), F.lit(None))
            else:
                below = frame.select(*_REC, node.alias("up"), F.posexplode(v).alias("i", "v"))
                level(below, dtype.elementType, F.concat_ws(".", "up", "i"), F.col("up"), _none(), F.col("i"))

    level(rows, rows.schema["v"].dataType, F.lit("0"), _none(), _none(), F.lit(None))
    nodes = out[0]
    for more in out[1:]:
        nodes = nodes.unionByName(more)
    return nodes


_MEMBERS = ["annotations", "annotation_uid", "attributes", "attributes_json", "memberships", "asset_part_id", "asset_uri", "part_path", "element_indices"]


def object_rows(nodes: DataFrame, members: list[str], inner: str) -> DataFrame:
    """One row per object node: its ``members`` as structs (node, kind, scalar), pivoted in one aggregation.

    ``list_node`` is the list it lies in, or itself where it stands for a list
    of one, and ``position`` its place there. ``inner`` names a member of
    members: all of these come as a list (parent, scalar) in a column of that name.
    """
    place = F.struct(F.coalesce(F.when(F.col("ordinal").isNotNull(), F.col("parent")), F.col("node")).alias("list_node"), F.coalesce("ordinal", F.lit(0)).alias("position"))
    own = F.struct(F.col("node").alias("at"), place.alias("place"), _none().alias("label"), F.lit(None).cast("struct<node: string, kind: string, scalar: string>").alias("member"), _none().alias("parent"))
    held = F.struct(
        F.when(F.col("label") == inner, F.regexp_extract("parent", r"^(.*)\.", 1)).otherwise(F.col("parent")).alias("at"), F.lit(None).cast("struct<list_node: string, position: int>").alias("place"),
        "label", F.struct("node", "kind", "scalar").alias("member"), "parent",
    )
    wanted = F.col("label").isin([*members, inner])
    is_object = F.col("kind") == "object"
    rows = nodes.where(is_object | wanted).select(*_REC, F.explode(F.array_compact(F.array(F.when(is_object, own), F.when(wanted, held)))).alias("x")).select(*_REC, "x.*")
    return rows.groupBy(*_REC, "at").agg(
        F.max("place").alias("place"), *[F.max(F.when(F.col("label") == m, F.col("member"))).alias(m) for m in members],
        F.collect_list(F.when(F.col("label") == inner, F.struct("parent", F.col("member.scalar").alias("scalar")))).alias(inner),
    ).where("place is not null").select(*_REC, F.col("at").alias("node"), "place.*", *members, inner)


def annotation_entities(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotations, memberships, elements) of a node table of batch documents.

    - annotations: record_table, record_id, annotation_pos, annotation_uid, method; one row per object in ``annotations``;
    - memberships: + membership_pos, asset_part_id, asset_uri, part_path; one row per object in ``memberships``, linked by annotation_pos;
    - elements: record_table, record_id, annotation_pos, membership_pos, element_index, part_path, method; distinct non-null indices.

    Positions count NULL places; an object or scalar standing where a list is expected is a list of one. ``method`` is that of
    ``attributes``, else of ``attributes_json``, else ''; ``part_path`` is '' if absent.
    An index given as text is that number; what is no whole number of 64 bits is no index.
    """
    # Few columns of few nodes, read three times below.
    objects = written(object_rows(nodes, _MEMBERS, "method"))
    text = lambda name: F.col(f"{name}.scalar")
    method = lambda of: F.get(F.filter("method", lambda m: (m["parent"] == F.col(f"{of}.node")) & m["scalar"].isNotNull()), F.lit(0))["scalar"]
    top = objects.where("node = '0'").select(*_REC, F.col("annotations.node").alias("list_node")).where("list_node is not null")
    ann = objects.join(top, [*_REC, "list_node"]).select(
        *_REC, F.col("position").alias("annotation_pos"), text("annotation_uid").alias("annotation_uid"),
        F.coalesce(method("attributes"), method("attributes_json"), F.get_json_object(text("attributes_json"), "$.method"), F.lit("")).alias("method"), F.col("memberships.node").alias("list_node"),
    )
    mem = objects.select(*_REC, "list_node", "position", "asset_part_id", "asset_uri", "part_path", "element_indices").join(ann.where("list_node is not null"), [*_REC, "list_node"]).select(
        *_REC, "annotation_pos", "annotation_uid", "method", F.col("position").alias("membership_pos"), text("asset_part_id").alias("asset_part_id"), text("asset_uri").alias("asset_uri"),
        F.coalesce(text("part_path"), F.lit("")).alias("part_path"), F.col("element_indices.node").alias("list_node"),
    )
    number = F.trim("scalar")
    whole = F.when(number.rlike(r"^[+-]?\d+$"), number.try_cast("long")).when(number.rlike(r"^[+-]?\d+\.0*$"), F.substring_index(number, ".", 1).try_cast("long"))
    items = nodes.where(F.col("kind").isin("number", "string") & (F.col("ordinal").isNotNull() | (F.col("label") == "element_indices")))
    items = items.select(*_REC, F.coalesce(F.when(F.col("ordinal").isNotNull(), F.col("parent")), F.col("node")).alias("list_node"), whole.alias("element_index")).where("element_index is not null")
    # Repeats of a list meet where its items meet their list, so they need no shuffle of their own.
    items = items.repartition(*_REC, "list_node").distinct()
    elements = items.join(mem.select(*_REC, "annotation_pos", "membership_pos", "part_path", "method", "list_node").where("list_node is not null"), [*_REC, "list_node"])
    return ann.drop("list_node"), mem.drop("list_node"), elements.select(*_REC, "annotation_pos", "membership_pos", "element_index", "part_path", "method")
