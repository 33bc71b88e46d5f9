"""Open metadata as VARIANT: what a profile's head holds keeps its type and nesting, and paths reach into it.

A path is `key.key[2].key`; `[*]` stands for every element of a list, and a key with signs of its own stands in quotes, as
`["a.b"].c`. All functions on columns are expressions; those on values are for one file or one printed row."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.session import ready

_STEP = re.compile(r"""\.?([\w-]+)|\[(\d+)\]|\[(\*)\]|\[(?:"([^"]*)"|'([^']*)')\]""")
_CONDITION = re.compile(r"(.+?)\s*(!=|>=|<=|=|>|<|~)\s*(.*)", re.DOTALL)
EVERY = None
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def steps(path: str) -> list[str | int | None]:
    """The keys, places and EVERYs of a path; a path that isn't one raises."""
    found, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or (m[1] is not None and (path[at] == ".") != bool(at)):
            raise ValueError(f"not a path: {path!r} at {at}")
        found.append(int(m[2]) if m[2] else EVERY if m[3] else next(k for k in (m[1], m[4], m[5]) if k is not None))
        at = m.end()
    return found


def _dollar(part: list[str | int]) -> str:
    quoted = lambda k: f"[{k}]" if isinstance(k, int) else f'["{k}"]' if "'" in k else f"['{k}']"
    return "$" + "".join(map(quoted, part))


# ---------------------------------------------------------------- expressions


def from_map(values: Column) -> Column:
    """Metadata of a map of texts."""
    return F.try_parse_json(F.to_json(values))


def kind(value: Column) -> Column:
    """object, array, string, boolean, number or null; null for a value that isn't there."""
    head = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), head), F.lit("number")))


def value(metadata: Column, path: str, of: str = "string") -> Column:
    """The value at a path (without `[*]`) as a type; null if there is none or it can't be one."""
    return F.try_variant_get(metadata, _dollar(steps(path)), of)


def values(metadata: Column, path: str) -> Column:
    """All values at a path as an array, in order; an empty one where the path leads nowhere."""
    parts: list[list] = [[]]
    for s in steps(path):
        parts.append([]) if s is EVERY else parts[-1].append(s)
    none = F.array().cast("array<variant>")

    def within(part: list, of: str):
        return lambda v: F.try_variant_get(v, _dollar(part), of)

    found = F.array(metadata)
    for part in parts[:-1]:
        at = within(part, "array<variant>")
        found = F.flatten(F.transform(found, lambda v: F.coalesce(at(v), none)))  # noqa: B023
    if parts[-1]:
        found = F.transform(found, within(parts[-1], "variant"))
    return F.filter(found, lambda v: v.isNotNull())


def _compared(v: Column, op: str, operand) -> Column:
    if op == "type":
        return kind(v) == operand
    if op == "in":
        return F.array_contains(F.array(*[F.coalesce(_compared(v, "=", x), F.lit(False)) for x in operand]), True) if operand else F.lit(False)
    if operand is None:
        return kind(v) == "null"
    if op == "~" or isinstance(operand, (dt.date, dt.datetime)):
        operand = str(operand)
    if isinstance(operand, bool):
        own, got = kind(v) == "boolean", F.try_variant_get(v, "$", "boolean")
    elif isinstance(operand, (int, float)):
        own, got = kind(v) == "number", F.try_variant_get(v, "$", "double" if isinstance(operand, float) else "decimal(38,9)")
    else:
        own, got = kind(v) == "string", F.try_variant_get(v, "$", "string")
    told = {"=": got == operand, "<": got < operand, "<=": got <= operand, ">": got > operand, ">=": got >= operand}
    return own & (F.contains(F.lower(got), F.lit(str(operand).lower())) if op == "~" else told[op])


def condition(metadata: Column, path: str, op: str = "=", operand=None) -> Column:
    """Whether some value at a path fits. Types are not mixed: a number never fits a text. Texts of ISO dates compare as
    dates do.

    op: = != < <= > >=, `~` (a text that contains another, case ignored), in (one of a list), type (a name of `kind`),
    exists and missing. `!=` and `missing` ask that no value fits, so they hold where the path leads nowhere."""
    if op in ("exists", "missing"):
        found = F.size(values(metadata, path)) > 0
        return found if op == "exists" else ~F.coalesce(found, F.lit(False))
    if op == "!=":
        return ~condition(metadata, path, "=", operand)
    if op not in ("=", "<", "<=", ">", ">=", "~", "in", "type"):
        raise ValueError(f"no such comparison: {op!r}")
    return F.coalesce(F.exists(values(metadata, path), lambda v: F.coalesce(_compared(v, op, operand), F.lit(False))), F.lit(False))


def where(rows: DataFrame, conditions: dict, column: str = "attributes") -> DataFrame:
    """Rows whose metadata fit all conditions: path to a value, to a list (any of it) or to (comparison, operand)."""
    for path, wanted in conditions.items():
        op, operand = wanted if isinstance(wanted, tuple) else ("in", wanted) if isinstance(wanted, list) else ("=", wanted)
        rows = rows.filter(condition(F.col(column), path, op, operand))
    return rows


def depth(metadata: Column) -> Column:
    """How deep objects and lists stand in one another."""
    marks = F.regexp_extract_all(F.regexp_replace(F.to_json(metadata), r'"(?:[^"\\]|\\.)*+"', ""), F.lit(r"([\[\]{}])"), F.lit(1))
    step = lambda s, m: F.struct((s["now"] + F.when(m.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"]).alias("most"))
    return F.coalesce(F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"], F.lit(0))


def leaves(rows: DataFrame, column: str = "attributes", levels: int | None = None) -> DataFrame:
    """A row for each value that holds no other, with its path (lists as `[*]`), kind and text; the other columns stay.
    Empty objects and lists are such values, without a text. One scan: each level is a generator over the one before; how many there are
    is counted first unless given. Names `path`, `kind` and `text` must be free."""
    if levels is None:
        levels = rows.agg(F.max(depth(F.col(column)))).first()[0] or 0
    others = [F.col(c) for c in rows.columns if c != column]
    spark = rows.sparkSession
    found = rows.filter(F.col(column).isNotNull()).select(*others, F.lit("").alias("path"), F.col(column).alias("_v"))
    plain = F.when(F.col("_key").rlike(r"^[\w-]+$"), F.concat(F.when(F.col("path") == "", "").otherwise("."), F.col("_key"))).otherwise(F.concat(F.lit('["'), "_key", F.lit('"]')))
    for _ in range(levels):
        parts = spark.tvf.variant_explode_outer(F.col("_v").outer()).toDF("_pos", "_key", "_value")
        step = F.when(F.col("_pos").isNull(), "").when(F.col("_key").isNull(), "[*]").otherwise(plain)
        found = found.lateralJoin(parts).select(*others, F.concat("path", step).alias("path"), F.coalesce("_value", "_v").alias("_v"))
    told = found.select(*others, "path", kind(F.col("_v")).alias("kind"), "_v")
    return told.select(*others, "path", "kind", F.when(~F.col("kind").isin("object", "array"), F.try_variant_get("_v", "$", "string")).alias("text"))


def inventory(rows: DataFrame, column: str = "attributes", levels: int | None = None) -> DataFrame:
    """(path, kind, n_values, least, most): what paths there are, of what kinds; the least and greatest value as texts."""
    ready(rows.sparkSession)
    found = leaves(rows.select(column), column, levels).select("path", "kind", "text")
    # Spark aggregates least and greatest texts by sorting, which would hold all values of a task; of each batch a row for a
    # path and kind is left before that.
    parts = found.mapInArrow(_told, "path string, kind string, n_values long, least string, most string")
    return parts.groupBy("path", "kind").agg(F.sum("n_values").alias("n_values"), F.min("least").alias("least"), F.max("most").alias("most"))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, kind, n_values, least, most) of each batch of (path, kind, text); texts compare by their bytes, as Spark's do."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.set_column(2, "text", table["text"].cast(pa.binary()))
        told = table.group_by(["path", "kind"]).aggregate([([], "count_all"), ("text", "min"), ("text", "max")])
        told = told.select(["path", "kind", "count_all", "text_min", "text_max"]).rename_columns(["path", "kind", "n_values", "least", "most"])
        for i in (3, 4):
            told = told.set_column(i, told.column_names[i], told.column(i).cast(pa.string()))
        yield from told.to_batches()


# ---------------------------------------------------------------- values of one file or row


def as_json(found: dict) -> str:
    """A head as JSON: keys are texts, dates ISO texts, numbers that JSON lacks are texts."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple, set)):
            return [plain(x) for x in v]
        if v is None or isinstance(v, (bool, int, str)) or (isinstance(v, float) and math.isfinite(v)):
            return v
        return str(v)

    return json.dumps(plain(found), ensure_ascii=False)


def picked(found, path: str):
    """The value at a path of nested dicts and lists; a list of all of them if the path has `[*]`, None if there is none."""
    at, many = [found], False
    for s in steps(path):
        if s is EVERY:
            at, many = [x for v in at if isinstance(v, list) for x in v], True
        elif isinstance(s, int):
            at = [v[s] for v in at if isinstance(v, list) and s < len(v)]
        else:
            at = [v[s] for v in at if isinstance(v, dict) and s in v]
    return at if many else at[0] if at else None


def changed(found: dict, path: str, new) -> dict:
    """A copy with a value at a path; None takes it away. Objects on the way are made; a list grows by one at its end."""
    way = steps(path)
    if not way or EVERY in way:
        raise ValueError(f"not one place: {path!r}")

    def put(v, left: list):
        step, rest = left[0], left[1:]
        if isinstance(step, int):
            if not isinstance(v, list) or step > len(v) or (step == len(v) and new is None):
                raise ValueError(f"no place {step} for {path!r}")
            inner = new if not rest else put(v[step] if step < len(v) else None, rest)
            return v[:step] + ([] if inner is None and not rest else [inner]) + v[step + 1 :]
        if v is not None and not isinstance(v, dict):
            raise ValueError(f"{step!r} of {path!r} is not within an object")
        v = v or {}
        if not rest:
            return {k: x for k, x in v.items() if k != step} if new is None else v | {step: new}
        if new is None and step not in v:
            return v
        return v | {step: put(v.get(step), rest)}

    return put(found, way)


def parsed_condition(text: str) -> tuple[str, object]:
    """`path=value`, also with != < <= > >= ~; `path` alone asks that it exists. Values are read as JSON, else as texts."""
    m = _CONDITION.fullmatch(text)
    if not m:
        return text.strip(), ("exists", None)
    try:
        operand = json.loads(m[3])
    except ValueError:
        operand = m[3]
    if isinstance(operand, (dict, list)) and m[2] not in ("=", "!="):
        raise ValueError(f"{m[2]} needs one value: {text!r}")
    if isinstance(operand, dict):
        raise ValueError(f"not a plain value: {text!r}")
    if isinstance(operand, list):
        if m[2] == "!=":
            raise ValueError(f"!= needs one value: {text!r}")
        return m[1].strip(), ("in", operand)
    return m[1].strip(), (m[2], operand)
