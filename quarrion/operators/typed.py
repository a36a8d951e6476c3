"""Typed predicates: equality, lists, ranges, presence, distance, geometry, and filters in comparison syntax."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrion.functions import geo
from quarrion.plans.scope import Hit, Scope

from .text import paths_of


def _same(value):
    """An equality test; a boolean never equals a number, nor a number a text."""
    return lambda v: v.eqNullSafe(F.lit(value)) if value is None else v == F.lit(value)


def fits(scope: Scope, path: str, value) -> bool:
    """Whether a value is of the type of the path: comparison is within a type."""
    kind = scope.type_of(path)
    while kind is not None and hasattr(kind, "elementType"):
        kind = kind.elementType
    if kind is None:
        return False
    name = kind.typeName()
    if isinstance(value, bool):
        return name == "boolean"
    if isinstance(value, (int, float)):
        return name in ("byte", "short", "integer", "long", "float", "double") or name.startswith("decimal")
    if isinstance(value, datetime):
        return name in ("timestamp", "timestamp_ntz", "date")
    return name in ("string", "varchar", "char")


def test_of(scope: Scope, path: str, op: str, value, raw: bool = False) -> Column:
    if value is None:
        return scope.column(path).isNull() if op == "eq" else F.lit(False)
    if not fits(scope, path, value):
        return F.lit(False)
    compare = {"eq": lambda v: v == F.lit(value), "gt": lambda v: v > F.lit(value), "gte": lambda v: v >= F.lit(value), "lt": lambda v: v < F.lit(value), "lte": lambda v: v <= F.lit(value)}[op]
    return (scope.raw_value if raw else scope.any_value)(path, compare)


def _either(tests: list[Column]) -> Column:
    out = tests[0] if tests else F.lit(False)
    for t in tests[1:]:
        out = out | t
    return out


def equals(spec: dict, scope: Scope) -> Hit:
    paths = paths_of(spec["path"])
    match, plain = (_either([test_of(scope, p, "eq", spec["value"], raw) for p in paths]) for raw in (False, True))
    return Hit(match, F.lit(1.0), plain)


def in_list(spec: dict, scope: Scope) -> Hit:
    values = spec["value"] if isinstance(spec["value"], list) else [spec["value"]]
    if len({type(v) for v in values} - {int, float}) + bool({type(v) for v in values} & {int, float}) > 1:
        raise ValueError("values of a list must share a type")
    good = {p: [v for v in values if fits(scope, p, v)] for p in paths_of(spec["path"])}
    match, plain = (_either([find(p, lambda v, g=g: v.isin(g)) for p, g in good.items() if g]) for find in (scope.any_value, scope.raw_value))
    return Hit(match, F.lit(1.0), plain)


def range_(spec: dict, scope: Scope) -> Hit:
    """Both bounds apply to one value.  Every path that matches scores 1."""
    bounds = {k: spec[k] for k in ("gt", "gte", "lt", "lte") if k in spec}
    if not bounds or {"gt", "gte"} <= set(bounds) or {"lt", "lte"} <= set(bounds):
        raise ValueError("a range has one or two bounds, one on a side")
    if any(isinstance(v, (bool, dict)) for v in bounds.values()):
        raise ValueError("bounds must be numbers, dates or strings")
    ops = {"gt": lambda v, b: v > b, "gte": lambda v, b: v >= b, "lt": lambda v, b: v < b, "lte": lambda v, b: v <= b}

    def inside(v):
        out = F.lit(True)
        for k, b in bounds.items():
            out = out & ops[k](v, F.lit(b))
        return out

    paths = [p for p in paths_of(spec["path"]) if all(fits(scope, p, b) for b in bounds.values())]
    each = [scope.any_value(p, inside) for p in paths]
    score = sum((F.when(one, 1.0).otherwise(0.0) for one in each), F.lit(0.0))
    return Hit(_either(each), score, _either([scope.raw_value(p, inside) for p in paths]))


def exists(spec: dict, scope: Scope) -> Hit:
    """In Parquet a null is a missing value."""
    return Hit(scope.column(spec["path"]).isNotNull(), F.lit(1.0))


def near(spec: dict, scope: Scope) -> Hit:
    """pivot / (pivot + distance): numbers, dates (milliseconds), points (metres; a struct of lon and lat)."""
    origin, pivot = spec["origin"], float(spec["pivot"])
    if pivot <= 0:
        raise ValueError("pivot must be positive")
    match, score = F.lit(False), F.lit(0.0)
    for path in paths_of(spec["path"]):
        c = scope.column(path)
        if isinstance(origin, dict):
            far = geo.distance(c["lon"], c["lat"], origin["coordinates"])
        elif isinstance(origin, datetime):
            millis = lambda x: F.unix_millis(x.cast("timestamp"))
            far = F.abs(millis(c) - millis(F.lit(origin)))
        else:
            far = F.abs(c.cast("double") - float(origin))
        match = match | c.isNotNull()
        score = score + F.coalesce(pivot / (pivot + far), F.lit(0.0))
    return Hit(match, score)


def geo_within(spec: dict, scope: Scope) -> Hit:
    c = scope.column(spec["path"])
    lon, lat = c["lon"], c["lat"]
    if "circle" in spec:
        hit = geo.distance(lon, lat, spec["circle"]["center"]["coordinates"]) <= float(spec["circle"]["radius"])
    elif "box" in spec:
        hit = geo.in_box(lon, lat, spec["box"]["bottomLeft"]["coordinates"], spec["box"]["topRight"]["coordinates"])
    elif "geometry" in spec:
        hit = geo.in_geometry(lon, lat, spec["geometry"])
    else:
        raise ValueError("geoWithin needs a box, circle or geometry")
    return Hit(F.coalesce(hit, F.lit(False)), F.lit(1.0))


def geo_shape(spec: dict, scope: Scope) -> Hit:
    """The relation of stored shapes to a geometry: of points (lon, lat) to a polygon, and of boxes (west, south, east, north)
    to a point or an upright box."""
    relation, geometry, paths = spec["relation"], spec["geometry"], paths_of(spec["path"])
    if relation not in ("contains", "disjoint", "intersects", "within"):
        raise ValueError(f"unknown relation {relation}")
    each = []
    for path in paths:
        c = scope.column(path)
        if "west" in getattr(scope.type_of(path), "names", []):
            each.append(c.isNotNull() & geo.box_relation(c["west"], c["south"], c["east"], c["north"], relation, geometry))
            continue
        if geometry["type"] == "Point":
            same = (c["lon"] == float(geometry["coordinates"][0])) & (c["lat"] == float(geometry["coordinates"][1]))
            if relation == "within":
                raise ValueError("nothing lies within a point")
            hit = ~same if relation == "disjoint" else same
        elif relation == "contains":
            hit = F.lit(False)
        else:
            inside = geo.in_geometry(c["lon"], c["lat"], geometry)
            hit = ~inside if relation == "disjoint" else inside
        each.append(c.isNotNull() & hit)
    return Hit(F.coalesce(_either(each), F.lit(False)), F.lit(1.0))


def mql(spec: dict, scope: Scope) -> Column:
    """A filter in comparison syntax; keys are joined by and, an empty filter matches all."""
    out = F.lit(True)
    for key, arg in spec.items():
        if key in ("$and", "$or", "$nor"):
            parts = [mql(x, scope) for x in arg]
            one = parts[0]
            for p in parts[1:]:
                one = one & p if key == "$and" else one | p
            out = out & (~one if key == "$nor" else one)
        elif isinstance(arg, dict) and any(k.startswith("$") for k in arg):
            out = out & _clauses(key, arg, scope)
        else:
            out = out & test_of(scope, key, "eq", arg)
    return out


def _clauses(path: str, arg: dict, scope: Scope) -> Column:
    out = F.lit(True)
    for op, value in arg.items():
        if op in ("$in", "$nin") and not isinstance(value, list):
            raise ValueError(f"{op} needs a list")
        if op == "$not":
            one = ~_clauses(path, value, scope)
        elif op == "$exists":
            one = scope.column(path).isNotNull() if value else scope.column(path).isNull()
        elif op in ("$in", "$nin"):
            one = F.lit(False)
            for v in value:
                one = one | test_of(scope, path, "eq", v)
            one = ~one if op == "$nin" else one
        elif op == "$ne":
            one = ~test_of(scope, path, "eq", value)
        elif op in ("$eq", "$gt", "$gte", "$lt", "$lte"):
            one = test_of(scope, path, op[1:], value)
        else:
            raise ValueError(f"unknown comparison {op}")
        out = out & one
    return out
