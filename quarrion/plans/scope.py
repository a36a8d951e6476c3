"""What an operator compiles against: columns by path, tokens of a path, and statistics of the whole index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.functions.analysis import Analyzer, custom, stock

from .definition import IndexDefinition


@dataclass
class Hit:
    """A compiled operator: whether a row matches, and its relevance where it does.

    plain: a condition that every match meets and that needs no derived column, so it can go down to the scan.
    """

    match: Column
    score: Column
    plain: Column | None = None


class Statistics:
    """Totals and term lists over all documents.

    A compilation records what it lacks and goes on with stand-ins; `run` finds it, and the next compilation uses it.
    """

    def __init__(self):
        self.wanted: dict[tuple, Column] = {}
        self.listed: dict[tuple, tuple] = {}
        self.found: dict[tuple, float] = {}
        self.lists: dict[tuple, list] = {}
        #: Whether matches depend on the totals, not relevance alone.
        self.selects = False

    @property
    def lacking(self) -> bool:
        return bool(self.wanted or self.listed)

    def get(self, name: tuple, total: Column) -> float:
        if name in self.found:
            return self.found[name]
        self.wanted[name] = total
        return 1.0

    def terms(self, name: tuple, tokens: Column, test, rank, most: int) -> list[tuple[str, float, int]] | None:
        """(term, rank, document frequency) of the `most` terms that pass a test, of the highest rank and in term order.
        None where they are not known yet."""
        name = (*name, most)
        self.selects = True
        if name not in self.lists:
            self.listed[name] = (tokens, test, rank, most)
        return self.lists.get(name)

    def run(self, docs: DataFrame) -> None:
        names = list(self.wanted)
        if names:
            row = docs.agg(*[self.wanted[n].alias(f"s{k}") for k, n in enumerate(names)]).first()
            self.found |= {n: float(row[k] or 0) for k, n in enumerate(names)}
        for name, (tokens, test, rank, most) in self.listed.items():
            one = docs.select(F.explode(F.array_distinct(F.filter(tokens, lambda t: F.coalesce(test(t), F.lit(False))))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
            top = one.select("t", rank(F.col("t")).alias("w"), "n").orderBy(F.desc("w"), "t").limit(most).collect()
            self.lists[name] = [(r.t, float(r.w), r.n) for r in top]
        self.wanted, self.listed = {}, {}


#: Between a path and the name of another analyzer of it.
MULTI = "\x00"


@dataclass
class Scope:
    """Root documents, or the elements of an array of structs at `prefix` within a lambda."""

    definition: IndexDefinition
    schema: T.StructType
    stats: Statistics = field(default_factory=Statistics)
    prefix: str = ""
    element: Column | None = None
    parent: Scope | None = None
    derived: dict[tuple, tuple[str, int, Column]] = field(default_factory=dict)

    def once(self, key: tuple, column: Column, layer: int) -> Column:
        """A root document's value as a column of its own, computed once however often operators use it.

        A layer may use the columns of those before it.
        """
        if self.element is not None:
            return column
        return F.col(self.derived.setdefault(key, (f"__derived{len(self.derived)}", layer, column))[0])

    def derive(self, docs: DataFrame) -> DataFrame:
        """docs with the columns that compiled operators use."""
        for layer in sorted({n for _, n, _ in self.derived.values()}):
            docs = docs.withColumns({name: column for name, n, column in self.derived.values() if n == layer})
        return docs

    def where(self, docs: DataFrame, hit: Hit) -> DataFrame:
        """The matching documents with the derived columns.

        What a match needs of plain columns is asked first and goes down to the scan, so no other text is analysed.  A row
        number in the whole condition keeps the optimiser from moving it below the derived columns, where it would analyse a
        text again for every use.
        """
        if hit.plain is not None:
            docs = docs.where(hit.plain)
        if not self.derived:
            return docs.where(hit.match)
        rows = self.derive(docs).withColumn("__derived", F.monotonically_increasing_id())
        return rows.where(hit.match & (F.col("__derived") >= 0))

    def plain(self, docs: DataFrame) -> DataFrame:
        """docs without the derived columns."""
        return docs.drop("__derived", *[name for name, _, _ in self.derived.values()])

    def type_of(self, path: str) -> T.DataType | None:
        """The type at a dotted path, None where there is no such column; arrays on the way are passed."""
        kind: T.DataType = self.schema
        for name in path.partition(MULTI)[0].split("."):
            while isinstance(kind, T.ArrayType):
                kind = kind.elementType
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return None
            kind = kind[name].dataType
        return kind

    def column(self, path: str) -> Column:
        """The column at a path; a path that the documents lack is null."""
        path = path.partition(MULTI)[0]
        if self.element is not None:
            if not path.startswith(self.prefix + "."):
                raise ValueError(f"{path} lies outside {self.prefix}")
            out = self.element
            for name in path[len(self.prefix) + 1 :].split("."):
                out = out.getField(name)
            return out
        if self.type_of(path) is None:
            return F.lit(None)
        return F.col(".".join(f"`{p}`" for p in path.split(".")))

    def raw_value(self, path: str, test) -> Column:
        """Whether the value, or one value of an array, passes; null where there is none, so that it can go down to the scan."""
        column = self.column(path)
        return F.exists(column, test) if isinstance(self.type_of(path), T.ArrayType) else test(column)

    def any_value(self, path: str, test) -> Column:
        return F.coalesce(self.raw_value(path, test), F.lit(False))

    def text_paths(self) -> list[str]:
        """The dotted paths of all strings, and of arrays of strings, outside of nested documents."""

        def walk(kind, path):
            if isinstance(kind, T.StructType):
                return [x for f in kind for x in walk(f.dataType, f"{path}.{f.name}" if path else f.name)]
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
            return [path] if isinstance(kind, T.StringType) and self.definition.of(path, "string", kind) is not None else []

        return walk(self.schema, "")

    def with_multi(self, path: str, name: str) -> str:
        """The path as its analyzer of that name sees it."""
        spec = self.definition.of(path, "string", self.type_of(path)) or {}
        if name not in spec.get("multi", {}):
            raise ValueError(f"{path} has no multi {name}")
        return f"{path}{MULTI}{name}"

    def analyzer(self, path: str) -> Analyzer:
        path, _, multi = path.partition(MULTI)
        spec = self.definition.of(path, "string", self.type_of(path)) or self.definition.of(path, "autocomplete", self.type_of(path)) or {}
        spec = spec["multi"][multi] if multi else spec
        name = spec.get("searchAnalyzer") or spec.get("analyzer") or self.definition.search_analyzer or self.definition.analyzer
        known = self.definition.analyzers
        return custom(known[name]) if name in known else stock(name)

    def index_analyzer(self, path: str) -> Analyzer:
        """The analyzer of stored texts; queries may have another."""
        plain, _, multi = path.partition(MULTI)
        spec = self.definition.of(plain, "string", self.type_of(plain)) or self.definition.of(plain, "autocomplete", self.type_of(plain)) or {}
        spec = spec["multi"][multi] if multi else spec
        name = spec.get("analyzer") or self.definition.analyzer
        known = self.definition.analyzers
        return custom(known[name]) if name in known else stock(name)

    def tokens(self, path: str) -> Column:
        """Tokens of the text, or of all texts of an array one after another; null where there is none."""
        column = self.column(path)
        analyze = self.index_analyzer(path)
        if isinstance(self.type_of(path), T.ArrayType):
            return self.once((path, "tokens"), F.flatten(F.transform(column, analyze)), 0)
        return self.once((path, "tokens"), analyze(column.cast("string")), 0)

    def inside(self, path: str, element: Column) -> Scope:
        return Scope(self.definition, self.schema, self.stats, path, element, self)
