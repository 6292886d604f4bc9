"""Graph pattern algebra: basic patterns, joins, optional parts, unions, filters, groups; compiled to DataFrames and to SQL.

A variable is a column; an unbound variable is NULL. Results are bags, as in SPARQL. Patterns are joined along shared
variables, constants first, and never as a product. Expressions are SQL text that Spark and DuckDB read alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.kg_views import PREFIXES, TYPE, triples_sql


#: What values of variables begin with: one of these.
Kinds = dict[str, frozenset[str]]


def term(text: str) -> str:
    """A variable with its ?, or the constant that a term stands for."""
    if text.startswith("?"):
        return text
    if text == "a":
        return TYPE
    if text.startswith("<"):
        return text[1:-1]
    if text.startswith('"'):
        return text[1:].rsplit('"', 1)[0]
    prefix, _, name = text.partition(":")
    return PREFIXES[prefix] + name


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quoted(text: str) -> str:
    """A string literal that Spark and DuckDB read alike: no sign of the text ends it or escapes another."""
    return "concat(" + ", ".join(f"chr({ord(c)})" if c in "'\\" else f"'{c}'" for c in text) + ", '')" if "'" in text or "\\" in text else f"'{text}'"


def _duck(expression: str) -> str:
    """The expression for DuckDB, which names one function otherwise."""
    return expression.replace("startswith(", "starts_with(")


class Node:
    """A part of a plan: ``frame`` compiles it for Spark, ``sql`` for DuckDB; ``names`` are its variables."""

    def frame(self, graph) -> DataFrame:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def unbound(self) -> set[str]:
        """Variables that have no value in some rows: an optional part or a part of a union did not bind them."""
        child = getattr(self, "child", None)
        return child.unbound() & set(self.names) if child is not None else set()

    def query(self) -> str:
        return f"WITH triples AS ({triples_sql()}) {self.sql()}"

    def __add__(self, other: Node) -> Node:
        return Join(self, other)

    def optional(self, *patterns: str | Node) -> Node:
        return Join(self, _node(*patterns), "left")

    def where(self, expression: str) -> Node:
        return Where(self, expression)

    def bind(self, **columns: str) -> Node:
        return Bind(self, columns)

    def group(self, keys: list[str], **aggregates: str) -> Node:
        return Group(self, keys, aggregates)

    def select(self, *names: str, distinct: bool = False) -> Node:
        return Select(self, list(names), distinct)

    def top(self, order: list[str], limit: int | None = None, offset: int = 0) -> Node:
        return Top(self, order, limit, offset)


@dataclass
class Pattern(Node):
    s: str
    p: str
    o: str

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(x[1:] for x in (self.s, self.p, self.o) if x.startswith("?")))

    def _parts(self) -> tuple[dict[str, str], list[tuple[str, str]]]:
        """Columns by variable, and conditions (column, constant or other column)."""
        columns: dict[str, str] = {}
        conditions = []
        for col, x in (("s", self.s), ("p", self.p), ("o", self.o)):
            if not x.startswith("?"):
                conditions.append((col, _quoted(x)))
            elif x[1:] in columns:
                conditions.append((col, columns[x[1:]]))
            else:
                columns[x[1:]] = col
        return columns, conditions

    def frame(self, graph, needed: set[str] | None = None, prefix: str = "", kinds: Kinds | None = None) -> DataFrame:
        """With ``needed`` only those variables; ``prefix``: the predicate variable's value begins so; ``kinds``: what values of other variables begin with."""
        constant = lambda x: None if x.startswith("?") else x
        columns, conditions = self._parts()
        shown = {n: c for n, c in columns.items() if needed is None or n in needed}
        used = [*shown.values(), *(c for c, _ in conditions), *(v for _, v in conditions if v in ("s", "p", "o"))]
        df = graph.scan(constant(self.p), constant(self.o), tuple(c for c in ("s", "p", "o") if c in used) or ("p",), prefix, **({"ends": (kinds.get(self.s[1:]), kinds.get(self.o[1:]))} if kinds and hasattr(graph, "kinds") else {}))
        for col, value in conditions:
            df = df.where(f"{col} = {value}")
        return df.select(*(F.col(c).alias(n) for n, c in shown.items()))

    def sql(self) -> str:
        columns, conditions = self._parts()
        shown = ", ".join(f'{c} AS "{n}"' for n, c in columns.items()) or "1 AS one"
        test = " AND ".join(f"{c} = {v}" for c, v in conditions)
        return f"SELECT {shown} FROM triples" + (f" WHERE {test}" if test else "")


@dataclass
class FirstSame(Pattern):
    """The pattern of same-as triples where a query asks for the first ``limit`` rows by their subject, with subjects that come before their objects: a graph that knows them gives no others."""

    limit: int = 0

    def frame(self, graph, needed: set[str] | None = None, prefix: str = "", kinds: Kinds | None = None) -> DataFrame:
        if not hasattr(graph, "first_same"):
            return super().frame(graph, needed, prefix, kinds)
        shown = {n: c for n, c in self._parts()[0].items() if needed is None or n in needed}
        return graph.first_same(self.limit).select(*(F.col(c).alias(n) for n, c in shown.items()))


def _prefixes(expression: str) -> dict[str, str]:
    """Variables that must begin with a text, by an expression of tests that all must hold."""
    return {} if re.search(r"\bOR\b", expression, re.IGNORECASE) else dict(re.findall(r"\b(\w+) LIKE '([^'%_]*)%'(?= AND |$)", expression))


def _both(a: Kinds, b: Kinds) -> Kinds:
    """What values of variables begin with where both hold."""
    return a | b | {n: frozenset(max(x, y, key=len) for x in a[n] for y in b[n] if x.startswith(y) or y.startswith(x)) for n in a.keys() & b.keys()}


def _kinds(node: Node, graph, begins: dict[str, str]) -> Kinds:
    """What the values of a node's variables begin with, as far as the graph knows it of its patterns."""
    if isinstance(node, Pattern):
        constant = lambda x: None if x.startswith("?") else x
        known = graph.kinds(constant(node.p), constant(node.o), begins.get(node.p[1:], "") if node.p.startswith("?") else "") if hasattr(graph, "kinds") else (None, None)
        return {x[1:]: frozenset(k) for x, k in zip((node.s, node.o), known) if x.startswith("?") and k is not None}
    if isinstance(node, Where):
        return _kinds(node.child, graph, begins | _prefixes(node.expression))
    if isinstance(node, Hinted):
        return _kinds(node.child, graph, begins)
    if isinstance(node, Join):
        left = _kinds(node.left, graph, begins)
        found = left if node.how == "left" else _both(left, _kinds(node.right, graph, begins))
        loose = node.left.unbound() | node.right.unbound()
        return {n: k for n, k in found.items() if n not in loose}
    return {}


def _framed(node: Node, graph, needed: set[str] | None, begins: dict[str, str] | None = None, kinds: Kinds | None = None) -> DataFrame:
    """The frame of a node of which only some variables are needed (None: all), where others begin with what is known, or with one of several (``kinds``): all is told to the patterns
    below, as far as tests and joins let it through. What is told may be left undone; the tests and joins stay."""
    begins, kinds = begins or {}, kinds or {}
    if isinstance(node, Pattern):
        return node.frame(graph, needed, begins.get(node.p[1:], "") if node.p.startswith("?") else "", kinds)
    if isinstance(node, Where):
        words = set(re.findall(r"\w+", node.expression))
        below = _framed(node.child, graph, needed and needed | (words & set(node.names)), begins | _prefixes(node.expression), kinds)
        return below.where(node.expression)
    if isinstance(node, Hinted):
        return node.narrowed(graph, _framed(node.child, graph, needed and needed | {node.key}, begins, kinds))
    if isinstance(node, Join):
        shared = node.shared()
        below = needed and needed | set(shared)
        loose = node.left.unbound() | node.right.unbound()
        known = _both({n: k for n, k in kinds.items() if n not in loose}, _kinds(node, graph, begins))
        right = known if node.how == "inner" else {n: k for n, k in known.items() if n in shared}
        return node.compatible(_framed(node.left, graph, below, begins, known), _framed(node.right, graph, below, begins if node.how == "inner" else {}, right), shared)
    return node.frame(graph)


@dataclass
class Join(Node):
    left: Node
    right: Node
    how: str = "inner"

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys([*self.left.names, *self.right.names]))

    def shared(self) -> list[str]:
        shared = [n for n in self.left.names if n in self.right.names]
        if not shared:
            raise ValueError("patterns without a shared variable are a product")
        return shared

    def unbound(self) -> set[str]:
        left, right, both = self.left.unbound(), self.right.unbound(), set(self.left.names) & set(self.right.names)
        if self.how == "left":
            return left | (set(self.right.names) - set(self.left.names))
        return (left & right) | (left - both) | (right - both)

    def compatible(self, left: DataFrame, right: DataFrame, shared: list[str]) -> DataFrame:
        """Rows whose shared variables agree, where one without a value agrees with any: the left rows are parted by the shared variables that they lack, and each part is an equi-join on
        the others. On the right a lacking variable is taken into account for inner joins; for optional parts it is not (their rows are what they bind)."""
        loose = [n for n in shared if n in self.left.unbound()]
        other = [n for n in shared if n in self.right.unbound() and self.how == "inner"]
        if not loose and not other:
            return left.join(right, shared, self.how)
        parts = None
        for lacks_left in _subsets(loose):
            for lacks_right in _subsets(other):
                a, b = _lacking(left, loose, lacks_left), _lacking(right, other, lacks_right)
                on = [n for n in shared if n not in lacks_left and n not in lacks_right]
                if not on:
                    raise ValueError(f"rows without a value of {shared} would be a product")
                free = [n for n in shared if n not in on]
                b = b.select(*(F.col(n).alias(f"__{n}") if n in free else F.col(n) for n in b.columns))
                joined = a.join(b, on, self.how)
                joined = joined.select(*(F.coalesce(n, f"__{n}").alias(n) if n in free else F.col(n) for n in [c for c in joined.columns if not c.startswith("__") or c[2:] not in free]))
                parts = joined if parts is None else parts.unionByName(joined)
        return parts

    def frame(self, graph) -> DataFrame:
        return _framed(self, graph, None)

    def sql(self) -> str:
        shared = self.shared()
        loose = [n for n in shared if n in self.left.unbound() or (n in self.right.unbound() and self.how == "inner")]
        if not loose:
            word = "NATURAL LEFT JOIN" if self.how == "left" else "NATURAL JOIN"
            return f"SELECT * FROM ({self.left.sql()}) {word} ({self.right.sql()})"
        test = " AND ".join(f'(a."{n}" = b."{n}"' + (f' OR a."{n}" IS NULL' + (f' OR b."{n}" IS NULL' if self.how == "inner" else "") if n in loose else "") + ")" for n in shared)
        shown = ", ".join(f'coalesce(a."{n}", b."{n}") AS "{n}"' if n in shared else f'{"a" if n in self.left.names else "b"}."{n}"' for n in self.names)
        return f"SELECT {shown} FROM ({self.left.sql()}) a {'LEFT ' if self.how == 'left' else ''}JOIN ({self.right.sql()}) b ON {test}"


def _subsets(names: list[str]) -> list[set[str]]:
    return [set(c) for k in range(len(names) + 1) for c in combinations(names, k)]


def _lacking(df: DataFrame, names: list[str], lacks: set[str]) -> DataFrame:
    """Rows that have no value of just these of the names."""
    for n in names:
        df = df.where(F.col(n).isNull() if n in lacks else F.col(n).isNotNull())
    return df


@dataclass
class Union(Node):
    parts: list[Node]

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(n for p in self.parts for n in p.names))

    def unbound(self) -> set[str]:
        return {n for n in self.names if any(n not in p.names or n in p.unbound() for p in self.parts)}

    def frame(self, graph) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.frame(graph) for p in self.parts))

    def sql(self) -> str:
        return " UNION ALL BY NAME ".join(f"({p.sql()})" for p in self.parts)


@dataclass
class Where(Node):
    child: Node
    expression: str

    @property
    def names(self) -> list[str]:
        return self.child.names

    def frame(self, graph) -> DataFrame:
        return _framed(self, graph, None)

    def sql(self) -> str:
        return f"SELECT * FROM ({self.child.sql()}) WHERE {_duck(self.expression)}"


@dataclass
class Hinted(Node):
    """The child's rows whose ``key`` is one of those that ``reach`` has, where no others are asked for: all that can be in the result, or (``first``) its first ones in ascending order,
    as many as rows. If there are few they are looked up when the plan is made, and joins on the key read only what belongs to them; if many, the rows are the child's. Up to ``sent`` rows
    that are themselves what can be reached are sent to the rows that they are joined with, which are not shuffled then."""

    child: Node
    key: str
    reach: Node
    first: int = 0
    most: int = 2000
    sent: int = 100_000

    @property
    def names(self) -> list[str]:
        return self.child.names

    def narrowed(self, graph, df: DataFrame) -> DataFrame:
        keys = self.reach.frame(graph).select(self.key).where(F.col(self.key).isNotNull()).distinct()
        found = (keys.orderBy(self.key).limit(self.first) if self.first else keys.limit(self.most + 1)).collect()
        if len(found) <= max(self.most, self.first):
            return df.where(F.col(self.key).isin([r[0] for r in found]))
        return F.broadcast(df) if self.reach == self.child and df.limit(self.sent + 1).count() <= self.sent else df

    def frame(self, graph) -> DataFrame:
        return _framed(self, graph, None)

    def sql(self) -> str:
        return self.child.sql()


@dataclass
class Leading(Node):
    """The first ``rows`` of the child's rows in an order that begins with ``key`` ascending, and maybe others. ``reach`` has keys: up to the least of them, one more and more, rows are made and
    counted until there are enough; where there are not, all rows are the child's."""

    child: Node
    key: str
    reach: Node
    rows: int

    @property
    def names(self) -> list[str]:
        return self.child.names

    def frame(self, graph) -> DataFrame:
        df, many = self.child.frame(graph), self.rows
        keys = self.reach.frame(graph).select(self.key).where(F.col(self.key).isNotNull()).distinct().orderBy(self.key)
        while many <= 64 * self.rows:
            found = keys.limit(many).agg(F.max(self.key), F.count(F.lit(1))).first()
            if found[1] < many:
                break
            some = df.where(F.col(self.key) <= found[0])
            if some.limit(self.rows).count() == self.rows:
                return some
            many *= 8
        return df

    def sql(self) -> str:
        return self.child.sql()


@dataclass
class CrossTypes(Node):
    """The child's groups (type1, type2) of linked entities with their ``name``, where a graph counts them without making its triples."""

    child: Node
    prefix: str
    name: str

    @property
    def names(self) -> list[str]:
        return self.child.names

    def frame(self, graph) -> DataFrame:
        return graph.cross_types(self.prefix).withColumnRenamed("n", self.name) if hasattr(graph, "cross_types") else self.child.frame(graph)

    def sql(self) -> str:
        return self.child.sql()


@dataclass
class Bind(Node):
    child: Node
    columns: dict[str, str]

    @property
    def names(self) -> list[str]:
        return [*self.child.names, *self.columns]

    def frame(self, graph) -> DataFrame:
        return self.child.frame(graph).withColumns({n: F.expr(e) for n, e in self.columns.items()})

    def sql(self) -> str:
        return f"SELECT *, {', '.join(f'{_duck(e)} AS "{n}"' for n, e in self.columns.items())} FROM ({self.child.sql()})"


@dataclass
class Group(Node):
    child: Node
    keys: list[str]
    aggregates: dict[str, str]

    @property
    def names(self) -> list[str]:
        return [*self.keys, *self.aggregates]

    def frame(self, graph) -> DataFrame:
        words = {w for e in self.aggregates.values() for w in re.findall(r"\w+", e)}
        return _framed(self.child, graph, ({*self.keys} | words) & set(self.child.names)).groupBy(*self.keys).agg(*(F.expr(e).alias(n) for n, e in self.aggregates.items()))

    def sql(self) -> str:
        shown = ", ".join([*self.keys, *(f'{e} AS "{n}"' for n, e in self.aggregates.items())])
        return f"SELECT {shown} FROM ({self.child.sql()})" + (f" GROUP BY {', '.join(self.keys)}" if self.keys else "")


@dataclass
class Select(Node):
    child: Node
    columns: list[str]
    distinct: bool = False

    @property
    def names(self) -> list[str]:
        return self.columns

    def unbound(self) -> set[str]:
        return {c for c in self.columns if c not in self.child.names or c in self.child.unbound()}

    def frame(self, graph) -> DataFrame:
        df = _framed(self.child, graph, set(self.columns) & set(self.child.names))
        df = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in self.columns))
        return df.distinct() if self.distinct else df

    def sql(self) -> str:
        have = self.child.names
        shown = ", ".join(f'"{c}"' if c in have else f'NULL AS "{c}"' for c in self.columns)
        return f"SELECT {'DISTINCT ' if self.distinct else ''}{shown} FROM ({self.child.sql()})"


@dataclass
class Top(Node):
    """ORDER BY, LIMIT and OFFSET; all variables follow as tie-breaks, so that the rows do not depend on partitions."""

    child: Node
    order: list[str]
    limit: int | None = None
    offset: int = 0
    names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.names = self.child.names

    def _order(self) -> str:
        given = [x.split()[0] for x in self.order]
        every = [*self.order, *(n for n in self.names if n not in given)]
        return ", ".join(f"{x} NULLS LAST" if " " in x else f"{x} ASC NULLS LAST" for x in every)

    def frame(self, graph) -> DataFrame:
        df = self.child.frame(graph).orderBy(*(F.expr(x.split()[0]).desc_nulls_last() if x.lower().endswith(" desc") else F.expr(x.split()[0]).asc_nulls_last() for x in [*self.order, *(n for n in self.names if n not in {y.split()[0] for y in self.order})]))
        df = df.offset(self.offset) if self.offset else df
        return df if self.limit is None else df.limit(self.limit)

    def sql(self) -> str:
        cut = (f" LIMIT {self.limit}" if self.limit is not None else "") + (f" OFFSET {self.offset}" if self.offset else "")
        return f"SELECT * FROM ({self.child.sql()}) ORDER BY {self._order()}{cut}"


@dataclass
class Counts(Node):
    """(``variable``, n): how often triples whose predicate begins with ``prefix`` have each predicate, or (``ends``) each subject or object, several rows each."""

    variable: str
    prefix: str
    ends: bool = False

    @property
    def names(self) -> list[str]:
        return [self.variable, "n"]

    def frame(self, graph) -> DataFrame:
        found = graph.ends(self.prefix) if self.ends else graph.predicate_counts(self.prefix)
        return found.toDF(self.variable, "n")

    def sql(self) -> str:
        test = f"WHERE p LIKE '{self.prefix}%'"
        if self.ends:
            return f'SELECT s AS "{self.variable}", 1 AS n FROM triples {test} UNION ALL SELECT o, 1 FROM triples {test}'
        return f'SELECT p AS "{self.variable}", count(*) AS n FROM triples {test} GROUP BY p'


@dataclass
class Pairs(Node):
    """The first ``limit`` pairs of rows of ``side`` that have the same ``shared`` variable, the first with the lesser ``who``, and with different values of ``apart`` (if given).

    Rows of ``side`` are paired once with themselves: a variable x but the shared ones becomes x1 and x2. ``columns`` are the result's, in which pairs are ordered; all of the first row's
    but for shared ones come before the second row's, and who1 first. Only rows that can be in one of the first pairs are paired. With k the limit, take a pair (l, r) of the first k of one
    shared value. Each row before l whose ``who`` is lesser makes an earlier pair, with r or (where it is not apart from r) with l: there are less than k. So does, with l, each row
    between l and r that is apart from l. So r is among the first 2k of its value of ``apart`` and, where of each value 2k are kept, among the first 4k of all;
    without ``apart`` among the first 2k. These are counted in distinct values of ``who``, bounded in each task before anything is shuffled.
    """

    side: Node
    shared: list[str]
    who: str
    columns: list[str]
    limit: int
    apart: str | None = None

    @property
    def names(self) -> list[str]:
        return self.columns

    def _order(self) -> list[str]:
        own = [c for c in self.columns if c not in self.shared]
        if not own[0] == self.who + "1" or [c[-1] for c in own] != sorted(c[-1] for c in own):
            raise ValueError("pairs are ordered by their first row, beginning with who, and then by the second")
        return self.columns

    def frame(self, graph) -> DataFrame:
        key, rows = self.shared[0], self.side.frame(graph)
        first = lambda df, k, *by: df.withColumn("__r", F.dense_rank().over(Window.partitionBy(*by).orderBy(self.who))).where(F.col("__r") <= k).drop("__r")
        if self.apart:
            rows = first(first(rows, 2 * self.limit, key, self.apart), 4 * self.limit, key)
        else:
            rows = first(rows, 2 * self.limit, key)
        # What is left of a shared value is a short list, in which all pairs are made.
        own = [n for n in self.side.names if n not in self.shared]
        lists = rows.groupBy(*self.shared).agg(F.collect_list(F.struct(*own)).alias("rows"))
        fits = lambda a, b: (a[self.who] < b[self.who]) & (a[self.apart] != b[self.apart] if self.apart else F.lit(True))
        pairs = F.flatten(F.transform("rows", lambda a: F.transform(F.filter("rows", lambda b: fits(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        made = lists.select(*self.shared, F.explode(pairs).alias("p"))
        shown = [F.col(c) if c in self.shared else F.col(f"p.{'ab'[int(c[-1]) - 1]}.{c[:-1]}").alias(c) for c in self.columns]
        return made.select(*shown).orderBy(*(F.col(c).asc_nulls_last() for c in self._order())).limit(self.limit)

    def sql(self) -> str:
        shown = ", ".join(f'a."{c}"' if c in self.shared else f'{"ab"[int(c[-1]) - 1]}."{c[:-1]}" AS "{c}"' for c in self.columns)
        test = " AND ".join([*(f'a."{k}" = b."{k}"' for k in self.shared), f'a."{self.who}" < b."{self.who}"', *([f'a."{self.apart}" <> b."{self.apart}"'] if self.apart else [])])
        order = ", ".join(f'"{c}" ASC NULLS LAST' for c in self._order())
        return f"SELECT {shown} FROM ({self.side.sql()}) a JOIN ({self.side.sql()}) b ON {test} ORDER BY {order} LIMIT {self.limit}"


def _node(*parts: str | Node) -> Node:
    """Patterns and nodes joined so that each shares a variable with those before it; patterns with more constants first."""
    left: list[Node] = [p if isinstance(p, Node) else Pattern(*map(term, p.split(None, 2))) for p in parts]
    rank = lambda n: -sum(not x.startswith("?") for x in (n.s, n.p, n.o)) if isinstance(n, Pattern) else 0
    left.sort(key=rank)
    out = left.pop(0)
    while left:
        k = next((k for k, n in enumerate(left) if set(n.names) & set(out.names)), None)
        if k is None:
            raise ValueError("patterns without a shared variable are a product")
        out = Join(out, left.pop(k))
    return out


def match(*parts: str | Node) -> Node:
    """A basic graph pattern: strings ``subject predicate object`` of variables, prefixed names, <iris> and "literals"."""
    return _node(*parts)
