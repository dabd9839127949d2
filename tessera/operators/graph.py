"""Property graphs: nodes (id, attributes) and edges (src, dst, attributes). Patterns become joins; hops of variable
length become a frontier that is joined with the edges, level by level."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import EdgePart, NodePart, Query, Test, parse
from ..session import cut, last_of


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = True
    label_field: str | None = None

    # looking up

    def node(self, i: object) -> DataFrame:
        return self.nodes.where(F.col("id") == F.lit(i))

    def edge(self, src: object, dst: object) -> DataFrame:
        return self._both().where((F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst)))

    def neighbors(self, i: object) -> DataFrame:
        return self._both().where(F.col("src") == F.lit(i)).select(F.col("dst").alias("id"))

    successors = neighbors

    def predecessors(self, i: object) -> DataFrame:
        return self._both().where(F.col("dst") == F.lit(i)).select(F.col("src").alias("id"))

    def out_edges(self, i: object) -> DataFrame:
        """(id, attributes) of the edges from a node."""
        return self._both().where(F.col("src") == F.lit(i)).withColumnRenamed("dst", "id").drop("src")

    def in_edges(self, i: object) -> DataFrame:
        """(id, attributes) of the edges to a node."""
        return self._both().where(F.col("dst") == F.lit(i)).withColumnRenamed("src", "id").drop("dst")

    def declared_edges(self) -> DataFrame:
        """Edges whose source is a declared node."""
        return self._both().join(self.nodes.select(F.col("id").alias("src")), "src", "left_semi")

    def has_node(self, i: object) -> bool:
        return not self.node(i).isEmpty()

    def has_edge(self, src: object, dst: object) -> bool:
        return not self.edge(src, dst).isEmpty()

    def nodes_with_label(self, label: str) -> DataFrame:
        if not self.label_field:
            raise ValueError("the graph has no label field")
        return self.nodes.where(F.col(self.label_field).cast("string") == label).select("id")

    def _both(self) -> DataFrame:
        """Edges as they are walked: undirected ones go both ways."""
        if self.directed:
            return self.edges
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        turned = self.edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
        return self.edges.unionByName(turned).dropDuplicates(["src", "dst"])

    def degrees(self, kind: str = "out") -> DataFrame:
        """(id, degree) of nodes that have edges: out, in, or both; undirected: out."""
        edges = self._both()
        out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        if kind == "out" or not self.directed:
            return out
        into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
        return into if kind == "in" else out.union(into).groupBy("id").agg(F.sum("degree").alias("degree"))

    def counts(self) -> DataFrame:
        """(nodes, edges): edges from declared nodes; an undirected one counts for either end."""
        return self.nodes.agg(F.count("*").alias("nodes")).crossJoin(self._both().join(self.nodes.select(F.col("id").alias("src")), "src", "left_semi").agg(F.count("*").alias("edges")))

    # changes

    def add_nodes(self, new: DataFrame, order: str | None = None) -> Graph:
        """Nodes put in or put over; of one id the last by `order`, or else by place, wins."""
        rows = last_of(new, ["id"], order)
        rows = rows.drop(order) if order and order not in self.nodes.columns else rows
        return replace(self, nodes=self.nodes.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True))

    def add_edges(self, new: DataFrame, order: str | None = None) -> Graph:
        """Edges put in or put over; of one pair of ends (in either direction where the graph is undirected) the last wins. Nodes aren't made."""
        if not self.directed:
            new = new.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
        rows = last_of(new, ["src", "dst"], order)
        rows = rows.drop(order) if order and order not in self.edges.columns else rows
        gone = rows.select("src", "dst")
        if not self.directed:
            gone = gone.union(rows.select("dst", "src"))
        return replace(self, edges=self.edges.join(gone, ["src", "dst"], "left_anti").unionByName(rows, allowMissingColumns=True))

    def remove_nodes(self, gone: DataFrame) -> Graph:
        """With the edges at them."""
        ids = gone.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return replace(self, nodes=self.nodes.join(ids, "id", "left_anti"), edges=edges.select(*self.edges.columns))

    def remove_edges(self, gone: DataFrame) -> Graph:
        return replace(self, edges=self.edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti").select(*self.edges.columns))

    # walking

    def step(self, direction: str) -> DataFrame:
        """Edges for one hop: (src, dst, attributes) from where the hop starts."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        walked = self._both()
        turned = walked.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
        if direction == "out" or not self.directed:
            return walked
        if direction == "in":
            return turned
        # a neighbour on both sides counts once, by the outgoing edge
        return walked.unionByName(turned.join(walked.select("src", "dst"), ["src", "dst"], "left_anti"))

    def reachable(self, sources: DataFrame, low: int, high: int, direction: str = "out") -> DataFrame:
        """(source, id, depth): nodes whose shortest distance is from low to high hops, for every source. low 0 has the source itself."""
        hop = self.step(direction).select("src", "dst").distinct().persist()
        frontier = cut(sources.select(F.col("id").alias("source"), F.col("id").alias("id")).distinct())
        levels = [frontier.withColumn("depth", F.lit(0))]
        visited = frontier
        for depth in range(1, high + 1):
            frontier = cut(frontier.join(hop, frontier["id"] == hop["src"]).select("source", F.col("dst").alias("id")).distinct().join(visited, ["source", "id"], "left_anti"))
            if frontier.isEmpty():
                break
            levels.append(frontier.withColumn("depth", F.lit(depth)))
            visited = visited.union(frontier)
        hop.unpersist()
        return reduce(DataFrame.union, levels).where(F.col("depth").between(low, high))

    # patterns

    def _match(self, part: NodePart, var: str) -> DataFrame:
        df = self.nodes
        if part.label is not None:
            if not self.label_field:
                raise ValueError("the graph has no label field")
            df = df.where(F.col(self.label_field).cast("string") == part.label)
        for k, v in part.props.items():
            df = df.where(F.col(k) == F.lit(v) if k in df.columns else F.lit(False))
        return df.select(*[F.col(c).alias(f"{var}.{c}") for c in df.columns], F.lit(True).alias(f"{var}.__node"))

    @staticmethod
    def _column(var: str, name: str) -> Column:
        return F.col(f"`{var}.{name}`")

    def _test(self, t: Test, columns: list[str]) -> Column:
        name = f"{t.var}.{'id' if t.kind == 'id' else t.name}"
        if name not in columns:
            return F.lit(False)
        c = F.col(f"`{name}`")
        if t.op == "in":
            return F.coalesce(c.isin(t.value), F.lit(False)) if t.value else F.lit(False)
        v = F.lit(t.value)
        test = {"==": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[t.op]
        return F.coalesce(test, F.lit(False))

    def _hop(self, left: DataFrame, at: str, edge: EdgePart, edge_var: str, part: NodePart, var: str) -> DataFrame:
        hop = self.step(edge.direction)
        hop = hop.select(*[F.col(c).alias(f"{edge_var}.{c}") for c in hop.columns])
        df = left.join(hop, self._column(at, "id") == self._column(edge_var, "src"))
        return self._land(df, self._column(edge_var, "dst"), part, var)

    def _land(self, df: DataFrame, at: Column, part: NodePart, var: str) -> DataFrame:
        """A hop's end: it may be undeclared, unless the pattern says something of it."""
        node = self._match(part, var)
        fixed = part.label is not None or bool(part.props)
        df = df.withColumn("__at", at).join(node, F.col("__at") == self._column(var, "id"), "inner" if fixed else "left")
        return df.withColumn(f"{var}.id", F.col("__at")).drop("__at")

    def query_iter(self, text: str) -> Iterator[dict]:
        """The query's rows one by one, a partition at a time."""
        return (r.asDict(True) for r in self.query(text).toLocalIterator())

    def query(self, text: str) -> DataFrame:
        """Rows of the pattern's items, named as they are written."""
        q = parse(text, self.label_field)
        # names in a chain may come again; the last one is meant
        names = [n.var or f"__n{i}" for i, n in enumerate(q.nodes)]
        inner = [f"__v{i}" if names[i] in names[i + 1 :] else names[i] for i in range(len(names))]
        edge_names = [e.var or f"__e{i}" for i, e in enumerate(q.edges)]
        start = self._match(q.nodes[0], inner[0])
        first = q.edges[0]
        if first.variable:
            seeds = start
            for t in q.where[0] if len(q.where) == 1 else []:
                if t.var == inner[0]:
                    seeds = seeds.where(self._test(t, start.columns))
            found = self.reachable(seeds.select(self._column(inner[0], "id").alias("id")), first.low, first.high, first.direction)
            df = start.join(found.select(F.col("source").alias("__source"), F.col("id").alias("__found")), self._column(inner[0], "id") == F.col("__source"))
            df = self._land(df, F.col("__found"), q.nodes[1], inner[1]).drop("__source", "__found")
        elif first.optional:
            stay = self._land(start, self._column(inner[0], "id"), q.nodes[1], inner[1])
            df = stay.unionByName(self._hop(start, inner[0], first, edge_names[0], q.nodes[1], inner[1]), allowMissingColumns=True)
        else:
            df = start
            for i, e in enumerate(q.edges):
                df = self._hop(df, inner[i], e, edge_names[i], q.nodes[i + 1], inner[i + 1])
        if q.where:
            df = df.where(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [self._test(t, df.columns) for t in tests]) for tests in q.where]))
        df = self._items(df, q, edge_names)
        return df if q.limit is None else df.limit(q.limit)

    def _items(self, df: DataFrame, q: Query, edge_names: list[str]) -> DataFrame:
        def attributes(var: str) -> Column:
            own = [c for c in df.columns if c.startswith(f"{var}.") and not c.endswith(".__node") and not (var in edge_names and c.split(".")[1] in ("src", "dst"))]
            return F.struct(*[F.col(f"`{c}`").alias(c.split(".", 1)[1]) for c in own]) if own else F.lit(None).cast("string")

        out = []
        if q.items:
            for it in q.items:
                name = f"{it.var}.{'id' if it.kind == 'id' else it.name}"
                if it.kind == "var":
                    out.append(attributes(it.var).alias(it.text))
                else:
                    out.append((F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")).alias(it.text))
            return df.select(*out)
        for n in dict.fromkeys(n.var for n in q.nodes if n.var):
            out += [attributes(n).alias(n), self._column(n, "id").alias(f"id({n})")]
        out += [attributes(e.var).alias(e.var) for e in q.edges if e.var]
        return df.select(*out)
