"""A query session: variables, settings and the meaning of each statement.

Statements compile to lazy plans over id tables; an assignment binds the plan.
Commands give DataFrames or text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.functions.predicates import COMPARISONS, And, Compare, Not, Or, Predicate
from ancestra.operators import stats, transformers
from ancestra.operators.federation import remote_lineage
from ancestra.operators.graph import Graph, Store
from ancestra.plans.language import Assign, Binary, Call, Command, Name, Number, QueryError, Text, Unary, Variable, parse
from ancestra.sources import readers, writers

#: The settings there are, with their defaults (None: not set).
SETTINGS = {"precision": 3, "exportLimit": 4096, "maxDepth": None, "limit": None}

HELP = "assignment: $x = graph; %p = constraint. methods: getVertex getEdge getEdgeWithEndpoints getEdgeEndpoints getEdgeSource getEdgeDestination getMatch getNeighbor getLineage getLocalLineage getLink getPath getShortestPath getSubgraph span collapseEdge refineDependencies transform limit subset vertexSubset edgeSubset sample vertexSample edgeSample. commands: dump save stat describe pathlengths list erase reset native env remote help"


def _text(x) -> str:
    if isinstance(x, (Text, Name)):
        return x.text
    if isinstance(x, Number):
        return str(x.value)
    raise QueryError("expected text")


def _number(x) -> int:
    if isinstance(x, Number):
        return x.value
    raise QueryError("expected a number")


class Session:
    """Statements run against ``store``; ``hosts`` are further stores by name, for remote commands."""

    def __init__(self, store: Store, hosts: dict[str, Store] | None = None):
        self.store, self.hosts = store, hosts or {}
        self.graphs: dict[str, Graph] = {}
        self.constraints: dict[str, Predicate] = {}
        self.env: dict[str, int | None] = dict(SETTINGS)
        self.seed = 0

    def run(self, text: str):
        """The result of the last statement: a DataFrame, a text, a pair of DataFrames (dump) or None."""
        out = None
        for s in parse(text):
            out = self._assign(s) if isinstance(s, Assign) else self._command(s)
        return out

    # statements

    def _assign(self, s: Assign) -> None:
        name = s.target.text
        if name.startswith("%"):
            value = self.predicate(s.value)
            if s.op != "=":
                old = self._constraint(name)
                value = {"+=": Or(old, value), "-=": And(old, Not(value)), "&=": And(old, value)}[s.op]
            self.constraints[name] = value
            return
        if name == "$base" and s.op == "=":
            raise QueryError("$base can't be assigned")
        value = self.graph(s.value)
        if s.op != "=":
            old = self.graph(s.target)
            value = {"+=": old + value, "-=": old - value, "&=": old & value}[s.op]
        if name == "$base":
            raise QueryError("$base can't be assigned")
        self.graphs[name] = value.distinct().kept()

    def _command(self, c: Command):
        run: Callable | None = getattr(self, f"_do_{c.name}", None)
        if run is None:
            raise QueryError(f"unknown command {c.name!r}")
        return run(list(c.args))

    def _exportable(self, args: list) -> Graph:
        every = isinstance(args[0], Name) and args[0].text.lower() == "all"
        g = self.graph(args[1] if every else args[0])
        most = self.env["exportLimit"]
        if not every and most is not None:
            n = stats.counts(g).first()
            if n.vertices + n.edges > most:
                raise QueryError(f"{n.vertices + n.edges} elements are more than exportLimit {most}; use all")
        return g

    def _do_dump(self, args: list):
        """dump [all] $g | %p"""
        at = args[-1]
        if isinstance(at, Variable) and at.text.startswith("%") or not isinstance(at, Name) and self._is_predicate(at):
            return str(self.predicate(at))
        return self._exportable(args).export()

    def _do_save(self, args: list):
        """save [all] $g 'path': JSON if the path ends in .json, else DOT"""
        v, e = self._exportable(args[:-1]).export()
        path = _text(args[-1])
        (writers.write_json if path.endswith(".json") else writers.write_dot)(v, e, path)

    def _do_stat(self, args: list) -> DataFrame:
        """stat $g | stat vertex|edge key histogram|mean|std $g | stat vertex|edge key distribution n $g"""
        if len(args) == 1:
            return stats.counts(self.graph(args[0]))
        kind, key, what = _text(args[0]).lower(), _text(args[1]), _text(args[2]).lower()
        g = self.graph(args[-1])
        if what == "histogram":
            return stats.histogram(g, kind, key)
        if what in ("mean", "std"):
            return (stats.mean if what == "mean" else stats.std)(g, kind, key).withColumn(what, F.round(what, self.env["precision"]))
        if what == "distribution":
            n = _number(args[3])
            out = stats.distribution(g, kind, key, n)
            return out.select(F.round("low", self.env["precision"]).alias("low"), F.round("high", self.env["precision"]).alias("high"), "n")
        raise QueryError(f"unknown statistic {what!r}")

    def _do_describe(self, args: list) -> DataFrame:
        """describe $g vertex|edge [limit] | describe $g vertex|edge key count [limit] | ... key minmax"""
        g, kind, rest = self.graph(args[0]), _text(args[1]).lower(), args[2:]
        if not rest or isinstance(rest[0], Number):
            return stats.describe_keys(g, kind, _number(rest[0]) if rest else None)
        key, what = _text(rest[0]), _text(rest[1]).lower()
        if what == "count":
            return stats.describe_count(g, kind, key, _number(rest[2]) if len(rest) > 2 else None)
        if what == "minmax":
            return stats.describe_minmax(g, kind, key)
        raise QueryError(f"unknown description {what!r}")

    def _do_pathlengths(self, args: list) -> DataFrame:
        """pathlengths $g $from $to [depth]"""
        depth = _number(args[3]) if len(args) > 3 else self._depth(None, need=True)
        found = self.graph(args[0]).path_lengths(self.graph(args[1]), self.graph(args[2]), depth)
        return self.store.spark.createDataFrame([(x,) for x in found], "length int")

    def _do_list(self, args: list) -> DataFrame:
        """list [all|graph|constraint|env]"""
        what = _text(args[0]).lower() if args else "all"
        rows: list[tuple] = []
        if what in ("all", "graph"):
            for name, g in [("$base", self.store.base), *sorted(self.graphs.items())]:
                n = stats.counts(g).first()
                rows.append(("graph", name, f"{n.vertices} vertices, {n.edges} edges"))
        if what in ("all", "constraint"):
            rows += [("constraint", k, str(p)) for k, p in sorted(self.constraints.items())]
        if what in ("all", "env"):
            rows += [("env", k, "UNDEFINED" if x is None else str(x)) for k, x in sorted(self.env.items())]
        return self.store.spark.createDataFrame(rows, "kind string, name string, value string")

    def _do_erase(self, args: list) -> None:
        for a in args:
            if not isinstance(a, Variable):
                raise QueryError("erase takes variables")
            (self.graphs if a.text.startswith("$") else self.constraints).pop(a.text, None)

    def _do_reset(self, args: list) -> None:
        if [_text(a).lower() for a in args] != ["workspace"]:
            raise QueryError("reset workspace")
        self.graphs.clear()
        self.constraints.clear()

    def _do_native(self, args: list) -> DataFrame:
        """native 'sql': Spark SQL over views ``vertices`` and ``edges`` of the store"""
        self.store.vertices.createOrReplaceTempView("vertices")
        self.store.edges.createOrReplaceTempView("edges")
        return self.store.spark.sql(_text(args[0]))

    def _do_env(self, args: list):
        """env set name n | env unset name | env print name | env list"""
        what = _text(args[0]).lower()
        if what == "list":
            return self._do_list([Name("env")])
        name = next((k for k in self.env if k.lower() == _text(args[1]).lower()), None)
        if name is None:
            raise QueryError(f"unknown setting {_text(args[1])!r}")
        if what == "set":
            self.env[name] = int(_text(args[2]))
        elif what == "unset":
            self.env[name] = None
        elif what in ("print", "get"):
            return "UNDEFINED" if self.env[name] is None else str(self.env[name])
        return None

    def _do_remote(self, args: list):
        """remote link $x 'host' $y | unlink $x | list $x | clear $x | copy $x $y | query 'host' 'text' | create $x 'host' vertices | export $x"""
        what = _text(args[0]).lower()
        if what == "query":
            return Session(self._host(_text(args[1])), self.hosts).run(_text(args[2]))
        if what == "create":
            self.graphs[args[1].text] = self.store.empty()
        g = self.graph(args[1])
        if what in ("link", "create"):
            host = self._host(_text(args[2]))
            named = [x.text for x in args[3:] if isinstance(x, Text)]  # ids of vertices there; without any it is all of the host
            there = host.vertices_by_id(*named) if named else host.base
            g.remotes = g.remotes | {_Linked(_text(args[2]), there)}
        elif what in ("unlink", "clear"):
            name = _text(args[2]) if len(args) > 2 else None
            g.remotes = frozenset(r for r in g.remotes if name is not None and r.host != name)
        elif what == "copy":
            g.remotes = g.remotes | self.graph(args[2]).remotes
        elif what == "list":
            return self.store.spark.createDataFrame([(r.host,) for r in sorted(g.remotes, key=lambda r: r.host)], "host string")
        elif what == "export":
            v, e = g.export()
            for r in g.remotes:
                rv, re_ = r.graph.export()
                v, e = v.unionByName(rv), e.unionByName(re_)
            return v.dropDuplicates(["id"]), e.dropDuplicates(["id"])
        else:
            raise QueryError(f"unknown remote command {what!r}")
        self.graphs[args[1].text] = g
        return None

    def _host(self, name: str) -> Store:
        if name not in self.hosts:
            raise QueryError(f"unknown host {name!r}")
        return self.hosts[name]

    def _do_help(self, args: list) -> str:
        return HELP

    def _do_exit(self, args: list) -> None:
        return None

    _do_quit = _do_exit

    def _do_print(self, args: list) -> str:
        """print storage"""
        return "spark"

    # expressions

    def _constraint(self, name: str) -> Predicate:
        if name not in self.constraints:
            raise QueryError(f"unknown constraint {name}")
        return self.constraints[name]

    def _is_predicate(self, x) -> bool:
        return isinstance(x, Variable) and x.text.startswith("%") or isinstance(x, Unary) or isinstance(x, Binary) and (x.op in COMPARISONS or x.op in ("and", "or"))

    def predicate(self, x) -> Predicate:
        if isinstance(x, Variable) and x.text.startswith("%"):
            return self._constraint(x.text)
        if isinstance(x, Unary):
            return Not(self.predicate(x.of))
        if isinstance(x, Binary):
            if x.op in ("and", "or"):
                return (And if x.op == "and" else Or)(self.predicate(x.left), self.predicate(x.right))
            if x.op in COMPARISONS and isinstance(x.left, Name) and isinstance(x.right, (Text, Number)):
                return Compare(x.left.text, x.op, _text(x.right))
        raise QueryError("a comparison is: name operator 'text'")

    def graph(self, x) -> Graph:
        if isinstance(x, Variable):
            if x.text == "$base":
                return self.store.base
            if x.text not in self.graphs:
                raise QueryError(f"unknown graph {x.text}")
            return self.graphs[x.text]
        if isinstance(x, Binary) and x.op in ("+", "-", "&"):
            a, b = self.graph(x.left), self.graph(x.right)
            return a + b if x.op == "+" else a - b if x.op == "-" else a & b
        if isinstance(x, Call):
            return self._method(x) if x.subject is not None else self._function(x)
        raise QueryError("expected a graph")

    def _function(self, c: Call) -> Graph:
        name = c.name.lower()
        if name == "vertices":
            return self.store.vertices_by_id(*map(_text, c.args)) if c.args else self.store.empty()
        if name == "edges":
            return self.store.edges_by_id(*map(_text, c.args))
        return self._method(Call(Variable("$base"), c.name, c.args))

    def _depth(self, given, need: bool = False) -> int | None:
        got = _number(given) if given is not None else self.env["maxDepth"]
        if got is None and need:
            raise QueryError("needs a depth, or env set maxDepth")
        return got

    def _method(self, c: Call) -> Graph:
        g, name, args = self.graph(c.subject), c.name.lower(), list(c.args)
        plain = {"getedgeendpoints": g.get_edge_endpoints, "getedgesource": g.get_edge_source, "getedgedestination": g.get_edge_destination}
        if name in plain:
            return plain[name]()
        filters = {"getvertex": g.get_vertex, "getedge": g.get_edge, "getedgewithendpoints": g.get_edge_with_endpoints}
        if name in filters:
            return filters[name](self.predicate(args[0]) if args else None)
        if name == "getmatch":
            return g.get_match(self.graph(args[0]), *map(_text, args[1:]))
        if name == "getneighbor":
            return g.get_neighbor(self.graph(args[0]), _text(args[1]))
        if name in ("getlineage", "getlocallineage"):
            depth = args[1] if len(args) > 1 and isinstance(args[1], Number) else None
            way = _text(args[-1]) if len(args) > 1 and not isinstance(args[-1], Number) else "b"
            start, depth = self.graph(args[0]), self._depth(depth)
            out = g.get_lineage(start, depth, way)
            if name == "getlineage" and self.hosts and depth is not None:
                out = remote_lineage(out, start, depth, way, list(self.hosts.values()))
            return out
        if name == "getlink":
            return g.get_link(self.graph(args[0]), self.graph(args[1]), self._depth(args[2] if len(args) > 2 else None, need=True))
        if name == "getpath":
            legs, i = [], 1
            while i < len(args):
                to = self.graph(args[i])
                depth = args[i + 1] if i + 1 < len(args) and isinstance(args[i + 1], Number) else None
                legs.append((to, self._depth(depth)))
                i += 2 if depth is not None else 1
            return g.get_path(self.graph(args[0]), *legs)
        if name == "getshortestpath":
            return g.get_shortest_path(self.graph(args[0]), self.graph(args[1]), self._depth(args[2] if len(args) > 2 else None))
        if name == "getsubgraph":
            return g.get_subgraph(self.graph(args[0]))
        if name == "span":
            return g.span(self.graph(args[0]))
        if name == "collapseedge":
            return g.collapse_edge(*map(_text, args))
        if name == "refinedependencies":
            pairs = readers.dependency_map(self.store.spark, _text(args[0]))
            return g.refine_dependencies(pairs, _text(args[1]), self._depth(args[2] if len(args) > 2 else None))
        if name == "limit":
            n = _number(args[0]) if args else self.env["limit"]
            if n is None:
                raise QueryError("limit needs a number, or env set limit")
            return g.limit(n)
        what = "vertex" if name.startswith("vertex") else "edge" if name.startswith("edge") else "both"
        if name in ("subset", "vertexsubset", "edgesubset"):
            return g.subset(_number(args[0]), _number(args[1]) if len(args) > 1 else None, what)
        if name in ("sample", "vertexsample", "edgesample"):
            self.seed += 1
            return g.sample(_number(args[0]), what, self.seed)
        if name == "transform":
            source = next((self.graph(a) for a in args[1:] if isinstance(a, (Variable, Call)) and not self._is_predicate(a)), None)
            texts = [_text(a) for a in args[1:] if isinstance(a, (Text, Name))]
            depth = next((a.value for a in args[1:] if isinstance(a, Number)), None)
            out = transformers.apply(_text(args[0]), g, texts[0] if texts else "", source=source, depth=depth, way=texts[1] if len(texts) > 1 else None)
            self.store = out.store
            return out
        raise QueryError(f"unknown method {c.name!r}")


class _Linked:
    """A linked graph of another store; two are the same if their host is."""

    def __init__(self, host: str, graph: Graph):
        self.host, self.graph = host, graph

    @property
    def v(self) -> DataFrame:
        return self.graph.v

    @property
    def e(self) -> DataFrame:
        return self.graph.e

    def __eq__(self, other) -> bool:
        return isinstance(other, _Linked) and other.host == self.host

    def __hash__(self) -> int:
        return hash(self.host)
