"""The graph engine on a five-vertex graph whose results were worked out by hand, and on random graphs against brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ancestra.functions.identity import vertex_id
from ancestra.functions.predicates import Compare
from ancestra.operators import stats
from ancestra.operators import transformers as t
from ancestra.operators.federation import remote_lineage
from ancestra.operators.graph import Graph, Store
from ancestra.plans.language import QueryError
from ancestra.plans.session import Session

V = {
    "v1": {"type": "Process", "name": "root process", "pid": "10"},
    "v2": {"type": "Process", "name": "child process", "pid": "32"},
    "v3": {"type": "Artifact", "filename": "output.tmp"},
    "v4": {"type": "Artifact", "filename": "output.o"},
    "v5": {"type": "Agent", "uid": "10", "gid": "10", "name": "john"},
}
E = {
    "e1": ("v2", "v1", {"type": "WasTriggeredBy", "time": "5:56 PM"}),
    "e2": ("v2", "v3", {"type": "Used", "iotime": "12 ms"}),
    "e3": ("v4", "v2", {"type": "WasGeneratedBy", "iotime": "11 ms"}),
    "e4": ("v4", "v3", {"type": "WasDerivedFrom"}),
    "e5": ("v1", "v5", {"type": "WasControlledBy"}),
    "e6": ("v2", "v5", {"type": "WasControlledBy"}),
}


def make(spark, v=V, e=E):
    vs = spark.createDataFrame([(k, a) for k, a in v.items()], "id string, annotations map<string,string>")
    es = spark.createDataFrame([(k, *x) for k, x in e.items()], "id string, child string, parent string, annotations map<string,string>")
    return Store.of(vs, es)


@pytest.fixture(scope="module")
def store(spark):
    return make(spark)


def ids(g: Graph) -> tuple[set, set]:
    return {r.id for r in g.v.collect()}, {r.id for r in g.e.collect()}


CASES = [
    ("$out = $base.getLineage($v4, 1, 'a')", "v4 v2 v3", "e3 e4"),
    ("$out = $base.getLineage($v4, 2, 'a')", "v4 v2 v3 v1 v5", "e3 e4 e1 e2 e6"),
    ("$out = $base.getLineage($v4, 3, 'a')", "v4 v2 v3 v1 v5", "e3 e4 e1 e2 e6 e5"),
    ("$out = $base.getLineage($v4, 'a')", "v4 v2 v3 v1 v5", "e3 e4 e1 e2 e6 e5"),
    ("$out = $base.getLineage($v3, 1, 'd')", "v3 v2 v4", "e2 e4"),
    ("$out = $base.getLineage($v2, 1, 'b')", "v2 v1 v3 v5 v4", "e1 e2 e6 e3"),
    ("$out = $base.getPath($v4, $v3, 1)", "v4 v3", "e4"),
    ("$out = $base.getPath($v4, $v3, 10)", "v4 v2 v3", "e2 e3 e4"),
    ("$out = $base.getPath($v4, $v2, 1, $v5, 2)", "v4 v2 v1 v5", "e3 e1 e5 e6"),
    ("$out = $base.getShortestPath($v4, $v3)", "v4 v3", "e4"),
    ("$out = $base.getShortestPath($v3, $v4)", "", ""),
    ("$out = $base.getLink($v1, $v3, 2)", "v1 v2 v3", "e1 e2"),
    ("$out = $base.getNeighbor($v2, 'ancestor')", "v2 v1 v3 v5", "e1 e2 e6"),
    ("$out = $base.getVertex(type == 'Process')", "v1 v2", ""),
    ("$out = $base.getVertex(not name == 'john')", "v1 v2 v3 v4", ""),
    ("$out = $base.getVertex(name != 'john')", "v1 v2", ""),
    ("$out = $base.getVertex(pid < '4')", "v1 v2", ""),
    ("$out = $base.getVertex(name like '%process') & $base.getVertex(pid ~ '^1')", "v1", ""),
    ("$out = $base.getVertex(name not like 'root%' and type = 'Process')", "v2", ""),
    ("$out = $base.getVertex(nokey != 'x')", "", ""),
    ("$out = $base.getVertex(\"*\" = '10')", "v1 v5", ""),
    ("$out = $base.getEdge(type == 'Used').getEdgeEndpoints()", "v2 v3", ""),
    ("$out = $base.getEdgeWithEndpoints(type == 'Used')", "v2 v3", "e2"),
    ("$s = $v2 + $v3 + $v4; $out = $base.getSubgraph($s)", "v2 v3 v4", "e2 e3 e4"),
    ("$s = $v2 + $v3; $out = $s.span($base)", "v2 v3", "e2"),
    ("$out = $base.collapseEdge('type')", "v1 v2 v3 v4 v5", "e1 e2 e3 e4 e5 e6"),
    ("$out = $base.vertexSubset(1, 3)", "v2 v3", ""),
    ("$out = $base.edgeSubset(-2)", "", "e5 e6"),
    ("$out = $base.limit(2)", "v1 v2", "e1 e2"),
    ("$out = $base - $v1", "v2 v3 v4 v5", "e1 e2 e3 e4 e5 e6"),
    ("%p = type = 'Process'; %p += type = 'Agent'; $out = $base.getVertex(%p and not pid = '10')", "v2 v5", ""),
    ("# a comment\n$out = vertices('v1', 'v9'); $out += edges('e1')", "v1", "e1"),
]


@pytest.mark.parametrize(("text", "v", "e"), CASES)
def test_programs(store, text, v, e):
    s = Session(store)
    s.run("".join(f"$v{i} = vertices('v{i}');" for i in range(1, 6)) + text)
    assert ids(s.graphs["$out"]) == (set(v.split()), set(e.split()))


def test_commands(store):
    s = Session(store)
    s.run("$a = vertices('v4'); $b = vertices('v3');")
    assert [r.length for r in s.run("pathlengths $base $a $b 3").collect()] == [1]
    assert s.run("stat $base").first().asDict() == {"vertices": 5, "edges": 6}
    assert s.run("dump type = 'x' or not a like 'b'") == "((\"type\" = 'x') or (not (\"a\" like 'b')))"
    assert [tuple(r) for r in s.run("describe $base vertex type count").collect()] == [("Agent", 1), ("Artifact", 2), ("Process", 2)]
    assert [r.key for r in s.run("describe $base edge 2").collect()] == ["iotime", "time"]
    assert s.run("describe $base vertex none minmax").first().min == "UNDEFINED"
    assert s.run("native 'select count(*) as n from edges'").first().n == 6
    s.run("env set exportLimit 3")
    with pytest.raises(QueryError):
        s.run("dump $base")
    assert s.run("dump all $base")[0].count() == 5
    assert s.run("env print maxDepth") == "UNDEFINED"
    assert {r.name for r in s.run("list graph").collect()} == {"$base", "$a", "$b"}
    s.run("erase $a")
    for bad in ("$x = $a", "$base = $b", "$x = $b.noSuch()", "@m = $b", "$x = $base.getVertex(pid < qid)", "frobnicate", "$x = $b.subset(0, 5)"):
        with pytest.raises(ValueError):
            s.run(bad)
    s.run("reset workspace")
    assert not s.graphs


def test_shortest_path_of_every_start(spark):
    es = {"e1": ("s1", "d1", {}), "e2": ("s2", "m", {}), "e3": ("m", "d2", {}), "e4": ("s2", "k", {}), "e5": ("k", "d2", {}), "e6": ("s2", "l", {}), "e7": ("l", "m", {}), "e8": ("s1", "s2", {})}
    st = make(spark, {x: {"n": x} for x in "s1 s2 s3 m k l d1 d2".split()}, es)
    src, dst = st.vertices_by_id("s1", "s2", "s3"), st.vertices_by_id("d1", "d2")
    assert ids(st.base.get_shortest_path(src, dst)) == ({"s1", "d1", "s2", "m", "k", "d2"}, {"e1", "e2", "e3", "e4", "e5"})
    assert ids(st.base.get_shortest_path(src, dst, 1)) == ({"s1", "d1"}, {"e1"})
    assert ids(st.base.get_shortest_path(st.vertices_by_id("s1"), src)) == ({"s1"}, set())
    assert ids(st.base.get_shortest_path(st.vertices_by_id("s3"), dst)) == (set(), set())


def test_hops_read_links_without_shuffling_them(spark):
    st = make(spark).kept()
    front = spark.range(50).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"))
    from ancestra.operators.graph import _hop

    for n in (3, 50):
        plan = _hop(st.links("a"), front, n)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and ("PushedFilters: [In(src" in plan) == (n == 3)
    assert st.links("a") is st.links("a")


def test_default_paths_of_no_interest(spark):
    hit = lambda pattern, paths: [r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").where(F.col("p").rlike(pattern)).collect()]
    paths = ["/tmp/x", "/a/tmp", "pipe:[3]", "/unknown", "x scoreboard y", ".", "./a", "stdin", "/x/stdin", "(null)", "/dev/null", "/dev/null/x", "/lib/a.so", "/lib/a.so.1", "/lib/a.sox", "/etc/a.conf", "/etc/a.conf.d", "a.lock"]
    assert hit(t.NOISE_PATHS, paths) == ["/tmp/x", "pipe:[3]", "/unknown", "x scoreboard y", ".", "stdin", "(null)", "/dev/null"]
    assert hit(t.LIBRARY_PATHS, paths) == ["/lib/a.so", "/lib/a.so.1", "/etc/a.conf", "a.lock"]


def test_match_and_sample(spark):
    st = make(spark, {"a": {"k": "1", "l": "x"}, "b": {"k": "1", "l": "x"}, "c": {"k": "1"}, "d": {"l": "x"}, "e": {"k": "2", "l": "x"}}, {})
    left, right = st.vertices_by_id("a", "c", "d"), st.vertices_by_id("b", "e", "d")
    assert ids(left.get_match(right, "k", "l"))[0] == {"a", "b"}
    got = ids(st.base.sample(3, "vertex", seed=1))[0]
    assert len(got) == 3 and got == ids(st.base.sample(3, "vertex", seed=1))[0]


def test_lineage_on_random_graphs(spark):
    rng = random.Random(7)
    vs = {f"n{i:02d}": {"i": str(i)} for i in range(30)}
    es = {f"e{i:02d}": (f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}", {}) for i in range(45)}
    st = make(spark, vs, es)
    for depth in (1, 2, 30):
        seen, used, front = {"n00"}, set(), {"n00"}
        for _ in range(depth):
            used |= {k for k, (c, _, _) in es.items() if c in front}
            front = {p for c, p, _ in es.values() if c in front} - seen
            seen |= front
        assert ids(st.base.get_lineage(st.vertices_by_id("n00"), depth, "a")) == (seen, used)


@pytest.mark.parametrize(("values", "n", "want"), [(range(1, 11), 3, [(1, 13 / 3, 4), (13 / 3, 23 / 3, 3), (23 / 3, 10, 3)]), (range(4), 2, [(0, 2, 2), (2, 3, 2)]), ([5, 5], 3, [(5, 5, 2)]), ([], 3, [])])
def test_distribution(spark, values, n, want):
    st = make(spark, {f"v{i:02d}": {"x": str(x)} for i, x in enumerate(values)} | {"t": {"x": "text"}, "u": {"y": "1"}}, {})
    got = sorted(tuple(r) for r in stats.distribution(st.base, "vertex", "x", n).collect())
    assert [(pytest.approx(a), pytest.approx(b), c) for a, b, c in want] == got
    assert len(stats.mean(st.base, "vertex", "x").collect()) == (1 if want else 0)


# transformations


def flat_of(g):
    v, e = g.export()
    names = {r.id: tuple(sorted(r.annotations.items())) for r in v.collect()}
    return sorted((tuple(sorted(r.annotations.items())), names[r.child], names[r.parent]) for r in e.collect())


def graph(spark, vs, es):
    return make(spark, vs, {f"e{i:02d}": x for i, x in enumerate(es)}).base


P = lambda pid, **k: {"type": "Process", "pid": pid, **k}
FILE = lambda path, **k: {"type": "Artifact", "path": path, **k}


def test_forks_and_first_execve_are_one(spark):
    vs = {"a": P("1"), "b": P("2", name="old"), "c": P("2", name="new"), "d": P("2", name="newer"), "f": FILE("/x")}
    es = [("b", "a", {"operation": "fork", "event id": "1"}), ("c", "b", {"operation": "execve", "event id": "2"}), ("d", "c", {"operation": "execve", "event id": "9"}), ("b", "f", {"operation": "read", "event id": "3"})]
    got = flat_of(t.apply("SimpleForks", graph(spark, vs, es)))
    new, one, f = (("name", "new"), ("pid", "2"), ("type", "Process")), (("pid", "1"), ("type", "Process")), (("path", "/x"), ("type", "Artifact"))
    assert got == sorted([((("event id", "1"), ("operation", "fork (execve)")), new, one), ((("event id", "9"), ("operation", "execve")), new, new), ((("event id", "3"), ("operation", "read")), new, f)])


def test_ephemeral_files(spark):
    vs = {"p": P("1"), "q": P("2"), "own": FILE("/own"), "shared": FILE("/shared"), "never": FILE("/never")}
    es = [("own", "p", {"operation": "write"}), ("p", "own", {"operation": "read"}), ("shared", "p", {"operation": "write"}), ("q", "shared", {"operation": "read"}), ("q", "never", {"operation": "mmap (read)"})]
    left = lambda name, text="": {(e, c[-1][1], dict(p).get("path") or dict(c).get("path")) for e, c, p in flat_of(t.apply(name, graph(spark, vs, es), text))}
    assert {x[2] for x in left("NoEphemeralReads", "limited=false") if "read" in str(x[0])} == {"/shared"}
    assert {x[2] for x in left("NoEphemeralWrites") if "write" in str(x[0])} == {"/shared"}


def test_aggregation_of_values(spark):
    vs = {"a": P("1"), "f": FILE("/x", version="1"), "g": FILE("/x", version="2")}
    es = [("a", "f", {"operation": "read", "time": "10", "size": "5"}), ("a", "f", {"operation": "read", "time": "9", "size": "6"}), ("a", "g", {"operation": "read", "time": "11"})]
    got = flat_of(t.apply("Aggregation", graph(spark, vs, es)))
    assert got == [((("operation", "read"), ("time range", "[9, 11]"), ("total size", "[11]")), (("pid", "1"), ("type", "Process")), (("path", "/x"), ("type", "Artifact"), ("version count", "[2]")))]


def test_sanitized_values(spark):
    vs = {"a": P("1", cwd="/home", uid="7"), "f": FILE("/a/b/c/d/e", **{"remote address": "1.2.3.4"})}
    es = [("a", "f", {"time": "0.5", "size": "3"})]
    got = flat_of(t.apply("Sanitization", graph(spark, vs, es), "sanitizationLevel=medium"))
    assert got == [((("size", "NULL"), ("time", "1970-1-1 NULL:0:0.500")), (("cwd", "/home"), ("pid", "1"), ("type", "Process"), ("uid", "NULL")), (("path", "/a/b/NULL/d/e"), ("remote address", "1.2.NULL.4"), ("type", "Artifact")))]


def test_addresses_and_agents(spark):
    vs = {"t": {"type": "Activity"}, "i": {"type": "Entity", "n": "1"}, "o": {"type": "Entity", "n": "2"}, "x": {"type": "Agent", "address": "X"}, "y": {"type": "Agent", "address": "Y"}}
    es = [("t", "i", {"type": "Used"}), ("o", "t", {"type": "WasGeneratedBy", "transactionValue": "5"}), ("i", "x", {"type": "WasAttributedTo"}), ("o", "y", {"type": "WasAttributedTo"})]
    got = flat_of(t.apply("OnlyAddresses", graph(spark, vs, es)))
    who = lambda a: (("address", a), ("type", "Agent"))
    assert got == [((("transactionValue", "5"), ("type", "ActedOnBehalfOf")), who("Y"), who("X"))]
    assert ((("type", "ActedOnBehalfOf"),), who("Y"), who("X")) in flat_of(t.apply("OnlyAgents", graph(spark, vs, es)))


def agents_by_hand(vs, es):
    """Pairs of agents, by brute force over all pairs of vertices."""
    agent = {v for v, a in vs.items() if a["type"] == "Agent"}
    held, after = {}, {}
    for c, p in es:
        if c in agent or p in agent:
            held.setdefault(p if c in agent else c, set()).add(c if c in agent else p)
        after.setdefault(c, set()).add(p)
    out = set()
    for v in held:
        seen, front = set(), {v}
        while front := {y for x in front for y in after.get(x, ())} - seen:
            seen |= front
        out |= {(a, b) for w in seen - {v} for a in held[v] for b in held.get(w, ())}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_agents_over_walks_with_cycles(spark, seed):
    rng = random.Random(seed)
    vs = {f"p{i}": P(str(i)) for i in range(16)} | {f"g{i}": {"type": "Agent", "uid": str(i)} for i in range(5)}
    es = {(f"p{rng.randrange(16)}", f"p{rng.randrange(16)}") for _ in range(14)} | {(f"p{rng.randrange(16)}", f"g{rng.randrange(5)}") for _ in range(7)}
    es |= {("p0", "p1"), ("p1", "p0"), ("p0", "g4"), ("g0", "p3")}
    got = flat_of(t.apply("OnlyAgents", graph(spark, vs, [(c, p, {}) for c, p in sorted(es)])))
    assert {("g" + dict(c)["uid"], "g" + dict(p)["uid"]) for _, c, p in got} == agents_by_hand(vs, es)


def test_an_agent_on_a_cycle_of_others_is_not_its_own(spark):
    vs = {"a": P("1"), "b": P("2"), "g": {"type": "Agent", "uid": "1"}, "h": {"type": "Agent", "uid": "2"}}
    assert flat_of(t.apply("OnlyAgents", graph(spark, vs, [("a", "b", {}), ("b", "a", {}), ("a", "g", {}), ("a", "h", {})]))) == []


def test_the_agents_query_walks_all_edges(spark, tmp_path):
    from ancestra.queries import reference

    vs = {"a1": P("1"), "a2": P("2"), "a3": P("3"), "f1": FILE("/x"), "b1": {"type": "Agent", "uid": "1"}, "b2": {"type": "Agent", "uid": "2"}, "b3": {"type": "Agent", "uid": "3"}}
    es = [("a1", "a2", "WasTriggeredBy", "clone"), ("a2", "f1", "Used", "read"), ("f1", "a3", "WasGeneratedBy", "write"), ("a1", "b1", "WasControlledBy", None), ("a2", "b2", "WasControlledBy", None), ("a3", "b3", "WasAssociatedWith", None)]
    edges = [(f"e{i}", c, p, {"type": k, **({"operation": o} if o else {})}) for i, (c, p, k, o) in enumerate(es)]
    spark.createDataFrame(list(vs.items()), "hash string, annotations map<string,string>").withColumn("ref", F.lit(False)).write.parquet(f"{tmp_path}/vertices.parquet")
    spark.createDataFrame(edges, "hash string, childvertexhash string, parentvertexhash string, annotations map<string,string>").withColumn("ref", F.lit(False)).write.parquet(f"{tmp_path}/edges.parquet")
    got = reference.QUERIES["t_only_agents"](spark, str(tmp_path))
    assert got.where("kind = 'edge'").count() == 3 and got.where("kind = 'vertex'").count() == 3


def test_a_cut_contextual_walk_raises(spark):
    g = graph(spark, {"a": P("1"), "b": P("2"), "c": P("3")}, [("a", "b", {"time": "1"}), ("b", "c", {"time": "2"})])
    source = g.get_vertex(Compare("pid", "==", "1"))
    assert t.contextual_temporal_traversal(t.flat(g), "time", source, 9).count() == 2
    with pytest.raises(RuntimeError):
        t.contextual_temporal_traversal(t.flat(g), "time", source, 1)


def test_content_merges_after_a_transformation(spark):
    vs = {"a": P("1"), "f": FILE("/x", version="1"), "g": FILE("/x", version="2")}
    es = [("a", "f", {"operation": "read"}), ("a", "g", {"operation": "read"}), ("g", "f", {"operation": "update"})]
    out = t.apply("NoVersions", graph(spark, vs, es))
    assert len(flat_of(out)) == 1
    one = spark.createDataFrame([({"path": "/x", "type": "Artifact"},)], "a map<string,string>").select(vertex_id(F.col("a"))).first()[0]
    assert one in ids(out)[0]


@pytest.mark.parametrize("name", ["LastName", "MergeIO", "NoMemory", "SimpleForks", "Aggregation", "OPM2Prov", "OnlyAddresses", "OnlyAgents", "NoEphemeralReads", "Sanitization"])
def test_transformations_of_nothing(spark, name):
    assert ids(t.apply(name, make(spark, {}, {}).base)) == (set(), set())


def test_lineage_over_two_hosts(spark):
    sock = lambda a, b: {"subtype": "network socket", "local address": a, "local port": "1", "remote address": b, "remote port": "1"}
    dst = make(spark, {"2": P("2"), "1": P("1"), "4": {**sock("B", "A")}, "3": FILE("/etc/passwd")}, {"f": ("2", "1", {}), "g": ("1", "4", {}), "h": ("3", "2", {})})
    src = make(spark, {"1002": P("2"), "1001": P("1"), "1003": FILE("/etc/passwd"), "1004": sock("A", "B")}, {"a": ("1001", "1002", {}), "b": ("1002", "1003", {}), "c": ("1004", "1001", {})})
    start = src.base.get_vertex(Compare("path", "=", "/etc/passwd"))
    got = ids(remote_lineage(src.base.get_lineage(start, 6, "d"), start, 6, "d", [dst]))
    assert got == ({"1001", "1002", "1003", "1004", "1", "2", "3", "4"}, set("abcfgh"))


def test_remote_save_and_transform(spark, store, tmp_path):
    other = make(spark, {"w1": {"type": "Agent"}}, {})
    s = Session(store, {"there": other})
    s.run("$a = vertices('v1'); $b = vertices('v2'); remote link $a 'there' $b;")
    assert [r.host for r in s.run("remote list $a").collect()] == ["there"]
    assert s.run("stat $a").first().asDict() == {"vertices": 2, "edges": 0}
    s.run("remote copy $b $a; remote unlink $a 'there';")
    assert s.run("remote list $a").collect() == [] and s.run("stat $b").first().vertices == 2
    assert {r.id for r in s.run("remote export $b")[0].collect()} == {"v2", "w1"}
    assert s.run("remote query 'there' 'stat $base'").first().vertices == 1
    s.run("remote clear $b; remote create $c 'there'")
    assert s.run("stat $c").first().vertices == 1
    s.run(f"save $base '{tmp_path}/g.json'; save $base '{tmp_path}/g'")
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "g.json").glob("part*")) == 11
    (tmp_path / "m.dot").write_text('"WasGeneratedBy" -> "WasControlledBy" [label="WasDependentOn"];\n')
    s.run(f"$r = $base.refineDependencies('{tmp_path}/m.dot', type, 3)")
    assert ids(s.graphs["$r"]) == ({"v1", "v2", "v4", "v5"}, {"e1", "e3", "e5", "e6"})
    s.run("$t = $base.transform(OPM2Prov, ''); $p = $t.getVertex(type == 'Activity')")
    assert len(ids(s.graphs["$t"])[1]) == 6 and len(ids(s.graphs["$p"])[0]) == 2
    s.run("$src = $base.getVertex(name = 'john'); $q = $base.transform(Prune, '', $src, 'descendants', 1)")
    assert len(ids(s.graphs["$q"])[1]) == 8  # the store now also has the converted graph: 12 edges, 4 of them at john


def test_a_store_is_loaded_once_and_again_when_cleared(spark):
    from ancestra import session
    from ancestra.queries import reference

    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        pytest.skip("no test data")
    first = reference.store(spark, d)
    assert reference.store(spark, d) is first
    n = first.edges.count()
    session.clear(spark)
    assert reference.store(spark, d) is not first and reference.store(spark, d).edges.count() == n
