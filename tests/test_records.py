"""The general record operators against brute force on small fixtures, with their edge cases."""

import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from ancestra.functions.earley import Grammar
from ancestra.functions.identity import canon_hash
from ancestra.operators import dedup, hierarchy, logparse, nested, orphans, skew, wide


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# hierarchies


def climb(parent):
    out = {}
    for v in set(parent) | set(parent.values()):
        way, x = [], v
        while x in parent and x not in way:
            way.append(x)
            x = parent[x]
        if x in way:
            ring = way[way.index(x):]
            out[v] = (min(ring), way.index(x), int(v in ring))
        else:
            out[v] = (x, len(way), 0)
        if out[v][2]:
            out[v] = (out[v][0], 0, 1)
    return out


@pytest.mark.parametrize(("seed", "finish"), [(1, 0), (2, 0), (3, 10), (4, 1000)])
def test_contraction_gives_roots_depths_and_cycles(spark, seed, finish):
    rng = random.Random(seed)
    parent = {f"n{i:02d}": f"n{rng.randrange(40):02d}" for i in range(32)}
    parent |= {f"c{i:02d}": f"c{i + 1:02d}" for i in range(12)}
    parent["s"] = "s"
    links = spark.createDataFrame([*parent.items(), ("c00", "c01"), (None, "x"), ("y", None)], "child string, parent string")
    got = {r.v: (r.root, r.depth, r.on_cycle) for r in hierarchy.resolve(links, finish=finish).collect()}
    assert got == climb(parent)
    ways = {}
    for v in got:
        x, way = parent.get(v), []
        while x and x not in way and x != v:
            way.append(x)
            x = parent.get(x)
        ways[v] = way
    pairs = rows(hierarchy.ancestors(links, finish=finish))
    assert pairs == sorted((v, a, i + 1) for v, way in ways.items() for i, a in enumerate(way))
    path = {r.v: r.path for r in hierarchy.paths(links, finish=finish).collect()}
    assert path == {v: v if got[v][2] else "/".join([*reversed(ways[v][: got[v][1]]), v]) for v in got}


def test_paths_and_descendants(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("p", "q"), ("q", "p"), ("r", "q")], "child string, parent string")
    at = {r.v: r.path for r in hierarchy.paths(links).collect()}
    assert at == {"a": "a", "b": "a/b", "c": "a/b/c", "d": "a/b/d", "p": "p", "q": "q", "r": "q/r"}
    n = {r.v: r.n_below for r in hierarchy.descendant_counts(links).collect()}
    assert n == {"a": 3, "b": 2, "c": 0, "d": 0, "r": 0}


@pytest.mark.parametrize("finish", [1000, 200_000])
def test_a_chain_makes_no_pairs(spark, finish):
    n = 20_000 if finish == 1000 else 100_000
    links = spark.range(n).select(F.format_string("%06d", "id").alias("parent"), F.format_string("%06d", F.col("id") + 1).alias("child"))
    got = hierarchy.resolve(links, finish=finish).agg(F.count("*"), F.min("root"), F.max("root"), F.max("depth"), F.count_distinct("depth")).first()
    assert tuple(got) == (n + 1, "000000", "000000", n, n + 1)


def test_paths_of_a_chain(spark):
    links = spark.range(1500).select(F.format_string("%04d", "id").alias("parent"), F.format_string("%04d", F.col("id") + 1).alias("child"))
    want = "/".join(f"{i:04d}" for i in range(1501))
    for finish in (100, 200_000):
        assert hierarchy.paths(links, finish=finish).where("v = '1500'").first().path == want


def test_a_parent_of_most_rows(spark):
    links = spark.range(3000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("child"), F.lit("hub").alias("parent"))
    links = links.unionByName(spark.createDataFrame([("hub", "top"), ("x", "c7")], "child string, parent string"))
    got = hierarchy.resolve(links).groupBy("root", "depth").count()
    assert rows(got) == [("top", 0, 1), ("top", 1, 1), ("top", 2, 3000), ("top", 3, 1)]


def test_hierarchy_of_an_empty_table(spark):
    assert hierarchy.resolve(spark.createDataFrame([], "child string, parent string")).collect() == []


# missing references


def test_missing_references_follow_lifetimes(spark):
    t = lambda d: datetime(2024, 1, d, tzinfo=UTC)
    edges = spark.createDataFrame([("e1", "a", "b", t(5)), ("e1", "a", "b", t(5)), ("e2", "a", None, t(1)), ("e3", "z", "b", t(9)), ("e4", "a", "b", None), (None, "q", "q", t(1))], "id string, c string, p string, at timestamp")
    keys = spark.createDataFrame([("a", t(2), None, 1), ("b", t(1), t(6), 2), ("b", t(1), t(6), 3), (None, t(1), None, 4)], "ref string, since timestamp, until timestamp, extra int").drop("extra")
    refs = orphans.references(edges, "id", {"child": "c", "parent": "p"}, "at")
    lost = orphans.missing(refs, keys, "since", "until")
    assert rows(lost.select("ident", "endpoint")) == [("e2", "child"), ("e3", "child"), ("e3", "parent"), ("e4", "child"), ("e4", "parent")]
    when = spark.createDataFrame([("e1", "m1"), ("e2", None), ("e3", "m1"), ("e4", "m2")], "ident string, period string")
    got = {(r.endpoint, r.period): (r.n_refs, r.n_orphans) for r in orphans.report(refs, lost, when, "period").collect()}
    assert got == {("child", "m1"): (2, 1), ("parent", "m1"): (2, 1), ("child", None): (1, 1), ("child", "m2"): (1, 1), ("parent", "m2"): (1, 1)}


# nested records

ARRAYS = ["xs", "ys"]


def brute_items(text):
    out = []

    def walk(v, path, item):
        v = nested.unwrap(v)
        for k, x in v.items() if isinstance(v, dict) else ():
            p = f"{path}.{k}" if path else k
            if k in ARRAYS:
                for i, y in enumerate(nested._as_list(x) or []):
                    if nested.unwrap(y) is not None:
                        out.append((f"{p}[{i}]", item))
                        walk(y, f"{p}[{i}]", f"{p}[{i}]")
            else:
                walk(x, p, item)

    walk(json.loads(text), "", "")
    return sorted(out)


TEXTS = [
    '{"xs": [{"ys": [1, null, 2]}, null, {"o": {"ys": {"array": ["a"]}}}]}',
    '{"a.b.C": {"xs": {"array": [{"xs": "[{\\"ys\\": [true]}]"}]}, "t": "[1, 2]"}}',
    '{"o": {"p": {"xs": {"ys": ["q"]}}}, "we ird": {"x\'s": [1], "xs": [[1], {"ys": []}]}}',
    '{"xs": null, "ys": []}',
    '{"xs": {"string": "[\\"u\\"]"}}',
    "{}",
    '{"m": {"k1": 1, "k2": [1], "k3": {"xs": [1e999, "\\ud800"]}}, "ys": "text", "xs": ["[1]", {"ys": "[2"}]}',
]


def test_nested_items_at_any_depth(spark):
    bad = ['{"xs": [1', "", None, "[1, 2]", "NaN", '{"xs": [1]} x']
    df = spark.createDataFrame(list(enumerate(TEXTS + bad)), "k bigint, t string")
    got = {}
    for r in nested.nested_items(df, "k", "t", ARRAYS).collect():
        got.setdefault(r.k, []).append((r.item_path, r.parent_path))
    assert {k: sorted(x) for k, x in got.items()} == {k: y for k, x in enumerate(TEXTS) if (y := brute_items(x))}


def test_nested_items_of_long_and_deep_records(spark):
    deep = '{"o":' * 60_000 + '{"xs": [1, 2.5, true, null, "\\"]"]}' + "}" * 60_000
    texts = ['{"t": "%s", "xs": [1]}' % ("a" * 21_000_000), '{"n": %s, "xs": [1]}' % ("7" * 1100), '{"n": %s, "xs": [1]}' % ("7" * 5000), '{"l": %s, "xs": [1]}' % ("[" * 1200 + "]" * 1200), deep]
    bad = [deep[:-1], deep + "}", deep.replace("2.5", "2.5.1"), deep.replace("true", "NaN")]
    df = spark.createDataFrame(list(enumerate(texts + bad)), "k bigint, t string")
    got = nested.nested_items(df, "k", "t", ARRAYS).select("k", "ordinal", "item").collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, "1"), (1, 0, "1"), (2, 0, "1"), (3, 0, "1"), (4, 0, "1"), (4, 1, "2.5"), (4, 2, "true"), (4, 4, '"\\"]"')]


def test_child_tables_are_typed(spark):
    df = spark.createDataFrame([(1, '{"xs": [{"n": 3, "s": "a"}, {"n": "no"}], "ys": ["v", {"n": 1}]}')], "k bigint, t string")
    items = nested.nested_items(df, "k", "t", ARRAYS)
    assert rows(nested.child_table(items, "k", "xs", {"n": "bigint", "s": "string"})) == [(1, "xs[0]", "", 0, 3, "a"), (1, "xs[1]", "", 1, None, None)]
    assert [r.value for r in nested.child_table(items, "k", "ys", {"value": "string"}).orderBy("ordinal").collect()][0] == "v"


def test_named_arrays_in_unlisted_ones(spark):
    df = spark.createDataFrame([(1, '{"o": [{"xs": [1]}, [{"ys": [2]}]], "xs": [[{"ys": [3]}]]}')], "k bigint, t string")
    got = rows(nested.nested_items(df, "k", "t", ARRAYS).select("item_path", "parent_path"))
    assert got == [("o[0].xs[0]", ""), ("o[1][0].ys[0]", ""), ("xs[0]", ""), ("xs[0][0].ys[0]", "xs[0]")]


def test_flat_tables_have_the_columns_of_the_merged_schema(spark):
    texts = ['{"n": 1, "o": {"f": 1.5, "b": true}, "N": "x", "u": [1, {"a": 2}], "xs": [{"n": 1, "ys": ["p"]}, null, "q"]}', '{"n": 9007199254740993, "o": {"f": 2}, "m": {"map": {"k": 1}}, "xs": [{"n": "no", "k": null}], "k": 3}', "[1]", None, "{"]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    root = nested.flat_table(df, "k", "t", ARRAYS)
    assert [c for c in root.dtypes if c[0] != "k"] == [("N", "string"), ("k 2", "bigint"), ("m.k", "bigint"), ("n 2", "bigint"), ("o.b", "boolean"), ("o.f", "double"), ("u", "string")]
    assert sorted((tuple(r) for r in root.collect()), key=str) == [(0, "x", None, None, 1, True, 1.5, '[1,{"a":2}]'), (1, None, 3, 1, 9007199254740993, None, 2.0, None)]
    xs = nested.flat_table(df, "k", "t", ARRAYS, "xs")
    assert xs.columns == ["k", "item_no", "parent_no", "item_path", "parent_path", "ordinal", "value", "k 2", "n"]
    assert sorted((tuple(r) for r in xs.collect()), key=str) == [(0, 1, 0, "xs[0]", "", 0, None, None, "1"), (0, 2, 0, "xs[2]", "", 2, "q", None, None), (1, 1, 0, "xs[0]", "", 0, None, None, "no")]
    assert rows(nested.flat_table(df, "k", "t", ARRAYS, "ys")) == [(0, 3, 1, "xs[0].ys[0]", "xs[0]", 0, "p")]


def test_maps_with_data_for_keys_are_one_column(spark):
    texts = ['{"m": {"k%d": %d}, "xs": [1]}' % (i, i) for i in range(300)]
    got = nested.flat_table(spark.createDataFrame(list(enumerate(texts)), "k bigint, t string"), "k", "t", ARRAYS)
    assert got.columns == ["k", "m"] and got.where("k = 7").first().m == '{"k7":7}' and got.where("m is null").count() == 0


def test_record_tables_are_registered():
    from ancestra.queries import general

    assert {"p3_records", "p3_host_identifiers", "p3_interfaces", "p3_ip_addresses", "p3_group_ids", "p3_imported_libraries", "p3_hashes", "p3_names", "p3_parameters", "p3_components"} <= set(general.QUERIES)


def test_nested_of_nothing(spark):
    assert nested.nested_items(spark.createDataFrame([], "k bigint, t string"), "k", "t", ARRAYS).collect() == []


# attribute rows


@pytest.mark.parametrize(("text", "want"), [(" 42 ", 42), ("+7", 7), ("-007", -7), ("1,234,567", 1234567), ("12.000", 12), ("0x1F", 31), ("0xzz", None), ("12 kB", None), ("1,23", None), ("1.5", None), ("", None), (None, None), ("0x", None), ("9223372036854775808", 9223372036854775808), ("0x7fffffffffffffff", 2**63 - 1), ("0xffffffffffffffff", 2**64 - 1), ("0x1" + "0" * 16, int(wide.BEYOND)), ("1" * 50, int(wide.BEYOND)), ("0" * 60 + "5", 5)])
def test_whole_numbers(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(wide.whole_number(F.col("t"))).first()[0]
    assert (None if got is None else int(got)) == want


def test_pivot_to_typed_columns(spark):
    data = [(1, "A", "1"), (1, " a ", "01"), (1, "b", "x"), (2, "a", "2"), (2, "A", "3"), (2, "c", "1.5"), (3, "B", None), (3, "b", ""), (None, "a", "1"), (4, None, "1"), (5, "id", "9")]
    df = spark.createDataFrame(data, "id bigint, field string, value string").withColumns({"w": F.lit(1), "text": F.lit(None)})
    per = wide.reduced(df, ["id"], "field", "value")
    out = wide.pivot_wide(per, ["id"], [("a", "bigint"), ("b", "string"), ("c", "double"), ("id", "bigint")])
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == {1: (1, "x", None, None), 2: (None, None, 1.5, None), 3: (None, None, None, None), 5: (None, None, None, 9)}
    assert dict(wide.attribute_types(per)) == {"a": "string", "b": "string", "c": "double", "id": "bigint"}


@pytest.mark.parametrize("odd", [1, 3])
def test_wide_and_rest_have_every_value(spark, odd):
    data = [(i, "size", "0x10" if i == 9 else str(i)) for i in range(odd, 20)] + [(i, "size", x) for i, x in enumerate(["12 kB", "4096B", "3.5"][:odd])]
    data += [(5, "size", "6"), (6, "size", " 6.0 "), (1, "name", "b"), (1, "NAME", "a"), (1, "name", "a"), (2, "name", " "), (2, "name", None), (3, "big", "0x7fffffffffffffff"), (3, "big", "1")]
    data += [(1, "ratio", "0.5"), (1, "ratio", ".5e0"), (2, "ratio", "0.12345678901234567"), (None, "size", "1")]
    df = spark.createDataFrame(data, "id bigint, field string, value string")
    per = wide.reduced(df, ["id"], "field", "value")
    columns = wide.attribute_types(per)
    assert dict(columns)["size"] == ("bigint" if odd == 1 else "string")
    cells = {(r.id, c): r[c] for r in wide.pivot_wide(per, ["id"], columns).collect() for c, _ in columns if r[c] is not None}
    left = {(r.id, r.field, r.value) for r in wide.rest(df, per, ["id"], "field", "value", columns).collect()}
    for i, f, v in data:
        if i is not None and v and v.strip():
            cell, v = cells.get((i, f.lower())), v.strip()
            held = cell is not None and (cell == v if isinstance(cell, str) else v.replace(".0", "") in (str(cell), hex(cell)) if isinstance(cell, int) else v in (str(cell), str(int(cell))))
            assert held != ((i, f.lower(), v) in left), (i, f, v)
    assert {(5, "size", "6"), (1, "name", "b"), (3, "big", "0x7fffffffffffffff")} <= left if odd == 3 else {(5, "size", "5"), (5, "size", "6"), (0, "size", "12 kB")} <= left


def test_numbers_too_long_contradict(spark):
    df = spark.createDataFrame([(1, "n", "0x7fffffffffffffff"), (2, "n", "5"), (2, "n", "7" * 45), (3, "n", "8" * 45), (4, "n", "0xfffffffffffffffff"), (4, "n", "4")], "id bigint, field string, value string")
    assert {r.id: r.whole for r in wide.reduced(df, ["id"], "field", "value").collect()} == {1: 2**63 - 1, 2: None, 3: None, 4: None}


def test_pivot_over_many_batches(spark):
    df = spark.range(3000).select(F.col("id") % 500, F.concat(F.lit("f"), (F.col("id") % 3).cast("string")), F.col("id").cast("string")).toDF("id", "field", "value")
    per = wide.reduced(df, ["id"], "field", "value")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = wide.pivot_wide(per, ["id"], [("f0", "string"), ("f1", "string"), ("f2", "string")]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i in range(3000):
        k = (i % 500, i % 3)
        want[k] = min(want.get(k, str(i)), str(i))
    assert len(out) == 500
    assert {(r.id, j): r[f"f{j}"] for r in out for j in range(3) if r[f"f{j}"]} == want


# repeated messages


def test_one_copy_of_each_message(spark):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s, tzinfo=UTC)
    data = [(1, "AB", t(5)), (2, "a-b ", t(3)), (3, "ab", t(3)), (4, "c", None), (5, "c", t(9)), (6, None, t(1)), (7, " ", t(1)), (8, "d", None)]
    df = spark.createDataFrame(data, "seq bigint, h string, d timestamp")
    assert [r[0] for r in rows(dedup.surplus(df, canon_hash("h"), "seq", "d"))] == [1, 3, 4]
    assert [r[0] for r in rows(dedup.keep_first(df, canon_hash("h"), "seq", "d"))] == [2, 5, 6, 7, 8]
    assert dedup.surplus(df.limit(0), canon_hash("h"), "seq", "d").collect() == []


# log lines

LINES = [
    ("a", 1, "\tat x.Y(Z.java:1)"),
    ("a", 2, "[2023-10-08 08:33:43,630] ERROR relay.group.Warden - buffer of 2 - flushed\r"),
    ("a", 3, "java.lang.IllegalStateException: state 32"),
    ("a", 4, ""),
    ("a", 5, "2023-04-26 14:49:14.362 UTC [26312] [unknown] LOG:  key -> [WARN] ERROR:  x"),
    ("a", 6, "\tselect 1"),
    ("a", 7, "2023-04-26 14:49:14.362 CET [2] quill shell DEBUG1:  y"),
    ("b", 1, "2023-05-29 13:32:18.559+0530 WARN  [o.q.b.WireServer] queue [x]"),
    ("b", 2, "May 29, 2023 12:02:23 PM app.screen.Eddy <init>"),
    ("b", 3, "SEVERE: queue above limit"),
    ("b", 4, "INFO: no level any more"),
    ("b", 5, "node=n1 type=SYSCALL msg=audit(1685347041.070:99): arch=c0"),
    ("b", 6, "type=EOE msg=audit(1685346931.476:676872): "),
    ("b", 7, "I0529 07:58:31.637094  2497 PlanRunner.cpp:759] key"),
    ("b", 8, "May  9 08:02:37 node15 hooksd[8113]: query: done"),
    ("b", 9, "Feb 30 08:02:37 node15 kernel: query"),
    ("b", 10, None),
    ("b", 11, "something 2023-05-29 13:32:18.559 else"),
    ("b", 12, "May 29, 2023 12:00:00 AM a.B run"),
]


def test_log_entries(spark):
    df = spark.createDataFrame([(i, f, n, m, datetime(2023, 6, 1, tzinfo=UTC)) for i, (f, n, m) in enumerate(LINES)], "line_id bigint, log_file string, line_no int, msg string, collected timestamp")
    parsed = logparse.parse_lines(df, "msg", "collected", ["log_file", "line_no", "line_id"])
    got = logparse.entries(parsed, "log_file", "line_no", "line_id", text=True)
    at = F.date_format("ts", "MM-dd HH:mm:ss")
    assert rows(got.select("line_id", at, "severity", "component", "n_lines")) == [
        (1, "10-08 08:33:43", "ERROR", "relay.group.Warden", 3),
        (4, "04-26 14:49:14", "INFO", "[unknown]", 2),
        (6, "04-26 13:49:14", "DEBUG", "quill shell", 1),
        (7, "05-29 08:02:18", "WARN", "o.q.b.WireServer", 1),
        (8, "05-29 12:02:23", "ERROR", "app.screen.Eddy", 3),
        (11, "05-29 07:57:21", "", "SYSCALL", 1),
        (12, "05-29 07:55:31", "", "EOE", 1),
        (13, "05-29 07:58:31", "INFO", "PlanRunner.cpp", 1),
        (14, "05-09 08:02:37", "", "hooksd", 1),
        (15, None, "", "kernel", 3),
        (18, "05-29 00:00:00", "", "a.B", 1),
    ]
    message = {r.line_id: r.message for r in got.collect()}
    assert message[1] == "buffer of 2 - flushed\njava.lang.IllegalStateException: state 32\n"
    spans = rows(parsed.where("unparsed_to is not null").select("line_id", "unparsed_from", "unparsed_to"))
    assert spans == [(17, 0, len(LINES[17][2]))]
    assert rows(logparse.unparsed(parsed, "line_id")) == [(17, 0, len(LINES[17][2]), LINES[17][2])]
    assert {r.line_id: r.n_unparsed for r in got.collect() if r.n_unparsed} == {15: 1}


def test_passing_alternatives_over_changes_no_parse():
    text = "S -> A ; 0\nS -> B ; -1\nS -> S2 ; 0\nA -> x=/a+/ T ; -3\nT -> /b/ ; 0\nT -> T /b/ ; -1\nB -> y=/a/ T2 ; 0\nT2 -> /[ab]+/ ; 0\nS2 -> z=/c/ S2 ; 0\nS2 -> z=/c/ ; 0"
    g = Grammar(text, "S")
    assert g.parse("aab") == (-1.0, "B", [("y", 0, 1)]) and g.parse("b") is None and g.parse("") is None
    assert g.parse("ccc")[1] == "S2" and len(g.parse("ccc")[2]) == 3
    with pytest.raises(ValueError):
        Grammar("S -> /a/ ; 0\nS -> S /a/ ; 1", "S")


def test_entries_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(logparse, "BLOCK", 4)
    heads = {3, 4, 17}
    data = [(i, "f", i, "May  9 08:02:37 n kernel: x" if i in heads else f"line {i}", datetime(2023, 6, 1, tzinfo=UTC)) for i in range(1, 31)]
    df = spark.createDataFrame(data, "line_id bigint, log_file string, line_no int, msg string, collected timestamp")
    parsed = logparse.parse_lines(df, "msg", "collected", ["log_file", "line_no", "line_id"])
    assert rows(logparse.entries(parsed, "log_file", "line_no", "line_id").select("line_id", "n_lines")) == [(3, 1), (4, 13), (17, 14)]
    assert logparse.entries(parsed.limit(0), "log_file", "line_no", "line_id").collect() == []


# heavy keys


def test_fragments_spread_heavy_keys(spark):
    keys = ["hot"] * 900 + [f"k{i}" for i in range(300)] + [None] * 50
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n bigint")
    plan = skew.plan_fragments(df, "key", 8)
    assert max(plan.width) > 4 and max(plan.loads) < 2 * 1200 / 8 and len(plan.slots) <= (skew.BUCKETS_PER_TASK + 4) * 8
    got = {r.key: r.n for r in skew.balanced_counts(df, "key", "n", "n", plan=plan).collect()}
    assert got == {"hot": 900} | {f"k{i}": 1 for i in range(300)}
    right = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("k1", "z"), (None, "w")], "key string, v string")
    both = skew.balanced_join(df, right, "key", plan=plan)
    assert both.count() == 1801 and both.where("key = 'hot'").select("n", "v").distinct().count() == 1800
    assert skew.balanced_join(df, right, "key", "left_anti").count() == 299 + 50
    assert skew.balanced_join(df, right, "key", "left_semi").count() == 901
    assert skew.balanced_join(df, right, "key", "left").count() == 1801 + 299 + 50
    assert skew.balanced_join(df, right.withColumnRenamed("v", "n"), "key").columns == ["key", "n", "n_right"]
    with pytest.raises(ValueError):
        skew.balanced_join(df, right, "key", "outer")
    assert skew.balanced_join(df.limit(0), right, "key").count() == 0
    sizes = skew.placed(df, "key", plan).rdd.glom().map(len).collect()
    assert max(sizes) < 400


def test_counts_of_distinct_values_by_several_keys(spark):
    data = [("a", "x", i % 40) for i in range(400)] + [("a", "y", 1), ("b", "x", 1), ("b", "x", 1), (None, "x", 1), ("b", "x", None), ("b", None, 5)]
    df = spark.createDataFrame(data, "k string, l string, n bigint").withColumn("extra", F.rand())
    assert rows(skew.balanced_counts(df, ["k", "l"], "n")) == [("a", "x", 40), ("a", "y", 1), ("b", "x", 1)]
    assert rows(skew.balanced_counts(df, ["k", "l"], "n", least=2)) == [("a", "x", 40)]
    assert skew.balanced_counts(df.limit(0), "k", "n").collect() == []


def test_plans_for_many_tasks_and_heavy_keys(spark):
    df = spark.range(30_000).select(F.concat(F.lit("k"), (F.col("id") % 600).cast("string")).alias("key"), F.col("id").alias("n"))
    plan = skew.plan_fragments(df, "key", 300)
    assert max(plan.loads) <= 2 * 30_000 / 300
    right = df.select("key").distinct().withColumn("v", F.lit(1))
    assert skew.balanced_join(df, right, "key", plan=plan).count() == 30_000
    assert skew.balanced_counts(df, "key", "n", plan=plan).where("n = 50").count() == 600


def test_counting_and_missing_references_shuffle_once(spark):
    df = spark.createDataFrame([("e1", "a"), ("e2", "a")], "n string, key string")
    text = skew.balanced_counts(df, "key", "n")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 2 and text.count("Exchange shufflepartitionidpassthrough") == 1  # the other merges partial counts
    refs = df.select(F.col("n").alias("ident"), F.lit("parent").alias("endpoint"), F.col("key").alias("ref"), F.lit(None).cast("timestamp").alias("at"))
    text = orphans.missing(refs, refs.select("ref"))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in text and text.count("Exchange hashpartitioning") == 0
