"""Readers and writers: round trips and the fine print of each format."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from ancestra.functions.identity import reference_id
from ancestra.operators import nested
from ancestra.operators.graph import Store
from ancestra.sources import readers, writers


@pytest.fixture
def store(spark):
    v = spark.createDataFrame([("a" * 32, {"type": "Process", "name": 'say "hi"', "k:x": "1:2"}), ("b" * 32, {"type": "Artifact", "path": "/x"}), ("c" * 32, {"path": "no type"})], "id string, annotations map<string,string>")
    e = spark.createDataFrame([("d" * 32, "a" * 32, "b" * 32, {"type": "Used", "time": "1"})], "id string, child string, parent string, annotations map<string,string>")
    return Store.of(v, e)


def content(s: Store):
    return sorted((r.id, tuple(sorted(r.annotations.items()))) for r in s.vertices.collect()), sorted((r.child, r.parent, tuple(sorted(r.annotations.items()))) for r in s.edges.collect())


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_dot_round_trip(spark, store, tmp_path):
    writers.write_dot(store.vertices.where(~F.map_contains_key("annotations", "k:x")), store.edges, str(tmp_path / "g"))
    got = content(readers.read_dot(spark, str(tmp_path / "g")))
    want = content(store)
    assert got == ([x for x in want[0] if x[0][0] != "a"], want[1])
    whole = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part*")))
    assert whole.startswith("digraph") and whole.endswith("}\n") and whole.count("digraph") == 1


def test_json_round_trip(spark, store, tmp_path):
    writers.write_json(store.vertices, store.edges, str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("part*") for x in p.read_text().splitlines()]
    one = write(tmp_path, "one.json", json.dumps(lines))
    v, e = content(readers.read_json(spark, one))
    want = content(store)
    assert content(readers.read_json(spark, str(tmp_path / "j"), lines=True)) == (v, e)
    assert v == [x for x in want[0] if x[0][0] != "c"] and e == want[1]


def test_json_leaves_out_what_is_no_element(spark, tmp_path):
    p = write(tmp_path, "x.json", json.dumps([{"id": "", "type": "Process", "annotations": {}}, {"id": "q", "type": "Process"}, {"id": "r", "annotations": {}}, {"id": "s", "type": "Agent", "annotations": {"n": None, "m": "1"}}, {"from": "s", "type": "Used"}]))
    s = readers.read_json(spark, p)
    assert [r.annotations for r in s.vertices.collect()] == [{"type": "Agent", "m": "1"}] and s.edges.count() == 0
    assert s.vertices.first().id == spark.range(1).select(reference_id(F.lit("s"))).first()[0]


def test_text_round_trip(spark, tmp_path, store):
    plain = store.vertices.where("id <> '" + "a" * 32 + "'")
    writers.write_text(plain, store.edges, str(tmp_path / "t"))
    got, want = content(readers.read_text(spark, str(tmp_path / "t"))), content(store)
    assert got == ([x for x in want[0] if x[0][0] != "a"], want[1])


def test_parquet_and_messages(spark, store, tmp_path):
    writers.write_parquet(store.vertices, store.edges, str(tmp_path / "p"))
    assert content(readers.read_parquet(spark, str(tmp_path / "p"))) == content(store)
    writers.write_elements_json(store.vertices, store.edges, str(tmp_path / "m"))
    assert content(readers.read_elements_json(spark, str(tmp_path / "m"))) == content(store)


def test_database_by_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "PIECE", 2)
    monkeypatch.setattr(readers, "PIECE", 2)
    v = spark.createDataFrame([(f"{i:x}" * 32, {"type": "Process", "n": 'a "b", é\n'} if i % 3 else None if i % 2 else {}) for i in range(11)], "id string, annotations map<string,string>").repartition(3)
    e = spark.createDataFrame([("d" * 32, "a" * 32, "b" * 32, {"type": "Used", "x": ""})], "id string, child string, parent string, annotations map<string,string>")
    url, own = f"jdbc:derby:{tmp_path}/db", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = lambda d: sorted((r.id, sorted((r.annotations or {"none": ""}).items())) for r in d.collect())
    writers.write_jdbc(v, e, f"{url};create=true", own, by_driver=True)
    for by_driver in (True, False):
        got = readers.read_jdbc(spark, url, own, by_driver=by_driver)
        assert rows(got.vertices) == rows(v) and rows(got.edges) == rows(e)
    writers.write_jdbc(v.limit(0), e.limit(0), f"jdbc:derby:{tmp_path}/none;create=true", own, by_driver=True)
    none = readers.read_jdbc(spark, f"jdbc:derby:{tmp_path}/none", own, by_driver=True)
    assert none.vertices.count() == none.edges.count() == 0


def test_database_on_a_cluster(spark, store, tmp_path):
    """Executors in JVMs of their own don't reach the driver's database."""
    store.vertices.withColumnRenamed("id", "hash").write.parquet(str(tmp_path / "vertices.parquet"))
    store.edges.select(F.col("id").alias("hash"), F.col("child").alias("childvertexhash"), F.col("parent").alias("parentvertexhash"), "annotations", "ref").write.parquet(str(tmp_path / "edges.parquet"))
    run = """if True:
        import sys
        from pyspark.sql import SparkSession
        from ancestra.queries import formats
        d = sys.argv[1]
        conf = {"spark.master": "local-cluster[2,1,1024]", "spark.checkpoint.dir": f"file://{d}/shared", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.driver.host": "127.0.0.1"}
        spark = SparkSession.builder.config(map=conf).getOrCreate()
        formats.QUERIES["s_jdbc"](spark, d).write.parquet(f"{d}/out")
        spark.stop()
    """
    env = {k: x for k, x in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": os.pathsep.join(sys.path)}
    got = subprocess.run([sys.executable, "-c", run, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert got.returncode == 0, got.stderr[-2000:]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in out.where("kind = 'vertex'").collect()) == ["a" * 32, "b" * 32, "c" * 32]
    assert [(r.child, r.parent, r.text) for r in out.where("kind = 'edge'").collect()] == [("a" * 32, "b" * 32, "{time=1, type=Used}")]


def test_dsl_lines(spark, tmp_path):
    p = write(tmp_path, "x.dsl", "type:Process id:1 name:root\\ process cmd:a\\:b\ntype:Artifact id:2\nTYPE:Used from:1 to:2 op:read op:write\ntype:Nothing id:3\n\nnonsense\n")
    s = readers.read_dsl(spark, p)
    v, e = content(s)
    assert [dict(a) for _, a in sorted(v, key=lambda x: len(x[1]))] == [{"type": "Artifact"}, {"type": "Process", "name": "root process", "cmd": "a:b"}]
    assert [dict(x[2]) for x in e] == [{"type": "Used", "op": "write"}]
    assert {e[0][0], e[0][1]} == {x[0] for x in v}


def test_provenance_texts(spark, store, tmp_path):
    kind = F.create_map(F.lit("type"), F.lit("Activity"), F.lit("a b"), F.lit('"'))
    v = store.vertices.withColumn("annotations", kind)
    read = lambda p: "\n".join(x.read_text() for x in (tmp_path / p).glob("part*"))
    writers.write_provn(v, store.edges, str(tmp_path / "n"))
    assert f'activity(data:{"a" * 32}, [data:a_b="\'"])' in read("n") and f"used(data:{'a' * 32}, data:{'b' * 32}" in read("n")
    writers.write_turtle(v, store.edges, str(tmp_path / "o"))
    assert f"data:{'a' * 32} prov:used data:{'b' * 32} ." in read("o")
    writers.write_datalog(v, store.edges, str(tmp_path / "d"))
    assert read("d").strip().startswith(f"parent('{'a' * 32}','{'b' * 32}').") or f"\nparent('{'a' * 32}','{'b' * 32}').\n" in read("d")
    assert {(r.id[0], r.field) for r in writers.attribute_rows(store.vertices).collect()} >= {("b", "path"), ("c", "path")}
    assert writers.adjacency(store.edges, "d").first().neighbours == ["a" * 32]


def test_dependency_map(spark, tmp_path):
    p = write(tmp_path, "m.dot", '"a" -> "b" [label="WasDependentOn" color="x"];\n"c" -> "d" [label="Other"];\n')
    assert list(readers.dependency_map(spark, p)) == [("a", "b")]


def test_other_sources(spark, tmp_path):
    prov = write(tmp_path, "p.json", json.dumps({"entity": {"e1": {"path": "/x"}}, "activity": {"a1": {}}, "used": {"u": {"prov:activity": "a1", "prov:entity": "e1", "t": "1"}, "bad": {}}}))
    v, e = content(readers.read_prov_json(spark, prov))
    assert len(v) == 2 and [dict(x[2]) for x in e] == [{"type": "Used", "t": "1"}]
    csv = write(tmp_path, "e.csv", 'Time of Day,Process Name,PID,Operation,Path\n1,x.exe,7,ReadFile,C:\\a\n2,x.exe,7,WriteFile,C:\\b\n3,x.exe,,WriteFile,C:\\b\n')
    v, e = content(readers.read_events_csv(spark, csv))
    assert len(v) == 3 and sorted(dict(x[2])["type"] for x in e) == ["Used", "WasGeneratedBy"]
    trace = write(tmp_path, "t.txt", '12 1.5 open("/etc/x", O_RDONLY) = 3\n12 1.6 write("/tmp/y") = 5\n12 1.7 fork() = 13\n12 1.8 open("/no") = -1 ENOENT\n')
    v, e = content(readers.read_trace(spark, trace))
    assert len(v) == 4 and sorted(dict(x[2])["operation"] for x in e) == ["fork", "open", "write"]
    audit = write(tmp_path, "a.log", 'node=n type=SYSCALL msg=audit(1.5:9): pid=5 comm="a b" key=(null)\nother\n')
    r = readers.read_audit(spark, audit).first()
    assert (r.time, r.event_id, r.record, r.fields) == ("1.5", "9", "SYSCALL", {"pid": "5", "comm": "a b", "key": "(null)"})
    block = write(tmp_path, "b.json", json.dumps({"hash": "B", "height": 1, "tx": [{"hash": "T", "inputs": [{"prev_out": {"addr": "X", "n": 0, "tx_index": 5, "value": 9}}], "out": [{"addr": "Y", "n": 1, "tx_index": 6, "value": 9}]}]}))
    v, e = content(readers.read_blocks(spark, block))
    assert sorted(dict(x[2])["type"] for x in e) == ["Used", "WasAttributedTo", "WasAttributedTo", "WasGeneratedBy", "WasInformedBy"]


def test_nested_records_as_a_store(spark):
    texts = [("RECORD_SUBJECT", {"uuid": "s", "type": "SUBJECT_PROCESS", "cid": 5}), ("RECORD_FILE_OBJECT", {"uuid": "o"}), ("RECORD_EVENT", {"uuid": "x", "type": "EVENT_READ", "subject": {"a.b.UUID": "s"}, "predicateObject": "o", "sequence": {"long": 3}}), ("RECORD_EVENT", {"uuid": "y", "type": "EVENT_WRITE", "subject": "s"})]
    df = spark.createDataFrame([(i, r, json.dumps(x)) for i, (r, x) in enumerate(texts)], "k bigint, rectype string, t string")
    bodies = nested.normalise(df, "k", "t", []).join(df.select("k", "rectype"), "k")
    v, e = content(readers.cdm_store(bodies))
    assert sorted(dict(a)["type"] for _, a in v) == ["Object", "Subject"] and [dict(x[2])["operation"] for x in e] == ["EVENT_READ"]
