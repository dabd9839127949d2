"""Semantics that the catalogue's queries don't reach: order, errors, persistence, parsers, streams."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import Bloom, Catalog, Collection, CountingBloom, Dataset, Fifo, Graph, InvertedFile, Many, OrderedMap, Range, Search, Sequence, StringSet, Unique, Vector, addressed
from tessera import errors as E
from tessera.functions import types
from tessera.functions.text import terms
from tessera.operators import fulltext, structures
from tessera.plans import boolquery, pattern
from tessera.streaming import counters

POSTS = [("p1", "alice", 100, 5, "red fox"), ("p2", "alice", 300, 7, "blue fox"), ("p3", "alice", 200, 7, "red dog"), ("p4", "bob", 150, 1, "a cat"), ("p5", "bob", 400, 9, "red cat")]
INDEXES = {"feed": Many("username", "created_at", True, True), "engagement": Range("engagement"), "text": Search(("text",), "bm25"), "id": Unique("id")}


@pytest.fixture(scope="module")
def posts(spark):
    return Collection(spark.createDataFrame(POSTS, "id string, username string, created_at long, engagement long, text string"), "id", INDEXES)


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_feeds(posts):
    assert ids(posts.find("feed", "alice")) == ["p2", "p3", "p1"] and ids(posts.find("feed", "bob")) == ["p5", "p4"]
    assert ids(posts.find("feed", "alice", limit=2)) == ["p2", "p3"] and ids(posts.find("feed", "nobody")) == []
    assert ids(posts.find("feed", "alice", 300, 150)) == ["p2", "p3"]
    assert ids(posts.range("engagement", desc=True)) == ["p5", "p3", "p2", "p1", "p4"] and ids(posts.range("engagement", 5, 7)) == ["p1", "p2", "p3"]
    assert ids(posts.latest("engagement")) == ["p5"] and ids(posts.first("engagement")) == ["p4"]
    assert [tuple(r) for r in posts.groups("feed").collect()] == [("alice", 3), ("bob", 2)]
    assert posts.count("feed", "alice", 150, 300).first()[0] == 2
    assert ids(posts.where(lambda r: r["engagement"] > 6 and "red" in r["text"]).orderBy("id")) == ["p3", "p5"]
    assert ids(posts.search("text", "red AND NOT dog")) == ["p1", "p5"]
    assert ids(posts.search("text", "red OR fox", {"username": "alice"}, limit=1)) == ["p1"]
    assert len(ids(posts.sample(2, 1))) == 2 and "p1" not in posts.describe(0)


def test_descending_strings(spark):
    df = spark.createDataFrame([("1", "g", "a"), ("2", "g", "ab"), ("3", "g", "b")], "id string, g string, s string")
    assert ids(Collection(df, "id", {"m": Many("g", "s", True)}).find("m", "g")) == ["3", "1", "2"]


def test_keys_tie_as_strings(spark):
    df = spark.createDataFrame([(9, 1), (10, 1), (2, 1)], "id long, v long")
    assert ids(Collection(df, "id", {"v": Range("v")}).range("v")) == [10, 2, 9]


def test_changes(posts, spark):
    new = spark.createDataFrame([("p1", "zoe", 1, 1, "x", 1), ("p1", "zoe", 2, 2, "y", 2), ("p9", "bob", 5, 5, "z", 3)], "id string, username string, created_at long, engagement long, text string, at long")
    after = posts.insert_many(new, "at")
    assert sorted((r["id"], r["created_at"]) for r in after.df.collect()) == [("p1", 2), ("p2", 300), ("p3", 200), ("p4", 150), ("p5", 400), ("p9", 5)]
    assert after.update(["p9"], text="new").get("id", "p9").first()["text"] == "new"
    assert after.increment(["p9"], "engagement", 3).get("id", "p9").first()["engagement"] == 8
    assert sorted(ids(after.delete(["p1", "p9"]).df)) == ["p2", "p3", "p4", "p5"]
    clash = Collection(posts.df, "id", {"u": Unique("engagement")})
    with pytest.raises(E.UniqueViolation):
        clash.insert_many(new.drop("at").limit(1))
    with pytest.raises(E.SchemaError):
        posts.update(["p1"], id="x")
    for wrong in ({"x": Range("nope")}, {"x": Vector("text")}):
        with pytest.raises(E.SchemaError):
            Collection(posts.df, "id", wrong)


def test_catalog(spark, tmp_path):
    db = Catalog(spark, str(tmp_path / "db"))
    db.collection("users", {"uid": "utf8[8!]", "name": "utf8[6]", "age": "int32", "at": "datetime"}, "uid", {"name": Many("name", "age", True, True)})
    db.write("users", spark.createDataFrame([("u1", "anna é é", 3), ("u2", "bob", None)], "uid string, name string, age int"))
    got = {r["uid"]: r for r in db.read("users").collect()}
    assert got["u1"]["name"] == "anna " and got["u2"]["age"] == 0 and got["u2"]["at"].year == 1970
    with pytest.raises(E.NameTaken):
        db.create("users")
    with pytest.raises(E.NotFound):
        db.read("nope")
    with pytest.raises(E.SchemaError):
        db.write("users", spark.createDataFrame([(1,)], "other long"))
    with pytest.raises(Exception, match="longer than 8 bytes"):
        db.write("users", spark.createDataFrame([("u" * 9,)], "uid string"))
    version = db.version
    with pytest.raises(RuntimeError):
        with db.durable():
            db.create("a")
            db.create("b", "queue", {"x": "int64"})
            raise RuntimeError
    assert db.version == version and "a" not in db
    with db.durable():
        db.create("a")
        db.append("users", spark.createDataFrame([("u3", "c", 5)], "uid string, name string, age int"))
    again = Catalog(spark, str(tmp_path / "db"), "r")
    assert again.names() == ["a", "users"] and again.read("users").count() == 3 and again.version == version + 1
    assert ids(again.collection("users").find("name", "bob"), "uid") == ["u2"]
    with pytest.raises(E.ReadOnly):
        again.create("c")
    read = db.handle("a")
    db.migrate("users", {"uid": "utf8[8!]", "first": "text", "age": "int32", "score": "float64"}, {"first": F.upper("name")}, {})
    assert sorted((r["first"], r["age"], r["score"]) for r in db.read("users").collect()) == [("ANNA ", 3, 0.0), ("BOB", 0, 0.0), ("C", 5, 0.0)]
    db.drop("a")
    with pytest.raises(E.Dropped):
        read()
    db.vacuum(1)
    assert db.verify()["ok"] and db.stats()["users"]["rows"] == 3
    assert Catalog(spark, str(tmp_path / "db")).read("users").count() == 3


def test_dataset_and_structures(spark):
    d = Dataset(addressed(spark.range(20).select((F.col("id") * 2).alias("x")), ["x"]))
    first = d.df.orderBy("_addr").first()["_addr"]
    assert d.record(first) == {"x": 0} and d.write_field(first, "x", 7).record(first) == {"x": 7}
    gone = d.delete(spark.createDataFrame([(first,)], "a long"))
    with pytest.raises(E.NotFound):
        gone.record(first)
    assert [r["valid"] for r in gone.read_many(first, 3).collect()] == [False, True, True]
    rows = [(i * 3, f"v{i}", i not in (2, 5)) for i in range(12)]
    seq = Sequence(spark.createDataFrame(rows, "_pos long, v string, _valid boolean"))
    live = [v for _, v, ok in rows if ok]
    for s in (slice(None), slice(2, 8), slice(None, None, -1), slice(-3, None), slice(8, 1, -2), slice(1, 100, 4)):
        assert ids(seq.slice(s.start, s.stop, s.step), "v") == live[s]
    assert ids(seq.at(-1), "v") == [live[-1]] and ids(seq.at(0), "v") == [live[0]] and ids(seq.at(99), "v") == []
    q = Fifo(spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "_seq long, x string"))
    taken = []
    with pytest.raises(E.Empty):
        while True:
            row, q = q.pop()
            taken.append(row["x"])
    assert taken == ["a", "b", "c"]
    jobs = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate([("sweep", 2), ("bake", 8), ("wash", 3), ("cook", 8), ("iron", 3)])], "seq long, t string, p long")
    assert ids(structures.drain_priority(jobs, "p", "seq"), "t") == ["bake", "cook", "wash", "iron", "sweep"]
    log = [("set", "a"), ("set", "b"), ("set", "c"), ("get", "a"), ("set", "d"), ("get", "c"), ("get", "b"), ("set", "e")]
    log = spark.createDataFrame([("x", k, i, op, float(i)) for i, (op, k) in enumerate(log)], "cache string, key string, seq long, op string, v double")
    assert [r["key"] for r in structures.lru_replay(log, "cache", "key", "seq", "op", 3, "v").orderBy("rank").collect()] == ["e", "c", "d"]
    a, b = (StringSet(spark.createDataFrame([(x,) for x in s], "member string")) for s in ("abc", "ab"))
    assert b.issubset(a) and a.issuperset(b) and not a.isdisjoint(b)
    with pytest.raises(E.NotFound):
        a.remove("z")
    with pytest.raises(E.NestingNotSupported):
        structures.nested("set", "map", a.df, "member")
    with pytest.raises(E.SchemaError):
        OrderedMap(spark.range(3).withColumnRenamed("id", "_key")).prefix("a")


@pytest.fixture(scope="module")
def social(spark):
    nodes = spark.createDataFrame([("alice", "Al", 30), ("bob", "Bo", 25), ("carol", "Ca", 40), ("dave", "Da", 20)], "id string, name string, age long")
    edges = spark.createDataFrame([("alice", "bob", 0.9, 2020), ("alice", "carol", 0.5, 2021), ("bob", "carol", 0.7, 2019), ("carol", "dave", 0.3, 2022), ("ghost", "dave", 1.0, 1)], "src string, dst string, weight double, since long")
    return Graph(nodes, edges, True, "name")


@pytest.mark.parametrize(
    ("pattern_text", "want"),
    [
        ('MATCH (a)-[+]->(b) WHERE id(a) == "alice" RETURN id(b)', {"bob", "carol", "dave"}),
        ('MATCH (a)-[*2]->(b) WHERE id(a) == "alice" RETURN id(b)', {"dave"}),
        ('MATCH (a)-[*2..4]->(b) WHERE id(a) == "alice" RETURN id(b)', {"dave"}),
        ('MATCH (a)-[?]->(b) WHERE id(a) == "alice" RETURN id(b)', {"alice", "bob", "carol"}),
        ('MATCH (a)<-[r]-(b) WHERE id(a) == "dave" RETURN id(b)', {"carol", "ghost"}),
        ('MATCH (a)-[r]->(b) WHERE r.weight > 0.6 AND id(a) == "alice" OR r.since == 2022 RETURN id(b)', {"bob", "dave"}),
        ('MATCH (a:Al)-[r]->(b {age: 25}) RETURN id(b)', {"bob"}),
        ('MATCH (g)-->(d) WHERE id(g) == "ghost" RETURN id(d)', set()),
        ('MATCH (a)-->(b)-->(c) WHERE a.name != "x" RETURN id(c)', {"carol", "dave"}),
        ('MATCH (a)-->(b) WHERE b.missing != 3 RETURN id(b)', set()),
        ('MATCH (a)--(b) WHERE label(a) == "Da" RETURN id(b)', {"carol", "ghost"}),
    ],
)
def test_patterns(social, pattern_text, want):
    assert {r[0] for r in social.query(pattern_text).collect()} == want


def test_pattern_items_and_errors(social):
    df = social.query("MATCH (a)-[r]->(b) LIMIT 2")
    assert df.columns == ["a", "id(a)", "b", "id(b)", "r"] and df.count() == 2
    assert social.query("MATCH (a)-[r]->(b) RETURN r.weight, a.name LIMIT 0").count() == 0
    for bad in ("MATCH (a)", "MATCH (a)-[*2]->(b)-->(c)", "RETURN a", "MATCH (a)-->(b) WHERE a.x ~ 3", "MATCH (a)<-->(b)"):
        with pytest.raises(ValueError):
            pattern.parse(bad)
    assert social.counts().first().asDict() == {"nodes": 4, "edges": 4}
    assert {r["id"]: r["degree"] for r in social.degrees("both").collect()}["carol"] == 3


def test_bfs_against_plain_python(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)}
    g = Graph(spark.createDataFrame([(i,) for i in range(40)], "id long"), spark.createDataFrame(list(edges), "src long, dst long"))
    want = set()
    for s in range(40):
        seen, level = {s}, {s}
        for depth in range(1, 5):
            level = {b for a, b in edges if a in level} - seen
            seen |= level
            want |= {(s, x, depth) for x in level}
    assert {tuple(r) for r in g.reachable(g.nodes, 1, 4).collect()} == want


def test_text(spark):
    df = spark.createDataFrame([(0, 'Hello_World "été" L’été'), (1, None)], "id long, t string")
    assert [r[0] for r in df.select(terms(F.col("t"))).collect()] == [["helloworld", '"', "ete", '"', "l", "ete"], []]
    with pytest.raises(ValueError):
        boolquery.parse("a AND (b")
    assert boolquery.parse("a AND b OR c") == boolquery.Op("AND", boolquery.Term("a"), boolquery.Op("OR", boolquery.Term("b"), boolquery.Term("c")))
    words = "a b c d e f".split()
    for seed in (0, 1, 7):
        rng = random.Random(seed)
        docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7)))) for i in range(40)]
        frame = spark.createDataFrame(docs, "id long, t string")
        index = fulltext.postings(frame, "id", ["t"])
        for q in ("a AND b OR c", "(a OR b) AND NOT c", "a AND NOT b AND NOT c"):

            def holds(node, have):
                if isinstance(node, boolquery.Term):
                    return node.text in have
                x, y = holds(node.left, have), holds(node.right, have)
                return {"AND": x and y, "OR": x or y, "ANDNOT": x and not y}[node.kind]

            want = {i for i, t in docs if holds(boolquery.parse(q), set(t.split()))}
            assert set(ids(fulltext.search(frame, q, "id", ["t"]))) == want == set(ids(fulltext.matching(index, q), "doc_id"))


def test_vectors_and_sketches(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>")
    for metric in ("cosine", "dot", "l2"):
        index = InvertedFile(metric, 8).train(df)
        q = [float(v) for v in x[3]]
        full = index.search(index.assign(df), q, 10, 8).collect()
        s = x @ x[3] if metric == "dot" else -((x - x[3]) ** 2).sum(1) if metric == "l2" else (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x[3] / np.linalg.norm(x[3]))
        assert [r["id"] for r in full] == np.argsort(-s, kind="stable")[:10].tolist()
    with pytest.raises(RuntimeError):
        InvertedFile().assign(df)
    f = Bloom(300, 0.01)
    inside, outside = (spark.createDataFrame([(f"{p}{i}",) for i in range(300)], "k string") for p in "ab")
    bits = f.build(inside, "k")
    assert f.might_contain(bits, inside, "k").where("not maybe").count() == 0
    assert f.might_contain(bits, outside, "k").where("maybe").count() <= 15
    with pytest.raises(E.CounterOverflow):
        c = CountingBloom(10, 0.1, 2)
        c.checked(c.counters(spark.createDataFrame([("x",)] * 3, "k string"), "k"))


def test_types(spark):
    df = spark.createDataFrame([("é" * 5, 300)], "s string, n int")
    assert df.select(types.stored(F.col("s"), "utf8[5]")).first()[0] == "éé" and df.select(types.stored(F.col("s"), "U2")).first()[0] == "éé"
    with pytest.raises(Exception, match="beyond uint8"):
        df.select(types.stored(F.col("n"), "uint8")).collect()
    for bad in ("utf8", "U0", "text[3]", "nope"):
        with pytest.raises(E.SchemaError):
            types.data_type(bad)
    t = spark.sql("select timestamp_ntz'2024-03-05 06:07:08.000009' as t")
    assert t.select(types.dt_key(F.col("t"), "microsecond")).first()[0] == "20240305060708000009"
    assert t.select(types.key_dt(types.dt_key(F.col("t")))).first()[0].second == 8


def test_streams(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    source.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = counters.windowed_counts(stream, "ts", "event_type", late="3650 days").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["start"], r["event_type"], r["n"]) for r in counters.windowed_counts(source, "ts", "event_type").collect()}
    assert {(r["start"], r["event_type"], r["n"]) for r in spark.table("counted").collect()} == want
    log = stream.select(F.lit("one").alias("c"), "event_type", "event_id", F.lit("set").alias("op"))
    q = counters.lru_stream(log, "c", "event_type", "event_id", "op", 3).writeStream.format("memory").queryName("cached").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = [r["event_type"] for r in source.groupBy("event_type").agg(F.max("event_id").alias("m")).orderBy(F.col("m").desc()).limit(3).collect()]
    assert spark.table("cached").collect()[-1]["keys"] == last
