"""Changes, handles and errors of structures, the catalog's commits, and indexes that are stored."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import Blobs, Bloom, Catalog, Collection, Dataset, FlatIndex, InvertedFile, KeyedMap, LruMap, Many, Nested, PriorityQueue, Range, SearchIndex, Sequence, StringSet, Unique, Vector
from tessera import errors as E
from tessera.operators import sketches, vectors
from tessera.session import last_of, numbered


def test_numbered_and_last(spark):
    df = spark.createDataFrame([(i * 7 % 100, f"v{i}") for i in range(100)], "k long, v string").repartition(5)
    assert [(r["n"], r["k"]) for r in numbered(df, ["k"], "n", 3).orderBy("n").collect()] == [(i + 3, i) for i in range(100)]
    assert numbered(df.limit(0), ["k"], "n").count() == 0
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (None, "c", 1), (None, "d", None), (2, "e", None)], "k long, v string, o long").coalesce(1)
    assert {(r["k"], r["v"]) for r in last_of(rows, ["k"]).collect()} == {(1, "b"), (None, "d"), (2, "e")}
    assert {(r["k"], r["v"]) for r in last_of(rows, ["k"], "o").collect()} == {(1, "a"), (None, "c"), (2, "e")}


def test_missing_keys_and_repeated_ones(spark):
    df = spark.createDataFrame([("a", 1, 2.5), ("b", 2, 3.5)], "id string, n long, x double")
    c = Collection(df, "id", {"u": Unique("n"), "g": Many("n", "x"), "r": Range("x")})
    for act in (lambda: c.update(["z"], n=1), lambda: c.increment(["a", "z"], "n"), lambda: c.delete(["z"]), lambda: c.record("z"), lambda: c.delete(spark.createDataFrame([("z",)], "id string"))):
        with pytest.raises(E.NotFound):
            act()
    assert c.update(["z", "a"], "ignore", n=9).record("a")["n"] == 9 and len(c.delete(["z"], "ignore")) == 2
    new = c.insert_many(spark.createDataFrame([("c", 5, 1.0), ("c", 6, 2.0), ("a", 7, 0.0)], "id string, n long, x double").coalesce(1))
    assert {r["id"]: r["n"] for r in new} == {"a": 7, "b": 2, "c": 6}
    assert "a" in c and "z" not in c and c.ref("a").get("x") == 2.5 and c.ref("b").update(x=9.0).record("b")["x"] == 9.0
    with pytest.raises(E.UniqueViolation):
        c.insert(id="d", n=1, x=0.0)
    with pytest.raises(E.SchemaError):
        c.insert(n=1)
    assert [c.candidates(w) for w in ({"n": 1, "x": (0, 1)}, {"n": 1}, {"x": (0, 1)}, None)] == [(3, "g"), (2, "u"), (1, "r"), (0, "scan")]
    plan = c.get_primary("a")._jdf.queryExecution().toString()
    assert "cast(id" not in plan


def test_records_and_blobs(spark):
    empty = spark.createDataFrame([], "x long, s string, _addr long, _deleted boolean")
    d, ref = Dataset(empty, "d").insert_one(x=5, s="a")
    d, ids = d.insert(spark.createDataFrame([(2, "c"), (1, "b")], "x long, s string"), "x")
    assert ref.key == 0 and sorted(r[0] for r in ids.collect()) == [1, 2] and d.record(1) == {"x": 1, "s": "b"}
    assert d.ref(2)["s"] == "c" and d.ref(2).set("s", "z").record(2)["s"] == "z" and d.write(2, x=9).record(2) == {"x": 9, "s": None}
    over = d.write_many(spark.createDataFrame([(7, "n", 1), (8, "m", 99)], "x long, s string, _addr long"))
    assert over.record(1) == {"x": 7, "s": "n"} and over.df.count() == 3
    gone = d.delete(spark.createDataFrame([(0,)], "a long"))
    with pytest.raises(E.Deleted):
        gone.record(0)
    with pytest.raises(E.NotFound):
        d.record(77)
    with pytest.raises(E.WrongOwner):
        Dataset(empty, "other").read(ref)
    with pytest.raises(E.SchemaError):
        d.write(0, nope=1)
    with pytest.raises(E.SchemaError):
        d.ref(0).get("nope")
    heap, one = Blobs(spark.createDataFrame([], "blob_id long, data binary")).write(b"\x00x")
    heap, two = heap.write(b"")
    assert (one, two) == (0, 1) and heap.read(0) == b"\x00x" and heap.read(1) == b""
    with pytest.raises(E.NotFound):
        heap.delete(0).read(0)


def test_structures(spark):
    s = Sequence(spark.createDataFrame([(i, True, f"v{i}") for i in range(6)], "_pos long, _valid boolean, v string"))
    assert s.slice_array(1, 3).column("v").to_pylist() == ["v1", "v2"]
    holed = s.delete_at(1).delete_at(-1)
    with pytest.raises(E.HasHoles):
        holed.slice_array()
    assert holed.sparse() and not s.sparse() and not holed.compact().sparse() and holed.compact().slice_array().num_rows == 4
    with pytest.raises(IndexError):
        s.set(6, v="x")
    with pytest.raises(E.Empty):
        StringSet(spark.createDataFrame([], "member string")).pop()
    assert len(StringSet(spark.createDataFrame([("a",)], "member string")).add("a").add("b")) == 2
    with pytest.raises(E.Empty):
        PriorityQueue(spark.createDataFrame([], "priority long, _seq long")).pop()
    m = KeyedMap(spark.createDataFrame([(1, "a")], "_key long, v string"))
    with pytest.raises(E.NotFound):
        m.remove([1, 2])
    assert len(m.remove([1, 2], "ignore")) == 0 and m.record(1) == {"v": "a"} and m.get_ref(1).set("v", "b").record(1) == {"v": "b"}
    lru = LruMap(spark.createDataFrame([], "_key string, a long, b long, _used long"), 2).set("x", a=1, b=2).set("y", a=3)
    lru = lru.set("x", b=5, other=1)
    assert lru.get("x")[0] == {"a": 1, "b": 5} and lru.is_full() and len(lru) == 2 and lru.get("q")[0] is None
    assert [r[0] for r in lru.set("z", a=0).keys().collect()] == ["z", "x"]
    with pytest.raises(E.NotFound):
        lru.delete("q")
    outer = Nested(spark.createDataFrame([("p", 1, "a"), ("q", 1, "b")], "o string, _key long, v string"), "o")
    inner = outer.open("new").put_one(4, v="d")
    assert {tuple(r) for r in outer.write_back("new", inner).df.collect()} == {("p", 1, "a"), ("q", 1, "b"), ("new", 4, "d")}
    with pytest.raises(E.SchemaError):
        outer.from_ref({"outer": "o", "key": "p", "inner": "Sequence"})


def test_appends_write_new_rows_only(spark, tmp_path):
    db = Catalog(spark, str(tmp_path / "db"))
    db.create("t", "dataset", {"x": "int64"})
    db.write("t", spark.range(100).withColumnRenamed("id", "x"))
    before = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "db").rglob("*.parquet"))}
    db.append("t", spark.createDataFrame([(500,)], "x long"))
    db.append("t", spark.createDataFrame([(501,)], "x long"))
    after = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "db").rglob("*.parquet"))}
    assert before.items() <= after.items() and db.read("t").count() == 102 and len(db.entry("t")["paths"]) == 3
    new = [f for f in after if f not in before]
    assert sum(spark.read.parquet(f).count() for f in new) == 2
    db.vacuum()
    assert db.read("t").count() == 102 and len(db.entry("t")["paths"]) == 1


def test_two_writers(spark, tmp_path):
    """Both begin from one version: the second to commit is refused, and what it wrote isn't seen."""
    one = Catalog(spark, str(tmp_path / "db"))
    one.create("t", "dataset", {"x": "int64"})
    two = Catalog(spark, str(tmp_path / "db"))
    one.write("t", spark.createDataFrame([(1,)], "x long"))
    with pytest.raises(E.NameTaken):
        two.write("t", spark.createDataFrame([(2,)], "x long"))
    assert [r[0] for r in Catalog(spark, str(tmp_path / "db"), "r").read("t").collect()] == [1]
    two.refresh()
    two.append("t", spark.createDataFrame([(2,)], "x long"))
    assert sorted(r[0] for r in two.read("t").collect()) == [1, 2]


def test_kinds_and_options(spark, tmp_path):
    db = Catalog(spark, str(tmp_path / "db"))
    for kind, options in (("flat", {}), ("flat", {"dim": 4, "metric": "no"}), ("bloom", {"rate": 2}), ("lru", {"capacity": 0}), ("queue", {"nope": 1}), ("search", {}), ("nope", {})):
        with pytest.raises(E.SchemaError):
            db.create("x", kind, **options)
    db.create("jobs", "priority", {"priority": "float64", "task": "text", "_seq": "int64"}, max_first=False)
    q = db.open("jobs").push_one(priority=2.0, task="b").push_one(priority=1.0, task="a")
    db.save("jobs", q)
    assert db.open("jobs").peek().first()["task"] == "a"
    db.create("near", "flat", dim=2)
    db.save("near", db.open("near").add_many(spark.createDataFrame([(1, [3.0, 4.0])], "id long, vec array<double>")))
    assert db.open("near").search([3.0, 4.0], 1).first()["score"] == pytest.approx(1.0)
    db.create("words", "search", text_fields=["t"])
    db.open("words").add_many(spark.createDataFrame([(1, "red fox"), (2, "fox")], "id long, t string"), "id")
    assert [r[0] for r in db.open("words").search("red AND fox").collect()] == [1] and len(db.open("words")) == 2


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(0, "red red fox"), (1, "Blue fox"), (2, "red dog"), (3, ""), (4, None)], "id long, t string")
    index = SearchIndex.create(spark, str(tmp_path / "ix"), ["t"]).add_many(docs, "id")
    index = SearchIndex.open(spark, str(tmp_path / "ix"))
    assert index.n == 5 and index.total == 7 and len(index) == 5 and 3 in index and 9 not in index
    c = Collection(docs, "id", {"t": __import__("tessera").Search(("t",), "bm25")})
    for q in ("red", "red OR fox", "fox AND NOT red", "r* AND fox", "red dog OR fox"):
        for mode in ("boolean", "bm25", "tfidf"):
            want = {r["id"]: r["score"] for r in c.search("t", q, mode=mode, with_scores=mode != "boolean").select("id", "score" if mode != "boolean" else F.lit(None).alias("score")).collect()}
            got = {r["doc_id"]: r["score"] for r in index.search(q, mode).collect()}
            assert got.keys() == want.keys() and all(got[k] == want[k] or got[k] == pytest.approx(want[k]) for k in got)
    gone = index.delete([0])
    assert {r[0] for r in gone.search("red").collect()} == {2} and 0 not in gone and len(gone) == 4
    assert gone.get_document(0, docs, "id").first()["t"] == "red red fox"
    with pytest.raises(E.NotFound):
        gone.delete([0])
    merged = gone.merged()
    assert merged.n == 4 and {r[0] for r in merged.search("red").collect()} == {2} and merged.tombstones == ()
    with pytest.raises(ValueError):
        index.search("*")


def test_vectors(spark, sf):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(50)], "id long, vec array<double>")
    flat = FlatIndex.empty(spark, 8, "dot").add_many(df)
    with pytest.raises(E.NotFound):
        flat.remove([1, 99])
    assert len(flat.remove([1, 2])) == 48
    with pytest.raises(Exception, match="not 8 numbers"):
        flat.add_many(spark.createDataFrame([(1, [1.0])], "id long, vec array<double>")).df.collect()
    index = InvertedFile("l2", 5).train(df)
    with pytest.raises(E.NotFound):
        index.remove(index.assign(df), [77])
    # cells are those of the nearest centroids
    x = {r["id"]: np.array(r["vec"]) for r in df.collect()}
    assert all(((index.centroids - x[r["id"]]) ** 2).sum(1).argmin() == r["cell"] for r in index.assign(df).collect())


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_batches_against_brute_force(spark, metric):
    """Recall of the index by every row that is divisible by 20, and all of it where all cells are probed."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 2
    x = centres[rng.integers(0, 12, 1200)] + rng.normal(size=(1200, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T if metric == "cosine" else x @ x.T if metric == "dot" else -((x[:, None] - x[None]) ** 2).sum(2)
    want = {(i, int(j)) for i in range(0, 1200, 20) for j in np.argsort(-s[i], kind="stable")[:10]}
    index = InvertedFile(metric, 16).train(df)
    assigned = index.assign(df)
    for probe, least in ((16, 0.999), (8, 0.9)):
        got = {(r["query_id"], r["id"]) for r in index.batch_search(assigned, df.where("id % 20 = 0"), 10, probe).collect()}
        assert len(got & want) >= least * len(want)


def test_registered_index_recall(spark, sf):
    """The registered query, over its table: 0.9 of what comparing all vectors finds."""
    from tessera import catalogue

    def pairs(name):
        return {tuple(r) for r in catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}

    want, got = pairs("vec_batch"), pairs("ivf_batch")
    assert len(got & want) >= 0.9 * len(want)


def test_quantised_search_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    index = InvertedFile("l2", 4, 4, 4).train(df)
    rows = {r["id"]: r for r in index.assign(df).collect()}
    q = rng.normal(size=8)
    want = {}
    for i, r in rows.items():
        decoded = index.centroids[r["cell"]] + np.concatenate([index.books[k][c] for k, c in enumerate(r["codes"])])
        want[i] = -((q - decoded) ** 2).sum()
    got = [(r["id"], r["score"]) for r in index.search(index.assign(df), q.tolist(), 20, 4).collect()]
    assert [g[1] for g in got] == pytest.approx(sorted(want.values(), reverse=True)[:20])
    assert all(want[i] == pytest.approx(v) for i, v in got)


def test_sample_against_plain_python(spark):
    c = Collection(spark.range(500), "id", {})
    got = [r["id"] for r in c.sample(20, 7).collect()]
    assert len(set(got)) == 20 and got == [r["id"] for r in c.sample(20, 7).collect()] != [r["id"] for r in c.sample(20, 8).collect()]
    assert [r["id"] for r in c.sample(3, None).collect()] == [0, 1, 10]


def test_bloom_bitmap_and_join_agree(spark, monkeypatch):
    f = Bloom(500, 0.05)
    bits = f.build(spark.range(0, 1000, 2), "id")
    probes = spark.range(1500).union(spark.createDataFrame([(None,)], "id long"))
    bitmap = {r["id"]: r["maybe"] for r in f.might_contain(bits, probes, "id").collect()}
    monkeypatch.setattr(sketches, "BITMAP", 0)
    assert bitmap == {r["id"]: r["maybe"] for r in f.might_contain(bits, probes, "id").collect()}
    assert all(bitmap[i] for i in range(0, 1000, 2)) and not bitmap[None] and sum(bitmap.values()) < 700


def test_vector_index_declared(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0])], "id long, g string, v array<double>")
    c = Collection(df, "id", {"v": Vector("v"), "g": Many("g")})
    assert c.nearest("v", [1.0, 0.1], 1).first()["id"] == 1 and c.nearest("v", [1.0, 0.1], 1, {"g": "b"}).first()["id"] == 2


def test_replay_of_many_caches(spark):
    """More caches than go into one Arrow batch of results, and one that is longer than a batch."""
    from collections import OrderedDict

    from tessera.operators import structures

    rng = np.random.default_rng(11)
    n = 60_000
    caches = np.where(np.arange(n) < 25_000, -1, rng.integers(0, 3000, n)).tolist()
    keys = [None if k == 5 else f"k{k}" for k in rng.integers(0, 6, n).tolist()]
    ops = [("set", "set", "get", "delete")[i] for i in rng.integers(0, 4, n).tolist()]
    want: dict = {}
    for i, (c, k, op) in enumerate(zip(caches, keys, ops, strict=True)):
        held = want.setdefault(c, OrderedDict())
        if op == "set":
            held[k] = i
            held.move_to_end(k)
            if len(held) > 3:
                held.popitem(last=False)
        elif op == "get" and k in held:
            held.move_to_end(k)
        elif op == "delete":
            held.pop(k, None)
    log = spark.createDataFrame([(c, k, i, op, i) for i, (c, k, op) in enumerate(zip(caches, keys, ops, strict=True))], "cache long, key string, seq long, op string, v long")
    got = structures.lru_replay(log.repartition(4), "cache", "key", "seq", "op", 3, "v")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((c, k, v, r) for c, held in want.items() for r, (k, v) in enumerate(reversed(held.items()))), key=repr)


def _plain_postings(rows):
    from collections import Counter

    texts: dict = {}
    for i, t in rows:
        texts.setdefault(i, []).extend((t or "").split())
    return sorted((w, i, n, len(ws)) for i, ws in texts.items() for w, n in Counter(ws).items())


def test_postings_without_a_shuffle(spark):
    """Counted within each document; rows of one id are one document, with the length of all its rows."""
    from tessera.operators import fulltext

    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 9))) for i in range(60)] + [(100, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = fulltext.postings(df, "id", ["t"])
    assert sorted(map(tuple, got.collect())) == _plain_postings(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    rows += [(5, "w1 w1 other"), (5, None), (6, "w0")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    assert sorted(map(tuple, fulltext.postings(df, "id", ["t"]).collect())) == _plain_postings(rows)


def test_index_is_made_in_parts_by_document(spark, tmp_path, monkeypatch):
    """No posting goes through a shuffle: a document's are in one file, each file is sorted by term, and no task has much text."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(SearchIndex, "_PART", 300, raising=False)
    monkeypatch.setattr(SearchIndex, "_MANY", 50, raising=False)
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 13))) for i in range(90)] + [(200, None)]
    index = SearchIndex.create(spark, str(tmp_path / "ix"), ["t"]).add_many(spark.createDataFrame(rows, "id long, t string"), "id")
    more = [(300, "w1 w1 late"), (300, "w2"), (301, "")]
    both = index.add_many(spark.createDataFrame(more, "id long, t string"), "id")
    for found, want, files in ((index, rows, 2), (both, rows + more, 2), (both.merged(), rows + more, 2)):
        assert sorted(map(tuple, found.postings().select("term", "doc_id", "tf", "dl").collect())) == _plain_postings(want)
        assert sorted((r["doc_id"], r["dl"]) for r in found.documents().collect()) == sorted({i: sum(len((t or "").split()) for k, t in want if k == i) for i, _ in want}.items())
        assert found.n == len({i for i, _ in want}) == len(found) and found.total == sum(len((t or "").split()) for _, t in want)
        where = found.postings().select(F.input_file_name().alias("f"), "doc_id", "term").collect()
        assert len({r["f"] for r in where}) >= files and len({(r["f"], r["doc_id"]) for r in where}) == len({r["doc_id"] for r in where})
    for part in (tmp_path / "ix").glob("*/postings/*.parquet"):
        terms = [r["term"] or "" for r in spark.read.parquet(str(part)).collect()]
        assert terms == sorted(terms)
