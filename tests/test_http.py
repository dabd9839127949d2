from __future__ import annotations

import threading

import pytest

from tessera import Catalog, Many, Search
from tessera import errors as E
from tessera.sources.http import Client, serve


def test_rest(spark, tmp_path):
    db = Catalog(spark, str(tmp_path / "db"))
    db.collection("users", {"uid": "utf8[8]", "team": "text", "age": "int64", "bio": "text"}, "uid", {"team": Many("team", "age", True), "bio": Search(("bio",))})
    server = serve(db)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = Client(f"http://127.0.0.1:{server.server_address[1]}")
        assert c.names() == {"users": "collection"}
        assert c.put("users", [{"uid": "a", "team": "x", "age": 3, "bio": "red fox"}, {"uid": "b", "team": "x", "age": 9}]) == {"written": 2}
        c.put("users", [{"uid": "a", "team": "x", "age": 4, "bio": "red fox"}])
        assert c.get("users/a")["age"] == 4 and len(c.get("users")) == 2
        assert [r["uid"] for r in c.get("users/find/team?value=x")] == ["b", "a"]
        assert [r["uid"] for r in c.get("users/search/bio?q=red%20AND%20fox")] == ["a"]
        assert c.get("users?team=x&fields=uid&limit=1") and c.delete("users", "a") == {"deleted": "a"}
        for path in ("users/a", "nope"):
            with pytest.raises(E.NotFound):
                c.get(path)
        with pytest.raises(E.SchemaError):
            c.put("users", [{"wrong": 1}])
        c.put("users", [{"uid": "c", "team": "x", "age": 1}, {"uid": "c", "team": "y", "age": 2}])
        assert c.get("users/c")["team"] == "y" and c.count("users") == 2 and c.get("users/c?fields=age") == {"age": 2}
        assert c.update("users", "c", age=7)["age"] == 7 and c.increment("users", "c", "age", 2)["age"] == 9
        assert c.get("users/count/team?value=x") == {"count": 1} and c.get("users/_info")["kind"] == "collection"
        assert sorted(r["uid"] for r in c.get("users/_keys")) == ["b", "c"] and c.get("_verify") == {"ok": True, "issues": []}
        with pytest.raises(E.SchemaError):
            c.get("users?limit=10000000")
        with pytest.raises(E.NotFound):
            c.update("users", "zz", age=1)
        c.create("q", "queue", {"_seq": "int64", "v": "text"})
        c.put("q", [{"v": "one"}, {"v": "two"}])
        assert c.pop("q")["v"] == "one" and [r["v"] for r in c.get("q/drain")] == ["two"] and c.pop("q")["v"] == "two"
        with pytest.raises(E.NotFound):
            c.pop("q")
        c.create("m", "map", {"_key": "int64", "v": "text"})
        c.put("m", [{"_key": 1, "v": "a"}, {"_key": 1, "v": "b"}])
        assert c.get("m/1") == {"v": "b"} and c.delete("m", "1") == {"deleted": "1"}
        c.create("s", "set", {"member": "text"})
        c.put("s", [{"member": "x"}, {"member": "x"}])
        assert c.count("s") == 1 and c.get("s/x") == {"member": "x"}
        c.create("l", "sequence", {"_pos": "int64", "_valid": "bool", "v": "text"})
        c.put("l", [{"v": "first"}, {"v": "second"}])
        assert c.get("l/1")["v"] == "second"
        c.create("e", "collection", {"id": "int64", "emb": "float32[2]"}, primary="id")
        c.put("e", [{"id": 1, "emb": [1.0, 0.0]}])
        assert c.get("e/1")["id"] == 1 and c.stats()["e"]["rows"] == 1
        assert c.drop("e") == {"dropped": "e"} and "e" not in c.names()
    finally:
        server.shutdown()
