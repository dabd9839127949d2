"""A REST surface over a catalog, on Python's own server: the reads and changes that serve people, not bulk data.

GET    /                                  names and kinds
GET    /_stats, /_verify                  rows and bytes; unique fields that clash
POST   /_vacuum                           every table written anew and compactly
PUT    /<name>                            declares a structure: {"kind": ..., "fields": {...}, "options": {...}}
DELETE /<name>                            drops it
GET    /<name>?field=value&limit=20&fields=a,b      rows, filtered by equality
GET    /<name>/_info, _count, _keys       declaration; number of rows; keys
GET    /<name>/<key>[?fields=a,b]         a record of a collection or map, a set's member, a sequence's row by index
GET    /<name>/find/<index>?value=v&start=&end=&limit=     count/<index>, groups/<index>, range/<index>?low=&high=&desc=
GET    /<name>/search/<index>?q=text&limit=                first/<index>, latest/<index>, unique/<index>?value=
POST   /<name>/nearest/<index>            {"query": [...], "k": 10, "where": {...}}
GET    /<name>/peek, drain?limit=         queues
POST   /<name>/pop                        takes from a queue
POST   /<name>                            records as a JSON list, put in (appended; pushed on queues)
PATCH  /<name>/<key>                      some fields of a record
POST   /<name>/<key>/increment            {"field": ..., "amount": ...}
DELETE /<name>/<key>                      a record, or a set's member

404: no such name or record; 409: the name or a unique value is taken; 422: records or parameters that don't fit; 403: read only.
Answers have `limit` rows, 100 where it isn't given: a page for people. A limit above MOST_ROWS is refused.
"""

from __future__ import annotations

import datetime
import decimal
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import Empty, NameTaken, NotFound, ReadOnly, SchemaError, UniqueViolation
from ..functions.types import conformed, data_type, struct
from ..operators import structures
from .catalog import Catalog

MOST_ROWS = 100_000


def _plain(value: Any) -> Any:
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return int(value)
    return bytes(value).hex() if isinstance(value, bytes | bytearray) else str(value)


def handler(catalog: Catalog) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: Any) -> None:
            pass

        def _send(self, status: int, body: Any) -> None:
            data = json.dumps(body, default=_plain).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _answer(self, act: Any) -> None:
            try:
                self._send(200, act())
            except (NotFound, Empty, IndexError) as e:
                self._send(404, {"error": str(e)})
            except (NameTaken, UniqueViolation) as e:
                self._send(409, {"error": str(e)})
            except ReadOnly as e:
                self._send(403, {"error": str(e)})
            except (SchemaError, ValueError, TypeError) as e:
                self._send(422, {"error": str(e)})

        def _parts(self) -> tuple[list[str], dict[str, str]]:
            url = urlsplit(self.path)
            return [unquote(p) for p in url.path.split("/") if p], {k: v[0] for k, v in parse_qs(url.query).items()}

        @staticmethod
        def _limit(limit: str | None) -> int:
            n = int(limit or 100)
            if not 0 <= n <= MOST_ROWS:
                raise SchemaError(f"limit must be from 0 to {MOST_ROWS}")
            return n

        def _rows(self, df: DataFrame, limit: str | None) -> list[dict]:
            return [r.asDict(True) for r in df.limit(self._limit(limit)).collect()]

        def _body(self) -> Any:
            return json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"null")

        def _key(self, name: str, key: str) -> Any:
            """A key from a path, of the kind that the structure's key has."""
            entry = catalog.entry(name)
            field = entry["options"].get("primary") or entry["options"].get("key") or entry["options"].get("column")
            kind = data_type(entry["fields"][field]) if field in entry["fields"] else None
            return int(key) if isinstance(kind, T.IntegralType) else float(key) if isinstance(kind, T.FractionalType) else key

        def _record(self, name: str, key: str, fields: str | None) -> Any:
            kind = catalog.entry(name)["kind"]
            if kind == "set":
                if key not in catalog.open(name):
                    raise NotFound(key)
                return {"member": key}
            if kind == "sequence":
                got = self._rows(catalog.open(name).at(int(key)), "1")
            elif kind == "collection":
                got = self._rows(catalog.collection(name).get_primary(self._key(name, key)), "1")
            else:
                got = [catalog.open(name).record(self._key(name, key))]
            if not got:
                raise NotFound(key)
            return {f: got[0][f] for f in fields.split(",")} if fields else got[0]

        def _indexed(self, name: str, what: str, index: str, args: dict[str, str], limit: str | None) -> Any:
            c = catalog.collection(name)
            n = self._limit(limit)
            if what == "find":
                return self._rows(c.find(index, args.get("value"), args.get("start"), args.get("end"), n), limit)
            if what == "count":
                return {"count": c.count(index, args.get("value"), args.get("start"), args.get("end")).first()[0]}
            if what == "groups":
                return self._rows(c.groups(index, args.get("order_by", "count"), args.get("desc", "1") not in ("0", "false"), n), limit)
            if what == "range":
                return self._rows(c.range(index, args.get("low"), args.get("high"), n, args.get("desc", "0") in ("1", "true")), limit)
            if what == "unique":
                return self._rows(c.get(index, args.get("value")), "1")
            if what in ("first", "latest"):
                return self._rows(getattr(c, what)(index), "1")
            if what == "search":
                return self._rows(c.search(index, args.get("q", ""), mode=args.get("mode"), limit=n), limit)
            raise NotFound(f"{what}/{index}")

        def do_GET(self) -> None:
            parts, args = self._parts()

            def act() -> Any:
                if not parts:
                    return {n: catalog.entry(n)["kind"] for n in catalog.names()}
                name = parts[0]
                if name == "_stats":
                    return catalog.stats()
                if name == "_verify":
                    return catalog.verify()
                entry = catalog.entry(name)
                limit = args.pop("limit", None)
                if len(parts) == 1:
                    df = catalog.read(name)
                    fields = args.pop("fields", None)
                    for k, v in args.items():
                        if k not in df.columns:
                            raise SchemaError(f"no field {k}")
                        df = df.where(df[k].cast("string") == v)
                    return self._rows(df.select(*fields.split(",")) if fields else df, limit)
                if parts[1] == "_info":
                    return {k: entry[k] for k in ("kind", "fields", "options")}
                if parts[1] == "_count":
                    return {"count": catalog.read(name).count()}
                if parts[1] == "_keys":
                    return self._rows(catalog.open(name).keys(), limit)
                if entry["kind"] in ("queue", "priority") and parts[1] in ("peek", "drain"):
                    return self._rows(catalog.open(name).drain(), "1" if parts[1] == "peek" else limit)
                if len(parts) == 2:
                    return self._record(name, parts[1], args.get("fields"))
                return self._indexed(name, parts[1], parts[2], args, limit)

            self._answer(act)

        def _put_in(self, name: str, records: list[dict]) -> Any:
            entry = catalog.entry(name)
            fields = sorted({k for r in records for k in r})
            if unknown := set(fields) - set(entry["fields"]):
                raise SchemaError(f"unknown fields {sorted(unknown)}")
            rows = [(*(r.get(k) for k in fields), i) for i, r in enumerate(records)]
            new = catalog.spark.createDataFrame(rows, T.StructType([*struct({k: entry["fields"][k] for k in fields}).fields, T.StructField("__i", T.LongType())]))
            whole = conformed(new, entry["fields"], ("__i",))
            if entry["kind"] == "collection":
                catalog.write(name, catalog.collection(name).insert_many(whole, "__i").df)
            elif entry["kind"] in ("map", "ordered"):
                catalog.save(name, catalog.open(name).put(whole, "__i"))
            elif entry["kind"] == "set":
                catalog.save(name, catalog.open(name).update(whole.select(entry["options"]["column"])))
            elif entry["kind"] in ("queue", "priority"):
                catalog.save(name, catalog.open(name).push(whole, "__i"))
            elif entry["kind"] == "sequence":
                catalog.save(name, catalog.open(name).append(whole, "__i"))
            else:
                catalog.append(name, whole.drop("__i"))
            return {"written": len(records)}

        def do_POST(self) -> None:
            parts, _ = self._parts()
            body = self._body()

            def act() -> Any:
                name = parts[0]
                if name == "_vacuum":
                    catalog.vacuum()
                    return {"ok": True}
                if len(parts) == 1:
                    return self._put_in(name, body if isinstance(body, list) else [body])
                if parts[1] == "pop":
                    got, rest = catalog.open(name).pop()
                    catalog.save(name, structures.Fifo(rest.waiting(), rest.seq) if isinstance(rest, structures.Fifo) else rest)
                    return got
                if parts[1] == "nearest":
                    return self._rows(catalog.collection(name).nearest(parts[2], body["query"], self._limit(str(body.get("k", 10))), body.get("where")), str(body.get("k", 10)))
                if parts[2:] == ["increment"]:
                    catalog.write(name, catalog.collection(name).increment([self._key(name, parts[1])], body["field"], body.get("amount", 1)).df)
                    return self._record(name, parts[1], None)
                raise NotFound("/".join(parts))

            self._answer(act)

        def do_PUT(self) -> None:
            parts, _ = self._parts()
            body = self._body() or {}

            def act() -> Any:
                made = catalog.create(parts[0], body.get("kind", "dataset"), body.get("fields"), **body.get("options", {}))
                return {k: made[k] for k in ("kind", "fields", "options")}

            self._answer(act)

        def do_PATCH(self) -> None:
            parts, _ = self._parts()
            body = self._body() or {}

            def act() -> Any:
                name, key = parts[0], self._key(parts[0], parts[1])
                c = catalog.open(name)
                catalog.write(name, c.set_fields(key, **body).df)
                return self._record(name, parts[1], None)

            self._answer(act)

        def do_DELETE(self) -> None:
            parts, _ = self._parts()

            def act() -> Any:
                if len(parts) == 1:
                    catalog.drop(parts[0])
                    return {"dropped": parts[0]}
                kind, key = catalog.entry(parts[0])["kind"], self._key(parts[0], parts[1])
                c = catalog.open(parts[0])
                catalog.write(parts[0], (c.remove(key) if kind == "set" else c.remove([key]) if kind in ("map", "ordered") else c.delete([key])).df)
                return {"deleted": parts[1]}

            self._answer(act)

    return Handler


def serve(catalog: Catalog, port: int = 0) -> ThreadingHTTPServer:
    """A server on the loopback interface, not started: call serve_forever() on it."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(catalog))


class Client:
    """The same surface from elsewhere; errors come as those of the engine."""

    _ERRORS = {404: NotFound, 409: NameTaken, 403: ReadOnly, 422: SchemaError}

    def __init__(self, address: str):
        self.address = address.rstrip("/")

    def _call(self, method: str, path: str, body: Any = None) -> Any:
        from urllib.error import HTTPError

        request = Request(f"{self.address}/{path}", method=method, data=None if body is None else json.dumps(body).encode())
        try:
            with urlopen(request, timeout=60) as answer:
                return json.load(answer)
        except HTTPError as e:
            raise self._ERRORS.get(e.code, RuntimeError)(json.load(e).get("error", "")) from None

    def names(self) -> dict[str, str]:
        return self._call("GET", "")

    def get(self, path: str) -> Any:
        return self._call("GET", path)

    def put(self, name: str, records: list[dict]) -> Any:
        return self._call("POST", name, records)

    def delete(self, name: str, key: str) -> Any:
        return self._call("DELETE", f"{name}/{key}")

    def create(self, name: str, kind: str = "dataset", fields: dict[str, str] | None = None, **options: Any) -> Any:
        return self._call("PUT", name, {"kind": kind, "fields": fields, "options": options})

    def drop(self, name: str) -> Any:
        return self._call("DELETE", name)

    def update(self, name: str, key: Any, **changes: Any) -> Any:
        return self._call("PATCH", f"{name}/{key}", changes)

    def increment(self, name: str, key: Any, field: str, amount: float = 1) -> Any:
        return self._call("POST", f"{name}/{key}/increment", {"field": field, "amount": amount})

    def pop(self, name: str) -> Any:
        return self._call("POST", f"{name}/pop", {})

    def nearest(self, name: str, index: str, query: list[float], k: int = 10, where: dict | None = None) -> Any:
        return self._call("POST", f"{name}/nearest/{index}", {"query": query, "k": k, "where": where})

    def count(self, name: str) -> int:
        return self._call("GET", f"{name}/_count")["count"]

    def stats(self) -> Any:
        return self._call("GET", "_stats")
