"""Operations on a database as JSON requests, and a small HTTP server for them.

A facade for tools, not an analytic path: rows that it returns are pages of bounded size, or lines
that are written one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import functions as F

from ..collection import Collection, Database

PAGE = 1000


def _rows(df) -> Iterator[dict]:
    for r in df.select(F.to_json(F.struct(*df.columns)).alias("json")).toLocalIterator():
        yield json.loads(r["json"])


def handle(db: Database, request: dict[str, Any]) -> Any:
    """The answer to a request: {"op": ..., "store": ..., ...}; Stream gives an iterator of rows."""
    op = request.get("op")
    if op == "ListStores":
        return sorted(db.collections)
    c: Collection = db.collections[request["store"]]
    key = c.model.key
    if op == "Count":
        return c.count()
    if op == "Get":
        return next(_rows(c.stored.where(F.col(key) == F.lit(request["id"])).limit(1)), None)
    if op == "ListDocs":
        page = c.stored.orderBy(key).offset(int(request.get("offset", 0))).limit(min(int(request.get("limit", PAGE)), PAGE))
        return list(_rows(page))
    if op == "Stream":
        return _rows(c.stored)
    if op == "Upsert":
        lines = c.spark.createDataFrame([(json.dumps(d),) for d in request["docs"]], "line string")
        rows = lines.select(F.from_json("line", c.stored.schema).alias("d")).select("d.*")
        with c.transaction() as t:
            t.upsert(rows)
        return len(request["docs"])
    if op == "Delete":
        with c.transaction() as t:
            t.delete(*request["ids"])
        return None
    if op == "Truncate":
        with c.transaction() as t:
            t.truncate()
        return None
    raise ValueError(f"unknown operation {op}")


def serve(db: Database, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server whose POST bodies are requests; call serve_forever() on it. No authentication: keep it local."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            try:
                answer, code = handle(db, json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))), 200
            except (KeyError, ValueError) as e:
                answer, code = {"error": str(e)}, 400
            self.send_response(code)
            self.send_header("Content-Type", "application/x-ndjson" if isinstance(answer, Iterator) else "application/json")
            self.end_headers()
            for part in answer if isinstance(answer, Iterator) else [answer]:
                self.wfile.write(json.dumps(part).encode() + b"\n")

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
