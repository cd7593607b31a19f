"""The HTTP surface: catalog pages, schema and attribute text, data and raw files.

Metadata is answered from memory. Data is streamed in chunks as tasks finish.
"""

from __future__ import annotations

import html
import logging
import sys
import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import chain, islice
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .config import load
from .operators.catalog import Catalog, NotListed
from .plans.schema import BindError
from .sources.base import Stale

log = logging.getLogger(__name__)


#: Pieces of a data response that are made before its status is sent: the schema text, a length, the first bytes.
AHEAD = 3


@dataclass
class Reply:
    status: int
    body: Iterable[bytes] = ()
    headers: dict[str, str] = field(default_factory=dict)


def text(status: int, body: str, kind: str = "text/plain; charset=utf-8") -> Reply:
    return Reply(status, [body.encode()], {"Content-Type": kind})


def page(title: str, inner: str) -> Reply:
    return text(200, f'<html><head><meta charset="UTF-8"><title>{html.escape(title)}</title></head><body>{inner}</body></html>', "text/html")


class Service:
    """Routes of a catalog; ``root`` is put in front of links."""

    def __init__(self, catalog: Catalog, root: str = ""):
        self.catalog, self.root = catalog, root

    def reply(self, path: str, query: str | None = None, accept: str = "") -> Reply:
        """Catalog routes come first, then data; a query that doesn't parse asks for everything."""
        if path in ("", "/"):
            return page("catalog", f'<p>{len(self.catalog)} datasets</p><a href="{self.root}/data">data</a>')
        if path != "/data" and not path.startswith("/data/"):
            return text(404, "")
        tail = path.removeprefix("/data").removeprefix("/")
        if not tail and accept.lower() == "application/json":
            return text(200, self.catalog.as_json(), "application/json")
        try:
            return self.folder(tail)
        except NotListed:
            pass
        for suffix, answer in ((".das", self.das), (".dds", self.dds), (".dods", self.dods)):
            if tail.endswith(suffix):
                try:
                    return answer(self.catalog.get(tail.removesuffix(suffix)), query)
                except NotListed:
                    break
        return self.raw(tail)

    def folder(self, folder: str) -> Reply:
        folders, names = self.catalog.folder(folder)
        base = f"{self.root}/data/{folder.rstrip('/')}/".replace("/data//", "/data/")
        link = lambda to, shown: f'<a href="{html.escape(to)}">{html.escape(shown)}</a>'
        rows = [f"<tr><td>{link(base + f, f + '/')}</td></tr>" for f in folders]
        rows += [f"<tr><td>{link(base + n, n)}</td>" + "".join(f"<td>{link(base + n + s, s.upper().strip('.') or 'RAW')}</td>" for s in (".das", ".dds", "")) + "</tr>" for n in names]
        return page(folder, f"<h1>data/{html.escape(folder)}</h1><table>{''.join(rows)}</table>")

    def das(self, dataset, query: str | None) -> Reply:
        return text(200, dataset.das())

    def dds(self, dataset, query: str | None) -> Reply:
        try:
            return text(200, str(dataset.bind(query, on_malformed="all")))
        except BindError as e:
            return text(400, str(e))

    def dods(self, dataset, query: str | None) -> Reply:
        try:
            length, body = dataset.dods(query, on_malformed="all")
            ready = list(islice(body, AHEAD))  # a job that fails at once is told by the status
        except BindError as e:
            return text(400, str(e))
        except Stale as e:
            return text(503, str(e))
        except Exception:
            log.exception("no data of %s", dataset.key)
            return text(500, "")
        return Reply(200, chain(ready, body), {"Content-Type": "application/octet-stream", "Content-Description": "dods-data", "Content-Length": str(length), "XDODS-Server": "slabworks"})

    def raw(self, key: str) -> Reply:
        try:
            body = self.catalog.get(key).raw()
        except (NotListed, FileNotFoundError):
            return text(404, "")
        return Reply(200, body, {"Content-Type": "application/octet-stream", "Content-Disposition": "attachment", "XDODS-Server": "slabworks"})


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            began = time.monotonic()
            path, mark, query = self.path.partition("?")
            reply = service.reply(path, query if mark else None, self.headers.get("Accept", ""))
            self.send_response(reply.status)
            body = reply.body
            if "Content-Length" not in reply.headers:
                if isinstance(body, (list, tuple)):
                    reply.headers["Content-Length"] = str(sum(map(len, body)))
                else:
                    self.close_connection = True
            for k, v in reply.headers.items():
                self.send_header(k, v)
            self.end_headers()
            for piece in body:
                self.wfile.write(piece)
            log.debug("%s %s %d %.3f s", self.command, self.path, reply.status, time.monotonic() - began)

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(spark, catalog: Catalog, host: str, port: int, root: str = "") -> ThreadingHTTPServer:
    """A server that isn't running yet: call ``serve_forever``."""
    return ThreadingHTTPServer((host, port), handler(Service(catalog, root)))


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .sources.scan import open_folder

    config = load(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("slabworks").config("spark.scheduler.mode", "FAIR").getOrCreate()
    serve(spark, open_folder(spark, config.data), *config.host_port, config.root_url).serve_forever()


if __name__ == "__main__":
    main()
