"""The service over HTTP, with the standard library's server."""

from __future__ import annotations

import json
import os
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.sql import SparkSession

from marlstone.problems import DecodeError, Problem, ProblemsError
from marlstone.service import Service, Settings
from marlstone.streaming.chunks import json_stream


class _Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    service: Service

    def log_message(self, *args) -> None:
        pass

    def _body(self) -> object:
        data = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        return json.loads(data) if data.strip() else None

    def _send(self, content: object, status: int = 200) -> None:
        data = b"" if content is None else json.dumps(content, ensure_ascii=False).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def _missing(self, message: str) -> None:
        self._send({"message": message}, 404)

    def _problems(self, problems: list[Problem], status: int) -> None:
        self._send({"problems": [p.to_json() for p in problems]}, status)

    def _stream(self, parts) -> None:
        self.send_response(200)
        self.send_header("Content-Type", "application/json")
        self.send_header("Transfer-Encoding", "chunked")
        self.end_headers()
        for part in json_stream(parts):
            data = part.encode()
            self.wfile.write(b"%x\r\n%s\r\n" % (len(data), data))
        self.wfile.write(b"0\r\n\r\n")

    def _route(self) -> None:
        path = unquote(self.path.split("?", 1)[0]).rstrip("/") or "/"
        for method, pattern, handle in ROUTES:
            if method == self.command and (found := re.fullmatch(pattern, path)):
                try:
                    handle(self, *found.groups())
                except ProblemsError as error:
                    self._problems(error.problems, 400)
                except (DecodeError, ValueError) as error:
                    self._problems([Problem("json error", str(error))], 400)
                except Exception as error:
                    self._problems([Problem(type(error).__name__, str(error))], 400)
                return
        self._missing(f"{self.command} {path} not found")

    do_GET = do_POST = do_PUT = do_DELETE = _route

    def create_table(self) -> None:
        self._send(self.service.create_table(self._body()))

    def list_tables(self) -> None:
        self._send(self.service.list_tables())

    def get_table(self, table_id: str) -> None:
        table = self.service.catalog.by_id(table_id)
        self._send(table.schema_json()) if table else self._missing(f"no table {table_id}")

    def drop_table(self, table_id: str) -> None:
        self.service.catalog.drop(table_id)
        self._send(None)

    def submit(self) -> None:
        self._send(self.service.submit(self._body()))

    def get_query(self, query_id: str) -> None:
        found = self.service.describe_query(query_id)
        self._send(found) if found else self._missing(f"no query {query_id}")

    def list_queries(self) -> None:
        self._send(self.service.list_queries())

    def get_result(self, query_id: str) -> None:
        parts = self.service.result(query_id, self._body())
        self._stream(parts) if parts is not None else self._missing(f"no result of query {query_id}")

    def get_error(self, query_id: str) -> None:
        problems = self.service.problems(query_id)
        self._problems(problems, 200) if problems is not None else self._missing(f"no error of query {query_id}")

    def system_info(self) -> None:
        self._send(self.service.system_info())


ROUTES = (
    ("PUT", "/table", _Handler.create_table),
    ("GET", "/tables", _Handler.list_tables),
    ("GET", "/table/([^/]+)", _Handler.get_table),
    ("DELETE", "/table/([^/]+)", _Handler.drop_table),
    ("POST", "/query", _Handler.submit),
    ("GET", "/queries", _Handler.list_queries),
    ("GET", "/query/([^/]+)", _Handler.get_query),
    ("GET", "/result/([^/]+)", _Handler.get_result),
    ("GET", "/error/([^/]+)", _Handler.get_error),
    ("GET", "/system/info", _Handler.system_info),
)


def make_server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), type("Handler", (_Handler,), {"service": service}))


def main() -> None:
    """Serve by the environment's settings, MARLSTONE_HOSTNAME and MARLSTONE_PORT, until interrupted."""
    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    service = Service(spark, Settings.from_environment())
    server = make_server(service, os.environ.get("MARLSTONE_HOSTNAME", "127.0.0.1"), int(os.environ.get("MARLSTONE_PORT", "80")))
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        server.server_close()
        service.stop()


if __name__ == "__main__":
    main()
