"""A paged web source with retries and a rate limit, and a stub server to try it on."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(url: str, retries: int = 5, wait: float = 1.0, factor: float = 1.8, timeout: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The body, after up to `retries` further attempts with waits growing by `factor`. Errors of the request itself
    (status 4xx but 408 and 429) are raised at once."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            if attempt == retries or (e.code < 500 and e.code not in (408, 429)):
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == retries:
                raise
        sleep(wait * factor**attempt)
    raise AssertionError


class _Pages(InputPartition):
    def __init__(self, pages: list[int]):
        self.pages = pages


class PagedReader(DataSourceReader):
    """Pages are dealt to `tasks` partitions, each of which keeps to its part of the allowed requests a second."""

    def __init__(self, options: dict):
        self.url, self.pages, self.tasks = options["path"], int(options["pages"]), int(options.get("tasks", 4))
        self.retries, self.wait, self.factor = int(options.get("retries", 5)), float(options.get("wait", 1.0)), float(options.get("factor", 1.8))
        self.per_second = float(options.get("per_second", 0))

    def partitions(self):
        n = max(1, min(self.tasks, self.pages))
        return [_Pages(list(range(1 + i, self.pages + 1, n))) for i in range(n)]

    def read(self, partition):
        n = max(1, min(self.tasks, self.pages))
        for page in partition.pages:
            began = time.monotonic()
            yield page, fetch(f"{self.url}{'&' if '?' in self.url else '?'}{urllib.parse.urlencode({'page': page})}", self.retries, self.wait, self.factor)
            if self.per_second:
                time.sleep(max(0.0, n / self.per_second - (time.monotonic() - began)))


class PagedSource(DataSource):
    """spark.read.format("paged").option("pages", n).load(url) -> (page, body); parse the body with from_json.

    Options: tasks, retries, wait (seconds before the first retry), factor, per_second (requests of all tasks together).
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema):
        return PagedReader(self.options)


def stub(bodies: list[str], host: str = "127.0.0.1", fail_first: int = 1):
    """A server of page 1, 2 ... whose first answers to each page are 503. Returns it and its address; `shutdown()` ends it."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked: dict[int, int] = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            page = int(urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["page"][0])
            asked[page] = asked.get(page, 0) + 1
            known = 1 <= page <= len(bodies)
            self.send_response(404 if not known else 503 if asked[page] <= fail_first else 200)
            self.end_headers()
            if known and asked[page] > fail_first:
                self.wfile.write(bodies[page - 1].encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer((host, 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://{host}:{server.server_port}/"
