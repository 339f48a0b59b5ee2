"""An HTTP façade over the same searches: GET with region, query, files, data and full; POST stores a query file."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from intervale.plans import search as plans
from intervale.plans.index import IntervalIndex
from intervale.schema import GENOME_SIZE
from intervale.sources.readers import read_intervals
from intervale.tables import shared_dir


def answer(spark: SparkSession, index: IntervalIndex, params: dict[str, str], uploads: str, data: str = "") -> Iterator[str]:
    """The lines of the text page for a request's parameters, a partition at a time on the driver."""
    if "data" in params:
        return iter([data])
    files = params["files"].split(",") if params.get("files") else None
    if "region" in params:
        s = plans.Search(index, params["region"], files=files)
        if "full" in params:
            return (f"{line}\t{name}" for line, name in s.iterate())
        return plans.count_text(s.counts())
    if "query" in params:
        path = f"{uploads}/{os.path.basename(params['query'])}"
        q = read_intervals(spark, path).intervals.select("chrom", "start", "end")
        s = plans.Search(index, q, files=files)
        if "full" in params:
            return (f"{line}\t{name}" for line, name in s.iterate())
        return plans.significance_text(s.significance(float(params.get("genome", GENOME_SIZE))))
    raise ValueError("neither region, query nor data")


def serve(spark: SparkSession, index_path: str, port: int = 8080, matrix: str | None = None) -> ThreadingHTTPServer:
    """A server, not yet running; ``matrix``: the JSON that ``data`` returns. Uploads go to the folder that
    all executors share, and replace one of the same name."""
    index, uploads = IntervalIndex.load(spark, index_path), f"{shared_dir(spark)}/uploads-{uuid.uuid4().hex}"
    data = open(matrix).read() if matrix else ""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, lines: Iterator[str]) -> None:
            """The lines as they come; the page ends with the connection."""
            first = next(lines, None)  # what is wrong with a request shows before the header is sent
            self.send_response(code)
            self.send_header("Content-Type", "text/plain; charset=utf-8")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            if first is not None:
                self.wfile.write(first.encode())
            for line in lines:
                self.wfile.write(f"\n{line}".encode())

        def do_GET(self) -> None:  # noqa: N802
            params = {k: v[0] for k, v in parse_qs(urlparse(self.path).query, keep_blank_values=True).items()}
            try:
                self._send(200, answer(spark, index, params, uploads, data))
            except (ValueError, FileNotFoundError) as e:
                self._send(400, iter([str(e)]))

        def do_POST(self) -> None:  # noqa: N802
            name = os.path.basename(parse_qs(urlparse(self.path).query).get("name", ["query.bed"])[0])
            body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{uploads}/{name}")
            out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
            out.write(bytearray(body))
            out.close()
            self._send(200, iter([name]))

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
