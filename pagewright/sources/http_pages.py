"""A Python data source that fetches pages: format ``http_pages``.

Options: ``path`` (a local or mounted text file of URLs for the driver to read) or ``urls``
(separated by white space), ``partitions``, ``timeout`` in seconds, ``agent``, ``robots``.  URLs
of one host and port go to one partition, which waits ``delay_ms`` between two of them.  With
``robots`` set to true it first fetches the host's robots.txt: what that forbids is not fetched,
and its crawl delay counts if longer; no file allows all.  Only status 200 gives a body, cut at
2 MiB; other outcomes give ``fetch_error``.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagewright.functions.urls import parse_url
from pagewright.operators.filters import DISALLOWED
from pagewright.operators.politeness import allowed_by, robots_group

SCHEMA = "url string, html string, status int, fetch_error string, load_time long"
MOST_BYTES = 2 * 1024 * 1024
MOST_REDIRECTS = 3


class _Refused(OSError):
    """A redirect that is not followed."""


class _Redirects(urllib.request.HTTPRedirectHandler):
    # the parent's own limits would hide which of the two was met
    max_redirections = max_repeats = 2 * MOST_REDIRECTS + 2

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        chain = [*getattr(req, "chain", ()), req.full_url]
        if newurl in chain:
            raise _Refused("redirect loop")
        if len(chain) > MOST_REDIRECTS:
            raise _Refused("too many redirects")
        following = super().redirect_request(req, fp, code, msg, headers, newurl)
        if following is not None:
            following.chain = chain
        return following


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


def fetch(url: str, agent: str, timeout: float) -> tuple:
    """One row of ``SCHEMA``."""
    full = url if url.startswith(("http://", "https://")) else f"https://{url}"
    parsed = parse_url(full)
    if parsed is None or not parsed.authority:
        return full, None, None, "invalid URL", 0
    began = time.monotonic_ns()
    status, body, error = None, None, ""
    try:
        request = urllib.request.Request(full, headers={"User-Agent": agent})
        with urllib.request.build_opener(_Redirects).open(request, timeout=timeout) as response:
            status = response.status
            body = response.read(MOST_BYTES).decode("utf-8") if status == 200 else None
            error = "" if status == 200 else f"status {status}"
    except urllib.error.HTTPError as failed:
        status, error = failed.code, f"status {failed.code}"
    except UnicodeDecodeError:
        error = "invalid UTF-8"
    except _Refused as refused:
        error = str(refused)
    except (OSError, ValueError) as failed:
        error = f"transport: {failed}"
    return full, body, status, error, time.monotonic_ns() - began


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.timeout, self.agent = float(options.get("timeout", 10)), options.get("agent", "pagewright")
        self.delay, self.parts = float(options.get("delay_ms", 0)) / 1000, int(options.get("partitions", 8))
        self.robots = options.get("robots", "false").lower() == "true"
        self.urls = options.get("urls", "").split()
        if "path" in options:
            with open(options["path"], encoding="utf-8") as lines:
                self.urls += [x.strip() for x in lines if x.strip()]

    def partitions(self) -> list[InputPartition]:
        parts: list[list[str]] = [[] for _ in range(self.parts)]
        for url in self.urls:
            parsed = parse_url(url if "://" in url else f"https://{url}")
            parts[zlib.crc32((parsed.authority if parsed else url).encode()) % self.parts].append(url)
        return [HostPartition(p) for p in parts if p]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        last: dict[str, float] = {}
        files: dict[str, tuple[list[tuple[bool, str]], float]] = {}
        for url in partition.urls:
            full = url if "://" in url else f"https://{url}"
            parsed = parse_url(full)
            host = parsed.authority if parsed else ""
            delay = self.delay
            if self.robots and host:
                if host not in files:
                    text = fetch(f"{parsed.scheme}://{host}/robots.txt", self.agent, self.timeout)[1]
                    rules, delay_ms = robots_group(text, self.agent)
                    files[host] = rules, delay_ms / 1000
                rules, own = files[host]
                if not allowed_by(rules, parsed.path):
                    yield full, None, None, DISALLOWED, 0
                    continue
                delay = max(delay, own)
            if delay and host in last:
                time.sleep(max(0.0, last[host] + delay - time.monotonic()))
            last[host] = time.monotonic()
            yield fetch(url, self.agent, self.timeout)


class HttpPages(DataSource):
    """Register with ``spark.dataSource.register(HttpPages)``."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
