"""The fetch boundary: requests in, responses out. Replaying a table of responses is the default; a transport may be plugged in."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from functools import partial
from http.client import HTTPConnection, HTTPException, HTTPSConnection, RemoteDisconnected
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.verify import latest
from linkloom.session import stored
from linkloom.sources.spec import SPECS, SourceSpec

RESPONSES = "request_url string, method string, model string, region string, page int, status int, error string, headers map<string,string>, body string, final_url string, fetched_at timestamp"
FETCHED = "request_url string, status int, error string, headers map<string,string>, body string, final_url string, fetched_at timestamp"

#: (method, url, spec) to status, headers, body, final url; raises TimeoutError, OSError, HTTPException or ValueError.
Transport = Callable[[str, str, SourceSpec], tuple[int, dict[str, str], str, str]]


def replay(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests: request_url and others. Their captured responses, the latest of each; a request without one fails by network."""
    kept = latest(responses).select("request_url", "status", "error", "headers", "body", "final_url", "fetched_at")
    return requests.join(kept, "request_url", "left").withColumn("error", F.when(F.col("status").isNull() & F.col("error").isNull(), "network").otherwise(F.col("error")))


def wait_seconds(headers: dict[str, str], attempt: int, spec: SourceSpec, now: datetime | None = None) -> float:
    """Before the next attempt: what the server asks for, if the source honours it, or the doubling backoff."""
    low = {k.lower(): v for k, v in headers.items()}
    if spec.honours_retry_after:
        if asked := low.get("retry-after"):
            try:
                return max(0.0, float(asked))
            except ValueError:
                try:
                    return max(0.0, (parsedate_to_datetime(asked) - (now or datetime.now(UTC))).total_seconds())
                except (TypeError, ValueError):
                    pass
        if (reset := low.get("x-ratelimit-reset", "")).isdigit():
            return max(0.0, int(reset) - (now or datetime.now(UTC)).timestamp() + 1)
    return spec.backoff_s * 2**attempt


def fetch_one(url: str, spec: SourceSpec, transport: Transport, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One request with the source's retries."""
    out = {"request_url": url, "status": None, "error": "network", "headers": {}, "body": None, "final_url": None}
    for attempt in range(spec.retries + 1):
        if spec.jitter_s[1]:
            sleep(random.uniform(*spec.jitter_s))
        try:
            status, headers, body, final = transport(spec.method, url, spec)
        except TimeoutError:
            out |= {"status": None, "error": "timeout"}
            headers = {}
        except (OSError, HTTPException, ValueError):  # the last two also where a URL can't be asked for at all
            out |= {"status": None, "error": "network"}
            headers = {}
        else:
            out |= {"status": status, "error": None, "headers": headers, "body": body, "final_url": final}
            if status in spec.terminal or status in spec.soft_block:
                break
        if attempt < spec.retries:
            sleep(wait_seconds(headers, attempt, spec))
    return out | {"fetched_at": pd.Timestamp.now("UTC").tz_localize(None)}


def _fetch(spec: SourceSpec, transport: Transport, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    failures: dict[str | None, int] = {}
    blocked: set[str | None] = set()
    at_once = max(1, spec.concurrency)
    with ThreadPoolExecutor(at_once) as pool:
        for pdf in batches:
            done: list[dict] = []
            for key, rows in pdf.groupby("apart", sort=False, dropna=False):
                asked = list(zip(rows["request_url"], rows["referer"]))
                for at in range(0, len(asked), at_once):
                    if key in blocked or (spec.breaker and failures.get(key, 0) >= spec.breaker):
                        break  # what is left gets no response, as if never asked
                    for r in pool.map(lambda u: fetch_one(u[0], spec, partial(transport, headers={"Referer": u[1]}) if u[1] else transport), asked[at : at + at_once]):
                        failures[key] = failures.get(key, 0) + 1 if r["status"] is None else 0
                        if r["status"] in spec.soft_block:
                            blocked.add(key)
                        done.append(r)
            yield pd.DataFrame(done, columns=["request_url", "status", "error", "headers", "body", "final_url", "fetched_at"]).astype({"status": "Int32"})


def _sent(requests: DataFrame, spec: SourceSpec) -> DataFrame:
    """What goes to tasks of requests: request_url, referer, apart."""
    column = lambda c: (F.col(c) if c in requests.columns else F.lit(None)).cast("string")
    return requests.select("request_url", column("referer").alias("referer"), column(spec.apart or "apart").alias("apart"))


def fetch(requests: DataFrame, spec: SourceSpec, transport: Transport, tasks: int | None = None) -> DataFrame:
    """requests: request_url and perhaps referer, which goes with the request as the transport's headers. Each task keeps
    `concurrency` requests open. Breakers and soft blocks are the state of a source, or of each value of the column that its
    policy keeps apart; what shares a state shares a task."""
    sent = _sent(requests, spec)
    tasks = tasks or requests.sparkSession.sparkContext.defaultParallelism
    if spec.breaker is not None or spec.soft_block:
        dealt = sent.repartition(tasks, "apart") if spec.apart else sent.repartition(1)
    else:
        dealt = sent.repartition(tasks)
    return dealt.mapInPandas(partial(_fetch, spec, transport), FETCHED)


def verify_heads(urls: DataFrame, spec: SourceSpec, transport: Transport, origin: Callable, regional: Callable) -> DataFrame:
    """Look each url up at the origin; where it answers 301 and names a region, once more there. Each request is sent once."""
    asked = urls.select("url", origin(F.col("url")).alias("request_url"))
    first = stored(asked.join(fetch(asked.select("request_url").distinct(), spec, transport), "request_url").drop("request_url"), "heads")
    region = F.get(F.map_values(F.map_filter("headers", lambda k, _: F.lower(k) == "x-amz-bucket-region")), F.lit(0))
    moved = first.where(F.col("status") == 301).select("url", region.alias("region")).where("region IS NOT NULL")
    again = moved.select("url", regional(F.col("url"), F.col("region")).alias("request_url"))
    second = stored(again.join(fetch(again.select("request_url").distinct(), spec, transport), "request_url").drop("request_url"), "heads")
    return first.join(second.select("url"), "url", "left_anti").unionByName(second).withColumnRenamed("url", "request_url")


@dataclass(frozen=True)
class Asking:
    """As replay(), by sending each request once, under one policy; under() gives the same for another."""

    spec: SourceSpec
    transport: Transport

    def under(self, policy: str) -> Asking:
        return Asking(SPECS[policy], self.transport)

    def __call__(self, requests: DataFrame) -> DataFrame:
        kept = [c for c in ("referer", self.spec.apart) if c in requests.columns]
        sent = requests.select("request_url", *kept).dropDuplicates(["request_url"])
        return requests.join(stored(fetch(sent, self.spec, self.transport), self.spec.name), "request_url", "left")


def under(ask: Callable[[DataFrame], DataFrame], policy: str) -> Callable[[DataFrame], DataFrame]:
    """ask under another policy, where it knows of policies; captured responses do not."""
    return ask.under(policy) if isinstance(ask, Asking) else ask


#: Seconds that an idle connection is kept, and redirects that are followed.
KEEP_ALIVE_S, HOPS = 30.0, 20
_held = threading.local()


class _Connections:
    """A thread's open connections, one for each host: with a pool of as many threads as a policy has requests open, these
    are what the pool holds, and no request waits for another's connection."""

    def __init__(self) -> None:
        self.by_host: dict[tuple[str, str, int | None], tuple[HTTPConnection, float]] = {}

    def take(self, key: tuple[str, str, int | None], spec: SourceSpec) -> tuple[HTTPConnection, bool]:
        """A connection, and whether it has served before."""
        known, since = self.by_host.pop(key, (None, 0.0))
        if known is not None and time.monotonic() - since < KEEP_ALIVE_S:
            return known, True
        if known is not None:
            known.close()
        made = (HTTPSConnection if key[0] == "https" else HTTPConnection)(key[1], key[2], timeout=spec.timeouts_s["connect"])
        made.connect()
        return made, False


def _exchange(method: str, url: str, spec: SourceSpec, headers: dict[str, str]) -> tuple[int, dict[str, str], str]:
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError(f"no address: {url!r}")
    if not hasattr(_held, "connections"):
        _held.connections = _Connections()
    key = parts.scheme, parts.hostname, parts.port
    target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    while True:
        connection, used = _held.connections.take(key, spec)
        try:
            connection.sock.settimeout(spec.timeouts_s["write"])
            connection.request(method, target, headers=headers)
            connection.sock.settimeout(spec.timeouts_s["read"])
            answer = connection.getresponse()
            body = answer.read()
        except (RemoteDisconnected, ConnectionError):
            connection.close()
            if used:
                continue  # the server had closed it meanwhile
            raise
        except BaseException:
            connection.close()
            raise
        if answer.will_close:
            connection.close()
        else:
            _held.connections.by_host[key] = connection, time.monotonic()
        return answer.status, dict(answer.headers), body.decode("utf-8", "replace")


def http_transport(method: str, url: str, spec: SourceSpec, headers: dict[str, str] | None = None) -> tuple[int, dict[str, str], str, str]:
    """The default transport, on the standard library: HTTP/1.1 over connections that are kept, with the source's limits of time
    for connecting, sending and reading; redirects only where it follows them."""
    for _ in range(HOPS + 1):
        status, found, body = _exchange(method, url, spec, headers or {})
        to = next((v for k, v in found.items() if k.lower() == "location"), None)
        if not spec.follow_redirects or status not in (301, 302, 303, 307, 308) or not to:
            return status, found, body, url
        url = urljoin(url, to)
    raise OSError("too many redirects")
