"""What each source asks for and when it stops: these decide which rows exist, so they are data."""

from __future__ import annotations

from dataclasses import dataclass, field

from linkloom import constants as C


@dataclass(frozen=True)
class SourceSpec:
    name: str
    method: str = "GET"
    paging: str = "none"  # none, cursor, number
    page_cap: int | None = None
    concurrency: int = 3
    retries: int = 3
    backoff_s: float = 2.0  # doubles with each attempt
    terminal: tuple[int, ...] = (200,)
    soft_block: tuple[int, ...] = ()
    breaker: int | None = None  # consecutive transport failures after which the source is given up
    apart: str | None = None  # column by which the breaker's state is kept, each value in its own task
    follow_redirects: bool = False
    jitter_s: tuple[float, float] = (0.0, 0.0)
    honours_retry_after: bool = False
    timeouts_s: dict[str, float] = field(default_factory=lambda: {"connect": 10, "read": 30, "write": 5, "pool": 5})


SPECS = {s.name: s for s in (
    SourceSpec("regional", concurrency=50, retries=1, backoff_s=1.0, follow_redirects=True),
    SourceSpec("model_page", concurrency=30, retries=0),
    SourceSpec("wayback", paging="cursor", terminal=(200, 404), jitter_s=(0.1, 0.4)),
    SourceSpec("common_crawl", paging="number", terminal=(200, 404), breaker=10, apart="index", jitter_s=(0.1, 0.4)),
    SourceSpec("code_search", paging="number", page_cap=10, honours_retry_after=True),
    SourceSpec("organisation_search", paging="number", page_cap=10, honours_retry_after=True),
    SourceSpec("discourse", paging="number", page_cap=4, terminal=(200, 404), soft_block=C.BLOCKED),
    SourceSpec("forum_listing", paging="cursor", page_cap=10, terminal=(200, 404), soft_block=C.BLOCKED),
    SourceSpec("search_pages", concurrency=1, retries=0),
    SourceSpec("dork", concurrency=3, retries=0),
    SourceSpec("sister_index", concurrency=10, retries=1, backoff_s=1.0),
    SourceSpec("sister_model", concurrency=10, retries=0, follow_redirects=True),
    SourceSpec("model_sweep", concurrency=16, retries=0, jitter_s=(0.05, 0.25)),
    SourceSpec("linked_page", concurrency=16, retries=0, follow_redirects=True, jitter_s=(0.05, 0.25)),
    SourceSpec("verify", method="HEAD", concurrency=100, retries=0),
    SourceSpec("bruteforce", method="HEAD", concurrency=100, retries=0),
)}
