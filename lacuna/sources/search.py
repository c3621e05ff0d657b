"""A paper search service over an injected transport.

``Transport`` sends one request and returns status and parsed body, so the client can be
run against any HTTP library, or none in tests. A busy answer (429) is repeated after
growing waits; other failures raise.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: (method, path, parameters, JSON body) -> (status, parsed body)
Transport = Callable[[str, str, dict[str, Any], Any], tuple[int, Any]]

#: Fixed value: the fields that are asked for.
FIELDS = "paperId,title,year,venue,abstract,url,authors,citationCount,openAccessPdf,externalIds"
#: Fixed value: papers a search gives at once, at most, and ids of a batch.
SEARCH_LIMIT, BATCH = 100, 100


class SearchError(RuntimeError):
    """The service answered with a status that is neither success nor busy."""

    def __init__(self, status: int, path: str) -> None:
        super().__init__(f"{path} answered {status}")
        self.status = status


@dataclass
class SearchClient:
    """Implements ``PaperSearch`` with look-ups by identifier besides."""

    transport: Transport
    tries: int = 6
    first_wait: float = 1.0
    prefix: str = "ARXIV:"
    sleep: Callable[[float], None] = field(default=time.sleep)

    def _ask(self, method: str, path: str, params: dict[str, Any], body: Any = None) -> Any:
        status = 0
        for k in range(self.tries):
            status, answer = self.transport(method, path, params, body)
            if status == 429:
                if k < self.tries - 1:
                    self.sleep(self.first_wait * 2**k)
                continue
            if status >= 400:
                raise SearchError(status, path)
            return answer
        raise SearchError(status, path)

    def search(self, query: str, limit: int = 10) -> list[dict]:
        got = self._ask("GET", "/paper/search", {"query": query, "limit": limit, "fields": FIELDS})
        return (got or {}).get("data") or []

    def lookup(self, key: str) -> dict | None:
        """The paper of one id; None if the service does not know it."""
        try:
            return self._ask("GET", f"/paper/{self.prefix}{key}", {"fields": FIELDS})
        except SearchError as e:
            if e.status == 404:
                return None
            raise

    def batch(self, ids: Iterable[str]) -> list[dict | None]:
        """Papers in the order of the ids, None for unknown ones, ``BATCH`` ids a request."""
        keys = [f"{self.prefix}{i}" for i in ids]
        out: list[dict | None] = []
        for i in range(0, len(keys), BATCH):
            out += self._ask("POST", "/paper/batch", {"fields": FIELDS}, {"ids": keys[i : i + BATCH]})
        return out


def select_by_search(spark: SparkSession, client: SearchClient, query: str, n: int = 50) -> DataFrame:
    """``id, title, year, venue, citation_count, abstract`` of the first ``n`` hits that have an archive id, each id once.

    More are asked for, as not every hit has one; the service gives ``SEARCH_LIMIT`` at
    most. Repeated ids count towards ``n``.
    """
    named = [(h["externalIds"]["ArXiv"], h) for h in client.search(query, min(3 * n, SEARCH_LIMIT)) if (h.get("externalIds") or {}).get("ArXiv")][:n]
    rows = {key: (key, h.get("title") or "", h.get("year"), h.get("venue") or "", h.get("citationCount") or 0, h.get("abstract") or "") for key, h in reversed(named)}
    return spark.createDataFrame([rows[k] for k in dict.fromkeys(k for k, _ in named)], "id string, title string, year int, venue string, citation_count bigint, abstract string")
