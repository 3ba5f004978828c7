"""Requests to services that ask for patience: spacing between requests, and retries."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import TypeVar

from cladeforge.schema import check_range
from cladeforge.sources.releases import RETRYABLE, delays

T = TypeVar("T")


class Damaged(ValueError):
    """An answer that isn't what was asked for, though its status is fine; worth a retry."""


class Refused(ValueError):
    """An answer whose status a retry won't mend; carries status and text."""

    def __init__(self, status: int, text: str):
        super().__init__(f"{status}: {text[:500]}")
        self.status, self.text = status, text


#: When this process last asked a host.
_asked: dict[str, float] = {}


@dataclass(frozen=True)
class Client:
    """How to ask. Tasks don't share a clock: each of `parallel` ones waits parallel x
    spacing seconds between its own requests, so that together they keep the spacing."""

    spacing: float = 0.0
    parallel: int = 1
    tries: int = 10
    first: float = 1.0
    most: float = 120.0
    timeout: float = 10.0
    retry: tuple[int, ...] = RETRYABLE

    @classmethod
    def of(cls, options: Mapping[str, str], **defaults) -> Client:
        """From a source's options, which are strings of any case of name."""
        kinds = {"spacing": float, "parallel": int, "tries": int, "first": float, "most": float, "timeout": float}
        given = {k: kind(options[k]) for k, kind in kinds.items() if options.get(k) is not None}
        check_range("parallel", given.get("parallel"), 1)
        return cls(**defaults | given)

    def options(self) -> dict[str, str]:
        return {k: str(getattr(self, k)) for k in ("spacing", "parallel", "tries", "first", "most", "timeout")}

    def ask(self, url: str, read: Callable[[bytes], T], data: bytes | None = None, headers: Mapping[str, str] | None = None) -> T:
        """read() of the answer. A broken connection, an answer that read() finds Damaged
        and a status worth it are tried again, with growing delays; other statuses raise
        Refused. After the last try RuntimeError says what the last failure was."""
        host = url.split("/")[2]
        failure: Exception | None = None
        for wait in [*delays(self.tries, self.most, self.first), None]:
            time.sleep(max(0.0, _asked.get(host, 0.0) + self.spacing * self.parallel - time.monotonic()))
            _asked[host] = time.monotonic()
            try:
                with urllib.request.urlopen(urllib.request.Request(url, data, dict(headers or {})), timeout=self.timeout) as answer:
                    return read(answer.read())
            except urllib.error.HTTPError as error:
                if error.code not in self.retry:
                    raise Refused(error.code, error.read().decode("utf-8", "replace")) from None
                failure = error
            except (urllib.error.URLError, TimeoutError, ConnectionError, http.client.HTTPException, Damaged) as error:
                failure = error
            if wait is not None:
                time.sleep(wait)
        raise RuntimeError(f"no answer after {self.tries} tries; the last failure: {type(failure).__name__}: {failure}")
