"""HTTP reads with bounded retries, for readers that run in tasks."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

# Fixed values.
ATTEMPTS, LONGEST = 5, 30.0
LISTING_ATTEMPTS, LISTING_STEP = 4, 2.0
WARM_ATTEMPTS, WARM_STEP, WARM_LONGEST = 30, 2.0, 10.0
WAKING = (409, 429, 500, 502, 503, 504)


def transient(status: int) -> bool:
    return status == 429 or 500 <= status <= 599


def pause(attempt: int, retry_after: str | None = None) -> float:
    """Seconds before the next attempt: what the service asks for, else 2, 4, 8 ... up to 30."""
    if retry_after and retry_after.strip().isdigit():
        return float(retry_after)
    return min(LONGEST, 2.0**attempt)


def get(url: str, headers: dict[str, str] | None = None, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> str:
    """The body as text; statuses that may pass are tried again."""
    return fetch(url, headers, opener, sleep).decode("utf-8", "replace")


def fetch(url: str, headers: dict[str, str] | None = None, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> bytes:
    for attempt in range(1, ATTEMPTS + 1):
        try:
            with opener(urllib.request.Request(url, headers=headers or {}), timeout=60) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if attempt == ATTEMPTS or not transient(e.code):
                raise
            sleep(pause(attempt, e.headers.get("Retry-After") if e.headers else None))
    raise AssertionError("unreachable")


def warm_post(url: str, payload: dict, headers: dict[str, str] | None = None, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer of a service that may have to wake up; other statuses than those of waking fail at once."""
    body = json.dumps(payload).encode()
    for attempt in range(1, WARM_ATTEMPTS + 1):
        try:
            with opener(urllib.request.Request(url, body, {"Content-Type": "application/json"} | (headers or {})), timeout=300) as r:
                return r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if attempt == WARM_ATTEMPTS or e.code not in WAKING:
                raise
            sleep(min(WARM_LONGEST, WARM_STEP * attempt))
    raise AssertionError("unreachable")


def default_branch(body: str) -> str:
    """The branch that a repository's description names, else "main"."""
    try:
        found = json.loads(body).get("default_branch")
    except (ValueError, AttributeError):
        found = None
    return found if isinstance(found, str) and found.strip() else "main"


def until_listed(read: Callable[[], list], sleep: Callable[[float], None] = time.sleep) -> list:
    """A listing that is empty is read again, four times in all, with growing pauses."""
    found: list = []
    for attempt in range(1, LISTING_ATTEMPTS + 1):
        found = read()
        if found:
            break
        if attempt < LISTING_ATTEMPTS:
            sleep(LISTING_STEP * attempt)
    return found
