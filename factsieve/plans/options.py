"""Options of an extraction run, with their defaults."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

#: What a limit is when none is set: the defaults drop no records, list items or list pages.
NO_LIMIT = 2**31 - 3


@dataclass(frozen=True)
class Options:
    """``mode`` is auto, list or single; ``max_pagination_pages`` may be ``"all"``; ``as_of`` chooses among dated snapshots."""

    mode: str = "auto"
    max_records: int = NO_LIMIT
    min_fields_per_record: int = 2
    max_pages: int = 5
    max_depth: int = 1
    follow_internal_links: bool = True
    allow_pagination: bool = False
    max_pagination_pages: int | str | None = "all"
    min_confidence: float = 0.4
    max_list_items: int = NO_LIMIT
    as_of: dt.datetime | None = None
    robots_agent: str = "*"


def page_budget(options: Options) -> int:
    """List pages a walk may read beyond the first."""
    if not options.allow_pagination:
        return 0
    raw = options.max_pagination_pages
    if raw in ("all", None, 0) or raw == float("inf"):
        return NO_LIMIT
    try:
        n = int(raw)
    except (TypeError, ValueError):
        return 0
    return min(n, NO_LIMIT) if n > 0 else 0
