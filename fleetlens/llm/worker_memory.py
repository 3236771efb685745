"""What operators keep in a Python worker from one task to the next.

A worker outlives its task and serves one operator after the other. Each of them may keep automata and tables of some
hundred MB; were they all kept, an executor would hold those of every operator that it ever ran. So a worker keeps what
the operator at work needs, and the next operator's first request lets that go.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, build: Callable[[], Any]) -> Any:
    """What `build` made for this key, unless another key came in between; then that one's is let go and this one's is built anew."""
    try:
        return _KEPT[key]
    except KeyError:
        _KEPT.clear()
        gc.collect()  # tables may refer to what made them
        pa.default_memory_pool().release_unused()
        made = _KEPT[key] = build()
        return made
