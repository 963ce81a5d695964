"""What a Python worker keeps between tasks."""

from __future__ import annotations

import sys
import types


def kept(key: str, make):
    """make() once in a worker process; later tasks there get the same object. It must be a cache whose
    loss changes nothing but time."""
    store = sys.modules.setdefault("_vistrack_kept", types.ModuleType("_vistrack_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
