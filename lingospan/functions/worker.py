"""What a Python worker keeps between its tasks."""

from __future__ import annotations

import sys
import types
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

#: What the values of a worker may weigh together; a model weighs one unless told otherwise.
CAPACITY = 4.0


def registry() -> OrderedDict[object, tuple[float, Any]]:
    """The values of this worker, the least recently used first.

    The package's functions travel by value, so its module variables start afresh in every task: values are kept
    in a module of the worker's own.
    """
    store = sys.modules.setdefault("_lingospan_worker", types.ModuleType("_lingospan_worker")).__dict__
    return store.setdefault("values", OrderedDict())


def kept(key: object, make: Callable[[], Any], weight: float = 1.0, capacity: float = CAPACITY) -> Any:
    """The value made for ``key``, made anew only if the worker does not hold it.

    Several values are held side by side. The least recently used ones go, before the new one is made, until it fits
    into ``capacity`` with the rest; one that weighs more than that is held alone.
    """
    values = registry()
    if key not in values:
        while values and sum(w for w, _ in values.values()) + weight > capacity:
            values.popitem(last=False)
        values[key] = (weight, make())
    values.move_to_end(key)
    return values[key][1]
