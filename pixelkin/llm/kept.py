"""Values that a Python worker keeps from one task to the next.

Functions of this package reach the workers by value, with fresh module globals for every task; tables that take
a second to build would be built again each time. They are kept under their key in a module of the process.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

_NAME = "_pixelkin_kept"


def kept(key: tuple, build: Callable[[], object]):
    store = sys.modules.setdefault(_NAME, types.ModuleType(_NAME)).__dict__
    if key not in store:
        store[key] = build()
    return store[key]
