"""Connected components within a task, and of a large graph."""

from __future__ import annotations

import numpy as np

from vetloom.operators.graph import components  # noqa: F401  the operators take both from here


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of ``0 .. n - 1`` over the links (a, b)."""
    parent = np.arange(n)
    while len(a):
        low, high = parent[a], parent[b]
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        parent[np.maximum(low, high)] = np.minimum(low, high)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent
