"""A few links with the same components as many."""

from __future__ import annotations

import numpy as np


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links i - j among n points: each point that is not its component's smallest, and that smallest."""
    own = np.arange(n)
    label = own.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != own)
    return moved, label[moved]
