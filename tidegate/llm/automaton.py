"""Runs a dense automaton over many stretches of bytes at once."""

from __future__ import annotations

import numpy as np


def run(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, width: int, state: int, visit) -> None:
    """Advance all stretches codes[start : start + size] together, each from ``state``.

    table[s * width + code] is the next state. visit(t, places, index) gets, for each step t, the places in ``codes`` and
    the entries of the table that are used there. Stretches that have ended drop out.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    s = np.full(len(starts), state, np.int64)
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1 if len(sizes) else 1), "right")
    for t, n in enumerate(active):
        if n < len(s):
            s = s[:n]
        places = starts[:n] + t
        index = s * width + codes[places]
        visit(t, places, index)
        s = table[index].astype(np.int64)
