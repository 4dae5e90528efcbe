"""Byte streams of many texts and table-driven automata stepped over equal slices of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BREAK = 0xFF
"""Stands after each text in a stream; no UTF-8 byte has this value."""
LANE_BYTES = 1024


def stream_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each followed by BREAK; start of each text and the end of all)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(bytes([BREAK]).join(texts) + bytes([BREAK]), np.uint8), starts


@dataclass(frozen=True)
class Automaton:
    """``step[state * width + symbol]`` is the next state; state 0 starts; ``symbol[byte]`` is a byte's class."""

    symbol: np.ndarray
    step: np.ndarray
    width: int

    def run(self, stream: np.ndarray) -> np.ndarray:
        """The transition number (state * width + symbol) taken at each byte.

        Slices of equal length advance together, each from state 0. Where the state that
        truly enters a slice differs, the slice runs again from it, until it meets the
        states already found; so the result is that of one pass from left to right.
        """
        n = len(stream)
        lanes = -(-n // LANE_BYTES)
        padded = np.full(lanes * LANE_BYTES, BREAK, np.uint8)
        padded[:n] = stream
        symbols = self.symbol[padded].reshape(lanes, LANE_BYTES).T.copy()
        taken = np.empty((LANE_BYTES, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for k in range(LANE_BYTES):
            taken[k] = state * self.width + symbols[k]
            state = self.step[taken[k]]
        todo = np.arange(1, lanes)
        entered = np.zeros(lanes, np.int32)
        while len(todo):
            todo = todo[state[todo - 1] != entered[todo]]
            if not len(todo):
                break
            entered[todo] = state[todo - 1]
            live, now = todo, entered[todo]
            for k in range(LANE_BYTES):
                t = now * self.width + symbols[k, live]
                same = t == taken[k, live]
                if same.any():
                    live, t = live[~same], t[~same]
                    if not len(live):
                        break
                taken[k, live] = t
                now = self.step[t]
            else:
                state[live] = now
            todo = todo[todo + 1 < lanes] + 1
        return taken.T.reshape(-1)[:n]
