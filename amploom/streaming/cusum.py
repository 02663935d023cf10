"""CUSUM over a stream of samples: seven numbers of state a read.

The least deviation of a quiet window needs the whole read, so the stream takes it as a parameter; with the same
floor a read's segments are those of the batch kernel, in whatever micro-batches its samples come (in order of pos
across batches).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "m1 double, m2 double, n long, gp double, gn double, seg int"


def cusum_stream(samples: DataFrame, floor: float, key: str = "read_index", sigma: float = 1.0, h: float = 3.0) -> DataFrame:
    """(key, pos, x, seg) from a stream of (key long, pos long, x double)."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m1, m2, n, gp, gn, seg = state.get if state.exists else (0.0, 0.0, 0, 0.0, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values("pos")
        out = []
        for v in rows["x"]:
            n += 1
            d = v - m1
            m1 += d / n
            m2 += d * (v - m1)
            sd = max(floor, (m2 / n) ** 0.5)
            if n > 1 and sd > 0:
                gp = max(0.0, gp + sigma / sd * (v - m1 - sigma * sd / 2))
                gn = max(0.0, gn - sigma / sd * (v - m1 + sigma * sd / 2))
            if gp >= h or gn >= h:
                seg += 1
                m1, m2, n, gp, gn = float(v), 0.0, 1, 0.0, 0.0
            out.append(seg)
        state.update((float(m1), float(m2), int(n), float(gp), float(gn), int(seg)))
        yield pd.DataFrame({key: k[0], "pos": rows["pos"], "x": rows["x"], "seg": out})

    return samples.groupBy(key).applyInPandasWithState(step, f"{key} long, pos long, x double, seg int", STATE, "append", GroupStateTimeout.NoTimeout)
