"""First-wins selection on a stream: the state of a contig is the end of its last applied record.

Records of a contig must arrive in order of position, as a file's do; within a micro-batch they
are put in order. There is no event time, so nothing is late and no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def select_stream(records: DataFrame) -> DataFrame:
    """(contig, rec_ord, start, end, applied) of a stream (contig, rec_ord, start, end)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor = state.get[0] if state.exists else -1
        rows = pd.concat(batches).sort_values("rec_ord")
        applied = []
        for start, end in zip(rows["start"], rows["end"], strict=True):
            applied.append(start >= cursor)
            if start >= cursor:
                cursor = end
        state.update((int(cursor),))
        yield rows.assign(applied=applied)[["contig", "rec_ord", "start", "end", "applied"]]

    return records.select("contig", "rec_ord", "start", "end").groupBy("contig").applyInPandasWithState(
        step, "contig string, rec_ord long, start long, `end` long, applied boolean", "cursor long", "append", GroupStateTimeout.NoTimeout
    )
