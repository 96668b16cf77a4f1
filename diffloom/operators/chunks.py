"""Bin packing of patches into output chunks, in path order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def chunk_by_budget(items: DataFrame, budget: int) -> DataFrame:
    """changeset_id, path, size, chunk: a new chunk begins where the next item would exceed the budget.

    An item above the budget is alone in its chunk. Items go in path order. The running
    sum is reset by itself, so each change set is read in order by one task, which keeps
    two numbers and no rows. Null keys are left out, a null size counts as 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, chunk, used, solo = None, 0, 0, False
        for batch in batches:
            chunks = []
            for key, size in zip(batch["changeset_id"], batch["size"]):
                if key != current:
                    current, chunk, used, solo = key, 0, 0, False
                elif solo or used + size > budget:
                    chunk, used, solo = chunk + 1, 0, False
                used += size
                solo = size > budget
                chunks.append(chunk)
            yield batch.assign(chunk=pd.Series(chunks, index=batch.index, dtype="int32"))

    ordered = (
        items.where("changeset_id is not null and path is not null")
        .selectExpr("changeset_id", "path", "coalesce(size, 0L) as size")
        .repartition("changeset_id")
        .sortWithinPartitions("changeset_id", "path")
    )
    return ordered.mapInPandas(run, "changeset_id string, path string, size bigint, chunk int")
