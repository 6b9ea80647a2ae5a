"""The hook for a segmentation model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def predict(chips: DataFrame, model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Candidates of a segmentation model: model() is made once a task and turns batches of chips into rows of `schema`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infer = model()
        for batch in batches:
            yield infer(batch)

    return chips.mapInPandas(run, schema)
