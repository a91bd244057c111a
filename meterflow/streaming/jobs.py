"""The scrape pipeline as a stream.

Every function of this package takes streaming DataFrames; checkpoints and sinks are the caller's.  Operators with state need
``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..operators.relabel import Rule
from ..operators.scrapes import BODY_LIMIT, scrape_pipeline


def stream_scrape_pipeline(scrapes: DataFrame, target_labels: Column, rules: list[Rule] = [], external: Column | None = None, honor_labels: bool = False, honor_timestamps: bool = True, body_limit: int = BODY_LIMIT, sample_limit: int = 0) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(judged scrapes, final samples) of a stream of scrapes; no step keeps state."""
    return scrape_pipeline(scrapes, target_labels, rules, external, honor_labels, honor_timestamps, body_limit, sample_limit)
