"""The batch jobs as continuous ones: scrapes arrive as a stream, order within a target is by start."""

from .delivery import stream_batches, stream_delivery
from .jobs import stream_scrape_pipeline
from .staleness import FILES, staleness_events, stream_stale_markers, stream_staleness

__all__ = ["FILES", "staleness_events", "stream_batches", "stream_delivery", "stream_scrape_pipeline", "stream_stale_markers", "stream_staleness"]
