"""Streams: state that is kept up to date from micro-batches, windows and timers over event time."""

from .daily import daily_study
from .ordered import run_to_table
from .retention import retention_stream
from .timers import latest_times, timer_stream
from .upsert import LogSink, run_available

__all__ = ["LogSink", "daily_study", "latest_times", "retention_stream", "run_available", "run_to_table", "timer_stream"]
