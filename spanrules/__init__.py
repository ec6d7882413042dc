"""spanrules: latency explanation for distributed-tracing data, on Spark DataFrames.

Spans -> one wide latency row per trace -> split values per column -> range rules that explain
when the user-facing latency falls into an interval. Every step is a DataFrame plan; the driver
only ever holds small summaries (thresholds, the current beam, final answers).
"""

from spanrules.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
