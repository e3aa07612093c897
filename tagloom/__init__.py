"""tagloom: industrial tag time series on Spark.

Wide per-cycle snapshots become a long history table; history, sampled,
statistics and latest-value queries run over it; per-series window operators
(lag, hold-last, integral, rate, clamp, PID response, slew limit) and waveform
generation are DataFrame plans that Catalyst optimises and executors scale by
series and by time.
"""

from tagloom.schema import HISTORY_SCHEMA, METADATA_KEYS  # noqa: F401
from tagloom.session import ensure_checkpoint_dir, local_session  # noqa: F401

__all__ = ["HISTORY_SCHEMA", "METADATA_KEYS", "ensure_checkpoint_dir", "local_session"]
