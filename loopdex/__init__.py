"""loopdex: a Spark-native library for building and searching a captioned-media corpus.

Everything is expressed as DataFrame transformations (Catalyst plans); Python only
appears as Arrow-batched helpers where a built-in expression cannot do the job.
"""

from loopdex.config import SearchConfig
from loopdex.session import get_spark, checkpoint_dir

__all__ = ["SearchConfig", "get_spark", "checkpoint_dir"]
