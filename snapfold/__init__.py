"""snapfold: reconcile full feed snapshots against stored state with Spark DataFrames."""

from snapfold.session import configure, local_session, scratch_dir

__all__ = ["configure", "local_session", "scratch_dir"]
