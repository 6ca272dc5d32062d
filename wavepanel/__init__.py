"""wavepanel - panel-survey analytics on Spark DataFrames."""

from .session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
