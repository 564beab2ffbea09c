"""Session analytics on Spark: every operator is a DataFrame-to-DataFrame function keyed by session."""

from runlens.session import configure, table_of

__all__ = ["configure", "table_of"]
