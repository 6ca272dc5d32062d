"""Streaming version of the ingest job."""

from .ingest import start_long_ingest, stream_exports

__all__ = ["start_long_ingest", "stream_exports"]
