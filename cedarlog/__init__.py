"""cedarlog: log ingest, search, statistics and retention as Spark jobs."""

from cedarlog.session import configure
from cedarlog.schemas import SOURCES, source

__all__ = ["SOURCES", "configure", "source"]
