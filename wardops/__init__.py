"""wardops: care-facility analytics and bulk change rules as Spark jobs."""

from wardops.session import configure, local_session
from wardops.tables import Tables

__all__ = ["Tables", "configure", "local_session"]
