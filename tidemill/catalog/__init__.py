"""Every operator as a query over the test tables, with the same result stated in SQL."""

from tidemill.catalog import clean, closed, features, history, models, profiles, sampling, sources
from tidemill.catalog.base import REGISTERED

__all__ = ["REGISTERED", "clean", "closed", "features", "history", "models", "profiles", "sampling", "sources"]
