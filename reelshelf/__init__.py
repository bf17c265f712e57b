"""Media-catalogue analytics expressed as Spark DataFrame jobs."""

from reelshelf.plans.catalogue import Catalogue
from reelshelf.plans.spec import CatalogueQuery, QueryError, preset
from reelshelf.session import build_session

__all__ = ["Catalogue", "CatalogueQuery", "QueryError", "build_session", "preset"]
