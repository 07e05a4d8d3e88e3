"""All named queries; importing the catalogue modules registers them."""

from poolpick.plans import (catalog_analysis, catalog_eval, catalog_prepare, catalog_reports, catalog_scores,  # noqa: F401
                            catalog_selection)
from poolpick.plans.catalog_selection import flagship  # noqa: F401
from poolpick.plans.registry import ORACLES, QUERIES  # noqa: F401
