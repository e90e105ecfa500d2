"""All registered queries, by family."""

from tidemark.catalog import (  # noqa: F401
    timeseries, panel, evaluation, ledger, sources, jobs, boosting, series, blends, reports,
)
from tidemark.catalog.jobs import flagship  # noqa: F401
from tidemark.catalog.registry import ORACLES, QUERIES  # noqa: F401
