"""All registered queries."""

from segloom.catalog import batches, core, flows, queue, scalars, styles, terms  # noqa: F401
from segloom.catalog.registry import ORACLES, QUERIES  # noqa: F401
