"""Registered queries: each takes ``(spark, folder)`` and runs over the whole given tables."""

from tallymark.queries.registry import ORACLES, QUERIES  # noqa: F401
from tallymark.queries import (  # noqa: F401  (importing a module registers its queries)
    diagnose, encoding, models, prepare, profiling, scoring, selecting,
)
