"""Named queries over the star-schema tables, with their SQL."""

from galena.plans import builds, evaluation, records, reports, scoring, shaping, training

MODULES = (scoring, shaping, training, reports, builds, evaluation, records)
REGISTRY = {name: f for module in MODULES for name, f in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
