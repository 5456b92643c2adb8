"""All registered queries."""

from __future__ import annotations

from functools import wraps

from tilewright.plans import registry_augment, registry_files, registry_instances, registry_pixels, registry_tables
from tilewright.session import ship_code


def _ready(fn):
    """The query, with the package shipped to the workers first."""

    @wraps(fn)
    def run(spark, sf_dir):
        ship_code(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {
    name: _ready(fn)
    for module in (registry_pixels, registry_augment, registry_instances, registry_tables, registry_files)
    for name, fn in module.QUERIES.items()
}
ORACLES = {**registry_pixels.ORACLES, **registry_augment.ORACLES, **registry_instances.ORACLES, **registry_tables.ORACLES, **registry_files.ORACLES}
