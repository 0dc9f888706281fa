"""Queries over the driver's tables: importing this package registers them."""

from marlstone.plans import relational, runs, scalars, structure  # noqa: F401
