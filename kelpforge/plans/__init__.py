"""See the modules of this package."""

from kelpforge.plans import catalogue, scalars, studies  # noqa: F401  all register their queries
