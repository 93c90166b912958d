"""Column expressions: labels, null handling, geometry, arrays."""
from .columns import *  # noqa: F403
