"""All registered queries, and the SQL of those that SQL can express."""

from . import attributes, match, science, series, space  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES  # noqa: F401
