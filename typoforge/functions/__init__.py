"""Column functions: globs, boundary marks, splices, guards."""

from .text import *  # noqa: F403
