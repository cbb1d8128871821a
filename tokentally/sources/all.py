"""Every source, registered."""

from tokentally.sources import claude, codex, generic, opencode  # noqa: F401
from tokentally.sources.base import get, get_all, names  # noqa: F401
