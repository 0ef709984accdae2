"""Settings from the environment."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

from lectern.operators.jobs import Policy

YES = frozenset(("1", "true", "yes", "y", "on"))
#: What is read, by the name of the setting: the variable, what holds without it, and the least it may be. The kind of a value is that of its default.
VARIABLES: dict[str, tuple[str, bool | int | str | None, int | None]] = {
    "embed_disabled": ("EMBED_DISABLED", False, None),
    "extraction_backend": ("EXTRACTION_BACKEND", "local", None),
    "database": ("ZOTERO_DB_PATH", None, None),
    "lease_seconds": ("QUEUE_LEASE_SECONDS", 180, 15),
    "batch_size": ("QUEUE_BATCH_SIZE", 32, 1),
    "max_attempts": ("QUEUE_MAX_ATTEMPTS", 5, 1),
    "backoff_base_seconds": ("QUEUE_BACKOFF_BASE_SECONDS", 5, 1),
    "backoff_max_seconds": ("QUEUE_BACKOFF_MAX_SECONDS", 900, 5),
}
POLICY = ("lease_seconds", "batch_size", "max_attempts", "backoff_base_seconds", "backoff_max_seconds")


@dataclass(frozen=True)
class Settings:
    embed_disabled: bool
    extraction_backend: str
    database: str | None
    policy: Policy


def value_of(raw: str, default: bool | int | str | None, least: int | None) -> bool | int | str | None:
    """A variable's text as a value of its default's kind; what is blank, a placeholder that nobody filled in, or no number where one is wanted, gives the default."""
    raw = raw.strip()
    if not raw or "${" in raw:
        value = default
    elif isinstance(default, bool):
        value = raw.lower() in YES
    elif isinstance(default, int):
        value = int(raw) if re.fullmatch(r"[+-]?\d+", raw) else default
    else:
        value = raw
    return value if least is None else max(least, value)


def load(env: Mapping[str, str] | None = None) -> Settings:
    env = os.environ if env is None else env
    found = {name: value_of(env.get(variable) or "", default, least) for name, (variable, default, least) in VARIABLES.items()}
    policy = Policy(**{name: found.pop(name) for name in POLICY})
    return Settings(**found, policy=policy)
