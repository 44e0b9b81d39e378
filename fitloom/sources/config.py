"""Settings from environment-like mappings: typed, clamped, secrets masked."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


def number(env: Mapping[str, str], key: str, default: float, low: float, high: float) -> float:
    """A number of a setting, the default for unusable text, held between ``low`` and ``high``."""
    try:
        value = float(env.get(key, "") or default)
    except ValueError:
        value = default
    return max(low, min(high, value))


def flag(env: Mapping[str, str], key: str, default: bool) -> bool:
    value = env.get(key, "").strip().lower()
    return value in ("1", "true", "yes", "on") if value else default


def mask(secret: str) -> str:
    return "" if not secret else "****" if len(secret) <= 8 else f"{secret[:4]}****{secret[-4:]}"


@dataclass(frozen=True)
class Settings:
    max_upload_mb: float = 5.0
    max_chars: int = 60_000
    top_k: int = 50
    persist: bool = True

    @classmethod
    def load(cls, env: Mapping[str, str]) -> Settings:
        return cls(number(env, "MAX_UPLOAD_MB", 5, 0.1, 100), int(number(env, "MAX_CHARS", 60_000, 100, 10_000_000)), int(number(env, "TOP_K", 50, 1, 1000)), flag(env, "PERSIST", True))
