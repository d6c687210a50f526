"""Settings, read once from a mapping of names to texts (the environment by default).  Keys never enter a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

# Names of settings and what holds where they are unset.
KEY_NAMES = {"anthropic": "ANTHROPIC_API_KEY", "openai": "OPENAI_API_KEY", "gemini": "GEMINI_API_KEY"}
OTHER_KEY = "TOR_PROVIDER_API_KEY"
OVERRIDE = "TOR_GROUP_"
FX_RATE, FX_DATE = "36.50", "2026-08-28"
_ON = ("1", "true", "yes", "on")


def is_on(text: str | None) -> bool:
    return (text or "").strip().lower() in _ON


def key_name(provider: str) -> str:
    """The setting that holds a provider's key."""
    return KEY_NAMES.get(provider, OTHER_KEY)


@dataclass(frozen=True)
class Settings:
    provider: str
    model: str
    has_key: bool
    base_url: str | None
    max_upload_bytes: int
    origins: tuple[str, ...]
    timeout_seconds: int
    fx_rate: float  # baht for a dollar, told with its date
    fx_date: str
    compat_vision: bool  # whether the provider of any compatible endpoint sees images
    max_vision_pages: int
    max_vision_bytes: int
    kinds: tuple[str, ...]
    overrides: tuple[tuple[str, str], ...]  # names and texts, to be parsed as a table


def load(env: Mapping[str, str] | None = None) -> Settings:
    env = os.environ if env is None else env
    provider = env.get("TOR_PROVIDER", "anthropic")
    return Settings(
        provider=provider, model=env.get("TOR_MODEL", "claude-opus-5"), has_key=bool(env.get(key_name(provider))), base_url=env.get("TOR_PROVIDER_BASE_URL"),
        max_upload_bytes=int(env.get("MAX_UPLOAD_MB", "50")) << 20, origins=tuple(x.strip() for x in env.get("CORS_ORIGINS", "http://localhost:5173").split(",") if x.strip()),
        timeout_seconds=int(env.get("EXTRACTION_TIMEOUT_SECONDS", "300")), fx_rate=float(env.get("USD_THB_RATE", FX_RATE)), fx_date=env.get("USD_THB_RATE_DATE", FX_DATE),
        compat_vision=is_on(env.get("TOR_OPENAI_COMPAT_VISION")), max_vision_pages=int(env.get("TOR_MAX_VISION_PAGES", "20")), max_vision_bytes=int(env.get("TOR_MAX_VISION_PAYLOAD_BYTES", str(20 << 20))),
        kinds=("pdf", "docx", *(["xlsx"] if is_on(env.get("TOR_ENABLE_XLSX")) else [])), overrides=tuple(sorted((k, v) for k, v in env.items() if k.startswith(OVERRIDE))),
    )
