"""Which model provider the settings of a process name: ordered rules over environment variables."""

from __future__ import annotations

import base64
import re
from collections.abc import Mapping
from dataclasses import dataclass

from citelake.functions.text import LOCAL_HOST, LOCAL_KEYS

# Variables, endpoints and default models that users have in their settings.
HOSTED = {"groq": "https://api.groq.com/openai/v1"}
LOCAL = {"ollama": "http://localhost:11434/v1", "lm-studio": "http://localhost:1234/v1"}
KEYS = {"openai": ("OPENAI_API_KEY",), "groq": ("GROQ_API_KEY",), "gemini": ("GEMINI_API_KEY", "GOOGLE_API_KEY")}
BASES = ("OPENAI_API_BASE", "OPENAI_BASE_URL")
MODELS = {"openai": ("MODEL_NAME", "OPENAI_MODEL"), "local": ("MODEL_NAME", "OPENAI_MODEL"), "groq": ("MODEL_NAME",), "gemini": ("GEMINI_MODEL",)}
VISION_MODELS = {"openai": (), "local": (), "groq": (), "gemini": ("GEMINI_MODEL",)}
VISION = "VISION_MODEL_NAME"
EMBEDDERS = ("EMBEDDING_PROVIDER", "EMBEDDING_MODEL")
#: The key that a local endpoint is given where none is set.
PLACEHOLDER = LOCAL_KEYS[0]


@dataclass(frozen=True)
class Resolved:
    provider: str
    base_url: str | None
    api_key: str | None
    model: str | None
    flavour: str
    vision_model: str | None = None


def is_local(base_url: str | None, key: str | None) -> bool:
    """Whether the endpoint is on this machine, or the key is one that local servers are given."""
    return bool(base_url and re.match(LOCAL_HOST, base_url)) or (key or "").strip().lower() in LOCAL_KEYS


def resolve(
    environment: Mapping[str, str], provider: str | None = None, base_url: str | None = None, api_key: str | None = None,
    defaults: Mapping[str, str] | None = None, vision_defaults: Mapping[str, str] | None = None,
) -> Resolved:
    """What is given counts before what the environment names, and that before ``defaults`` (a model for each flavour).

    The provider is the first whose credential is there, in the order of ``KEYS``; an endpoint of one's own counts as the
    first.  A local endpoint needs no key, and a placeholder is used where none is set.
    """

    def first(names: tuple[str, ...]) -> str | None:
        return next((environment[n] for n in names if environment.get(n)), None)

    if provider is None:
        named = [p for p, names in KEYS.items() if first(names) or (p == "openai" and environment.get(BASES[0]))]
        provider = (named or ["openai"])[0]
    key = api_key or first(KEYS.get(provider, ()))
    marker = environment.get(KEYS["openai"][0]) or ""
    base = base_url or first(BASES) or LOCAL.get(marker.strip().lower())
    if base is None and (provider == "groq" or first(KEYS["groq"])):
        base = HOSTED["groq"]
    base = base.rstrip("/") if base else None
    if key is None and provider not in ("gemini", "groq") and is_local(base, None):
        key = PLACEHOLDER
    flavour = provider if provider in ("gemini", "groq") else "local" if is_local(base, marker) else "openai"
    vision = environment.get(VISION) or first(VISION_MODELS[flavour]) or (vision_defaults or {}).get(flavour)
    return Resolved(provider, base, key, first(MODELS[flavour]) or (defaults or {}).get(flavour), flavour, vision)


def embedding_provider(environment: Mapping[str, str], given: str | None = None, client: bool = False, local_library: bool = False) -> str:
    """Who makes vectors: the one named, else a client that is given, a library on this machine, a hosted key, or ``none``.

    A key that local servers are given is none: vectors that are refused for every text would be worse than no vectors.
    """
    named = (given or environment.get(EMBEDDERS[0]) or "auto").strip().lower()
    key = environment.get(KEYS["openai"][0])
    if named != "auto":
        return named
    if client:
        return "openai"
    return "sentence-transformers" if local_library else "openai" if key and key.strip().lower() not in LOCAL_KEYS else "none"


def image_url(image: bytes, mime_type: str = "image/png") -> str:
    """An image as a data URL."""
    return f"data:{mime_type};base64,{base64.b64encode(image).decode()}"
