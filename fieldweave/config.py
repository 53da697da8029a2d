"""Settings from the environment, each with a default."""

from __future__ import annotations

import os
from pathlib import Path

from fieldweave.errors import ValidationError


def _folder(variable: str, default: str) -> Path:
    return Path(os.environ.get(variable) or default)


def proto_dir() -> Path:
    return _folder("FIELDWEAVE_PROTO_DIR", "protos")


def store_dir() -> Path:
    return _folder("FIELDWEAVE_STORE_DIR", "data/field_store")


def registry_dir() -> Path:
    return _folder("FIELDWEAVE_REGISTRY_DIR", "data/registry")


def default_model() -> str:
    return os.environ.get("FIELDWEAVE_MODEL") or "rules"


def embedder_dir() -> Path | None:
    """Folder of a sentence model; None for the built-in embedder."""
    return Path(folder) if (folder := os.environ.get("FIELDWEAVE_EMBEDDER_DIR")) else None


def model_url() -> str:
    url = os.environ.get("FIELDWEAVE_MODEL_URL")
    if not url:
        raise ValidationError("MISSING_MODEL_URL", "set FIELDWEAVE_MODEL_URL to the endpoint of a hosted model")
    return url


def api_key() -> str:
    key = os.environ.get("FIELDWEAVE_API_KEY")
    if not key:
        raise ValidationError("MISSING_API_KEY", "set FIELDWEAVE_API_KEY to use a hosted model")
    return key
