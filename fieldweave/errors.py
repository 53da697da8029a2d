"""Errors with a code, a context and a cause, so that callers and logs can tell them apart."""

from __future__ import annotations


class FieldweaveError(Exception):
    """Base of all errors raised here; prints as `[code] message | context=... | cause=...`."""

    def __init__(self, code: str, message: str, context: dict | None = None, cause: Exception | None = None):
        super().__init__(message)
        self.code, self.message, self.context, self.cause = code, message, dict(context or {}), cause

    def __str__(self) -> str:
        parts = [f"[{self.code}] {self.message}"]
        parts += [f"{name}={value}" for name, value in (("context", self.context), ("cause", self.cause)) if value]
        return " | ".join(parts)


class ValidationError(FieldweaveError):
    """Input that is there but wrong: a format, a setting, a registry file."""


class NotFoundError(FieldweaveError):
    """A file or folder that isn't there."""


class DataAccessError(FieldweaveError):
    """A store or file that can't be read or written."""


class ProcessingError(FieldweaveError):
    """A model call or a pipeline step that failed."""
