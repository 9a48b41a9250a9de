"""Errors that carry a namespaced code."""

from __future__ import annotations


class EngineError(ValueError):
    """code: namespace and name, such as vector:invalid_filter_expr; kind: expected, unexpected or invariant."""

    def __init__(self, code: str, message: str, kind: str = "expected", **metadata: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.kind, self.metadata = code, message, kind, metadata

    def as_dict(self) -> dict:
        return {"kind": self.kind, "code": self.code, "message": self.message, "metadata": dict(self.metadata)}
