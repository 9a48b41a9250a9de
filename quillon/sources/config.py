"""Configuration: defaults, then file, then overrides, then environment; requests and their checks."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Mapping
from pathlib import Path

from quillon.errors import EngineError

DEFAULTS: dict[str, dict] = {
    "splitter": {"lines": 200, "overlap": 40, "maxChunkBytes": 2500},
    "scan": {"maxFileSizeBytes": 1_048_576, "extensions": [], "ignore": []},
    "search": {"topK": 5, "threshold": 0.0},
    "vectorDb": {"indexMode": "dense", "strategy": "exact"},
    "embedding": {"provider": "test", "dimension": 64},
}
PREFIX = "QUILLON_"


def _merged(a: dict, b: Mapping, where: str) -> dict:
    out = dict(a)
    for k, v in b.items():
        if k not in a:
            raise EngineError("config:unknown_key", f"{where}{k}")
        out[k] = _merged(a[k], v, f"{where}{k}.") if isinstance(a[k], dict) else v
    return out


def load(path: str | None = None, overrides: str | None = None, env: Mapping[str, str] | None = None) -> dict:
    """Unknown keys are refused. Environment: QUILLON_SECTION__KEY, as JSON or plain text."""
    out = DEFAULTS
    if path:
        text = Path(path).read_text()
        out = _merged(out, tomllib.loads(text) if path.endswith(".toml") else json.loads(text), "")
    if overrides:
        out = _merged(out, json.loads(overrides), "")
    for name, value in (os.environ if env is None else env).items():
        if name.startswith(PREFIX) and "__" in name:
            section, key = name[len(PREFIX) :].split("__", 1)
            known = {s.lower(): s for s in out}
            s = known.get(section.lower())
            keys = {k.lower(): k for k in out.get(s, {})} if s else {}
            if key.replace("_", "").lower() not in keys:
                raise EngineError("config:unknown_key", name)
            try:
                value = json.loads(value)
            except ValueError:
                pass
            out = _merged(out, {s: {keys[key.replace("_", "").lower()]: value}}, "")
    return out


def search_request(query: str, top_k: int | None = None, threshold: float | None = None, root: str = ".", **more) -> dict:
    """A checked search request with defaults."""
    if more:
        raise EngineError("request:unknown_key", ", ".join(sorted(more)))
    if not query.strip() or "\0" in query:
        raise EngineError("request:invalid_query", "empty, or with a NUL")
    k, t = DEFAULTS["search"]["topK"] if top_k is None else top_k, DEFAULTS["search"]["threshold"] if threshold is None else threshold
    if not 1 <= k <= 50:
        raise EngineError("request:invalid_top_k", str(k))
    if not 0 <= t <= 1:
        raise EngineError("request:invalid_threshold", str(t))
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", root):
        raise EngineError("request:invalid_root", root)
    return {"query": query, "topK": k, "threshold": t, "root": root}
