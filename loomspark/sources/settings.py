"""Settings files with variables of the environment (S25), and examples for prompts (S26). Both are small and read by the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

#: Words that mark examples of an older domain, which are passed over.
LEGACY = ("黄帝内经", "五脏", "六腑", "经络", "证型", "酸入肝", "汪五三")


def expand(text: str, env: Mapping[str, str]) -> str:
    """``${NAME:-default}`` and ``${NAME}`` with the values of ``env``; an unknown name without a default becomes empty."""
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), text)


def expand_shell(text: str, env: Mapping[str, str]) -> str:
    """The other dialect: ``$NAME`` and ``${NAME}``; an unknown name stays as it is written."""
    return re.sub(r"\$(?:(\w+)|\{([^}]*)\})", lambda m: env.get(m[1] or m[2], m[0]), text)


def load(text: str, env: Mapping[str, str], dialect=expand) -> dict:
    """Settings from JSON, or from YAML where a reader is installed; empty text gives no settings."""
    text = dialect(text, env)
    try:
        return json.loads(text) if text.strip() else {}
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}


def examples(text: str, default: list[dict]) -> list[dict]:
    """A list, or a map of category to list, flattened with the category; the default if none is left or the first five are of the older domain."""
    data = json.loads(text) if text.strip() else []
    if isinstance(data, dict):
        data = [{"category": k, **x} for k, xs in data.items() if isinstance(xs, list) for x in xs if isinstance(x, dict)]
    first = " ".join(str(x.get("text", "")) for x in data[:5])
    return default if not data or any(w in first for w in LEGACY) else data
