"""Small configuration files, read on the driver."""

from __future__ import annotations

import os
from typing import Any

from ..operators.policy import checked_thresholds


def load(path: str) -> dict[str, Any]:
    """A YAML file of nested mappings and scalars; PyYAML reads it where it is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return _plain(text)
    return yaml.safe_load(text) or {}


def _scalar(s: str) -> Any:
    s = s.strip()
    if s[:1] in "'\"" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "": None}.get(s.lower(), s)


def _plain(text: str) -> dict[str, Any]:
    """Mappings by indentation; comments go."""
    root: dict[str, Any] = {}
    open_: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#") or ":" not in body:
            continue
        depth = len(body) - len(body.lstrip())
        while open_[-1][0] >= depth:
            open_.pop()
        key, _, value = body.strip().partition(":")
        key = _scalar(key)
        if value.strip():
            open_[-1][1][key] = _scalar(value)
        else:
            child: dict[str, Any] = {}
            open_[-1][1][key] = child
            open_.append((depth, child))
    return root


def thresholds(path: str) -> tuple[float, dict[str, float], str]:
    """Default, limits by class and status of a threshold file; checked."""
    got = load(path)
    default = float(got.get("default", 0.5))
    table = {str(k): float(v) for k, v in (got.get("thresholds") or got.get("classes") or {}).items()}
    checked_thresholds(table, default)
    return default, table, str(got.get("status", ""))


def image_dir(path: str, split: str) -> str:
    """The image folder of a split of a data set file; a list file is an error."""
    got = load(path)
    at = got.get(split)
    if not at:
        raise ValueError(f"{path} has no split {split}")
    if str(at).endswith(".txt"):
        raise ValueError(f"{split} is a list file, not a folder: {at}")
    root = got.get("path") or ""
    base = root if os.path.isabs(root) else os.path.normpath(os.path.join(os.path.dirname(path), root))
    return at if os.path.isabs(at) else os.path.join(base, at)


def database_options(env: dict[str, str] | None = None, default: str = "jdbc:sqlite:outputs/inspections.db") -> dict[str, str]:
    """JDBC options; DATABASE_URL overrides the default file, whose folder is made."""
    url = (os.environ if env is None else env).get("DATABASE_URL", default)
    if url.startswith("jdbc:sqlite:") and (folder := os.path.dirname(url.removeprefix("jdbc:sqlite:"))):
        os.makedirs(folder, exist_ok=True)
    return {"url": url}
