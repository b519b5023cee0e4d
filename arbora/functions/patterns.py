"""Name patterns."""

from __future__ import annotations

_META = set(".^$|()[]{}+\\")


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: * any run, ? one character, all else literal."""
    body = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in _META else c for c in pattern)
    return f"^(?s:{body})$"
