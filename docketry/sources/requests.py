"""Requests and plans as YAML: what a user hands in, and gets back to edit.

Written as JSON, which is YAML as well. Reading takes the YAML library if there is
one, else JSON or the plain subset of it: ``key: value`` lines and lists of values.
"""

from __future__ import annotations

import json


def to_yaml(request: dict) -> str:
    return json.dumps(request, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def _value(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    try:
        return json.loads(text) if text else None
    except ValueError:
        return text


def from_yaml(text: str) -> dict:
    """A request's fields; anything but a mapping is an error."""
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            found = _plain(text)
        else:
            found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("a request is a mapping of fields")
    return found


def _plain(text: str) -> dict:
    out: dict = {}
    key = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        if bare.lstrip().startswith("- ") and key is not None:
            out[key] = [*(out[key] or []), _value(bare.lstrip()[2:])]
        elif ":" in bare and not bare[0].isspace():
            key, _, value = bare.partition(":")
            key = key.strip()
            out[key] = _value(value)
        else:
            raise ValueError(f"cannot read the line: {line}")
    return out
