"""Settings of a library as a JSON file: known names only, paths with "~" and variables expanded."""

from __future__ import annotations

import json
import os

# Names and defaults.
DEFAULTS: dict[str, str | None] = {"library": "~/library", "papers_dir": "~/papers", "bib_file": None, "vault_dir": None, "provider": None, "mailto": None}


class UnknownSetting(KeyError):
    code = "unknown_setting"


def expanded(value: str | None) -> str | None:
    return None if value is None else os.path.expanduser(os.path.expandvars(value))


def load(path: str) -> dict[str, str | None]:
    """The settings of a file over the defaults; a missing file has none, other names are refused."""
    told = {}
    if os.path.exists(path):
        with open(path) as f:
            told = json.load(f)
    if unknown := set(told) - set(DEFAULTS):
        raise UnknownSetting(min(unknown))
    return {name: expanded(value) for name, value in {**DEFAULTS, **told}.items()}


def save(path: str, **settings: str | None) -> None:
    """Write settings beside those that the file has; the file is replaced at once."""
    if unknown := set(settings) - set(DEFAULTS):
        raise UnknownSetting(min(unknown))
    told = {}
    if os.path.exists(path):
        with open(path) as f:
            told = json.load(f)
    fresh = f"{path}.new"
    with open(fresh, "w") as f:
        json.dump(told | settings, f, indent=1, sort_keys=True)
    os.replace(fresh, path)
