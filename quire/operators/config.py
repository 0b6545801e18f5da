"""Settings of the driver: the model's boundary, and a conversion program."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable, Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Where a model is reached; None where nothing is set."""

    model: str | None = None
    base_url: str | None = None
    api_key: str | None = None

    def require_key(self) -> str:
        if not self.api_key:
            raise RuntimeError("no key is set for the model")
        return self.api_key


def read_env_file(text: str) -> dict[str, str]:
    """NAME=value lines; comments, blank lines and lines without a sign are passed over; quotes around a value go."""
    out = {}
    for line in text.splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name.strip() and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def load_config(names: Mapping[str, str], env: Mapping[str, str] | None = None, env_file: str | None = None) -> Config:
    """names: the variable of each field. What is set in the environment wins over the file."""
    found: dict[str, str] = {}
    if env_file and os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as f:
            found = read_env_file(f.read())
    found |= os.environ if env is None else env
    return Config(**{field: found.get(variable) or None for field, variable in names.items()})


def find_program(name: str, configured: str | None = None, defaults: Iterable[str] = ()) -> str | None:
    """A program's path: the configured one (a folder gets the name), then the defaults, then the search path."""
    tried = [os.path.join(configured, name) if os.path.isdir(configured) else configured] if configured else []
    return next((p for p in [*tried, *defaults] if os.path.isfile(p)), None) or shutil.which(name)
