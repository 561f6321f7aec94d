"""Lexicons and rule tables, as data."""

import json
from functools import lru_cache
from pathlib import Path


@lru_cache
def load(name: str):
    """The content of a JSON file of this folder."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text(encoding="utf-8"))
