"""Options of the pipelines, with their defaults; read from a JSON file by dotted or nested names."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Options:
    id_offset: int = 11_834
    cluster_eps: float = 0.5
    cluster_least: int = 7
    cluster_most: int = 10_000
    parent_threshold: float = 0.86
    parents_least: int = 1
    parents_most: int = 5
    greedy_threshold: float = 0.6
    retrieval_rows: int = 80
    split_train: float = 0.8
    split_valid: float = 0.1
    seed: int = 42


def lookup(tree: dict, name: str, default: Any = None) -> Any:
    """The value at a dotted name of nested objects; default where a part is missing."""
    for part in name.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return default
        tree = tree[part]
    return tree


def load(path: str | None) -> Options:
    """Options with what a JSON file overrides; names that aren't options are an error."""
    if not path:
        return Options()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    known = {x.name for x in fields(Options)}
    if unknown := given.keys() - known:
        raise ValueError(f"no such options: {', '.join(sorted(unknown))}")
    return replace(Options(), **given)
