"""Options of clone detection."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

#: Names of the options in JSON. Clients send these.
_JSON = {
    "language": "language",
    "fragment_query": "fragment_query",
    "clone_token_threshold": "clone_token_threshold",
    "indexGitFilesOnly": "index_git_files_only",
    "ignore_nodes": "ignore_nodes",
    "extra_nodes": "extra_nodes",
    "blind_nodes": "blind_nodes",
    "dynamic_detection": "dynamic_detection",
    "update_on_save": "update_on_save",
    "incrementalParsing": "incremental_parsing",
}


@dataclass(frozen=True)
class CloneConfig:
    """language: file extension and lexer; fragment_query: node types that are fragments, as `(type) @name`
    patterns; clone_token_threshold: fewest tokens of a match; ignore_nodes: token types to drop; extra_nodes:
    inner nodes that also count as a token; blind_nodes: types whose tokens all look alike; dynamic_detection:
    refresh instead of rebuild; update_on_save: detect on save rather than on each change."""

    language: str = "java"
    fragment_query: str = "(method_declaration) @method (constructor_declaration) @constructor"
    clone_token_threshold: int = 100
    index_git_files_only: bool = True
    ignore_nodes: tuple[str, ...] = field(default=())
    extra_nodes: tuple[str, ...] = field(default=())
    blind_nodes: tuple[str, ...] = field(default=())
    dynamic_detection: bool = True
    update_on_save: bool = True
    incremental_parsing: bool = False

    def __post_init__(self) -> None:
        if self.clone_token_threshold < 1:
            raise ValueError("clone_token_threshold is at least 1")

    @property
    def fragment_types(self) -> tuple[str, ...]:
        """Node types in the order of the query's patterns."""
        return tuple(dict.fromkeys(re.findall(r"\(\s*(\w+)\s*\)\s*@\w+", self.fragment_query)))

    @classmethod
    def from_json(cls, text: str) -> CloneConfig:
        """Unknown names are left out, null keeps the default."""
        names = {f.name for f in fields(cls)}
        given = {}
        for key, value in (json.loads(text) or {}).items():
            name = _JSON.get(key, key)
            if name in names and value is not None:
                given[name] = tuple(value) if isinstance(value, list) else value
        return cls(**given)

    def to_json(self) -> str:
        back = {v: k for k, v in _JSON.items()}
        return json.dumps({back[f.name]: list(v) if isinstance(v := getattr(self, f.name), tuple) else v for f in fields(self)})
