"""Settings of an indexing job: defaults, then a file, then given sections, then single parameters; and the chunkers by name."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from quillon.functions import legal

#: Settings that hold where nothing else is given.
DEFAULTS = {
    "chunking": {"strategy": "hierarchical"},
    "embedding": {"max_length": 256, "batch_size": 32, "pooling": "auto", "normalize": False},
    "vector_store": {"collection_name": "legal_documents", "distance_metric": "cosine"},
}


def read_config(path: str) -> dict:
    """A JSON file, or a YAML file where a YAML reader is installed; an empty file has no settings."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text) if text.strip() else {}
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("YAML settings need a YAML reader; JSON settings do not") from missing
    return yaml.safe_load(text) or {}


def merge_config(path: str | None = None, config: dict | None = None, **parameters: dict) -> dict[str, dict]:
    """Sections of settings.  A section given in ``config`` replaces the file's; nulls in either do not count; ``parameters`` hold before all."""
    outer = {**(read_config(path) if path else {}), **(config or {})}
    return {name: {**base, **{k: v for k, v in (outer.get(name) or {}).items() if v is not None}, **(parameters.get(name) or {})} for name, base in DEFAULTS.items()}


def fixed_size(chunk_size: int = 1200, overlap: int = 200) -> Callable[[str, str], list[tuple]]:
    """Chunks of one size: ``(document, text)`` to ``(seq, id, text)``."""
    if chunk_size <= 0 or not 0 <= overlap < chunk_size:
        raise ValueError("chunk_size must be positive and overlap at least 0 and less than it")
    return lambda document, text: [(i, f"{document}.chunk_{i}", piece) for i, piece in enumerate(legal.fixed_chunks(text, chunk_size, overlap))]


def hierarchical() -> Callable[[str, str], list[tuple]]:
    """Sections of a document, as rows of :func:`quillon.functions.legal.flat_chunks`."""
    return legal.flat_chunks


CHUNKERS = {"fixed_size": fixed_size, "hierarchical": hierarchical}


def create_chunker(strategy: str, **parameters) -> Callable[[str, str], list[tuple]]:
    """The chunker of a name, in any case; unknown names are an error."""
    made = CHUNKERS.get(strategy.strip().lower())
    if made is None:
        raise ValueError(f"unknown chunking strategy; there are {', '.join(sorted(CHUNKERS))}")
    return made(**parameters)
