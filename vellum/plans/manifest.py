"""What a stored index was built with, and whether that still fits."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field

from vellum.sources.store import write_json_atomically

#: Settings that decide what an index holds; batch sizes and time limits don't.
SETTINGS = ("allow_cross_page_chunks", "chunk_max", "chunk_min", "chunk_overlap", "chunk_target", "embedding_model", "ocr_language", "searchable_chunk_types", "tokenizer_encoding", "use_ocr")


def canonical_json(value) -> str:
    """[TXT28] JSON with sorted keys, no spaces and no escapes of letters."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value) -> str:
    """[TXT28] SHA-256 of the canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@dataclass(frozen=True)
class Manifest:
    """[IDX6] Versions and settings of an index."""

    manifest_format_version: int
    record_schema_version: int
    semantic_table_name: str
    parser_version: str
    chunker_version: str
    settings: dict = field(default_factory=dict)

    def core(self) -> dict:
        return {k: getattr(self, k) for k in ("manifest_format_version", "record_schema_version", "semantic_table_name", "parser_version", "chunker_version", "settings")}

    def to_dict(self) -> dict:
        return {**self.core(), "fingerprint": fingerprint(self.core())}


def load_manifest(path: str) -> Manifest | None:
    """[SRC15] The manifest in ``path``; None where there is none. A wrong type, a missing field or a fingerprint that doesn't fit is a ValueError."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        try:
            raw = json.load(f)
        except json.JSONDecodeError as e:
            raise ValueError(f"{path} is no JSON: {e}") from e
    kinds = {"manifest_format_version": int, "record_schema_version": int, "semantic_table_name": str, "parser_version": str, "chunker_version": str, "settings": dict, "fingerprint": str}
    if not isinstance(raw, dict):
        raise ValueError(f"{path} holds no object")
    for k, kind in kinds.items():
        if not isinstance(raw.get(k), kind) or isinstance(raw.get(k), bool):
            raise ValueError(f"{path}: {k} is missing or no {kind.__name__}")
    m = Manifest(**{k: raw[k] for k in kinds if k != "fingerprint"})
    if fingerprint(m.core()) != raw["fingerprint"]:
        raise ValueError(f"{path}: the fingerprint doesn't fit")
    return m


def write_manifest(m: Manifest, path: str) -> None:
    """[SRC16] Write a manifest, replaced at once."""
    write_json_atomically(m.to_dict(), path)


def differences(stored: Manifest, current: Manifest) -> dict[str, tuple]:
    """[JON8] Settings and versions that differ, as (stored, current); what one side lacks is None."""
    a, b = ({**{k: v for k, v in m.core().items() if k != "settings"}, **{f"settings.{k}": v for k, v in m.settings.items()}} for m in (stored, current))
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k) or (k in a) != (k in b)}


def ensure_compatible(path: str, current: Manifest, *, adopt_missing: bool = False, dry_run: bool = False) -> Manifest:
    """[IDX7] The stored manifest if it fits; one that is missing is taken on if allowed, and written unless ``dry_run``. Else a RuntimeError that lists what differs."""
    stored = load_manifest(path)
    if stored is None:
        if not adopt_missing:
            raise RuntimeError(f"no manifest at {path}: rebuild the index, or adopt it as it is")
        if not dry_run:
            write_manifest(current, path)
        return current
    wrong = differences(stored, current)
    if wrong:
        raise RuntimeError("the index was built otherwise: " + "; ".join(f"{k} was {a!r}, is {b!r}" for k, (a, b) in wrong.items()))
    return stored
