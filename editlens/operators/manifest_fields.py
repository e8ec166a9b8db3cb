"""Field sets and duplicate keys at every level of a raw manifest, each violation with its path.

A schema read and VARIANT keep one of two equal keys, so the text itself is read: every object comes back as the list
of its pairs, in order, and a walk with the path from the top compares names with the contract of the level.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields of each level of a manifest.
MANIFEST = ("category", "shard", "audio_assets", "cases")
CASE = ("id", "language", "source_audio", "instruction_xml", "annotations")
AUDIO = ("asset_id", "path", "sha256")
ALIGNMENT = ("audio_sha256", "text_sha256", "segments")
SEGMENT = ("word", "start", "end")
# Annotations besides the alignment, by category: whether they must be there.
ANNOTATIONS = {"prosody": ("span_granularity", True), "emotion": ("source_emotion", False)}

VIOLATION = "check string, key string, path string, detail string"


class Pairs(list):
    """The pairs of an object in order, equal keys included."""

    def get(self, name: str) -> Any:
        """The last value of a key, as a reader that keeps one would take it."""
        return next((v for k, v in reversed(self) if k == name), None)


def _step(path: str, name: str) -> str:
    return f"{path}.{name}" if name.isidentifier() else f"{path}[{json.dumps(name)}]"


def duplicates(value: Any, path: str = "$") -> Iterator[str]:
    """Paths of keys that stand more than once in one object, at any depth."""
    stack = [(value, path)]
    while stack:
        node, at = stack.pop()
        if isinstance(node, Pairs):
            yield from (_step(at, k) for k, n in Counter(k for k, _ in node).items() if n > 1)
            stack += [(v, _step(at, k)) for k, v in node]
        elif isinstance(node, list):
            stack += [(v, f"{at}[{i}]") for i, v in enumerate(node)]


def _fields(value: Any, path: str, needed: tuple[str, ...], allowed: tuple[str, ...] = ()) -> Iterator[tuple[str, str]]:
    if not isinstance(value, Pairs):
        yield path, "no object"
        return
    names = {k for k, _ in value}
    yield from ((_step(path, n), "missing field") for n in needed if n not in names)
    yield from ((_step(path, n), "unknown field") for n in sorted(names.difference(needed, allowed)))


def _list(value: Any, path: str) -> Iterator[tuple[str, Any]]:
    """Members of a list with their paths; nothing for another value, which is reported by its level."""
    if isinstance(value, list) and not isinstance(value, Pairs):
        yield from ((f"{path}[{i}]", v) for i, v in enumerate(value))


def wrong_fields(manifest: Any) -> Iterator[tuple[str, str]]:
    """Path and reason of each missing or unknown field of the levels above."""
    yield from _fields(manifest, "$", MANIFEST)
    if not isinstance(manifest, Pairs):
        return
    name, must = ANNOTATIONS.get(manifest.get("category"), ("", False))
    extra = (name,) if name else ()
    if not isinstance(manifest.get("audio_assets"), Pairs):
        yield "$.audio_assets", "no object"
    if isinstance(manifest.get("cases"), Pairs) or not isinstance(manifest.get("cases"), list):
        yield "$.cases", "no list"
    for at, case in _list(manifest.get("cases"), "$.cases"):
        yield from _fields(case, at, CASE)
        if not isinstance(case, Pairs):
            continue
        notes = case.get("annotations")
        yield from _fields(case.get("source_audio"), f"{at}.source_audio", AUDIO)
        yield from _fields(notes, f"{at}.annotations", ("source_alignment", *(extra if must else ())), extra)
        alignment = notes.get("source_alignment") if isinstance(notes, Pairs) else None
        yield from _fields(alignment, f"{at}.annotations.source_alignment", ALIGNMENT)
        segments = alignment.get("segments") if isinstance(alignment, Pairs) else None
        for place, segment in _list(segments, f"{at}.annotations.source_alignment.segments"):
            yield from _fields(segment, place, SEGMENT)


def check_manifests(raw: DataFrame) -> DataFrame:
    """Violations ``(check, key, path, detail)`` of raw manifests ``(key, json)``, all found in one reading.

    C01 is a missing or unknown field (or a level that is no object or list), C02 a key that stands twice in one object,
    written with escapes or not. A text that is no JSON, and a null, is one violation of C01 at the top.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            for key, text in zip(batch["key"], batch["json"], strict=True):
                try:
                    value = json.loads(text, object_pairs_hook=Pairs) if isinstance(text, str) else None
                except (ValueError, RecursionError):
                    found.append(("C01", key, "$", "no JSON"))
                    continue
                found += [("C01", key, path, detail) for path, detail in wrong_fields(value)]
                found += [("C02", key, path, "duplicate key") for path in duplicates(value)]
            yield pd.DataFrame(found, columns=["check", "key", "path", "detail"])

    return raw.select(F.col("key").cast("string").alias("key"), "json").mapInPandas(check, VIOLATION)
