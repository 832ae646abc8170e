"""Loaders of word lists, rules and classes; all are small files that the driver reads."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.ml.feature import StopWordsRemover

LANGUAGES = ("danish", "dutch", "english", "finnish", "french", "german", "hungarian", "italian", "norwegian", "portuguese", "russian", "spanish", "swedish", "turkish")


def word_list(source: str | Iterable[str]) -> list[str]:
    """A file of one word a line, or the words themselves."""
    lines = Path(source).read_text(encoding="utf-8").splitlines() if isinstance(source, str) else source
    return [x.strip() for x in lines if x.strip()]


def pairs(source: str | dict[str, str], separator: str = ",") -> dict[str, str]:
    """A file of `from,to` lines, or the dictionary itself."""
    if isinstance(source, dict):
        return dict(source)
    rows = (x.split(separator, 1) for x in word_list(source))
    return {a.strip(): b.strip() for a, b in (r for r in rows if len(r) == 2)}


def rules(source: str | dict[str, str] | list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A file of lines `pattern<tab>label`, a dictionary from labels to patterns, or the rules (pattern, label)."""
    if isinstance(source, dict):
        return [(p, label) for label, p in source.items()]
    if isinstance(source, str):
        return [(a, b.strip()) for a, _, b in (x.partition("\t") for x in Path(source).read_text(encoding="utf-8").splitlines() if x.strip())]
    return [tuple(x) for x in source]


def word_classes(source: str | dict[str, list[str]]) -> dict[str, list[str]]:
    return json.loads(Path(source).read_text(encoding="utf-8")) if isinstance(source, str) else dict(source)


def stop_words(language: str) -> list[str]:
    if language not in LANGUAGES:
        raise ValueError(f"no stop words for {language}; known: {', '.join(LANGUAGES)}")
    return list(StopWordsRemover.loadDefaultStopWords(language))
