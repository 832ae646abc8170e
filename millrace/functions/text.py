"""Text stages as functions from columns to columns; all but stemming stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .stemmer import stem

JOINT = "~SP~"
DELIMITER = r"\s|(~SP~)"
_META = set(".^$*+?()[]{}|\\")


def delimiter(pattern: str | None) -> str:
    """What separates tokens: a tokenizer's pattern (white space by default) or the mark that earlier stages put between tokens."""
    return rf"{pattern or chr(92) + 's'}|({JOINT})"


def pieces(text: Column, pattern: str = DELIMITER) -> Column:
    """The parts between matches of a pattern, without empty parts at the end."""
    parts = F.split(text, pattern)
    return F.slice(parts, 1, F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0))))


def lower_case(text: Column) -> Column:
    return F.lower(text)


def mark_sentence(text: Column) -> Column:
    return F.concat(F.lit("_class_ss "), text, F.lit(" _class_se"))


def replace_patterns(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Rules (pattern, replacement) in order; $1 in a replacement is the first group."""
    for pattern, label in rules:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(label))
    return text


def remove_patterns(text: Column, patterns: Iterable[str]) -> Column:
    return replace_patterns(text, [(p, "") for p in patterns])


def quoted(word: str) -> str:
    return "".join("\\" + c if c in _META else c for c in word)


def plan_word_classes(classes: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """Rules (pattern, class) in an order in which no word hides a longer one that contains it.

    Words of a class share a rule as long as no longer word of another class that contains one of them is still to
    come; then that class goes first. A word of two classes belongs to the last."""
    class_of = {word: name for name, words in classes.items() for word in words}
    left = sorted(class_of, key=len, reverse=True)
    lines: list[tuple[str, list[str]]] = []
    now = class_of[left[0]] if left else None
    while left:
        own = [w for w in left if class_of[w] == now]
        word = own[0] if own else left[0]
        while holder := next((w for w in left[: left.index(word)] if word in w), None):
            word = next(w for w in left if class_of[w] == class_of[holder])
        now = class_of[word]
        if not lines or lines[-1][0] != now:
            lines.append((now, []))
        lines[-1][1].append(word)
        left.remove(word)
    return [(rf"(?i)\b(?:{'|'.join(map(quoted, words))})'?s?\b", name) for name, words in lines]


def replace_word_classes(text: Column, classes: Mapping[str, Sequence[str]]) -> Column:
    return replace_patterns(text, [(p, name.replace("\\", r"\\").replace("$", r"\$")) for p, name in plan_word_classes(classes)])


def substitute_words(text: Column, words: Mapping[str, str], pattern: str = DELIMITER) -> Column:
    """Tokens found in the dictionary become its words; tokens are joined by the mark."""
    if not words:
        return F.array_join(pieces(text, pattern), JOINT)
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    found = F.transform(pieces(text, pattern), lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.array_join(F.flatten(F.transform(found, lambda w: pieces(w, pattern))), JOINT)


def remove_stop_words(text: Column, words: Sequence[str], pattern: str = DELIMITER, case_sensitive: bool = False) -> Column:
    stop = F.array(*[F.lit(w if case_sensitive else w.lower()) for w in dict.fromkeys(words)]) if words else F.expr("cast(array() as array<string>)")
    return F.array_join(F.filter(pieces(text, pattern), lambda w: ~F.array_contains(stop, w if case_sensitive else F.lower(w))), JOINT)


def stem_words(text: Column, exceptions: Iterable[str] = (), pattern: str = DELIMITER) -> Column:
    """Every token but exceptions and class marks by its stem; each distinct token of a batch is stemmed once."""
    spared = frozenset(exceptions)

    @F.pandas_udf("string")
    def stems(tokens: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in known:
                known[w] = w if w in spared or "_class_" in w else stem(w)
            return known[w]

        return tokens.map(lambda t: None if t is None else JOINT.join(map(one, t)))

    return stems(pieces(text, pattern))


def tokenize(text: Column, pattern: str = r"\s") -> Column:
    """The tokens between matches of a pattern; empty ones are dropped."""
    return F.filter(F.split(text, delimiter(pattern)), lambda w: F.length(w) >= 1)


def fill_null(value: Column, default: object, kind: DataType | str) -> Column:
    return F.coalesce(value, F.lit(default).cast(kind))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by blanks."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))


def skip_grams(tokens: Column, window: int = 5) -> Column:
    """For every width from 3 to `window` and every place, the first and last token of that many, if they differ."""
    if window < 3:
        raise ValueError("the window is 3 at least; use 2-grams below that")
    none = F.expr("cast(array() as array<string>)")

    def of_width(k: int) -> Column:
        def ends(i: Column) -> Column:
            first, last = F.get(tokens, i), F.get(tokens, i + (k - 1))
            return F.when(first != last, F.concat(first, F.lit(" & "), last))

        return F.when(F.size(tokens) >= k, F.transform(F.sequence(F.lit(0), F.size(tokens) - k), ends)).otherwise(none)

    every = [of_width(k) for k in range(3, window + 1)]
    return F.filter(F.concat(*every), lambda x: x.isNotNull())


def assemble_grams(*lists: Column) -> Column:
    return F.concat(*lists)


def categorical_array(columns: Sequence[str]) -> Column:
    """One token `column_value` for each column, in order; a null value gives a null token."""
    return F.array(*[F.concat(F.lit(c + "_"), F.col(c).cast("string")) for c in columns])
