"""Run parameters and the engine's fixed tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

BOUNDARIES = ("none", "left", "right", "both")


@dataclass(frozen=True)
class Config:
    #: Source words: so many of the most frequent ones, or all validation words.
    top_n: int | None = None
    min_word_length: int = 3
    max_word_length: int = 10
    min_typo_length: int = 3
    freq_ratio: float = 10.0
    typo_freq_threshold: float = 0.0
    #: Tokens as common as this are words of the validation dictionary.
    validation_count: int = 5
    #: Tokens of the include text as common as this are user words.
    user_count: int = 4
    max_entries_per_file: int = 500
    max_iterations: int = 20
    platform: str = "espanso"
    max_corrections: int | None = None
    #: Words and typo patterns that are traced.
    debug_words: tuple[str, ...] = ()
    debug_typos: tuple[str, ...] = ()
    #: Longest n-gram of the table idx_substrings and of the oracles. Lookups have no such end: they go as far as the longest typo.
    max_ngram: int = 12

    def __post_init__(self):
        if self.max_word_length < self.min_word_length:
            raise ValueError("max_word_length must not be under min_word_length")
        if platform(self.platform).needs_limit and not self.max_corrections:
            raise ValueError(f"{self.platform} needs max_corrections")
        for name in ("debug_words", "debug_typos"):
            object.__setattr__(self, name, tuple(getattr(self, name)))

    @classmethod
    def load(cls, path: str | None = None, **given) -> Config:
        """Values given win over the JSON file's, those over the defaults."""
        known = {f.name for f in fields(cls)}
        base = {}
        if path:
            with open(path, encoding="utf-8") as f:
                base = json.load(f)
        if unknown := (base.keys() | given.keys()) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**base | {k: v for k, v in given.items() if v is not None})


# Neighbours of each key.
ADJACENT = {
    "a": "qwsz", "b": "vghn", "c": "xdfv", "d": "serfcx", "e": "wsdr", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "i": "ujko",
    "j": "huikmn", "k": "jiolm", "l": "kop", "m": "njk", "n": "bhjm", "o": "iklp", "p": "ol", "q": "wa", "r": "edft", "s": "awedxz",
    "t": "rfgy", "u": "yhji", "v": "cfgb", "w": "qase", "x": "zsdc", "y": "tghu", "z": "asx",
}
# Exclusion rules of the example run; words, and typo -> word with ":" for required boundaries.
WORD_RULES = ("th*nd", "*whwh", "was", "q*q")
TYPO_RULES = ("*thh -> *", ":an* -> *", "*ing: -> *ing", ":ht*: -> th*", "e*e -> th*", "hte -> the")
# Patterns traced in debug output.
DEBUG_TYPOS = ("hte", "*nig", ":an*", "*er:", ":t*e:")


@dataclass(frozen=True)
class Constraints:
    max_corrections: int | None = None
    max_typo_length: int | None = None
    max_word_length: int | None = None
    allowed: str | None = None
    supports_boundaries: bool = True
    direction: str = "ltr"
    needs_limit: bool = False


PLATFORMS: dict[str, Constraints] = {
    "espanso": Constraints(),
    "qmk": Constraints(6000, 62, 62, "^[a-z']*$", True, "rtl", True),
}


def register_platform(name: str, constraints: Constraints) -> None:
    """Extension point: constraints of another output platform."""
    PLATFORMS[name] = constraints


def platform(name: str) -> Constraints:
    if name not in PLATFORMS:
        raise ValueError(f"unknown platform {name!r}; known: {', '.join(sorted(PLATFORMS))}")
    return PLATFORMS[name]


#: Settings of the registered queries and their SQL: tables small enough that every stage can be compared.
QUERY_CONFIG = Config(top_n=300, typo_freq_threshold=3, max_entries_per_file=50, platform="qmk", max_corrections=500, debug_words=("the", "for", "was"), debug_typos=DEBUG_TYPOS)
