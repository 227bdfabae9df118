"""Word lists: files and tables."""

from .files import adjacency_file, exclusion_file, include_file
from .lexicon import lexicon, user_words

__all__ = ["adjacency_file", "exclusion_file", "include_file", "lexicon", "user_words"]
