"""The stopword list is a parameter of the analysis.

A list is a text file of upper-case words separated by white space; lines that
begin with ``#`` are remarks.  Without a path the list beside this module is used.
Words are compared after upper-casing and before stemming.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

DEFAULT_LIST = Path(__file__).with_name("stopwords.txt")


@lru_cache(maxsize=8)
def load_stopwords(path: str | None = None) -> tuple[str, ...]:
    """Words of the list at ``path`` in file order."""
    source = Path(path) if path else DEFAULT_LIST
    if not source.is_file():
        raise FileNotFoundError(
            f"no stopword list at {source}; pass stopwords=[...] or a list file"
        )
    lines = source.read_text(encoding="utf-8").splitlines()
    return tuple(word for line in lines if not line.startswith("#") for word in line.split())
