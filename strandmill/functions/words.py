"""Word counting rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_words(line: Column | str, rule: str = "space") -> Column:
    """Number of words in a line.

    ``space`` separates on U+0020 alone; ``whitespace`` also on tabs and the other
    ASCII white space, as ``wc -w`` does.
    """
    separators = {"space": " ", "whitespace": r"\s+"}
    if rule not in separators:
        raise ValueError(f"unknown word rule {rule!r}")
    return F.array_size(F.array_remove(F.split(line, separators[rule]), ""))
