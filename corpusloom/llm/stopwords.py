"""Frequent words from the stop-word lists that come with Spark."""

from __future__ import annotations

import re
from functools import cache

LANGUAGES = ("english", "german", "french", "spanish")


@cache
def stop_words(languages: tuple[str, ...] = LANGUAGES) -> frozenset[str]:
    """The words of all lists, lower-cased, contractions split at their apostrophes, without single letters, which noise is full of. Needs a running session; called on the driver."""
    from pyspark.ml.feature import StopWordsRemover

    lists = [StopWordsRemover.loadDefaultStopWords(x) for x in languages]
    return frozenset(p for words in lists for w in words for p in re.findall(r"[^\W_]{2,}", w.lower()))
