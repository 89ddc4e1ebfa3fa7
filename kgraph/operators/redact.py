"""Secrets replaced by their kind.  Matches of all rules are found first; of those that overlap, the one that
starts first stays, and of those the longest: replacing rule by rule would not give that."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import CONTEXT_LINES, MAX_REDACT, MIN_ENTROPY, SECRET_PATTERNS, SECRET_TOKEN, SECRET_WORDS


def entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def redact(text: str, extra: list[tuple[str, str, int]] = (), context: int = CONTEXT_LINES) -> tuple[str, list[tuple[str, int, int]]]:
    """The text without secrets, and (kind, line, original length) of each.  Texts beyond MAX_REDACT fail closed."""
    if len(text) > MAX_REDACT:
        return "[REDACTED:oversize]", [("oversize", 1, len(text))]
    spans = []
    for name, pattern, least in [*SECRET_PATTERNS, *extra]:
        spans += [(m.start(), m.end(), name) for m in re.finditer(pattern, text) if m.end() - m.start() >= max(1, least)]
    words = {k for k, line in enumerate(text.split("\n")) if re.search(SECRET_WORDS, line)}
    if words:
        for m in re.finditer(SECRET_TOKEN, text):
            line = text.count("\n", 0, m.start())
            if any(k in words for k in range(line - context, line + context + 1)) and entropy(m[0]) >= MIN_ENTROPY:
                spans.append((m.start(), m.end(), "high_entropy"))
    out, found, at = [], [], 0
    for start, end, name in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        if start < at:
            continue
        out += [text[at:start], f"[REDACTED:{name}]"]
        found.append((name, text.count("\n", 0, start) + 1, end - start))
        at = end
    return "".join([*out, text[at:]]), found


def redact_files(files: DataFrame) -> DataFrame:
    """files: project, file, content.  Returns project, file, redacted, n, kinds (sorted, distinct, comma-separated)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [redact(c) if isinstance(c, str) else ("", []) for c in batch["content"]]
            yield pd.DataFrame(
                {
                    "project": batch["project"],
                    "file": batch["file"],
                    "redacted": [t for t, _ in done],
                    "n": [len(f) for _, f in done],
                    "kinds": [",".join(sorted({k for k, _, _ in f})) for _, f in done],
                }
            )

    return files.select("project", "file", "content").mapInPandas(work, "project string, file string, redacted string, n long, kinds string")
