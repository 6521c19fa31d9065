"""Token counts of fields or sections by character offsets.

A document is encoded once as a whole, since encoding its sections one by one
gives other tokens at their edges. Every token has a span of characters;
every section is an interval of characters, and together they cover the
document. The interval join finds the first and the last section a token
touches by binary search. A token inside one section counts there. A token
that crosses boundaries is allocated by an explicit rule:

    largest   the section with most of its characters, the earlier if equal
    first     the section of its first character
    last      the section of its last character

``n_shared`` holds the count by characters instead (a crossing token gives
each section its share), so both add up to the tokens of the document.

Sections of a text are its lines; a line feed belongs to the line it ends.
Sections of a record are its fields, joined by line feeds, each with the line
feed after it.

Edge cases: a null or empty text has one empty section without tokens; a null
field is empty; rows repeating a doc_id are counted one by one; a null doc_id
is returned as it is; an empty table gives an empty result; further columns of
the input do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import arrow_map, read, small_batches, texts_of
from panelwright.llm.registry import query
from panelwright.llm.tokens import encoder

RULES = ("largest", "first", "last")
SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, n_shared double"


def line_starts(text: str) -> np.ndarray:
    """First characters of the lines of a text."""
    out, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(out, np.int64)


def allocate(spans: np.ndarray, starts: np.ndarray, end: int, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, crossing tokens and shares per section; spans: rows of (start, end)."""
    n = len(starts)
    s, e = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    low = np.searchsorted(starts, s, "right") - 1
    high = np.searchsorted(starts, e - 1, "right") - 1
    owner = high if rule == "last" else low
    crossing, shared = np.zeros(n, np.int64), np.bincount(low[low == high], minlength=n).astype(float)
    owner = owner.copy()
    edges = np.append(starts, max(end, 1))
    for t in np.flatnonzero(low != high):
        at = np.arange(low[t], high[t] + 1)
        part = np.minimum(edges[at + 1], e[t]) - np.maximum(edges[at], s[t])
        crossing[at] += 1
        shared[at] += part / (e[t] - s[t])
        if rule == "largest":
            owner[t] = at[np.argmax(part)]
    return np.bincount(owner, minlength=n), crossing, shared


def _count(batch_docs, texts, starts_of, rule, path):
    coder = encoder(path, offsets=True)
    columns = [[] for _ in range(7)]
    for doc, text, starts, tokens in zip(batch_docs, texts, starts_of, coder.encode(texts)):
        counts, crossing, shared = allocate(tokens[:, 1:], starts, len(text), rule)
        n = len(starts)
        for c, x in zip(columns, ([doc] * n, range(n), starts.tolist(), [*starts[1:].tolist(), len(text)], counts.tolist(), crossing.tolist(), shared.tolist())):
            c.extend(x)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "n_shared"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def count_lines(docs: DataFrame, rule: str = "largest", path: str | None = None) -> DataFrame:
    """One row per line of each text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batch):
        texts = texts_of(batch.column(1))
        yield _count(batch.column(0).to_pylist(), texts, map(line_starts, texts), rule, path)

    small_batches(docs.sparkSession)
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def count_fields(rows: DataFrame, id_column: str, fields: list[str], rule: str = "largest", path: str | None = None) -> DataFrame:
    """One row per field of each record; ``section`` is the field's place in ``fields``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batch):
        values = list(zip(*[texts_of(batch.column(i + 1)) for i in range(len(fields))]))
        starts = [np.cumsum([0, *(len(x) + 1 for x in v[:-1])]) for v in values]
        yield _count(batch.column(0).to_pylist(), ["\n".join(v) for v in values], starts, rule, path)

    small_batches(rows.sparkSession)
    picked = rows.select(F.col(id_column).cast("long").alias("_id"), *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(fields)])
    return arrow_map(picked, run, SCHEMA)


@query("op1_section_tokens")
def op1_section_tokens(spark, sf_dir):
    return count_lines(read(spark, sf_dir, "documents"))
