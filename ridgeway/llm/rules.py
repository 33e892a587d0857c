r"""Quality rules as a bitmask ledger.

``ledger`` measures every text once and evaluates every rule of ``RULES`` once: bit k of ``failed`` is set
where rule k rejects.  A policy is a versioned set of bits, so deciding under another policy, or asking what
a rule adds (``ablations``), is a bitwise operation on the ledger and never touches the texts again.

Definitions.  Words are maximal runs outside ASCII white space; a null or empty text has none and fails
``few_words``.  Lines that count are ``\n``-separated and hold a word.  Rows are judged one by one: repeated
rows get equal results, ties cannot arise, an empty table gives an empty ledger.  Only the id columns and the
text are read, so further columns, whatever their names, do no harm.  Window and line equality is equality of
64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .store import small_batches

SYMBOLS = "#*$%&|<>"
#: name -> (measure, factor, other measure, factor): it fails where measure * factor > other * factor.
#: "one" is the constant 1.  All integer arithmetic, so that any engine decides alike.
RULES: dict[str, tuple[str, int, str, int]] = {
    "few_words": ("one", 10, "n_words", 1),
    "repeated_windows": ("n_repeat_words", 100, "n_words", 20),
    "symbols": ("n_symbols", 10, "n_words", 1),
    "duplicate_lines": ("n_dup_lines", 100, "n_lines", 35),
    "long_words": ("word_chars", 1, "n_words", 14),
    "short_words": ("n_words", 2, "word_chars", 1),
    "shouting": ("n_upper", 2, "word_chars", 1),
}
POLICIES: dict[str, tuple[str, ...]] = {"base-1": ("few_words", "repeated_windows"), "strict-1": tuple(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
WINDOW = 5

_is_symbol = np.zeros(256, bool)
_is_symbol[[ord(c) for c in SYMBOLS]] = True
_is_upper = np.zeros(256, bool)
_is_upper[65:91] = True


def bits(policy: str) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in POLICIES[policy])


def measure(block: tb.Block) -> dict[str, np.ndarray]:
    """The measurements of every row of a block."""
    n = block.n
    row, start, end = block.words()
    hashes = block.hash(start, end)
    out = {"n_words": np.bincount(row, minlength=n)}
    lead = (block.data & 0xC0) != 0x80  # first byte of a code point
    out["word_chars"] = block.count(lead & ~tb._SPACE[block.data])
    out["n_symbols"] = block.count(_is_symbol[block.data])
    out["n_upper"] = block.count(_is_upper[block.data])
    line_row, line_start, line_end = block.lines()
    full = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_row, line_start, line_end = line_row[full], line_start[full], line_end[full]
    out["n_lines"] = np.bincount(line_row, minlength=n)
    later = tb.repeats(line_row, block.hash(line_start, line_end))[1]
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=n)
    at, window = tb.windows(row, hashes, WINDOW)
    at = at[tb.repeats(row[at], window)[0]]
    edge = np.bincount(at, minlength=len(row) + WINDOW) - np.bincount(at + WINDOW, minlength=len(row) + WINDOW)
    covered = np.cumsum(edge)[: len(row)] > 0
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return out


def failed_bits(m: dict[str, np.ndarray]) -> np.ndarray:
    value = lambda name: 1 if name == "one" else m[name]
    out = np.zeros(len(m["n_words"]), np.int64)
    for k, (a, x, b, y) in enumerate(RULES.values()):
        out |= (value(a) * x > value(b) * y).astype(np.int64) << k
    return out


def _measured(column: pa.Array) -> dict[str, np.ndarray]:
    parts = [measure(b) for b in tb.blocks(column)]
    m = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in MEASURES}
    return m | {"failed": failed_bits(m)}


def ledger(docs: DataFrame, ids: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document: the ids, all measures (long) and ``failed`` (long, bit k for rule k)."""
    docs = docs.select(*ids, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids), *(f"{m} bigint" for m in (*MEASURES, "failed"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _measured(batch.column(len(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], *(pa.array(m[k], pa.int64()) for k in (*MEASURES, "failed"))], names=[*ids, *MEASURES, "failed"])

    return small_batches(docs).mapInArrow(run, schema)


def passes(policy: str, failed: Column | str = "failed") -> Column:
    """Whether a ledger row passes a policy."""
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(bits(policy))) == 0


def keep_passing(docs: DataFrame, policy: str, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text passes ``policy``; one pass, no join."""
    where, mask = docs.columns.index(text), bits(policy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_measured(batch.column(where))["failed"] & mask == 0))

    return small_batches(docs).mapInArrow(run, docs.schema)


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (kept if it were dropped), and all rejected.

    Failure patterns are counted first; there are at most 2**rules of them whatever the corpus.
    """
    mask = bits(policy)
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in enumerate(RULES) if mask >> k & 1))).alias("r")
    return (
        patterns.select("pattern", "n", rule)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("pattern").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(F.col("pattern") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
            F.sum(F.when(F.col("pattern") != 0, F.col("n")).otherwise(0)).alias("rejected"),
        )
    )
