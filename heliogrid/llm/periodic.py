"""Stretches of words that repeat with a short period, by a sparse dynamic programme over diagonals.

A diagonal is a lag: its match length at a word is that at the word before, plus
one, if the word equals that of so many places earlier. A run of smallest period q
is what a diagonal at lag q covers until it ends. Earlier occurrences are those of
whole grams, not of single words: a run of three periods holds, for a power of two
g of q to 2q - 1 words (or 16, if q is less), grams of g words whose latest earlier
occurrence is at lag q exactly; a later one would make the period smaller. So each
place has one active lag a gram size, on its diagonal grams match from the run's
first to its last, and no diagonal of another lag is longer than its run. The work
grows with n log n, however often words repeat.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, slices

#: The shortest gram. Runs of three periods and of 24 words or more hold grams of it with their earlier occurrence.
LEAST_GRAM = 16
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def runs(ids: np.ndarray, min_words: int = 24, min_periods: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start and period.

    min_periods is 3 or more, min_words LEAST_GRAM + LEAST_GRAM / 2 or more; then every run has a gram.
    """
    if min_periods < 3 or min_words < LEAST_GRAM * 3 // 2:
        raise ValueError(f"runs need 3 periods and {LEAST_GRAM * 3 // 2} words at least")
    out, n, size = [], len(ids), 1
    names, places = ids, np.arange(n)  # of grams of `size` words that occur more than once; -1 for others
    while n >= max(min_words, min_periods * (size // 2 + 1) * (size > LEAST_GRAM)) and len(places):
        if size >= LEAST_GRAM:
            # the latest earlier occurrence of each gram, and so its active lag
            order = places[np.argsort(names[places], kind="stable")]
            again = names[order[1:]] == names[order[:-1]]
            at, lag = order[1:][again], (order[1:] - order[:-1])[again]
            fits = (lag <= size) & ((lag > size // 2) | (size == LEAST_GRAM))
            at, lag = at[fits], lag[fits]
            order = np.argsort(at)
            at, lag = at[order], lag[order]
            # a diagonal goes on as long as the next word matches at the same lag; where it ends, its run is whole
            begins = np.flatnonzero(np.diff(at, prepend=-2) != 1) if len(at) else np.zeros(0, np.int64)
            begins = np.union1d(begins, np.flatnonzero(np.diff(lag, prepend=0) != 0)) if len(at) else begins
            for first, end in zip(begins.tolist(), [*begins[1:].tolist(), len(at)]):
                period, matched = int(lag[first]), end - first + size - 1
                if matched + period >= max(min_words, min_periods * period):
                    out.append((int(at[first]) - period, matched + period, period))
        # names of grams of twice the size, from those of their halves
        left = places[places + size < n]
        left = left[names[left + size] >= 0] if size > 1 else left
        pair = names[left] * np.int64(n + 1) + names[left + size]
        _, place, count = np.unique(pair, return_inverse=True, return_counts=True)
        often = count[place] > 1
        places = left[often]
        names = np.full(n, -1, np.int64)
        names[places] = place[often]
        size *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def first_periods(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; of equals the first, then that of the smallest period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 24, min_periods: int = 3) -> DataFrame:
    """(id_col, n_words, runs, strongest, collapsed) for every row of docs.

    Words are runs of bytes other than space and 0x09-0x0D, compared byte by byte.
    A run is a stretch of words with smallest period q (words q apart are equal) of
    max(min_words, min_periods * q) words or more that no neighbouring word
    extends. runs has (start, length, period) by start and period; strongest is
    that of the greatest length / period (ties: smallest start, then period), null
    without a run. collapsed is the text of the words that no run holds after its
    first period, joined by one space.

    A null, empty or blank text has no words, no runs and an empty collapsed text.
    Rows stay as they are, repeated ones and those with a null id too; an empty
    table gives no rows; other columns are not read. Texts of any length are taken
    as a whole: time grows with n log n words and memory with n, about 100 bytes a
    word in the task that has the text.
    """
    names = [id_col, "n_words", "runs", "strongest", "collapsed"]

    def run(batches):
        for batch in slices(batches, 256):
            lengths, every, best, texts = [], [], [], []
            for text in binaries(batch.column(1)):
                words = (text or b"").split()
                found = runs(numbered(words), min_words, min_periods) if len(words) >= min_words else []
                lengths.append(len(words))
                every.append([dict(zip(("start", "length", "period"), r)) for r in found])
                best.append(dict(zip(("start", "length", "period"), strongest(found))) if found else None)
                if found:
                    words = [words[i] for i in np.flatnonzero(first_periods(len(words), found)).tolist()]
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(every, pa.list_(RUN)), pa.array(best, RUN), pa.array(texts, pa.binary()).cast(pa.string(), safe=False)], names)

    one = "struct<start: long, length: long, period: long>"
    picked = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` long, n_words long, runs array<{one}>, strongest {one}, collapsed string")


_STEP = "xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: {_STEP}), 4294967295)"
#: The query's result in SQL: equal words at a lag, numbered along their diagonal.
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_CRC} AS h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
m AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
b AS (SELECT doc_id, h, w, n, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM m),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM b),
s AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t),
e AS (SELECT x.doc_id, y.i - x.i AS lag, y.i FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS diagonal FROM e),
f AS (SELECT doc_id, lag, count(*) + lag AS length, max(i) + 1 - count(*) - lag AS start FROM k GROUP BY doc_id, lag, diagonal),
r AS MATERIALIZED (SELECT doc_id, start, length, min(lag) AS period FROM f WHERE length >= greatest(24, 3 * lag) GROUP BY doc_id, start, length),
z AS (SELECT doc_id, count(*) AS n_runs, arg_min((start, length, period), (-(length::DECIMAL(38, 20) / period), start, period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id AND s.i >= r.start + r.period AND s.i < r.start + r.length) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period, (1000 * best[2] // best[3])::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN z USING (doc_id) LEFT JOIN c USING (doc_id)
"""
