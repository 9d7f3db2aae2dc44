"""Substring dedup by Relative Lempel-Ziv parsing, on words.

The reference is the whole corpus, indexed in blocks: the words around each selected
8-word gram that occurs in more than one place (see dupscan). Each block is parsed
greedily against all others of its gram: a cursor stands at the block's first window,
and the factor is the longest run of words from there that another block has at the same
place, found among the neighbours in the sorted order of the blocks' suffixes. A factor of
35 words or more is a duplicate span, and the cursor goes to its boundary: to the first
window that reaches beyond the factor, so that windows across the boundary are checked. A
shorter factor gives one word as a literal, and the cursor moves on by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.llm import dupscan
from fleetward.llm.dupscan import GROUP_LIMIT, TEXTS_AT_ONCE, Group, Kind
from fleetward.llm.tokens import mix, powers, slices, word_bounds, word_hashes

WINDOW = 35
GRAM = 8


def _words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return word_hashes(data, *word_bounds(data))


def _symbols(text: str | None) -> Callable[[int, int], bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return lambda first, end: b" ".join(words[first:end])


def _part(around: bytes, first: int, end: int) -> bytes:
    return b" ".join(around.split(b" ")[first:end])


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """A number for each word, equal if and only if the words are: by hash, held against the bytes."""
    if not len(starts):
        return np.empty(0, dtype=np.int32)
    slices_ = [slice(a, a + at_once) for a in range(0, len(starts), at_once)]
    hashes = np.concatenate([word_hashes(data[starts[s][0] : ends[s][-1]], starts[s] - starts[s][0], ends[s] - starts[s][0]) for s in slices_])
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    size, like = ends - starts, first[code]
    if (size == size[like]).all() and all(_alike(data, starts[s], starts[like[s]], size[s]) for s in slices_):
        return code.astype(np.int32)
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts, ends, strict=True)], dtype=np.int32)


def _alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether all pieces of data from a equal those from b."""
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return bool((data[np.repeat(a, size) + inside] == data[np.repeat(b, size) + inside]).all())


def _decoded(around: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(around), dtype=np.uint8)
    starts, ends = word_bounds(data)
    row_ends = np.cumsum([len(x) + 1 for x in around])
    return word_codes(data, starts, ends), np.bincount(np.searchsorted(row_ends, starts, side="right"), minlength=len(around))


class Blocks:
    """Rows of one group after the other, as the index of each other's suffixes at a column."""

    def __init__(self, g: Group) -> None:
        self.g = g
        self.sums = np.zeros((len(g.x), g.x.shape[1] + 1), dtype=np.uint64)
        # A missing word is zero words on: rows are cut at what they have.
        np.cumsum(mix((g.x.astype(np.int64) + 2).view(np.uint64)) * powers(0xD6E8FEB86659FD95, g.x.shape[1]), axis=1, out=self.sums[:, 1:])

    def longest(self, rows: np.ndarray, column: int) -> np.ndarray:
        """For each row, words from the column on that it has in common with some other row of its group."""
        g, window = self.g, self.g.kind.window
        out = np.zeros(len(rows), dtype=np.int64)
        key, of = self.sums[rows, column + window] - self.sums[rows, column], g.of[rows]
        at = np.lexsort((key, of))
        near = np.r_[False, self._alike(key[at], of[at]), False]
        at = at[near[:-1] | near[1:]]
        at = at[np.lexsort((*g.x[rows[at], column + window :].T[::-1], key[at], of[at]))]
        common = self._common(rows[at], column)
        if (common[self._alike(key[at], of[at])] < window).any():
            # Two windows of one hash that differ: all are sorted by the words themselves.
            at = np.lexsort((*g.x[rows, column:].T[::-1], of))
            common = self._common(rows[at], column)
        out[at] = np.maximum(np.r_[0, common], np.r_[common, 0])[: len(at)]
        return out

    @staticmethod
    def _alike(key: np.ndarray, of: np.ndarray) -> np.ndarray:
        return (key[1:] == key[:-1]) & (of[1:] == of[:-1])

    def _common(self, rows: np.ndarray, column: int) -> np.ndarray:
        """Words that neighbours have in common from the column on; 0 between groups."""
        g = self.g
        a, b = rows[:-1], rows[1:]
        same = g.x[a, column:] == g.x[b, column:]
        n = np.argmin(np.pad(same, ((0, 0), (0, 1))), axis=1)
        return np.where(g.of[a] == g.of[b], np.minimum(n, np.minimum(g.have_right[a], g.have_right[b]) + g.kind.left - column), 0)


def factor(g: Group) -> np.ndarray:
    """Marks of the windows (by offset) that long factors cover, from a greedy parse of each row."""
    left, window = g.kind.left, g.kind.window
    first, last = left - g.t_max, left - g.t_min
    cursor = first.copy()
    edge = np.zeros((len(g.x), left + 2), dtype=np.int8)
    blocks = Blocks(g)
    for column in range(left + 1):
        active = (cursor == column) & (column <= last)
        if not active.any():
            continue
        has = np.zeros(int(g.of[-1]) + 1, dtype=bool)
        has[g.of[active]] = True
        rows = np.flatnonzero(has[g.of] & (first <= column) & (column <= last))
        long = np.zeros(len(g.x), dtype=np.int64)
        long[rows] = blocks.longest(rows, column)
        cursor[active & (long < window)] += 1
        spans = np.flatnonzero(active & (long >= window))
        reach = np.minimum(long[spans], window + last[spans] - column)
        edge[spans, column] += 1
        edge[spans, column + reach - window + 1] -= 1
        cursor[spans] = column + reach - window + 1
    return (np.cumsum(edge, axis=1)[:, :-1] > 0)[:, ::-1]


def word_kind(window: int = WINDOW, gram: int = GRAM) -> Kind:
    return Kind("words", window, gram, _words, True, _symbols, _decoded, _part, factor)


def _kept_rows(window: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, TEXTS_AT_ONCE):
            out = []
            for doc, text, copied, runs in zip(b["doc_id"], b["text"], b["copied"], b["runs"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                starts, ends = word_bounds(np.frombuffer(data, dtype=np.uint8))
                gone = dupscan.repeated_mask(len(starts), window, copied is True or copied == True, runs)  # noqa: E712
                kept = b" ".join([data[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)])
                row = [doc, len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest()]
                out.append([*row, kept.decode("utf-8", "surrogatepass")] if with_text else row)
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Null text has no words; a text shorter than a window loses nothing, copied or not; repeated rows are copies of
    each other; null ids stay; an empty table gives no rows. Other columns of docs are left out.
    """
    kind = word_kind(window, gram)
    out = dupscan.with_repeats(docs.select("doc_id", "text"), kind, group_limit)
    schema = "doc_id string, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    # Ids pass as text: pandas would make floating-point numbers of them beside a null.
    kept = out.select(F.col("doc_id").cast("string"), "text", "copied", "runs").mapInPandas(_kept_rows(window, with_text), schema)
    return kept.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


#: The same in DuckDB's SQL, by whole windows.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT k, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 1))) AS i FROM d),
h AS (SELECT k, i, md5(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS h FROM s),
r AS (SELECT k, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT k, unnest(range(i, i + {WINDOW})) AS i FROM r),
p AS (SELECT k, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
o AS (SELECT p.k, string_agg(x, ' ' ORDER BY p.i) AS t, count(*) AS n FROM p ANTI JOIN c ON p.k = c.k AND p.i = c.i GROUP BY p.k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN o USING (k)
"""
