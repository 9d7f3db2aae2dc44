"""Suffix dedup by a hash-compared suffix sort, on bytes.

A 200-byte string that starts in two places is found among the suffixes at the selected
64-byte grams (see dupscan). In each task the suffixes of every gram are mergesorted, two of
them compared by their longest common extension, which binary search over prefix
polynomial hashes finds in a logarithmic number of steps; what stands before the gram is
sorted in the same way, read backwards. What neighbours have in common is then counted byte
by byte, and an order that a hash collision has spoilt is sorted again by the bytes, so a
collision can neither make a match nor hide one. A string that starts t bytes before the
gram is repeated if another row lies in its run of neighbours with t bytes or more in
common to the left, and in its run with 200 - t or more to the right.
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
from fleetward.llm.tokens import byte_symbols, powers, slices

WINDOW = 200
GRAM = 64


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _symbols(text: str | None) -> Callable[[int, int], bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return lambda first, end: data[first:end]


def _decoded(around: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(around), dtype=np.uint8).astype(np.int16), np.array([len(x) for x in around], dtype=np.int64)


class Suffixes:
    """Rows of symbols from the first column on, each of its own length, compared by prefix polynomial hashes."""

    def __init__(self, x: np.ndarray, have: np.ndarray) -> None:
        self.x, self.have = x, have
        self.sums = np.zeros((len(x), x.shape[1] + 1), dtype=np.uint64)
        up = powers(0x2545F4914F6CDD1D, x.shape[1])
        for a in range(0, len(x), 1024):
            np.cumsum(byte_symbols(x[a : a + 1024] & 255) * up, axis=1, out=self.sums[a : a + 1024, 1:])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Binary search for the longest extension with equal hashes."""
        flat, wide = self.sums.reshape(-1), self.sums.shape[1]
        at_a, at_b = a * wide, b * wide
        most = np.minimum(self.have[a], self.have[b])
        n = np.zeros(len(a), dtype=np.int64)
        step = 1 << int(most.max(initial=1)).bit_length()
        while step := step >> 1:
            more = n + step
            fits = more <= most
            far = np.where(fits, more, 0)
            n = np.where(fits & (flat[at_a + far] == flat[at_b + far]), more, n)
        return n

    def before(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b, n being what they have in common; equal ones by row."""
        ends_a, ends_b = n >= self.have[a], n >= self.have[b]
        at = np.minimum(n, self.x.shape[1] - 1)
        return np.where(ends_a | ends_b, np.where(ends_a & ends_b, a < b, ends_a), self.x[a, at] < self.x[b, at])

    def sort(self, cut: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows in suffix order within each group (start, size), by mergesort of all groups side by side.

        Two sorted runs merge as each member finds, by binary search, how many of the other run go before it.
        """
        order = np.arange(len(self.x))
        start, size = np.repeat(cut, sizes), np.repeat(sizes, sizes)
        run, most = 1, int(sizes.max(initial=0))
        while run < most:
            at = np.flatnonzero(size > run)
            inside = at - start[at]
            mine = inside // run
            other = start[at] + (mine ^ 1) * run
            n_other = np.clip(start[at] + size[at] - other, 0, run)
            lo, hi = np.zeros(len(at), dtype=np.int64), n_other
            while (go := np.flatnonzero(lo < hi)).size:
                mid = (lo[go] + hi[go]) // 2
                a, b = order[other[go] + mid], order[at[go]]
                less = self.before(a, b, self.extension(a, b))
                lo[go] = np.where(less, mid + 1, lo[go])
                hi[go] = np.where(less, hi[go], mid)
            to = start[at] + (mine & ~1) * run + inside % run + lo
            new = order.copy()
            new[to] = order[at]
            order, run = new, 2 * run
        return order

    def common(self, order: np.ndarray) -> np.ndarray:
        """Symbols that neighbours in the order have in common, counted one by one."""
        a, b = order[:-1], order[1:]
        n = np.empty(len(a), dtype=np.int64)
        for k in range(0, len(a), 1024):
            s = slice(k, k + 1024)
            n[s] = np.argmin(np.pad(self.x[a[s]] == self.x[b[s]], ((0, 0), (0, 1))), axis=1)
        return np.minimum(n, np.minimum(self.have[a], self.have[b]))

    def neighbours(self, cut: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix order of each group, and what each row has in common with the one before it (-1: none is)."""
        of = np.repeat(np.arange(len(cut)), sizes)
        order = self.sort(cut, sizes)
        n = self.common(order)
        wrong = ~self.before(order[:-1], order[1:], n) & (of[1:] == of[:-1])
        for k in np.unique(of[1:][wrong]).tolist():
            # A collision has misled the sort: this group by its bytes.
            s = slice(cut[k], cut[k] + sizes[k])
            order[s] = sorted(range(s.start, s.stop), key=lambda i: (self.x[i, : self.have[i]].tolist(), i))
        if wrong.any():
            n = self.common(order)
        return order, np.r_[-1, np.where(of[1:] == of[:-1], n, -1)]


def extend(g: Group) -> np.ndarray:
    """Marks of the repeated strings, by offset: from the orders to the right and to the left of each gram."""
    left, window = g.kind.left, g.kind.window
    cut = np.flatnonzero(np.r_[True, np.diff(g.of) != 0])
    sizes = np.diff(np.r_[cut, len(g.of)])
    sides = []
    for x, have in ((g.x[:, left:], g.have_right), (np.ascontiguousarray(g.x[:, :left][:, ::-1]), g.have_left)):
        order, n = Suffixes(x, have).neighbours(cut, sizes)
        sides.append((order, n))
    out = np.zeros((len(g.x), left + 1), dtype=bool)
    run = np.empty((2, len(g.x)), dtype=np.int64)
    for t in range(left + 1):
        rows = np.flatnonzero((g.t_min <= t) & (t <= g.t_max))
        if len(rows) < 2:
            continue
        for k, least in ((0, window - t), (1, t)):
            order, n = sides[k]
            run[k, order] = np.cumsum(n < least)
        _, code, count = np.unique(run[0, rows] * len(g.x) + run[1, rows], return_inverse=True, return_counts=True)
        out[rows, t] = count[code] > 1
    return out


def byte_kind(window: int = WINDOW, gram: int = GRAM) -> Kind:
    return Kind("bytes", window, gram, lambda t: byte_symbols(_bytes(t)), False, _symbols, _decoded, lambda x, first, end: x[first:end], extend)


def _kept_rows(window: int, with_kept: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, TEXTS_AT_ONCE):
            out = []
            for doc, text, copied, runs in zip(b["doc_id"], b["text"], b["copied"], b["runs"], strict=True):
                data = _bytes(text)
                gone = dupscan.repeated_mask(len(data), window, copied is True or copied == True, runs)  # noqa: E712
                kept = data[~gone].tobytes()
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                row = [doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()]
                out.append([*row, kept] if with_kept else row)
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_kept: bool = True, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary).

    Null text has no bytes; a text shorter than a window loses nothing, copied or not; what is kept may cut a
    character, so it is bytes; repeated rows are copies of each other; null ids stay; an empty table gives no rows.
    Other columns of docs are left out.
    """
    out = dupscan.with_repeats(docs.select("doc_id", "text"), byte_kind(window, gram), group_limit)
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    # Ids pass as text: pandas would make floating-point numbers of them beside a null.
    kept = out.select(F.col("doc_id").cast("string"), "text", "copied", "runs").mapInPandas(_kept_rows(window, with_kept), schema)
    return kept.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


#: The same in DuckDB's SQL, by whole strings, as hexadecimal digits.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT k, x, unnest(range(1, greatest(length(x) // 2 - {WINDOW} + 2, 1))) AS i FROM d),
h AS (SELECT k, i, md5(substr(x, 2 * i - 1, {2 * WINDOW})) AS h FROM s),
r AS (SELECT k, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM r)),
n AS (SELECT k, min(i) AS a, max(i) + {WINDOW - 1} AS b FROM g GROUP BY k, g),
p AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM n),
o AS (SELECT k, sum(b - a + 1) AS gone, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM p JOIN d USING (k) GROUP BY k)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN o USING (k)
"""
