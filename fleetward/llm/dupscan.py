"""What the two exact duplicate scans (words, bytes) have in common.

A text is a sequence of symbols; a window of W symbols is repeated if its sequence starts
anywhere else. Each window has a selector: of the k-symbol grams in it the one of least
hash, the first among equals. Equal windows have equal selectors at equal offsets, so only
windows whose selectors are equal need be held against each other, and about one position
in (W - k) / 2 is a selector ("anchor").

1. anchors: every text's anchors; grams that occur in two different texts, or twice in one. Anchors
   are found twice, once for their grams and once for their places, rather than stored.
2. occurrences: for those alone, the symbols around them, one row each.
3. one task gets all occurrences of a gram and decides their windows by the operator's own
   method, whatever the number of different surroundings. Both methods compare symbols.
4. grams of more than GROUP_LIMIT occurrences: equal surroundings become one row, counted. Each
   is cut into PARTS ranges of offsets, and a range goes to a task by the symbols that all of
   its windows have in common. Ranges that are still too frequent have their windows grouped by
   content, an aggregation that combines before it shuffles.
5. removal: repeated windows' starts meet their text again, which is read a second time.

Whole copies of a text are known by its 128-bit hash: every window of theirs is repeated, and
one of them stands for all in steps 1 to 4. Places and starts grow with the texts, so they
meet them by a shuffle at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.llm.common import small_side, stage, text_of
from fleetward.llm.tokens import slices, window_hashes

#: Symbols of a text that are worked on at once; longer texts come in pieces that overlap by a window.
PIECE = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
#: Occurrences of one gram that one task takes (some 10 MB of contexts); beyond, they are dealt out by more symbols
#: than the gram's, at the cost of three more shuffles of theirs.
GROUP_LIMIT = 20_000
#: Ranges of offsets that a too frequent gram's occurrences are cut into.
PARTS = 4
ROWS_AT_ONCE = 4096
TEXTS_AT_ONCE = 500


@dataclass(frozen=True)
class Kind:
    """What differs between the scans."""

    name: str
    window: int
    gram: int
    #: Numbers that stand for a text's symbols, to hash grams of.
    numbers: Callable[[str | None], np.ndarray]
    well_mixed: bool
    #: Symbols of a text as stored in contexts: (text) to a function of (first, end) that gives bytes.
    symbols: Callable[[str | None], Callable[[int, int], bytes]]
    #: Contexts to (all their symbols as numbers that are equal if and only if the symbols are, symbols of each).
    decoded: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    #: Part of a context, from one symbol to another.
    part: Callable[[bytes, int, int], bytes]
    #: Decides groups: see Group and decide().
    method: Callable
    #: Symbols that are worked on at once; PIECE if not given.
    piece: int | None = None

    @property
    def left(self) -> int:
        return self.window - self.gram

    @property
    def width(self) -> int:
        return self.left + self.window


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == w else np.minimum(x[: len(x) - (w - have)], x[w - have :])


def _pieces(lengths: np.ndarray, window: int, piece: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to) of at most about so many symbols in all, covering every window once."""
    out, size = [], 0
    for k, n in enumerate(lengths):
        at = 0
        while n - at >= window:
            to = min(n, at + piece)
            if size and size + to - at > piece:
                yield out
                out, size = [], 0
            out.append((k, at, to))
            size += to - at
            if to == n:
                break
            at = to - window + 1
    if out:
        yield out


def select_anchors(kind: Kind, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """text, pos, lo, hi, gram hash: each anchor, once, with the first and last start of the windows it selects."""
    found = []
    w = kind.window - kind.gram + 1
    for piece in _pieces(np.array([len(t) for t in texts], dtype=np.int64), kind.window, kind.piece or PIECE):
        parts = [texts[k][a:b] for k, a, b in piece]
        sizes = np.array([len(x) for x in parts])
        first = np.cumsum(sizes) - sizes
        grams = window_hashes(np.concatenate(parts), kind.gram, kind.well_mixed)
        packed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        best = (_sliding_min(packed, w) & _LOW).astype(np.int64)
        n = sizes - kind.window + 1
        owner = np.repeat(np.arange(len(parts)), n)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        sel = best[start + first[owner]]
        cut = np.flatnonzero(np.r_[True, (np.diff(sel) != 0) | (np.diff(owner) != 0)])
        last = np.r_[cut[1:], len(sel)] - 1
        owner, at, lo, hi = owner[cut], sel[cut], start[cut], start[last]
        base = np.array([a for _, a, _ in piece])[owner]
        text = np.array([k for k, _, _ in piece])[owner]
        found.append((text, at - first[owner] + base, lo + base, hi + base, grams[at].view(np.int64)))
    if not found:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    text, pos, lo, hi, gram = (np.concatenate(x) for x in zip(*found, strict=True))
    # An anchor whose windows lie on both sides of a piece's border was found by both pieces, one after the other.
    cut = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(pos) != 0)])
    last = np.r_[cut[1:], len(text)] - 1
    return text[cut], pos[cut], lo[cut], hi[last], gram[cut]


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, first, last of each run of true marks in a 2-d array."""
    edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return row, first, after - 1


class Group:
    """Occurrences of some grams in one task, ordered by gram: symbols around each, and which windows count.

    x[i, left] is the gram's first symbol, -1 stands for none. Offset t is the window that starts t symbols before
    the gram; t_min to t_max are those that this occurrence selects. have_left and have_right are symbols that
    exist; of[i] numbers the gram.
    """

    def __init__(self, kind: Kind, gram: np.ndarray, around: list[bytes], n_left: np.ndarray, t_min: np.ndarray, t_max: np.ndarray) -> None:
        self.kind, self.have_left, self.t_min, self.t_max = kind, n_left, t_min, t_max
        self.of = np.cumsum(np.r_[False, gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, dtype=np.int64)
        flat, count = kind.decoded(around)
        self.have_right = count - n_left
        self.x = np.full((len(around), kind.width), -1, dtype=flat.dtype)
        at = np.r_[0, np.cumsum(count)]
        # Some rows at a time: an index of each symbol takes several times the symbol's room.
        for a in range(0, len(around), ROWS_AT_ONCE // 8):
            some = slice(a, a + ROWS_AT_ONCE // 8)
            n = count[some]
            part = flat[at[a] : at[a] + n.sum()]
            column = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(kind.left - n_left[some], n)
            self.x[np.repeat(np.arange(a, a + len(n)), n), column] = part


def decide(kind: Kind, gram: np.ndarray, around: list[bytes], n_left: np.ndarray, t_min: np.ndarray, t_max: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first t, last t) of repeated windows; rows are all occurrences of some grams, ordered by gram."""
    # Occurrences whose surroundings are equal stand for each other.
    whole = pd.DataFrame({"gram": gram, "around": around, "n_left": n_left, "t_min": t_min, "t_max": t_max})
    code = whole.groupby(list(whole.columns), sort=False).ngroup().to_numpy()
    _, rep, count = np.unique(code, return_index=True, return_counts=True)
    order = np.argsort(rep)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    code, rep, count = rank[code], rep[order], count[order]
    marks = np.zeros((len(rep), kind.left + 1), dtype=bool)
    cut = np.flatnonzero(np.r_[True, np.diff(gram[rep]) != 0])
    sizes = np.diff(np.r_[cut, len(rep)])
    some = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    if len(some):
        own = rep[some]
        marks[some] = kind.method(Group(kind, gram[own], [around[i] for i in own], n_left[own], t_min[own], t_max[own]))
    t = np.arange(kind.left + 1)
    marks = (marks | (count > 1)[:, None]) & (t >= t_min[rep, None]) & (t <= t_max[rep, None])
    return _runs(marks[code])


def _gram_rows(kind: Kind):
    """A row for each gram of each text's anchors, and whether the text has it twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, TEXTS_AT_ONCE):
            text, _, _, _, gram = select_anchors(kind, [kind.numbers(t) for t in b["text"]])
            order = np.lexsort((gram, text))
            text, gram = text[order], gram[order]
            new = np.r_[True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])] if len(gram) else np.empty(0, dtype=bool)
            at = np.flatnonzero(new)
            yield pd.DataFrame({"gram": gram[at], "n": np.diff(np.r_[at, len(gram)])})

    return run


def _place_rows(kind: Kind):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, TEXTS_AT_ONCE):
            text, pos, _, _, gram = select_anchors(kind, [kind.numbers(t) for t in b["text"]])
            yield pd.DataFrame({"h1": b["h1"].to_numpy()[text], "h2": b["h2"].to_numpy()[text], "gram": gram, "pos": pos})

    return run


OCCURRENCE = "h1 long, h2 long, gram long, pos long, t_min long, t_max long, n_left long, around binary"


def _occurrence_rows(kind: Kind):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, TEXTS_AT_ONCE):
            text, pos, lo, hi, gram = select_anchors(kind, [kind.numbers(t) for t in b["text"]])
            wanted = [np.asarray(x, dtype=np.int64) for x in b["at"]]
            size = np.array([len(x) for x in wanted], dtype=np.int64)
            base = 1 << 40
            keep = np.isin(text * base + pos, np.repeat(np.arange(len(wanted)), size) * base + (np.concatenate(wanted) if len(wanted) else 0))
            text, pos, lo, hi, gram = (x[keep] for x in (text, pos, lo, hi, gram))
            left = np.minimum(pos, kind.left)
            symbols = {k: kind.symbols(b["text"].iat[k]) for k in np.unique(text).tolist()}
            around = [symbols[k](p - n, p + kind.window) for k, p, n in zip(text.tolist(), pos.tolist(), left.tolist(), strict=True)]
            for a in range(0, len(text), ROWS_AT_ONCE):
                s = slice(a, a + ROWS_AT_ONCE)
                yield pd.DataFrame({"h1": b["h1"].to_numpy()[text[s]], "h2": b["h2"].to_numpy()[text[s]], "gram": gram[s], "pos": pos[s], "t_min": (pos - hi)[s], "t_max": (pos - lo)[s], "n_left": left[s], "around": around[s]})

    return run


def _decided_rows(kind: Kind, ids: list[str]):
    """Takes rows ordered by gram; works on whole groups, about ROWS_AT_ONCE rows at a time."""

    def result(rows: pd.DataFrame) -> pd.DataFrame:
        row, first, last = decide(kind, *(rows[c].tolist() if c == "around" else rows[c].to_numpy() for c in ("gram", "around", "n_left", "t_min", "t_max")))
        return pd.DataFrame({**{c: rows[c].to_numpy()[row] for c in ids}, "t_first": first, "t_last": last})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for b in batches:
            for a in range(0, len(b), ROWS_AT_ONCE):
                part = b.iloc[a : a + ROWS_AT_ONCE]
                held.append(part)
                n += len(part)
                if n < ROWS_AT_ONCE:
                    continue
                rows = pd.concat(held, ignore_index=True)
                gram = rows["gram"].to_numpy()
                # Everything before the last group, which may go on.
                cut = int(np.flatnonzero(np.r_[True, np.diff(gram) != 0])[-1])
                if cut:
                    yield result(rows.iloc[:cut])
                held, n = [rows.iloc[cut:]], len(rows) - cut
        if n:
            yield result(pd.concat(held, ignore_index=True))

    return run


def _decided(kind: Kind, rows: DataFrame, ids: list[str]) -> DataFrame:
    """ids, t_first, t_last of rows' repeated windows; a gram's rows come together in one task."""
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ids) + ", t_first long, t_last long"
    return rows.repartition("gram").sortWithinPartitions("gram").mapInPandas(_decided_rows(kind, ids), schema)


def _part_rows(kind: Kind):
    """Each surrounding once for each range of offsets it selects windows in; gram: hash of what these have in common."""
    wide = -(-(kind.left + 1) // PARTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, ROWS_AT_ONCE // PARTS):
            for part in range(PARTS):
                first, last = part * wide, min((part + 1) * wide - 1, kind.left)
                rows = b[(b["t_min"] <= last) & (b["t_max"] >= first)]
                if rows.empty:
                    continue
                rows = rows.assign(t_min=np.maximum(rows["t_min"], first), t_max=np.minimum(rows["t_max"], last))
                core = [kind.part(x, max(n - first, 0), n - last + kind.window) for x, n in zip(rows["around"], rows["n_left"], strict=True)]
                yield rows.assign(core=core, part=part)

    return run


def _window_rows(kind: Kind):
    """Content of every window of some surroundings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, max(1, ROWS_AT_ONCE // kind.window)):
            out = [(sid, t, kind.part(x, n - t, n - t + kind.window)) for sid, x, n, a, e in zip(b["sid"], b["around"], b["n_left"], b["t_min"], b["t_max"], strict=True) for t in range(a, e + 1)]
            yield pd.DataFrame(out, columns=["sid", "t", "window"])

    return run


def _hot_marks(kind: Kind, rows: DataFrame, group_limit: int) -> DataFrame:
    """(h1, h2, pos, runs of t) for rows of grams that are too frequent for one task."""
    col = F.col
    key = ["gram", "around", "n_left", "t_min", "t_max"]
    apart = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("sid", F.monotonically_increasing_id())
    apart = stage(apart, f"{kind.name}-surroundings")
    parts = apart.select("sid", *key).mapInPandas(_part_rows(kind), "sid long, gram long, around binary, n_left long, t_min long, t_max long, core binary, part int")
    parts = parts.withColumn("gram", F.xxhash64("gram", "part", "core")).drop("core", "part")
    parts = stage(parts, f"{kind.name}-parts")
    # What these have in common is long, so more of them are alike: smaller groups go to one task.
    hot = small_side(stage(parts.groupBy("gram").count().where(col("count") > group_limit // PARTS**2).select("gram"), f"{kind.name}-hot-parts", few=True), 24)
    marks = _decided(kind, parts.join(hot, "gram", "left_anti"), ["sid"])
    windows = parts.join(hot, "gram", "left_semi").select("sid", "around", "n_left", "t_min", "t_max").mapInPandas(_window_rows(kind), "sid long, t long, window binary")
    windows = stage(windows, f"{kind.name}-windows")
    twice = stage(windows.groupBy("t", "window").count().where(col("count") > 1).select("t", "window"), f"{kind.name}-twice", few=True)
    again = windows.join(small_side(twice, 64 + F.octet_length("window")), ["t", "window"]).select("sid", col("t").alias("t_first"), col("t").alias("t_last"))
    same = apart.where(col("n") > 1).select("sid", col("t_min").alias("t_first"), col("t_max").alias("t_last"))
    marks = stage(marks.unionByName(again).unionByName(same), f"{kind.name}-hot-marks", few=True)
    marks = marks.groupBy("sid").agg(F.collect_list(F.struct("t_first", "t_last")).alias("runs"))
    told = stage(marks.join(apart.select("sid", *key), "sid").drop("sid"), f"{kind.name}-told", few=True)
    return rows.join(small_side(told, 96 + F.octet_length("around") + 16 * F.size("runs")), key).select("h1", "h2", "pos", "runs")


def repeated_starts(docs: DataFrame, copies: DataFrame, kind: Kind, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """h1, h2, runs: starts of repeated windows of each text, as array<struct<first, last>>.

    docs(doc_id, text, h1, h2); copies(h1, h2, rep): texts that occur more than once, and an id of theirs. For a
    copied text there may be fewer than all. A row of the same id and text comes twice, which marks a copied text.
    """
    col = F.col
    once = docs.join(copies, ["h1", "h2"], "left").where(col("rep").isNull() | col("doc_id").eqNullSafe(col("rep.doc_id")))
    once = once.select("h1", "h2", "text")
    grams = once.select("text").mapInPandas(_gram_rows(kind), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    shared = stage(grams.where(col("n") > 1).select("gram"), f"{kind.name}-grams", few=True)
    anchors = once.mapInPandas(_place_rows(kind), "h1 long, h2 long, gram long, pos long")
    places = anchors.join(shared, "gram").groupBy("h1", "h2").agg(F.collect_set("pos").alias("at"))
    found = stage(once.join(places, ["h1", "h2"]).select("h1", "h2", "text", "at").mapInPandas(_occurrence_rows(kind), OCCURRENCE), f"{kind.name}-occurrences")
    hot = stage(found.groupBy("gram").count().where(col("count") > group_limit).select("gram"), f"{kind.name}-hot", few=True)
    marks = _decided(kind, found.join(small_side(hot, 24), "gram", "left_anti"), ["h1", "h2", "pos"])
    marks = marks.select("h1", "h2", "pos", F.array(F.struct("t_first", "t_last")).alias("runs"))
    if not hot.isEmpty():
        marks = marks.unionByName(_hot_marks(kind, found.join(small_side(hot, 24), "gram", "left_semi"), group_limit))
    runs = F.transform("runs", lambda r: F.struct((col("pos") - r["t_last"]).alias("first"), (col("pos") - r["t_first"]).alias("last")))
    return marks.select("h1", "h2", runs.alias("runs")).groupBy("h1", "h2").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def with_repeats(docs: DataFrame, kind: Kind, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """docs(doc_id, text) with h1, h2, copied (true, or null) and runs (or null)."""
    hashed = docs.select("doc_id", text_of().alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), F.col("text"))})
    copies = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where(F.col("n") > 1)
    copies = stage(copies.select("h1", "h2", F.struct("doc_id").alias("rep")), f"{kind.name}-copies", few=True)
    side = small_side(copies, 64)
    starts = stage(repeated_starts(hashed, side, kind, group_limit), f"{kind.name}-starts", few=True)
    copied = side.select("h1", "h2", F.lit(True).alias("copied"))
    return hashed.join(copied, ["h1", "h2"], "left").join(starts, ["h1", "h2"], "left")


def repeated_mask(n: int, window: int, copied: bool, runs) -> np.ndarray:
    """Which of a text's n symbols are covered by repeated windows."""
    if copied and n >= window:
        return np.ones(n, dtype=bool)
    edge = np.zeros(n + 1, dtype=np.int64)
    for r in runs if runs is not None else ():
        edge[r["first"]] += 1
        edge[r["last"] + window] -= 1
    return np.cumsum(edge[:-1]) > 0
