"""Dominance inside one task: rows of a cell (a group's points and the queries that meet them) as arrays.

Spark deals points and queries into cells, shuffles and sorts them; the functions here answer the cells of a sorted partition.  Points
are ordered by the first coordinate, so the points a query meets there are a prefix, a sum of at most ``log2`` aligned runs;
inside a run they are ordered by the second coordinate, with running minima of what is asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BUNDLE = 200_000                 # rows answered at once, where cells are small
PAIRS = 1 << 20                  # below this many pairs of a query and a point they are compared one by one
LONG_AGO = -(1 << 62)


def _falling(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Ranks of both, 0 for the largest value (NaN above all), and their number."""
    values, rank = np.unique(np.concatenate([points, queries]), return_inverse=True)
    rank = len(values) - 1 - rank
    return rank[:len(points)], rank[len(points):], len(values)


def dominated(p_cell, px, py, q_cell, qx, qy, values=()) -> tuple:
    """Per query: the points of its cell, those with x at least its own, those of them with y at least its own as well, and
    of these the least of each of ``values`` (distinct numbers from 0 on; as many as there are points where there is none)."""
    n, m = len(p_cell), len(q_cell)
    px, qx, n_x = _falling(px, qx)
    py, qy, n_y = _falling(py, qy)
    order = np.lexsort((px, p_cell))
    cell, y = p_cell[order], py[order]
    size = np.bincount(p_cell, minlength=int(max(p_cell.max(), q_cell.max())) + 1)
    start = np.cumsum(size) - size
    head = start[q_cell]
    deep = np.searchsorted(cell * n_x + px[order], q_cell * n_x + qx, side="right") - head
    own, here = start[cell], np.arange(n) - start[cell]
    both = np.zeros(m, np.int64)
    least = [np.full(m, n, np.int64) for _ in values]
    for level in range(int(deep.max()).bit_length()):
        asked = np.flatnonzero(deep >> level & 1)
        if not len(asked):
            continue
        run = own + (here >> level << level)                # where each point's run begins
        by = np.argsort(run * n_y + y, kind="stable")
        at = head[asked] + (deep[asked] >> level + 1 << level + 1)
        to = np.searchsorted((run * n_y + y)[by], at * n_y + qy[asked], side="right")
        both[asked] += to - at
        met = to > at
        for v, best in zip(values, least):
            # Runs lie one after another and later ones are set lower, so the running minimum starts anew in each.
            low = np.minimum.accumulate(v[order][by] - run * (n + 1))
            best[asked[met]] = np.minimum(best[asked[met]], low[to[met] - 1] + at[met] * (n + 1))
    return size[q_cell], deep, both, least


def _floats(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(float, copy=False)


def _places(values: pa.ChunkedArray) -> np.ndarray:
    """The rows of a struct column in the order of its fields, nulls first."""
    flat = pa.Table.from_arrays(values.combine_chunks().flatten(), names=[f.name for f in values.type])
    return pc.sort_indices(flat, sort_keys=[(c, "ascending") for c in flat.column_names], null_placement="at_start").to_numpy()


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells from rows sorted by cell."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BUNDLE or not batch.num_rows:
            continue
        table = pa.Table.from_batches(held)
        cell = table.column("_cell").combine_chunks()
        last = pc.index(cell, cell[-1]).as_py()             # rows of one cell lie together
        if last:
            yield table.slice(0, last)
            held = table.slice(last).to_batches()
            rows -= last
    if rows:
        yield pa.Table.from_batches(held)


def count_cells(kept: list[str], best: dict[str, str]):
    """Rows sorted by ``_cell`` to the queries among them (``_asks``), with ``total``, ``deep``, ``both`` and the columns of ``best``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            code = table.column("_cell").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            asks = table.column("_asks").to_numpy()
            has = np.bincount(code[~asks], minlength=int(code.max()) + 1) > 0
            if not (asks & has[code]).any():
                continue
            asking = asks & has[code]
            points, queries = table.filter(pa.array(~asks)), table.filter(pa.array(asking))
            order = {c: _places(points.column(c)) for c in best}
            values = []
            for c, how in best.items():
                rank = np.empty(points.num_rows, np.int64)
                rank[order[c]] = np.arange(points.num_rows)
                values.append(rank if how == "min" else points.num_rows - 1 - rank)
            total, deep, both, least = dominated(
                code[~asks], _floats(points, "_x"), _floats(points, "_y"),
                code[asking], _floats(queries, "_x"), _floats(queries, "_y"), values)
            columns = [queries.column(c) for c in kept] + [pa.array(a, pa.int64()) for a in (total, deep, both)]
            for (c, how), got in zip(best.items(), least):
                none = got == points.num_rows
                got = np.where(none, 0, got)
                at = order[c][got if how == "min" else points.num_rows - 1 - got]
                columns.append(points.column(c).combine_chunks().take(pa.array(at.astype(np.int64), mask=none)))
            yield from pa.Table.from_arrays(columns, names=[*kept, "total", "deep", "both", *best]).to_batches()
    return run


class Berths:
    """Points of a cell with the stretches in which they are taken, and the first start each query finds among them."""

    def __init__(self, table: pa.Table):
        self.x, self.y = _floats(table, "_x"), _floats(table, "_y")
        self.turn = pc.fill_null(table.column("_turn").cast(pa.int64()), LONG_AGO).to_numpy()
        taken = table.column("_taken").combine_chunks()
        counts = pc.list_value_length(taken).to_numpy().astype(np.int64)
        self.first = np.cumsum(counts) - counts
        stretches = taken.flatten()
        self.to = stretches.field("to").to_numpy()
        self.owner = np.repeat(np.arange(len(counts)), 2 * counts)
        self.edges = np.stack([stretches.field("from").to_numpy(), self.to], axis=1).ravel()

    def starts(self, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query the point with the earliest start from ``t`` on (the least turn of several; -1: no point accepts it) and
        that start.  Points that don't change state between the first and the last query are asked together; the
        others are compared one by one where they are few, else the queries are halved in time."""
        px, qx, _ = _falling(self.x, x)
        py, qy, _ = _falling(self.y, y)
        by_time = np.argsort(t, kind="stable")
        qx, qy, t = qx[by_time], qy[by_time], t[by_time]
        times = np.unique(np.concatenate([self.edges, t]))
        n_t, at = len(times), np.searchsorted(times, t)
        edges = self.owner * n_t + np.searchsorted(times, self.edges)
        spot, start = np.full(len(t), -1), np.full(len(t), 1 << 62)
        turn = np.full(len(t), 1 << 62)

        def passed(point, when):                # edges of a point up to an instant: an odd number while it is taken
            return np.searchsorted(edges, point * n_t + when, side="right") - 2 * self.first[point]

        def until(point, done):                 # when it is free: long ago, or at the end of the stretch
            free = np.full(len(point), LONG_AGO)
            odd = done & 1 == 1
            free[odd] = self.to[self.first[point[odd]] + (done[odd] >> 1)]
            return free

        def offer(query, point, free):
            begin, mine = np.maximum(free, t[query]), self.turn[point]
            wins = (begin < start[query]) | ((begin == start[query]) & (mine < turn[query])) | (spot[query] < 0)
            query, point = query[wins], point[wins]
            spot[query], start[query], turn[query] = point, begin[wins], mine[wins]

        todo = [(np.arange(len(px)), 0, len(t))]
        while todo:
            points, lo, hi = todo.pop()
            done = passed(points, at[lo])
            still = done == passed(points, at[hi - 1])
            fixed, moving = points[still], points[~still]
            if len(fixed):
                free = until(fixed, done[still])
                order = np.lexsort((self.turn[fixed], free))
                rank = np.empty(len(fixed), np.int64)
                rank[order] = np.arange(len(fixed))
                zero = np.zeros(len(fixed), np.int64)
                got = dominated(zero, -px[fixed], -py[fixed], np.zeros(hi - lo, np.int64), -qx[lo:hi], -qy[lo:hi], [rank])[3][0]
                met = np.flatnonzero(got < len(fixed))
                offer(lo + met, fixed[order[got[met]]], free[order[got[met]]])
            if len(moving) * (hi - lo) > PAIRS:
                mid = (lo + hi) // 2
                todo += [(moving, lo, mid), (moving, mid, hi)]
            elif len(moving):
                q, p = np.nonzero((px[moving] <= qx[lo:hi, None]) & (py[moving] <= qy[lo:hi, None]))
                q, p = q + lo, moving[p]
                free = until(p, passed(p, at[q]))
                order = np.lexsort((self.turn[p], np.maximum(free, t[q]), q))
                q, p, free = q[order], p[order], free[order]
                lead = np.flatnonzero(np.diff(q, prepend=-1))
                offer(q[lead], p[lead], free[lead])
        back = np.empty(len(t), np.int64)
        back[by_time] = np.arange(len(t))
        return spot[back], start[back]


def start_cells(kept: list[str], made: list[str]):
    """Rows sorted by ``_cell``, points first, to the queries among them that a point accepts, with the point's ``made`` columns and
    ``_slot`` (null where the query has no ``_t``).  The points of one cell and up to ``BUNDLE`` of its queries are held."""
    def answered(points: pa.Table, held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        berths, queries = Berths(points), pa.concat_tables(held)
        t = queries.column("_t")
        spot, start = berths.starts(_floats(queries, "_x"), _floats(queries, "_y"), pc.fill_null(t, LONG_AGO).to_numpy())
        met = pa.array(spot >= 0)
        slot = pa.array(start, pa.int64(), mask=t.is_null().to_numpy())
        chosen = points.take(pa.array(spot[spot >= 0]))
        queries = queries.filter(met)
        columns = [queries.column(c) for c in kept] + [chosen.column(c) for c in made] + [slot.filter(met)]
        yield from pa.Table.from_arrays(columns, names=[*kept, *made, "_slot"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, points, held, rows = None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            code = table.column("_cell").combine_chunks().dictionary_encode()
            cuts = np.flatnonzero(np.diff(code.indices.to_numpy(), prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = table.slice(lo, hi - lo)
                name = part.column("_cell")[0].as_py()
                if name != cell:
                    if points and held:
                        yield from answered(pa.concat_tables(points), held)
                    cell, points, held, rows = name, [], [], 0
                asks = part.column("_asks")
                if not asks[0].as_py():
                    points.append(part.filter(pc.invert(asks)))
                if points and asks[-1].as_py():
                    held.append(part.filter(asks))
                    rows += held[-1].num_rows
                if rows > BUNDLE:
                    yield from answered(pa.concat_tables(points), held)
                    held, rows = [], 0
        if points and held:
            yield from answered(pa.concat_tables(points), held)
    return run
