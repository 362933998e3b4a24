"""Neighbourhoods of one block of stations, and what is computed around each station (numpy, inside one task)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..config import EARTH_RADIUS_KM

# Cells of a neighbours x times table that are filled at once.
CELLS = 1_000_000
# A block's readings are held as a table of stations x times while it has at most so many cells a reading.
SPARSE = 8


class Places:
    """Station rows of a block; ``ids`` are its distinct stations, ``of`` tells the station of each row."""

    def __init__(self, sid, lat, lon, elev, known, max_km: float, max_elev: float | None, pass_unknown: bool):
        self.ids, self.of = np.unique(sid, return_inverse=True)
        order = np.argsort(lat, kind="stable")
        self.of, self.lat, self.lon, self.elev, self.known = self.of[order], lat[order], lon[order], elev[order], known[order]
        self.max_km, self.max_elev, self.pass_unknown = max_km, max_elev, pass_unknown
        a, b = np.radians(self.lat), np.radians(self.lon)
        self.unit = np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])
        self.reach = np.degrees(max_km / EARTH_RADIUS_KM) * 1.0001
        self.most = np.sin(min(max_km / EARTH_RADIUS_KM / 2, np.pi / 2))**2
        by_id = np.argsort(self.of, kind="stable")
        self.rows = np.split(by_id, np.cumsum(np.bincount(self.of, minlength=len(self.ids)))[:-1]) if len(self.ids) else []

    def km(self, row: int, rows: np.ndarray) -> np.ndarray:
        lat, lon, other, far = (np.radians(x) for x in (self.lat[row], self.lon[row], self.lat[rows], self.lon[rows]))
        half = np.sin((other - lat) / 2)**2 + np.cos(lat) * np.cos(other) * np.sin((far - lon) / 2)**2
        return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(half)))

    def around(self, row: int) -> np.ndarray:
        """The rows of other stations within the limits of a row."""
        lat = self.lat[row]
        if not np.isfinite(lat) or not np.isfinite(self.lon[row]):
            return np.empty(0, np.int64)
        lo, hi = int(np.searchsorted(self.lat, lat - self.reach)), int(np.searchsorted(self.lat, lat + self.reach, "right"))
        x, y, z = self.unit[:, lo:hi]
        half = ((x - self.unit[0, row])**2 + (y - self.unit[1, row])**2 + (z - self.unit[2, row])**2) / 4
        # The chord tells all but the places at the very limit, which the formula of the edges tells.
        margin = self.most * 1e-9 + 1e-14
        found = np.flatnonzero(half <= self.most + margin) + lo
        edge = half[found - lo] >= self.most - margin
        if edge.any():
            close = np.ones(len(found), bool)
            close[edge] = self.km(row, found[edge]) <= self.max_km
            found = found[close]
        keep = self.of[found] != self.of[row]
        if self.max_elev is not None:
            both = self.known[found] & self.known[row]
            keep &= np.where(both, np.abs(self.elev[row] - self.elev[found]) <= self.max_elev, self.pass_unknown)
        return found[keep]

    def edges(self, i: int) -> np.ndarray:
        """The stations that the edges of station ``i`` lead to, in order, as often as there are edges."""
        return np.sort(np.concatenate([self.of[self.around(r)] for r in self.rows[i]]))

    def members(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct stations that the edges of station ``i`` lead to, and how many edges lead to each."""
        return np.unique(self.edges(i), return_counts=True)


def median(x: np.ndarray) -> float:
    """Of sorted values; NaN counts as the largest."""
    return x[(len(x) - 1) // 2] * 0.5 + x[len(x) // 2] * 0.5


def spread(x: np.ndarray) -> float:
    """Population standard deviation; exactly 0 for equal values."""
    d = x - x[0]
    return float(np.sqrt(((d - d.mean())**2).mean()))


def centre(x: np.ndarray) -> tuple[float, float, float]:
    """Median, population standard deviation, and median distance from the median."""
    half = [(len(x) - 1) // 2, len(x) // 2]
    middle = median(np.partition(x, half))
    return middle, spread(x), median(np.partition(np.abs(x - middle), half))


class Readings:
    """The readings of a block: for each station its times (as places in ``times``), values, and which of them are there."""

    def __init__(self, ids: np.ndarray, sid, time, value, there):
        at = np.searchsorted(ids, sid)
        known = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == sid) if len(ids) else np.zeros(len(sid), bool)
        at, time, value, there = at[known], time[known], value[known], there[known]
        order = np.lexsort((time, at))
        self.at, time, self.value, self.there = at[order], time[order], value[order], there[order]
        self.times, self.code = np.unique(time, return_inverse=True)
        self.at, self.code = self.at.astype(np.int32), self.code.astype(np.int32)
        self.start = np.searchsorted(self.at, np.arange(len(ids) + 1))
        self.repeats = bool(((self.at[1:] == self.at[:-1]) & (self.code[1:] == self.code[:-1])).any())
        self.table = None
        if not self.repeats and len(ids) * len(self.times) <= SPARSE * max(len(self.at), 1):
            self.table = self._table(self.at, np.arange(len(self.at)), self.code, len(ids), len(self.times))

    def _table(self, row, rows, column, n, width) -> tuple[np.ndarray, np.ndarray]:
        """Values, and 0 for no row, 1 for a row without a value, 2 for a value."""
        value, state = np.zeros((n, width)), np.zeros((n, width), np.uint8)
        value[row, column], state[row, column] = self.value[rows], np.where(self.there[rows], 2, 1)
        return value, state

    def between(self, first: int, last: int) -> tuple[int, int]:
        return int(np.searchsorted(self.times, first)), int(np.searchsorted(self.times, last, "right"))

    def window(self, stations: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The stations with a row at times ``lo`` to ``hi``; values and states at the times of any of them; the time of each column.

        A time has as many columns as the station that repeats it most; no station repeats a time as a rule.
        """
        if self.table is not None:
            value, state = (t[:, lo:hi] for t in self.table)
            if len(stations) < len(value):
                value, state = value[stations], state[stations]
            some, columns = state.any(axis=1), state.any(axis=0)
            if not some.all():
                value, state = value[some], state[some]
            if not columns.all():
                value, state = value[:, columns], state[:, columns]
            return stations[some], value, state, lo + np.flatnonzero(columns)
        parts = [np.arange(self.start[s], self.start[s + 1]) for s in stations]
        parts = [p[slice(*np.searchsorted(self.code[p], [lo, hi]))] for p in parts]
        size = np.array([len(p) for p in parts], np.int64)
        rows, row = np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.cumsum(size > 0) - 1, size)
        code = self.code[rows]
        first = np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])[:len(rows)]
        copy = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0)) if len(rows) else rows
        columns, column = np.unique(np.stack([code, copy]), axis=1, return_inverse=True)
        value, state = self._table(row, rows, column.ravel(), int((size > 0).sum()), columns.shape[1])
        return stations[size > 0], value, state, columns[0]


def fill(value: np.ndarray, state: np.ndarray, column: np.ndarray, time: np.ndarray, copies: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values with gaps filled linearly in time, at most ``limit`` rows from a reading; the rows with a value of each cell, and all rows.

    ``column`` is the time of a column, ``time`` its microseconds. Rows that come ``copies`` times count as often; a time without a row
    is one.
    """
    there = state == 2
    n, width = value.shape
    at = np.arange(width)
    before = np.maximum.accumulate(np.where(there, at, -1), axis=1)
    after = np.minimum.accumulate(np.where(there, at, width)[:, ::-1], axis=1)[:, ::-1]
    has_before, has_after = before >= 0, after < width
    before, after = np.maximum(before, 0), np.minimum(after, width - 1)
    first_of_time = np.concatenate([[True], column[1:] != column[:-1]])[:width]
    if first_of_time.all() and (copies == 1).all():
        rows = np.ones((n, width), np.int64)
        near = (has_before & (at - before <= limit)) | (has_after & (after - at <= limit))
        filled = near.astype(np.int64)
    else:
        seen = np.logical_or.reduceat(state > 0, np.flatnonzero(first_of_time), axis=1)[:, np.cumsum(first_of_time) - 1]
        lonely = first_of_time & ~seen
        rows = np.where(state > 0, copies[:, None], lonely)
        begin = np.cumsum(rows, axis=1) - rows
        last = np.take_along_axis(begin + rows - 1, before, 1)
        following = np.take_along_axis(begin, after, 1)
        from_before = np.where(has_before, np.clip(limit + 1 + last - begin, 0, rows), 0)
        from_after = np.where(has_after, np.clip(rows - (following - limit - begin), 0, rows), 0)
        filled = np.where(there, rows, np.minimum(rows, from_before + from_after))
    p, q = np.take_along_axis(value, before, 1), np.take_along_axis(value, after, 1)
    tp, tq = time[before], time[after]
    with np.errstate(invalid="ignore", divide="ignore"):
        inner = p + (q - p) * ((time - tp) / (tq - tp))
    out = np.where(has_before & has_after, inner, np.where(has_before, p, q))
    return np.where(there, value, out), filled, rows


def correlations(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of ``x`` with each row of ``y``, weighted (0: left out); NaN with a False in the second array where one side is constant."""
    total = weight.sum(axis=1)
    some = np.argmax(weight > 0, axis=1)
    share = weight / np.maximum(total, 1)[:, None]

    def moved(v):
        d = np.where(weight > 0, v - np.take_along_axis(v, some[:, None], 1), 0.0)
        return np.where(weight > 0, d - (d * share).sum(axis=1)[:, None], 0.0)

    dx, dy = moved(np.broadcast_to(x, y.shape)), moved(y)
    return _ratio((dx * dy * share).sum(axis=1), (dx * dx * share).sum(axis=1), (dy * dy * share).sum(axis=1))


def _ratio(cov, xx, yy):
    below = np.sqrt(xx) * np.sqrt(yy)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(below == 0, np.nan, cov / below), below != 0


class Around:
    """The windows around the anomalies of a block."""

    def __init__(self, places: Places, readings: Readings, width: int):
        self.places, self.readings, self.width = places, readings, width
        self._of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._filled_at, self._filled = None, None

    def members(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours with the number of edges to each, and the station itself once it has one."""
        if i not in self._of:
            if len(self._of) > 256:
                self._of.clear()
            found, edges = self.places.members(i)
            at = np.searchsorted(found, i)
            self._of[i] = (np.insert(found, at, i), np.insert(edges, at, 1)) if len(found) else (found, edges)
        return self._of[i]

    def _whole(self, lo: int, hi: int, limit: int):
        """The filled table of all stations of the block at these times, kept while anomalies ask for the same."""
        if self._filled_at != (lo, hi, limit):
            value, state = (t[:, lo:hi] for t in self.readings.table)
            column, n = np.arange(lo, hi), len(state)
            step = max(1, CELLS // max(hi - lo, 1))
            parts = [fill(value[k:k + step], state[k:k + step], column, self.readings.times[column], np.ones(len(value[k:k + step]), np.int64), limit)[:2]
                     for k in range(0, n, step)]
            some = state.any(axis=1)
            self._filled_at, self._filled = (lo, hi, limit), (state > 0, some, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) > 0)
        return self._filled

    def aligned(self, i: int, time: int, limit: int, asked: int = 1) -> Iterator[tuple]:
        """Slices of the members that have a row around ``time``: stations, filled values, the rows with a value of each cell, all rows, the
        time of each column. An anomaly that is ``asked`` for several times has its rows as often."""
        stations, copies = self.members(i)
        copies = copies * asked
        lo, hi = self.readings.between(time - self.width, time + self.width)
        if not len(stations) or lo >= hi:
            return
        if self.readings.table is not None and (copies == 1).all():
            has, some, filled, there = self._whole(lo, hi, limit)
            stations = stations[some[stations]]
            if len(stations) and has[stations].any(axis=0).all():
                there = there[stations]
                yield stations, filled[stations], there, np.ones((1, 1), bool), np.arange(lo, hi)
                return
        found, value, state, column = self.readings.window(stations, lo, hi)
        if not len(found):
            return
        copies = copies[np.searchsorted(stations, found)]
        step = max(1, CELLS // len(column))
        for k in range(0, len(found), step):
            part = slice(k, k + step)
            yield found[part], *fill(value[part], state[part], column, self.readings.times[column], copies[part], limit), column

    def whole(self, i: int, time: int, limit: int, asked: int = 1) -> tuple | None:
        """``aligned`` in one piece with what holds per time: the target's values (and which are there), and where all have a value."""
        parts = list(self.aligned(i, time, limit, asked))
        if not parts:
            return None
        column = parts[0][4]
        first = np.concatenate([[True], column[1:] != column[:-1]])
        complete = np.ones(len(column), bool)
        target, known = np.zeros(len(column)), np.zeros(len(column), bool)
        for stations, filled, there, rows, _ in parts:
            complete &= (there == rows).all(axis=0)
            own = np.flatnonzero(stations == i)
            if len(own):
                target, known = filled[own[0]], there[own[0]] > 0
        if not first.all():
            of, at = np.cumsum(first) - 1, np.flatnonzero(first)
            complete = np.logical_and.reduceat(complete, at)[of]
            target, known = np.maximum.reduceat(np.where(known, target, -np.inf), at)[of], np.logical_or.reduceat(known, at)[of]
        return parts, column, complete, target, known

    def pairs(self, i: int, time: int, pairwise: bool, limit: int, asked: int = 1) -> tuple | None:
        """Members, the rows used of each, correlations with the station, and which of these there are."""
        found = self.whole(i, time, limit, asked)
        if found is None:
            return None
        parts, column, complete, target, known = found
        out = []
        for stations, filled, there, _, _ in parts:
            if not pairwise and there.dtype == bool:
                points = np.full(len(stations), int(complete.sum()))
                use = np.flatnonzero(complete)
                if len(use) and known[use].all():
                    x, y = target[use], filled if len(use) == len(complete) else filled[:, use]
                    x, y = x - x[0], y - y[:, :1]
                    x, y = x - x.mean(), y - y.mean(axis=1)[:, None]
                    corr, valid = _ratio(y @ x / len(x), (x * x).mean(), np.einsum("ij,ij->i", y, y) / len(x))
                else:
                    corr, valid = np.full(len(stations), np.nan), np.zeros(len(stations), bool)
            else:
                used = there * (known if pairwise else complete)
                points = used.sum(axis=1)
                corr, valid = correlations(target, np.where(used > 0, filled, 0.0), np.where(known, used, 0))
            out.append((stations, points, corr, valid & (stations != i)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def shown(self, i: int, time: int, first: int, limit: int, asked: int = 1) -> tuple | None:
        """Times, stations, ranks and filled values where all members have one: of the station (rank 0) and its ``first`` neighbours."""
        found = self.whole(i, time, limit, asked)
        if found is None:
            return None
        parts, column, complete, _, _ = found
        out = []
        for rank, station in enumerate([i, *self.places.edges(i)[:first].tolist()]):
            for stations, filled, there, _, _ in parts:
                for k in np.flatnonzero(stations == station):
                    at = np.repeat(np.flatnonzero(complete), there[k][complete].astype(np.int64))
                    out.append((self.readings.times[column[at]], np.full(len(at), station), np.full(len(at), rank, np.int32), filled[k][at]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else None

    def last(self, i: int, time: int) -> np.ndarray:
        """The neighbours' last values up to ``time``, no older than the width."""
        stations, _ = self.members(i)
        stations = stations[stations != i]
        lo, hi = self.readings.between(time - self.width, time)
        if not len(stations) or lo >= hi:
            return np.empty(0)
        _, value, state, _ = self.readings.window(stations, lo, hi)
        there = state == 2
        value, there = value[there.any(axis=1)], there[there.any(axis=1)]
        at = there.shape[1] - 1 - np.argmax(there[:, ::-1], axis=1) if len(there) else np.empty(0, np.int64)
        return value[np.arange(len(value)), at]


class Snapshot:
    """One variable's values by station, each as often as it is given."""

    def __init__(self, n: int, at: np.ndarray, value: np.ndarray):
        order = np.argsort(at, kind="stable")
        self.value, self.count = value[order], np.bincount(at, minlength=n)
        self.start = np.cumsum(self.count) - self.count

    def of(self, stations: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of ``stations``, and the place in ``stations`` of each."""
        count = self.count[stations]
        place = np.repeat(np.arange(len(stations)), count)
        return self.value[self.start[stations][place] + np.arange(len(place)) - (np.cumsum(count) - count)[place]], place


def grid_rows(readings: Readings, stations: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of ``stations`` have rows, their rows on the times of any of them, and their values."""
    rows = readings.start[stations + 1] - readings.start[stations]
    stations, rows = stations[rows > 0], rows[rows > 0]
    if readings.table is not None:
        times = np.full(len(stations), readings.table[1][stations].any(axis=0).sum())
    else:
        codes = [readings.code[readings.start[s]:readings.start[s + 1]] for s in stations]
        distinct = [np.unique(c) for c in codes]
        times = len(np.unique(np.concatenate([*distinct, np.empty(0, np.int64)]))) + rows - np.array([len(d) for d in distinct], np.int64)
    values = np.concatenate([[0], np.cumsum(readings.there)])
    return stations, times, values[readings.start[stations + 1]] - values[readings.start[stations]]


def pair_moments(readings: Readings, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common readings of station ``i`` with each of ``others``, their correlation, and whether there is one."""
    if readings.table is not None:
        value, state = readings.table
        own = state[i] == 2
        if not own.any():
            return np.zeros(len(others), np.int64), np.full(len(others), np.nan), np.zeros(len(others), bool)
        out = []
        step = max(1, CELLS // int(own.sum()))
        for k in range(0, len(others), step):
            some = others[k:k + step]
            weight = (state[some] == 2)[:, own].astype(np.int64)
            out.append((weight.sum(axis=1), *correlations(value[i][own], value[some][:, own], weight)))
        if out:
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))
    points, corr, valid = np.zeros(len(others), np.int64), np.full(len(others), np.nan), np.zeros(len(others), bool)

    def of(s):
        rows = slice(readings.start[s], readings.start[s + 1])
        there = readings.there[rows]
        return readings.code[rows][there], readings.value[rows][there]

    at, x = of(i)
    for k, other in enumerate(others):
        there, y = of(other)
        lo, hi = np.searchsorted(there, at), np.searchsorted(there, at, "right")
        points[k] = (hi - lo).sum()
        if points[k]:
            mine = np.repeat(np.arange(len(at)), hi - lo)
            theirs = np.arange(points[k]) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            c, v = correlations(x[mine], y[theirs][None, :], np.ones((1, len(mine)), np.int64))
            corr[k], valid[k] = c[0], v[0]
    return points, corr, valid
