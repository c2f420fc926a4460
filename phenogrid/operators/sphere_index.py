"""Nearest targets of many sites inside a task, by a cube index over an array of targets.

Positions are points on the unit sphere. Targets are sorted by cube for every size asked for; in the smallest size, no
cube holds more than a few targets (but for targets some ten metres apart). A site looks at the 27 cubes around it; whatever is
nearer than a cube's edge lies in them, so a site whose k-th target is that near is done, and only the others go on to
cubes of twice the size. All sites of a batch go through a size together.
"""

from __future__ import annotations

import numpy as np

_PAIRS = 2_000_000
_FEW = 8
_FINEST = 4e-6
_STEPS = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], dtype=np.int64)


def unit(lat, lon) -> np.ndarray:
    la, lo = np.radians(np.asarray(lat, dtype=float)), np.radians(np.asarray(lon, dtype=float))
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


class SphereIndex:
    """Targets by position; ``order`` ranks their ids and decides between equal distances."""

    def __init__(self, lat, lon, order: np.ndarray):
        self.at = unit(lat, lon)
        self.lat, self.lon = np.radians(np.asarray(lat, dtype=float)), np.radians(np.asarray(lon, dtype=float))
        self.order = np.asarray(order)
        self.levels: dict[int, tuple] = {}
        # an even spread over the sphere would put some two targets into a cube; a city needs smaller ones
        self.smallest = min(2.0, float(np.sqrt(4 * np.pi * 2 / max(len(self.at), 1))))
        while len(self.at) and self.smallest > _FINEST and self._fullest(0) > _FEW:
            self.smallest /= 2
            self.levels.clear()

    def _level(self, level: int):
        if level not in self.levels:
            keys = self._keys(np.floor(self.at / (self.smallest * 2 ** level)).astype(np.int64))
            rows = np.argsort(keys, kind="stable")
            self.levels[level] = (keys[rows], rows)
        return self.levels[level]

    @staticmethod
    def _keys(cubes: np.ndarray) -> np.ndarray:
        shifted = cubes + (1 << 20)
        return (shifted[..., 0] << 42) | (shifted[..., 1] << 21) | shifted[..., 2]

    def _km(self, lat: np.ndarray, lon: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Half the central angle's sine, squared: grows with the distance and is exact for near points."""
        dp, dl = self.lat[target] - lat, self.lon[target] - lon
        return np.sin(dp / 2) ** 2 + np.cos(lat) * np.cos(self.lat[target]) * np.sin(dl / 2) ** 2

    def nearest(self, lat, lon, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(site, target, rank) of the k nearest targets of every site, fewer only where there are fewer."""
        lat, lon = np.asarray(lat, dtype=float), np.asarray(lon, dtype=float)
        open_ = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon)) if len(self.at) else np.zeros(0, dtype=np.int64)
        found, level = [], 0
        while len(open_):
            left = [open_[:0]]
            # a part's pairs are bounded, unless one site alone has more
            width = max(1, _PAIRS // max(1, 27 * self._fullest(level)))
            for at in range(0, len(open_), width):
                part = open_[at:at + width]
                rest = self._search(part, lat, lon, k, level, found)
                left.append(rest)
            open_, level = np.concatenate(left), level + 1
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def _fullest(self, level: int) -> int:
        keys, _ = self._level(level)
        cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1, append=keys[-1] + 1))
        return int(np.diff(cuts).max())

    def _search(self, part, lat, lon, k, level, found) -> np.ndarray:
        edge = self.smallest * 2 ** level
        keys, rows = self._level(level)
        cubes = np.floor(unit(lat[part], lon[part]) / edge).astype(np.int64)
        around = self._keys(cubes[:, None, :] + _STEPS[None])
        low, high = np.searchsorted(keys, around), np.searchsorted(keys, around, side="right")
        sizes = (high - low).ravel()
        site = np.repeat(np.repeat(np.arange(len(part)), 27), sizes)
        starts = np.repeat(low.ravel() - (np.cumsum(sizes) - sizes), sizes)
        target = rows[starts + np.arange(len(site))]
        far = self._km(np.radians(lat[part])[site], np.radians(lon[part])[site], target)
        best = np.lexsort((self.order[target], far, site))
        site, target, far = site[best], target[best], far[best]
        first = np.searchsorted(site, np.arange(len(part)))
        rank = np.arange(len(site)) - first[site]
        # the k-th target of a finished site is nearer than an edge: 4 * far is the squared chord
        whole = edge >= 2.0
        last = np.full(len(part), np.inf)
        kth = rank == k - 1
        last[site[kth]] = far[kth]
        done = np.full(len(part), True) if whole else 4 * last <= edge * edge * (1 - 1e-9)
        take = done[site] & (rank < k)
        found.append((part[site[take]], target[take], rank[take] + 1))
        return part[~done]
