"""Gradient-boosted trees (logistic loss, histogram splits) over any number of rows.

``grow`` sees only sums of gradients per (class, node, feature, bin), so its rows may be arrays (``LocalSums``) or a
distributed table (``SparkSums``: one job per level sums every row where it lies; margins are staged every
``STAGE_ROUNDS`` rounds). Gradients are whole numbers of 1 / scale whose sums stay below 2 ** 53: the order of
summation changes nothing, and both give the same trees."""

from __future__ import annotations

from pyspark.sql.types import StructType


class Boosted:
    """Complete trees of one depth: per inner node a feature and a threshold (x > threshold goes right)."""

    def __init__(self, base: float, features, thresholds, leaves):
        self.base, self.features, self.thresholds, self.leaves = base, features, thresholds, leaves

    def margin(self, x):
        import numpy as np

        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - len(f)]
        return out

    def probability(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


#: Bins of a feature at most, the bin of no split, rounds between two stagings of the margins, and rows a task sums at a time.
BINS, NEVER, STAGE_ROUNDS, BLOCK_ROWS = 32, 255, 8, 32_768


def _walk(v, features, bins, levels: int):
    """The node of each row within level ``levels`` of one tree over binned features."""
    import numpy as np

    rows, node = np.arange(len(v)), np.zeros(len(v), dtype=np.int64)
    for level in range(levels):
        here = 2 ** level - 1 + node
        node = 2 * node + (v[rows, features[here]] > bins[here])
    return node


def _add(margin, v, trees) -> None:
    """Adds whole trees (features, bins, leaves: a row per class) to the margins, a column per class."""
    for features, bins, leaves in trees:
        for k in range(margin.shape[1]):
            margin[:, k] += leaves[k][_walk(v, features[k], bins[k], len(leaves[k]).bit_length() - 1)]


def _level(v, right, w, margin, features, bins, level: int, scale: float):
    """Sums of gradients and curvatures by (class, node, feature, bin)."""
    import numpy as np

    width, m = 2 ** level, v.shape[1]
    out = np.zeros((2, margin.shape[1], width, m, BINS))
    for k in range(margin.shape[1]):
        mine = np.flatnonzero(w[:, k])
        x = v if len(mine) == len(v) else v[mine]
        p = 1 / (1 + np.exp(-np.clip(margin[mine, k], -40, 40)))
        at = _walk(x, features[k], bins[k], level) * BINS
        sums = [np.rint(scale * w[mine, k] * of) for of in (p - right[mine, k], p * (1 - p))]
        x = np.ascontiguousarray(x.T)
        for j in range(m):
            cell = at + x[j]
            for i in (0, 1):
                out[i, k, :, j] += np.bincount(cell, sums[i], width * BINS).reshape(width, BINS)
    return out


class LocalSums:
    """Binned rows (uint8) held as arrays. ``right`` and ``w`` (weights): a column per class."""

    def __init__(self, v, right, w, scale: float):
        self.v, self.right, self.w, self.scale, self.margin, self.seen = v, right, w, scale, None, 0

    def __call__(self, base, trees, features, bins, level: int):
        import numpy as np

        if self.margin is None:
            self.margin = np.tile(np.array(base), (len(self.v), 1))
        _add(self.margin, self.v, trees[self.seen:])
        self.seen = len(trees)
        return _level(self.v, self.right, self.w, self.margin, features, bins, level, self.scale)


class SparkSums:
    """Rows of a table (y int, n bigint, v binary: the bins, and others that stay). ``rights``: an Arrow table of such rows
    -> ``right`` and ``w`` of ``LocalSums``; ``classes``: how many; ``stage``: writes a DataFrame and reads it back."""

    def __init__(self, rows, rights, classes: int, scale: float, stage):
        self.rows, self.rights, self.classes, self.scale, self.stage, self.seen = rows, rights, classes, scale, stage, 0

    def _blocks(self):
        rights = self.rights

        def blocks(batches, base, trees):
            import numpy as np
            import pyarrow as pa

            def worked(held):
                t = pa.Table.from_batches(held)
                of = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind).reshape(len(t), -1)
                v = of("v", np.uint8)
                margin = of("m", "<f8").copy() if "m" in t.column_names else np.tile(np.array(base), (len(t), 1))
                _add(margin, v, trees)
                return t, v, *rights(t), margin

            held, count = [], 0
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    count += b.num_rows
                if count >= BLOCK_ROWS:
                    yield worked(held)
                    held, count = [], 0
            if held:
                yield worked(held)

        return blocks

    def __call__(self, base, trees, features, bins, level: int):
        import numpy as np

        blocks, scale = self._blocks(), self.scale
        if len(trees) - self.seen >= STAGE_ROUNDS:
            new, kept = trees[self.seen:], [f for f in self.rows.schema.fields if f.name != "m"]
            names = [f.name for f in kept]

            def remember(batches):
                import pyarrow as pa

                for t, _, _, _, margin in blocks(batches, base, new):
                    m = pa.array([x.astype("<f8").tobytes() for x in margin], pa.binary())
                    yield from t.select(names).append_column("m", m).combine_chunks().to_batches()

            self.rows = self.stage(self.rows.mapInArrow(remember, StructType(kept).add("m", "binary")))
            self.seen = len(trees)
        new = trees[self.seen:]

        def sums(batches):
            import pyarrow as pa

            total = None
            for _, v, right, w, margin in blocks(batches, base, new):
                got = _level(v, right, w, margin, features, bins, level, scale)
                total = got if total is None else total + got
            if total is not None:
                g, h = total.reshape(2, -1)
                at = np.flatnonzero((g != 0) | (h != 0))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g[at]), pa.array(h[at])], ["slot", "g", "h"])

        m = len(self.rows.select("v").first().v)
        t = self.rows.mapInArrow(sums, "slot bigint, g double, h double").groupBy("slot").agg({"g": "sum", "h": "sum"}).toArrow()
        out = np.zeros((2, self.classes * 2 ** level * m * BINS))
        out[0, t["slot"].to_numpy()], out[1, t["slot"].to_numpy()] = t["sum(g)"].to_numpy(), t["sum(h)"].to_numpy()
        return out.reshape(2, self.classes, 2 ** level, m, BINS)


def grow(sums, means, cuts, scale: float, rounds: int = 40, depth: int = 3, rate: float = 0.25, ridge: float = 1.0) -> list[Boosted]:
    """One model per class, grown side by side. ``means``: the classes' shares of the weight; ``cuts``: per feature the
    ascending thresholds between its bins (fewer than ``BINS``)."""
    import numpy as np

    means = np.clip(means, 1e-4, 1 - 1e-4)
    base = np.log(means / (1 - means)).tolist()
    models, trees = [Boosted(b, [], [], []) for b in base], []
    allowed = np.array([np.arange(BINS - 1) < len(c) for c in cuts])
    for _ in range(rounds):
        features, bins = (np.full((len(base), 2 ** depth - 1), x, dtype=np.int64) for x in (0, NEVER))
        leaves = np.zeros((len(base), 2 ** depth))
        for level in range(depth):
            width = 2 ** level
            left = np.cumsum(sums(base, trees, features, bins, level) / scale, axis=-1)  # up to and with each bin
            total, left = left[:, :, :, :1, -1:], left[..., :-1]
            score = lambda x: x[0] ** 2 / (x[1] + ridge)
            gain = np.where(allowed, score(left) + score(total - left) - score(total), -np.inf).reshape(len(base), width, -1)
            top = gain.argmax(axis=-1)
            for k, node in np.ndindex(top.shape):
                j, b = divmod(int(top[k, node]), BINS - 1)
                at, all_ = width - 1 + node, total[:, k, node, 0, 0]
                split = gain[k, node, top[k, node]] > 1e-9
                if split:
                    features[k, at], bins[k, at] = j, b
                if level == depth - 1:
                    first = left[:, k, node, j, b] if split else all_
                    for side, (g, h) in enumerate((first, all_ - first)):
                        leaves[k, 2 * node + side] = -rate * g / (h + ridge)
        trees.append((features, bins, leaves))
        for k, model in enumerate(models):
            model.features.append(features[k])
            model.thresholds.append(np.array([np.inf if b == NEVER else cuts[f][b] for f, b in zip(features[k], bins[k], strict=True)]))
            model.leaves.append(leaves[k])
    return models


def fit(x, y, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = BINS, ridge: float = 1.0) -> Boosted:
    """x: rows by features; y: 0 or 1; all in arrays."""
    import numpy as np

    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    v = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1).astype(np.uint8)
    scale = whole_scale(len(x))
    return grow(LocalSums(v, y[:, None], np.ones((len(x), 1)), scale), np.array([y.mean()]), cuts, scale, rounds, depth, rate, ridge)[0]


def whole_scale(weight: float) -> float:
    """The power of two that keeps sums of gradients over this weight exact."""
    import math

    return 2.0 ** (51 - math.ceil(math.log2(max(weight, 1))))
