"""K-means for many models at once: every iteration is one pass over the points in which all
models that still move - every k and every restart - advance together.

Points are the distinct rows with their number of copies (a value that a third of the rows
hold is one point), packed into blocks. A task has an area of space, its blocks are cells of that,
cut into leaves of ``LEAF`` neighbouring points, with a box and sums for each leaf and for each
``FAN`` leaves, and so on. A pass goes down from the top with the centres that can be nearest to a
point of the box. A node with one such centre is added to it as a whole; only in leaves with several
points are measured, against those centres. Sums of weights and coordinates are kept for each
(model, centre); only those, at most (sum of k) x (columns + 1) numbers, reach the driver.

Results do not depend on how the rows are partitioned: coordinates lie on a grid of 2^-40, so
sums are sums of integers (two limbs) and the same in any order; starting centres are drawn by
a race of exponentials whose random numbers are hashes of a point's own coordinates. The race
gives each point the chance w d^2 / sum(w d^2) (its weight and squared distance to the nearest
centre so far): k-means++ over all rows, one pass for a centre of every restart. The first
centres of a restart serve all its k.

A model stops when the squared movements of its centres add up to at most the tolerance times
the variance of the columns (1, as they are z-scored), or at the iteration limit. A centre that
loses all its points stays where it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 12       # points in a block at most
LEAF = 1 << 6         # points in a leaf of a block
FAN = 1 << 4          # leaves, or nodes, under a node
CHUNK = 1 << 20       # points ordered in space at once
TASK_POINTS = 1 << 19  # points of a task, where there are more of them than a task for each core
AREAS = 1 << 8        # areas of space that are told apart when points are dealt to tasks; more tasks share areas
AREA_ROWS = 100       # rows drawn for each area to see where it ends
BLOCKS_AT_ONCE = 256  # blocks measured at once
PAIRS_AT_ONCE = 1 << 16  # centres of nodes, or points of leaves, measured at once
BLOCKS_ORDERED = 16   # blocks cut into leaves at once
CODEC = "zstd"        # of the points of a block
ROWS_AT_ONCE = 4      # blocks in a batch that Python gets: they are large, and larger batches cost more to build
LABELLED_AT_ONCE = 1 << 12  # rows labelled at once
COPIES = 1 << 12      # weight of a point at most; more copies are several points
GRID = float(1 << 40)
LIMB = 1 << 28        # sums of a leaf stay exact: 2^6 points x 2^12 copies x 2^28 < 2^53
NARROW = float(1 << 45)  # widest leaf, on the grid, whose points are kept as distances from its corner
EXACT = float(1 << 53)


def pack(rows: DataFrame, coordinates: Sequence[Column]) -> DataFrame:
    """Blocks (n, rows, leaves, data) of the distinct points of ``rows``. A block lies together in space and
    is cut into leaves of ``LEAF`` points, the last one filled up with copies of no weight. ``leaves`` has
    for each leaf its box and sums, ``data`` its points (columns, then weights unless all are 1: so many ``rows``; without loss compressed)."""
    p = len(coordinates)
    names = [f"z{j}" for j in range(p)]
    every = rows.select(*[c.alias(n) for c, n in zip(coordinates, names, strict=True)])
    points = every.groupBy(*names).agg(F.count(F.lit(1)).alias("w"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(w - 1) div {COPIES}")))
    points = points.withColumn("part", parts).withColumn("w", F.least(F.lit(COPIES), F.col("w") - F.col("part") * COPIES)).drop("part")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                if size + part.num_rows > CHUNK:
                    yield from cells(np.concatenate(held, 1))
                    held, size = [], 0
                values = np.array([part.column(c).to_numpy(zero_copy_only=False) for c in [*names, "w"]], np.float64)
                values[:p] = np.rint(values[:p] * GRID) / GRID
                values[:p] += 0.0  # no negative zeros: points are hashed by their bits
                held.append(values)
                size += part.num_rows
        if size:
            yield from cells(np.concatenate(held, 1))

    # a pass costs a task's start for each partition: as many as cores, unless the rows are very many. A task
    # gets an area of space, so that its leaves are small
    count = rows.count()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_POINTS))
    shared = -(-tasks // AREAS)
    area = areas(every, -(-tasks // shared), count)
    task = (area * shared + F.pmod(F.hash(*names), F.lit(shared))).cast("int")
    return points.repartitionById(-(-tasks // shared) * shared, task).mapInArrow(packed, "n int, rows int, leaves binary, data binary")


def areas(points: DataFrame, many: int, count: int) -> Column:
    """Number (0 to ``many`` - 1) of the area of a point: boxes with about as many distinct points each, as
    some drawn rows have it. Only where points are kept depends on it, no result."""
    names = points.columns
    drawn = points.sample(min(1.0, many * AREA_ROWS / count), 1) if count else points.limit(0)  # many x AREA_ROWS rows
    x = np.unique(np.array([tuple(r) for r in drawn.collect()], float).reshape(-1, len(names)), axis=0)

    def cut(x: np.ndarray, first: int, many: int) -> Column:
        if many == 1 or len(x) < 2:
            return F.lit(first)
        j = int((x.max(0) - x.min(0)).argmax())
        order = np.sort(x[:, j])
        limit = order[len(x) * (many // 2) // many]
        if not order[0] < limit:
            limit = order[np.searchsorted(order, limit, "right")] if order[-1] > limit else np.inf
        low = x[:, j] < limit
        if low.all() or not low.any():
            return F.lit(first)
        left = min(max(round(many * low.mean()), 1), many - 1)
        return F.when(F.col(names[j]) < F.lit(float(limit)), cut(x[low], first, left)).otherwise(cut(x[~low], first + left, many - left))

    return cut(x, 0, many)


def cells(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of points (columns, then weights) that lie together, leaf by leaf."""
    order = neighbours(values[:-1])
    for at in range(0, len(order), BLOCK):
        part = values[:, order[at:at + BLOCK]]
        n, spare = part.shape[1], -part.shape[1] % LEAF
        if spare:
            last = part[:, -1:].copy()
            last[-1] = 0
            part = np.concatenate([part, np.repeat(last, spare, 1)], 1)
        part = part.reshape(len(values), -1, LEAF)
        x, w = part[:-1] * GRID, part[-1]
        lo, hi = x.min(2), x.max(2)
        high = np.floor(x * (1 / LIMB))
        low = x - high * LIMB
        some = not (w == 1).all()
        if some:
            high *= w
            low *= w
        leaves = np.concatenate([lo, hi, high.sum(2), low.sum(2), w.sum(1)[None]]).T
        x -= corner(lo, hi)[:, :, None]
        yield block(n, np.ascontiguousarray(leaves), np.ascontiguousarray((np.concatenate([x, w[None]]) if some else x).transpose(1, 0, 2)))


def corner(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """What the points of leaves are measured from: differences are exact."""
    return np.where(hi - lo < NARROW, lo, 0.0)


def block(n: int, leaves: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    packed = pa.compress(pa.py_buffer(data), codec=CODEC, asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([data.shape[1]], pa.int32()), pa.array([leaves.tobytes()], pa.binary()), pa.array([packed], pa.binary())],
                                      names=["n", "rows", "leaves", "data"])


def neighbours(x: np.ndarray) -> np.ndarray:
    """An order of points (columns, points) in which those of a block, and in it of a leaf, lie
    together: halves at the middle of the widest column, again and again."""
    x, order = x.copy(), np.arange(x.shape[1])
    todo, full = [(0, len(order))], []
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            continue
        if b - a == BLOCK:  # full blocks are cut together
            full.append(a)
            continue
        unit = BLOCK if b - a > BLOCK else LEAF
        half = -(-(b - a) // (2 * unit)) * unit
        here = x[:, a:b]
        cut = np.argpartition(here[(here.max(1) - here.min(1)).argmax()], half)
        x[:, a:b], order[a:b] = here[:, cut], order[a:b][cut]
        todo += [(a, a + half), (a + half, b)]
    for i in range(0, len(full), BLOCKS_ORDERED):
        at = np.array(full[i:i + BLOCKS_ORDERED])[:, None] + np.arange(BLOCK)
        part, here = order[at], x[:, at]
        while part.shape[1] > LEAF:
            widest = (here.max(2) - here.min(2)).argmax(0)
            cut = np.argpartition(here[widest, np.arange(len(part))], part.shape[1] // 2, axis=1)
            part = np.take_along_axis(part, cut, 1).reshape(2 * len(part), -1)
            here = np.stack([np.take_along_axis(h, cut, 1) for h in here]).reshape(len(x), len(part), -1)
        order[at] = part.reshape(at.shape)
    return order


class Leaves:
    """The leaves of some blocks: boxes and corners on the grid, sums, and points from the corner."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        leaves = np.concatenate([x for x, _ in held])
        p = self.p = (leaves.shape[1] - 1) // 4
        self.lo, self.hi = leaves[:, :p], leaves[:, p:2 * p]
        self.corner = corner(self.lo, self.hi)
        self.whole = leaves[:, 2 * p:].astype(np.int64)  # high limbs, low limbs, weight
        self.local = np.concatenate([x[:, :p] for _, x in held])
        self.w = None
        if any(x.shape[1] > p for _, x in held):
            self.w = np.concatenate([x[:, p] if x.shape[1] > p else np.ones((len(x), LEAF)) for _, x in held])
        heaviest = 1.0 if self.w is None else self.w.max()
        reach = np.maximum(np.abs(self.lo - self.corner), np.abs(self.hi - self.corner))
        self.split = not reach.max() * heaviest * LEAF < EXACT

    def levels(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Boxes (lo, hi) in z units from the top nodes to the leaves; node i is above nodes FAN i to FAN i + FAN - 1."""
        out = [(self.lo / GRID, self.hi / GRID)]
        while len(out[0][0]) > 4 * FAN:
            at = np.arange(0, len(out[0][0]), FAN)
            out.insert(0, (np.minimum.reduceat(out[0][0], at), np.maximum.reduceat(out[0][1], at)))
        return out

    def sums(self, at: np.ndarray, local: np.ndarray, member: np.ndarray) -> np.ndarray:
        """High limbs, low limbs and weights (leaves, centres, 2 p + 1) of the members (leaves, centres, LEAF:
        weights) of the leaves ``at``, whose points are ``local``."""
        weight = member.sum(2)[:, :, None].astype(np.int64)
        high = np.floor(self.corner[at] / LIMB)
        low = (self.corner[at] - high * LIMB).astype(np.int64)[:, None, :] * weight
        high = high.astype(np.int64)[:, None, :] * weight
        points = local.transpose(0, 2, 1)
        if self.split:
            upper = np.floor(points / LIMB)
            high += np.matmul(member, upper).astype(np.int64)
            low += np.matmul(member, points - upper * LIMB).astype(np.int64)
        else:
            added = np.matmul(member, points).astype(np.int64)
            high += added // LIMB
            low += added % LIMB
        return np.concatenate([high, low, weight], 2)


@contextmanager
def few_at_once(blocks: DataFrame) -> Iterator[None]:
    """Jobs over the blocks get them in small batches."""
    conf, key = blocks.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = conf.get(key)
    conf.set(key, str(ROWS_AT_ONCE))
    try:
        yield
    finally:
        conf.set(key, held)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(points, leaves, data) of each block."""
    for batch in batches:
        for n, rows, leaves, data in zip(batch.column("n").to_pylist(), batch.column("rows").to_pylist(), batch.column("leaves"), batch.column("data"), strict=True):
            many = -(-n // LEAF)
            points = pa.decompress(data.as_buffer(), many * rows * LEAF * 8, codec=CODEC)
            yield n, np.frombuffer(leaves.as_buffer(), np.float64).reshape(many, -1), np.frombuffer(points, np.float64).reshape(many, rows, LEAF)


def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Leaves]:
    """The leaves of some blocks at a time."""
    held = []
    for _, leaves, data in blocks_of(batches):
        held.append((leaves, data))
        if len(held) == BLOCKS_AT_ONCE:
            yield Leaves(held)
            held = []
    if held:
        yield Leaves(held)


# ---------------------------------------------------------------- starting centres

def uniform(x: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) for each point (columns, points) from its bits and ``salt``."""
    with np.errstate(over="ignore"):
        h = np.array([0x9E3779B97F4A7C15], np.uint64)
        spare = h.copy()
        for word in [*(np.array([s], np.uint64) for s in salt), *x.view(np.uint64)]:
            if len(word) > len(h):
                h, spare = np.repeat(h, len(word)), np.empty(len(word), np.uint64)
            np.bitwise_xor(h, word, out=h)
            np.multiply(h, np.uint64(0xBF58476D1CE4E5B9), out=h)
            np.bitwise_xor(h, np.right_shift(h, np.uint64(27), out=spare), out=h)
            np.multiply(h, np.uint64(0x94D049BB133111EB), out=h)
            np.bitwise_xor(h, np.right_shift(h, np.uint64(31), out=spare), out=h)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def starts(blocks: DataFrame, k: int, restarts: int, seed: int, at_once: int = 1) -> list[np.ndarray]:
    """Starting centres of each restart, in the order drawn; fewer than ``k`` when there are not
    so many distinct points. ``at_once`` are drawn in a pass (1: exact k-means++). A point's distance to the
    centres is measured only if its random number could win at the farthest corner of its block."""
    chosen: list[list[tuple]] = [[] for _ in range(restarts)]
    for step in range(-(-k // at_once)):
        held = [np.array(c, float) for c in chosen]
        wanted = min(at_once, k - step * at_once)

        def race(batches: Iterator[pa.RecordBatch], held=held, step=step, wanted=wanted) -> Iterator[pa.RecordBatch]:
            first = [(np.empty(0), np.empty((0, 0))) for _ in held]  # the best keys so far and their points
            for n, leaves, data in blocks_of(batches):
                p = (leaves.shape[1] - 1) // 4
                lo, hi = leaves[:, :p], leaves[:, p:2 * p]
                x = ((data[:, :p] + corner(lo, hi)[:, :, None]) / GRID).transpose(1, 0, 2).reshape(p, -1)
                w = data[:, p].ravel() if data.shape[1] > p else np.ones(x.shape[1])
                lo, hi, heaviest = lo.min(0) / GRID, hi.max(0) / GRID, w.max()
                for r, centers in enumerate(held):
                    keys, points = first[r]
                    draw, some = uniform(x, seed, r, step), np.arange(x.shape[1])
                    if len(keys) == wanted:
                        most = heaviest
                        if len(centers):
                            most *= (np.maximum(np.abs(centers - lo), np.abs(centers - hi)) ** 2).sum(1).min()
                        some = np.flatnonzero(draw > np.exp(-keys[-1] * most * (1 + 1e-9)) * (1 - 1e-9))
                    here = np.ascontiguousarray(x[:, some].T)
                    rate = w[some] if not len(centers) else w[some] * nearest_exact(here, centers)
                    can = np.flatnonzero(rate > 0)
                    if not len(can):
                        continue
                    key = np.concatenate([keys, -np.log(draw[some[can]]) / rate[can]])
                    best = np.argsort(key, kind="stable")[:wanted]
                    first[r] = key[best], np.concatenate([points.reshape(-1, p), here[can]])[best]
            for r, (keys, points) in enumerate(first):
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([r] * len(keys), pa.int32()), pa.array(keys), pa.array(points.tolist(), pa.list_(pa.float64()))],
                                                     names=["restart", "key", "point"])

        drawn = blocks.mapInArrow(race, "restart int, key double, point array<double>")
        order = F.row_number().over(Window.partitionBy("restart").orderBy("key", "point"))
        with few_at_once(blocks):
            rows = drawn.withColumn("place", order).filter(F.col("place") <= wanted).orderBy("restart", "place").collect()  # restarts x wanted
        for r in rows:
            if tuple(r.point) not in chosen[r.restart]:
                chosen[r.restart].append(tuple(r.point))
        if len(rows) == 0:
            break
    return [np.array(c, float) for c in chosen if c]


def nearest_exact(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest centre, 0 for a point that is one."""
    out = np.full(len(x), np.inf)
    for c in centers:
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (x[:, j] - c[j]) ** 2
        np.minimum(out, d, out=out)
    return out


# ---------------------------------------------------------------- iterations

class Models:
    """The centres of some models, numbered through."""

    def __init__(self, models: Sequence[np.ndarray]) -> None:
        self.centers = np.concatenate(models)
        self.columns = np.ascontiguousarray(self.centers.T)
        self.norm = (self.centers * self.centers).sum(1)
        self.sizes = np.array([len(m) for m in models])
        self.first = np.cumsum(self.sizes) - self.sizes

    def everywhere(self, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, listed centres, how many of them) of all models at each node."""
        listed = self.first[:, None] + np.minimum(np.arange(self.sizes.max()), self.sizes[:, None] - 1)
        return np.repeat(np.arange(nodes), len(self.sizes)), np.tile(listed, (nodes, 1)), np.tile(self.sizes, nodes)

    def possible(self, lo: np.ndarray, hi: np.ndarray, listed: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(boxes, listed): whether a listed centre can be nearest to a point of the box, of the first ``count``
        listed. A centre is out if it is farther than the one nearest to the middle everywhere in the box, by
        more than what rounding may change."""
        rows, middle, half = np.arange(len(lo)), (lo + hi) / 2, (hi - lo) / 2
        at = [c[listed] for c in self.columns]
        norm = self.norm[listed]
        score = norm.copy()
        for j, c in enumerate(at):
            score -= (2.0 * middle[:, j])[:, None] * c
        able = np.arange(listed.shape[1]) < count[:, None]
        score[~able] = np.inf
        near = score.argmin(1)
        least = norm - norm[rows, near][:, None]
        for j, c in enumerate(at):
            gap = c - c[rows, near][:, None]
            least -= (2.0 * middle[:, j])[:, None] * gap
            least -= (2.0 * half[:, j])[:, None] * np.abs(gap, out=gap)
        slack = 1e-9 * (((np.abs(middle) + half) ** 2).sum(1) + self.norm.max() + 1.0)
        able &= ~(least > slack[:, None])
        return able


def possible(middle: np.ndarray, half: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(boxes, centres): whether a centre can be nearest to a point of a box, given by its middle and half its widths."""
    models = Models([centers])
    _, listed, count = models.everywhere(len(middle))
    return models.possible(middle - half, middle + half, listed, count)


def descend(levels: list[tuple[np.ndarray, np.ndarray]], models: Models) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, nodes, listed centres, how many of them), from the top: where one centre of a model is left, its
    node is whole and no more looked into; at the leaves (the last level) also those with several are given."""
    pending = [models.everywhere(len(levels[0][0]))]
    for depth, (lo, hi) in enumerate(levels):
        found: dict[int, list] = {}
        for nodes, listed, count in pending:
            step = max(1, PAIRS_AT_ONCE // listed.shape[1])
            for at in range(0, len(nodes), step):
                here, some = nodes[at:at + step], listed[at:at + step]
                able = models.possible(lo[here], hi[here], some, count[at:at + step])
                number = able.sum(1)
                one = np.flatnonzero(number <= 1)
                if len(one):
                    yield depth, here[one], some[one, able[one].argmax(1)][:, None], number[one]
                low = 1
                for most in (2, 4, 8, 1 << 30):
                    rows = np.flatnonzero((number > low) & (number <= most))
                    low = most
                    if len(rows):
                        if most == 2:
                            both = able[rows]
                            order = np.stack([both.argmax(1), both.shape[1] - 1 - both[:, ::-1].argmax(1)], 1)
                        else:
                            order = np.argsort(~able[rows], axis=1, kind="stable")[:, :number[rows].max()]  # possible ones first, by number
                        found.setdefault(most, []).append((here[rows], np.take_along_axis(some[rows], order, 1), number[rows]))
        pending = []
        for parts in found.values():
            widest = max(x.shape[1] for _, x, _ in parts)
            nodes, count = np.concatenate([n for n, _, _ in parts]), np.concatenate([c for _, _, c in parts])
            listed = np.concatenate([np.pad(x, ((0, 0), (0, widest - x.shape[1])), "edge") for _, x, _ in parts])
            if depth == len(levels) - 1:
                yield depth, nodes, listed, count
            else:
                under = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                inside = under < len(levels[depth + 1][0])
                pending.append((under[inside], np.repeat(listed, FAN, 0)[inside], np.repeat(count, FAN)[inside]))


def add(held: np.ndarray, at: np.ndarray, sums: np.ndarray) -> None:
    """Add rows of ``sums`` to the rows ``at`` of ``held``, as integers."""
    if len(at):
        order = np.argsort(at.astype(np.min_scalar_type(len(held))), kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        held[at[order[first]]] += np.add.reduceat(sums[order], first, 0)


def nearest(leaves: Leaves, at: np.ndarray, local: np.ndarray, listed: np.ndarray, count: np.ndarray, models: Models) -> np.ndarray:
    """(leaves, LEAF): which of the listed centres is nearest to each point (the first of equally near ones)."""
    c = models.centers[listed]
    less = models.norm[listed] / 2 - np.matmul(c, (leaves.corner[at] / GRID)[:, :, None])[:, :, 0]
    score = np.matmul(c / GRID, local)
    score -= less[:, :, None]
    best, index = score[:, 0], np.zeros((len(at), LEAF), np.int16)
    for i in range(1, listed.shape[1]):
        more = score[:, i] > best
        if i > 1:
            more &= (i < count)[:, None]
        np.copyto(best, score[:, i], where=more)
        np.copyto(index, np.int16(i), where=more)
    return index


def assign(leaves: Leaves, models: Models, held: np.ndarray) -> None:
    """Add the points of all leaves to their nearest centres, for each model."""
    levels = leaves.levels()
    whole = [leaves.whole]
    while len(whole) < len(levels):
        whole.insert(0, np.add.reduceat(whole[0], np.arange(0, len(whole[0]), FAN), 0))
    for depth, nodes, listed, count in descend(levels, models):
        if listed.shape[1] == 1:
            add(held, listed[:, 0], whole[depth][nodes])
            continue
        step = max(1, PAIRS_AT_ONCE * 2 // (LEAF * listed.shape[1]))
        for i in range(0, len(nodes), step):
            at, some = nodes[i:i + step], listed[i:i + step]
            local = leaves.local[at]
            index = nearest(leaves, at, local, some, count[i:i + step], models)
            member = (index[:, None, :] == np.arange(1, some.shape[1], dtype=np.int16)[:, None]).astype(np.float64)
            if leaves.w is not None:
                member *= leaves.w[at][:, None, :]
            sums = leaves.sums(at, local, member)
            add(held, some[:, 0], leaves.whole[at] - sums.sum(1))  # the first one has the rest
            used = sums[:, :, -1] > 0
            add(held, some[:, 1:][used], sums[used])


def exact_sums(blocks: DataFrame, models: Sequence[np.ndarray]) -> list[np.ndarray]:
    """One pass: for each model the sums (centres, columns + 1; integers on the grid, then weights) of the
    points nearest to its centres."""
    every, p = Models(models), models[0].shape[1]
    total = len(every.centers)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = np.zeros((total, 2 * p + 1), np.int64)
        for leaves in leaves_of(batches):
            assign(leaves, every, added)
        held = np.zeros((2, total, p + 1), np.int64)
        held[0][:, :p], held[1] = added[:, :p], added[:, p:]
        place = np.flatnonzero(held[1][:, p])
        if len(place):
            cell = (place[:, None] * (p + 1) + np.arange(p + 1)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(held[0][place].ravel()), pa.array(held[1][place].ravel())], names=["cell", "high", "low"])

    wide = "decimal(38, 0)"
    # a task has one row for each cell: as few sums as cores suffice
    few = blocks.sparkSession.sparkContext.defaultParallelism
    added = blocks.mapInArrow(sums, "cell long, high long, low long").repartition(few, "cell").groupBy("cell").agg(
        F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    exact = np.zeros(total * (p + 1), object)
    with few_at_once(blocks):
        rows = added.collect()  # at most total x (p + 1) rows
    for r in rows:
        exact[r.cell] = int(r.high) * LIMB + int(r.low)
    return [exact.reshape(total, p + 1)[a:a + n] for a, n in zip(every.first, every.sizes, strict=True)]


def means_of(sums: np.ndarray) -> np.ndarray:
    """Exact means (centres, columns; NaN without points)."""
    return np.array([[s / row[-1] / GRID if row[-1] else np.nan for s in row[:-1]] for row in sums], float)


def scan(blocks: DataFrame, models: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One pass: weights (centres) and exact means (centres, columns; NaN without points) of all models."""
    sums = exact_sums(blocks, models)
    return [s[:, -1].astype(float) for s in sums], [means_of(s) for s in sums]


def costs(blocks: DataFrame, models: list[np.ndarray]) -> list[float]:
    """Sum of squared distances of the points to their nearest centres, for each model: of a leaf with one
    possible centre the spread around its mean and the distance of that, else point by point."""
    every = Models(models)
    owner = np.repeat(np.arange(len(models)), every.sizes)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(models))
        for leaves in leaves_of(batches):
            w = np.ones((len(leaves.local), LEAF)) if leaves.w is None else leaves.w
            weight = w.sum(1)
            middle = np.matmul(leaves.local, w[:, :, None])[:, :, 0] / weight[:, None]
            spread = np.matmul(((leaves.local - middle[:, :, None]) / GRID) ** 2, w[:, :, None])[:, :, 0].sum(1)
            middle = (leaves.corner + middle) / GRID
            levels = leaves.levels()
            for depth, nodes, listed, count in descend(levels, every):
                if listed.shape[1] == 1:
                    under = FAN ** (len(levels) - 1 - depth)  # leaves of a node
                    step = max(1, PAIRS_AT_ONCE // under)
                    for i in range(0, len(nodes), step):
                        at, one = (nodes[i:i + step, None] * under + np.arange(under)).ravel(), np.repeat(listed[i:i + step, 0], under)
                        inside = at < len(weight)
                        at, one = at[inside], one[inside]
                        cost = spread[at] + weight[at] * ((middle[at] - every.centers[one]) ** 2).sum(1)
                        held += np.bincount(owner[one], cost, len(models))
                    continue
                step = max(1, PAIRS_AT_ONCE * 2 // (LEAF * listed.shape[1]))
                for i in range(0, len(nodes), step):
                    at, some = nodes[i:i + step], listed[i:i + step]
                    local = leaves.local[at]
                    index = nearest(leaves, at, local, some, count[i:i + step], every)
                    mine = every.centers[np.take_along_axis(some, index.astype(np.int64), 1)].transpose(0, 2, 1)
                    d = ((local + leaves.corner[at][:, :, None]) / GRID - mine) ** 2
                    held += np.bincount(owner[some[:, 0]], (d.sum(1) * w[at]).sum(1), len(models))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), pa.array(held)], names=["model", "cost"])

    with few_at_once(blocks):
        rows = blocks.mapInArrow(added, "model int, cost double").groupBy("model").agg(F.sum("cost").alias("cost")).collect()
    found = {r.model: r.cost for r in rows}
    return [found.get(i, 0.0) for i in range(len(models))]


def advance(blocks: DataFrame, models: list[np.ndarray], tolerance: float, most: int,
            watch: Callable[[int, int], None] | None = None) -> list[np.ndarray]:
    """The models after their last iteration. ``watch`` hears of each pass and its models."""
    models, moving = list(models), list(range(len(models)))
    for step in range(most):
        if not moving:
            break
        if watch:
            watch(step, len(moving))
        _, means = scan(blocks, [models[i] for i in moving])
        still = []
        for i, mean in zip(moving, means, strict=True):
            new = np.where(np.isnan(mean), models[i], mean)
            if ((new - models[i]) ** 2).sum() > tolerance:
                still.append(i)
            models[i] = new
        moving = still
    return models


def fit(blocks: DataFrame, ks: Sequence[int], restarts: int, seed: int, tolerance: float, most: int, at_once: int = 1,
        watch: Callable[[int, int], None] | None = None) -> dict[int, tuple[np.ndarray, float]]:
    """For each k the centres and cost of its cheapest restart (the first of equal ones: costs are
    compared to nine digits, as their sums depend on the order of addition beyond that)."""
    begun = starts(blocks, max(ks), restarts, seed, at_once)
    if not begun:
        raise ValueError("no rows to cluster")
    runs = [(k, c[:k]) for k in ks for c in (begun if k > 1 else begun[:1])]
    ended = advance(blocks, [c for _, c in runs], tolerance, most, watch)
    best: dict[int, tuple[np.ndarray, float]] = {}
    for (k, _), centers, cost in zip(runs, ended, costs(blocks, ended), strict=True):
        if k not in best or float(f"{cost:.9g}") < float(f"{best[k][1]:.9g}"):
            best[k] = centers, cost
    return best


def label(features: Column, centers: np.ndarray) -> Column:
    """1-based number of the nearest centre (the first of equally near ones) to an array column."""
    p = centers.shape[1]

    @F.arrow_udf("int")
    def nearest(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
        out = np.ones(len(x), np.int32)
        for at in range(0, len(x), LABELLED_AT_ONCE):
            part = np.ascontiguousarray(x[at:at + LABELLED_AT_ONCE].T)
            best, index = np.full(part.shape[1], np.inf), out[at:at + LABELLED_AT_ONCE]
            for i, c in enumerate(centers):
                d = np.zeros(part.shape[1])
                for j in range(p):
                    d += (part[j] - c[j]) ** 2
                index[d < best] = i + 1
                np.minimum(best, d, out=best)
        return pa.array(out)

    return nearest(features)
