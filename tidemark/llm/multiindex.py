"""Near-duplicate vectors through an inverted multi-index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import kept_table

SAMPLE = 4_096
LEADERS = 1_024
LEAST_BALL = 32
BLOCK = 1_024
RECALL = 0.9995
_EPS = 1e-9

UNIT = "id long, label int, leader int, angle double, vec array<double>"


def _units(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors can link at all, and those as unit vectors in double precision."""
    good, out = np.zeros(len(column), bool), []
    for i, v in enumerate(column):
        values = v.values.to_numpy(zero_copy_only=False) if v.is_valid else None
        if values is None or not len(values) or v.values.null_count:
            continue
        x = values.astype(float)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            continue
        x = x / top
        good[i] = True
        out.append(x / math.sqrt(float(x @ x)))
    return good, out


def _list(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows: the matrices of a task stay small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


@dataclass(frozen=True)
class Index:
    """Codebooks of the two halves, the traversal's stop, and the leaders of balls."""

    books: tuple[np.ndarray, np.ndarray]
    stop: float
    leaders: np.ndarray
    leader_labels: np.ndarray
    cosine: float

    @property
    def reach(self) -> float:
        """Angle of a link."""
        return math.acos(self.cosine)

    @property
    def radius(self) -> float:
        """Balls of this angle around a leader hold no two vectors that are no link."""
        return self.reach / 2 * (1 - 1e-6)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and the cells (as a matrix of flags) it visits.

        In each half the codewords are ordered by how far the vector is from their Voronoi
        cell. The multi-sequence traversal takes the cells of the product grid by the sum
        of both, nearest first, and ends once the sum passes `stop`.
        """
        own, far = [], []
        half = self.books[0].shape[1]
        for part, book in ((x[:, :half], self.books[0]), (x[:, half:], self.books[1])):
            d = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            near = d.argmin(1)
            apart = np.sqrt(np.maximum(((book[:, None] - book[None]) ** 2).sum(2), 1e-12))
            bound = np.maximum(d - d[np.arange(len(d)), near][:, None], 0) / (2 * apart[near])
            bound[np.arange(len(d)), near] = 0
            own.append(near)
            far.append(bound**2)
        k = len(self.books[1])
        flags = far[0][:, :, None] + far[1][:, None, :] <= self.stop
        return own[0] * k + own[1], flags.reshape(len(x), -1)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(10):
        d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
        near = d.argmin(1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = x[near == j].mean(0)
    return centres


def fitted(sample: np.ndarray, labels: np.ndarray, cosine: float, words: int) -> Index:
    """Codebooks of `words` each from a sample, and a stop that reaches `RECALL`.

    The stop is measured on pairs at exactly the threshold, the hardest ones: each sampled
    vector with a random one at that cosine. A pair is found if either visits the other's
    cell.
    """
    rng = np.random.default_rng(29)
    half = sample.shape[1] // 2
    books = (_codebook(sample[:, :half], words, rng), _codebook(sample[:, half:], words, rng))
    pick = rng.permutation(len(sample))[:LEADERS]
    index = Index(books, 0.0, sample[pick], labels[pick], cosine)
    x = sample[rng.integers(0, len(sample), 4_000)]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    y = cosine * x + math.sqrt(1 - cosine**2) * side / np.maximum(np.linalg.norm(side, axis=1), 1e-12)[:, None]
    need = np.full(len(x), np.inf)
    for stop in np.linspace(0.0, 2 - 2 * cosine, 57):
        at = Index(books, float(stop), index.leaders, index.leader_labels, cosine)
        (cx, fx), (cy, fy) = at.visits(x), at.visits(y)
        rows = np.arange(len(x))
        hit = fx[rows, cy] | fy[rows, cx]
        need[hit & np.isinf(need)] = stop
        if hit.mean() >= RECALL:
            break
    return Index(books, float(stop), index.leaders, index.leader_labels, cosine)


def _led(sent, dims: int):
    """Unit vectors with the nearest leader of their label, if it is near enough for its ball."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        for batch in _slices(batches):
            good, units = _units(batch.column(2))
            ids, labels = batch.column(0).to_numpy()[good], batch.column(1).to_numpy()[good]
            right = np.array([len(u) == dims for u in units], bool)
            leader, angle = np.full(len(units), -1, np.int32), np.zeros(len(units))
            if right.any():
                x = np.stack([u for u in units if len(u) == dims])
                cos = np.where(index.leader_labels == labels[right][:, None], x @ index.leaders.T, -1.0)
                best = cos.argmax(1)
                a = np.arccos(np.clip(cos[np.arange(len(x)), best], -1, 1))
                leader[right] = np.where(a <= index.radius, best, -1)
                angle[right] = a
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(leader), pa.array(angle), _list(units)], ["id", "label", "leader", "angle", "vec"])

    return run


FOUND = "kind int, a long, b long, n long"
DEGREE, EDGE, BALL, OPEN = 0, 1, 2, 3


def _against_balls(sent, dims: int):
    """Links of every vector to the balls of its label, decided by angles where they can be.

    Emits (DEGREE, vector, -, links), (EDGE, vector, head of the ball), (BALL, -, leader,
    links each member gains), and (OPEN, vector, leader) where members have to be compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, number, label, size, radius, head = sent.value
        for batch in _slices(batches):
            ids, labels, own = (batch.column(i).to_numpy() for i in range(3))
            rows: list[tuple[np.ndarray, ...]] = []
            at = np.array([len(v) == dims for v in batch.column(3)], bool)
            if len(number) and at.any():
                x = np.stack([v.values.to_numpy() for v, ok in zip(batch.column(3), at, strict=True) if ok])
                ids, labels, own = ids[at], labels[at], own[at]
                angle = np.arccos(np.clip(x @ index.leaders[number].T, -1, 1))
                angle[label != labels[:, None]] = np.inf
                member = own[:, None] == number
                inside = member | (angle + radius <= index.reach - _EPS)
                between = ~inside & (angle - radius <= index.reach + _EPS)
                degree = (inside * size).sum(1) - member.any(1)
                rows.append((np.full(len(ids), DEGREE), ids, np.zeros(len(ids), np.int64), degree))
                i, j = np.nonzero(inside)
                rows.append((np.full(len(i), EDGE), ids[i], head[j], np.ones(len(i), np.int64)))
                gained = (inside & ~member.any(1)[:, None]).sum(0)
                j = np.flatnonzero(gained)
                rows.append((np.full(len(j), BALL), np.zeros(len(j), np.int64), number[j], gained[j]))
                i, j = np.nonzero(between)
                rows.append((np.full(len(i), OPEN), ids[i], number[j], np.ones(len(i), np.int64)))
            columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.empty(0)] * 4
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], ["kind", "a", "b", "n"])

    return run


def _celled(sent, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        for batch in _slices(batches):
            at = [len(v) == dims for v in batch.column(2)]
            rows = batch.filter(pa.array(at))
            if not len(rows):
                continue
            x = np.stack([v.values.to_numpy() for v in rows.column(2)])
            cell, flags = index.visits(x)
            visited = [np.flatnonzero(f).astype(np.int32) for f in flags]
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in visited])]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(visited)))
            mask = pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(cell, pa.int32()), cells, mask, rows.column(2)], ["id", "label", "cell", "cells", "mask", "vec"])

    return run


def _linked(ids_a: np.ndarray, ids_b: np.ndarray, links: np.ndarray, both: bool) -> pa.Table:
    """Link counts of the rows (and columns), and edges that connect what is linked."""
    out = [(DEGREE, ids_a, links.sum(1))]
    if both:
        out.append((DEGREE, ids_b, links.sum(0)))
    kinds = [np.full(len(i), k) for k, i, _ in out]
    a, n = [i for _, i, _ in out], [d for _, _, d in out]
    b = [np.zeros(len(i), np.int64) for i in a]
    i, j = np.nonzero(links)
    if len(i):
        names, back = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
        u, v = back[: len(ids_a)][i], back[len(ids_a) :][j]
        low = np.arange(len(names))
        while True:
            new = low.copy()
            np.minimum.at(new, u, low[v])
            np.minimum.at(new, v, low[u])
            new = new[new]
            if (new == low).all():
                break
            low = new
        moved = np.flatnonzero(low != np.arange(len(low)))
        kinds.append(np.full(len(moved), EDGE))
        a.append(names[moved])
        b.append(names[low[moved]])
        n.append(np.ones(len(moved), np.int64))
    columns = [np.concatenate(c) for c in (kinds, a, b, n)]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    table = pa.Table.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], ["kind", "a", "b", "n"])
    return table.filter(pa.compute.or_(pa.compute.not_equal(table["kind"], DEGREE), pa.compute.greater(table["n"], 0)))


def _compared(cosine: float, both: bool):
    """One block of members and visitors of a cell: each pair is counted in one block only."""

    def run(block: pa.Table) -> pa.Table:
        member = block.column("member").to_numpy(zero_copy_only=False)
        x = np.stack([v.values.to_numpy() for chunk in block.column("vec").chunks for v in chunk])
        ids, cells = block.column("id").to_numpy(), block.column("home").to_numpy()
        here = block.column("cell")[0].as_py()
        m, v = np.flatnonzero(member), np.flatnonzero(~member)
        links = x[v] @ x[m].T >= cosine
        if both:
            masks = block.column("mask").to_pylist()
            # A member that visits the visitor's cell too: the pair belongs to the larger cell.
            flags = np.unpackbits(np.frombuffer(b"".join(masks[i] for i in m), np.uint8).reshape(len(m), -1), axis=1) if len(m) else np.zeros((0, 1))
            home = cells[v]
            mutual = flags[:, home].T.astype(bool) if len(m) else np.zeros((len(v), 0), bool)
            links &= ~mutual | (home < here)[:, None] | ((home == here)[:, None] & (ids[v][:, None] < ids[m][None]))
            same = (home == here)[:, None] & (ids[v][:, None] >= ids[m][None])
            links &= ~same
            return _linked(ids[v], ids[m], links, True)
        single = block.column("single").to_numpy(zero_copy_only=False)[v]
        first, second = _linked(ids[v][~single], ids[m], links[~single], False), _linked(ids[v][single], ids[m], links[single], True)
        return pa.concat_tables([first, second])

    return run


def _blocks(members: DataFrame, visitors: DataFrame, cosine: float, both: bool) -> DataFrame:
    """Compare the visitors with the members of their group (label, cell), block by block.

    Large groups are cut on both sides into parts of about `BLOCK` rows by a hash.
    """
    keys = ["label", "cell"]
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).join(visitors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_v")), keys)
    parts = sizes.select(*keys, F.ceil(F.col("_m") / BLOCK).cast("int").alias("_m"), F.ceil(F.col("_v") / BLOCK).cast("int").alias("_v"))
    deal = F.xxhash64("id", "cell")
    left = members.join(parts, keys).withColumn("_i", F.pmod(deal, "_m").cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_v") - 1)))
    right = visitors.join(parts, keys).withColumn("_j", F.pmod(deal, "_v").cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    rows = left.withColumn("member", F.lit(True)).unionByName(right.withColumn("member", F.lit(False))).drop("_m", "_v")
    return rows.groupBy(*keys, "_i", "_j").applyInArrow(_compared(cosine, both), FOUND)


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of a cosine of `cosine` or more between vectors of one label, and their components.

    Returns a row per vector: vec_id, n_links (other vectors linked directly), component_id
    (smallest id in reach), kept (vec_id = component_id).

    Codebooks on both vector halves, fitted to a sample of about `SAMPLE` vectors, form a
    product grid; every vector is filed in its cell and visits the nearest cells in
    multi-sequence order until the target recall (`Index.visits`, `fitted`); what it meets
    there is verified in double precision. Crowds of near copies are taken out first: a
    vector within half the angle of a link of a sampled leader belongs to the leader's
    ball, whose members are all linked with each other, so a ball of any size is counted,
    not compared; others are decided against whole balls by angles, and compared with the
    members only where angles leave it open.

    Vectors that are null, empty, zero or hold nulls or non-finite values, and those with a
    null label, link with nothing. Each length has an index of its own, fitted and searched
    one after the other. Rows without an id are returned and link with nothing; rows that
    repeat an id are vectors of their own, with their own links. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = kept_table(rows.withColumn("id", F.monotonically_increasing_id()))
    usable = rows.where("vec_id is not null and label is not null and size(vec) > 0").drop("vec_id")
    lengths = usable.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    linked = rows.sparkSession.createDataFrame([], "a long, _n long, root long")
    for length in lengths:
        # A vector of one number has the angles of that number and a zero.
        vec = F.col("vec") if length["d"] > 1 else F.concat("vec", F.array(F.lit(0.0)))
        found = _links(usable.where(F.size("vec") == length["d"]).withColumn("vec", vec), max(2, length["d"]), length["n"], cosine)
        linked = linked.union(found) if found is not None else linked
    placed = kept_table(rows.select("vec_id", "id").join(linked, F.col("id") == F.col("a"), "left").withColumn("root", F.coalesce("root", "id")))
    least = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = placed.join(least, "root")
    return out.select(
        "vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _links(usable: DataFrame, dims: int, total: int, cosine: float) -> DataFrame | None:
    """(a, _n, root) of the rows (id, label, vec of `dims` numbers) that link with another; None if none can."""
    spark = usable.sparkSession
    share = min(1.0, SAMPLE / total)
    drawn = usable.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(1_000_000 * share)).select("id", "label", "vec").toArrow()
    good, units = _units(drawn.column("vec").combine_chunks())
    if not units:
        return None
    most = usable.groupBy("label").count().agg(F.max("count")).first()[0]
    words = int(min(64, max(4, 2 ** round(math.log2(math.sqrt(most / 64) + 1)))))
    index = fitted(np.stack(units), drawn.column("label").to_numpy()[good], cosine, words)
    sent = spark.sparkContext.broadcast(index)
    led = kept_table(usable.select("id", "label", "vec").mapInArrow(_led(sent, dims), UNIT))

    crowds = led.where("leader >= 0").groupBy("label", "leader").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r"), F.min("id").alias("head"))
    balls = crowds.where(F.col("n") >= LEAST_BALL).orderBy("leader").collect()  # at most LEADERS rows
    number = np.array([b["leader"] for b in balls], np.int64)
    known = (index, number, *(np.array([b[c] for b in balls], t) for c, t in (("label", np.int32), ("n", np.int64), ("r", float), ("head", np.int64))))
    in_ball = F.col("leader").isin(number.tolist()) if len(number) else F.lit(False)
    members = led.withColumn("leader", F.when(in_ball, F.col("leader")).otherwise(-1))
    against = kept_table(members.select("id", "label", "leader", "vec").mapInArrow(_against_balls(spark.sparkContext.broadcast(known), dims), FOUND))

    singles = kept_table(
        members.where("leader < 0").select("id", "label", "vec").mapInArrow(_celled(sent, dims), "id long, label int, cell int, cells array<int>, mask binary, vec array<double>")
    )
    homes = singles.select("id", "label", "cell", F.col("cell").alias("home"), "mask", "vec")
    visits = singles.select("id", "label", F.explode("cells").alias("cell"), F.col("cell").alias("home"), F.lit(None).cast("binary").alias("mask"), "vec")
    pairs = _blocks(homes, visits, cosine, True)

    open_rows = against.where(F.col("kind") == OPEN).select(F.col("a").alias("id"), F.col("b").cast("int").alias("cell"))
    asking = open_rows.join(members.select("id", "label", "vec", (F.col("leader") < 0).alias("single")), "id")
    held = members.where("leader >= 0").select("id", "label", F.col("leader").alias("cell"), F.lit(0).alias("home"), F.lit(False).alias("single"), "vec")
    asked = _blocks(held, asking.select("id", "label", "cell", F.lit(0).alias("home"), "single", "vec"), cosine, False)

    found = kept_table(against.where(F.col("kind") != OPEN).union(pairs).union(asked))
    links = found.where(F.col("kind") == EDGE).select("a", "b")
    roots = components(links)
    gains = found.where(F.col("kind") == BALL).groupBy(F.col("b").cast("int").alias("_l")).agg(F.sum("n").alias("_g"))
    gained = members.where("leader >= 0").join(F.broadcast(gains), F.col("leader") == F.col("_l")).select(F.col("id").alias("a"), F.col("_g").alias("n"))
    degrees = found.where(F.col("kind") == DEGREE).select("a", "n").union(gained).groupBy("a").agg(F.sum("n").alias("_n"))
    return degrees.join(roots, F.col("a") == F.col("node"), "left").select("a", "_n", "root")
