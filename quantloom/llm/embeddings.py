"""Embedding near-dedup: PCA-ordered tiled comparison of all vectors.

1. Equal vectors are collapsed; the copies are counted, not compared.
2. The second moments of the unit vectors (d x d sums) give the PCA rotation. It keeps dot products, and
   puts most of a vector's length into its leading dimensions.
3. Unit vectors whose cosine reaches the threshold are at most sqrt(2 - 2 * threshold) apart, so they fall
   into equal or neighbouring cells of the first leading coordinates. A cell is cut into panels of a bounded
   number of vectors, small cells that follow each other share a panel, and only panels of neighbouring
   cells meet, each pair once. A panel's partners stream past it: it is sent once for itself and once to
   each half of its neighbours, in the width of the input (4 bytes a component for floats).
4. Two panels are compared tile by tile: the leading dimensions first; the norms of the rest bound what the
   other dimensions can add; when no cosine of a tile can reach the threshold the tile ends there. Pairs
   that are left accumulate more dimensions and are dropped by the same bound; dense tiles are
   multiplied whole. A cosine within 1e-9 of the threshold is computed again from the vectors as given.
5. A panel pair emits link counts and a spanning forest of its links, at most as many rows as vectors in
   it, so a group of near copies costs no quadratic rows. Components come from the forests.

Memory of a task: two panels, one tile and an Arrow batch (64 MB and a row, as Spark bounds it). Rotation and cells go to executors in d x d numbers; the cells
are at most (2 / width + 2) ^ 3, whatever the table, and are planned on the driver.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinite components link with
nothing; vectors of different lengths don't link; rows with a null id link with nothing and have a null
component; rows that share an id share a component; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quantloom.llm.common import drop_scratch, read_table, scratch
from quantloom.llm.graph import components

THRESHOLD = 0.9
PANEL_ROWS, TILE_ROWS = 8192, 1024
LEADING = 16
CELL_DIMS = 3
#: Share of a tile's pairs that may be left after the leading dimensions before it is multiplied whole.
DENSE = 0.02
NEAR = 1e-9


def _vectors(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v, key (128 bits of v), ok."""
    kind = frame.schema[vector_col].dataType
    held = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    own = frame.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{held}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    plain = F.transform("v", lambda x: x + F.lit(0.0).cast(held))  # -0.0 is 0.0
    return own.withColumn("key", F.struct(F.xxhash64(plain).alias("x"), F.xxhash64(F.lit("own"), plain).alias("y")))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotation(distinct: DataFrame, dim: int) -> np.ndarray:
    """d x d: rows are the principal directions of the unit vectors, largest second moment first."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                unit = _unit(_matrix(batch.column(0).slice(start, 4096)))
                total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches):
        total = np.zeros(dim * dim)
        for batch in batches:
            for sums in batch.column(0):
                total += np.frombuffer(sums.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = distinct.where(F.size("v") == dim).select("v").mapInArrow(moments, "sums binary")
    row = parts.repartition(16).mapInArrow(add, "sums binary").repartition(1).mapInArrow(add, "sums binary").first()  # d x d numbers
    return np.linalg.eigh(np.frombuffer(row["sums"]).reshape(dim, dim))[1][:, ::-1].T.copy()


class Panel:
    def __init__(self, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray, turn: np.ndarray):
        self.ids, self.copies = ids, copies.astype(float)
        self.unit = _unit(raw)
        self.turned = self.unit @ turn.T
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = np.sqrt(np.concatenate([squares, np.zeros((len(ids), 1))], axis=1))  # rest[:, k]: norm from dimension k on

    def __len__(self) -> int:
        return len(self.ids)


def tile_links(a: Panel, sa: slice, b: Panel, sb: slice, threshold: float) -> tuple[np.ndarray, np.ndarray] | np.ndarray | None:
    """The links between two tiles: None, index arrays, or (for dense tiles) a mask."""
    dim = a.turned.shape[1]
    lead = min(LEADING, dim)
    low = threshold - NEAR
    x, y = a.turned[sa], b.turned[sb]
    rest_x, rest_y = a.rest[sa], b.rest[sb]
    part = x[:, :lead] @ y[:, :lead].T
    open_ = part >= low - np.outer(rest_x[:, lead], rest_y[:, lead])
    left = int(np.count_nonzero(open_))
    if not left:
        return None
    if left > DENSE * open_.size:
        part += x[:, lead:] @ y[:, lead:].T
        found = part >= threshold
        i, j = np.nonzero(np.abs(part - threshold) <= NEAR)
        if len(i):
            found[i, j] = np.einsum("ij,ij->i", a.unit[sa][i], b.unit[sb][j]) >= threshold
        return found if found.any() else None
    i, j = np.nonzero(open_)
    so_far, at = part[i, j], lead
    while at < dim and len(i):
        upto = min(at + LEADING, dim)
        so_far = so_far + np.einsum("ij,ij->i", x[i, at:upto], y[j, at:upto])
        keep = so_far + rest_x[i, upto] * rest_y[j, upto] >= low
        i, j, so_far, at = i[keep], j[keep], so_far[keep], upto
    near = np.flatnonzero(np.abs(so_far - threshold) <= NEAR)
    found = so_far >= threshold
    found[near] = np.einsum("ij,ij->i", a.unit[sa][i[near]], b.unit[sb][j[near]]) >= threshold
    return (i[found], j[found]) if found.any() else None


def _forest(links: tuple[np.ndarray, np.ndarray] | np.ndarray, n: int, m: int) -> np.ndarray:
    """Labels of the n + m vectors of two tiles: equal within components of their links."""
    labels = np.arange(n + m)
    while True:
        before = labels.copy()
        if isinstance(links, np.ndarray):
            labels[:n] = np.minimum(labels[:n], np.where(links, labels[n:], n + m).min(axis=1))
            labels[n:] = np.minimum(labels[n:], np.where(links, labels[:n, None], n + m).min(axis=0))
        else:
            np.minimum.at(labels, links[0], labels[links[1] + n])
            np.minimum.at(labels, links[1] + n, labels[links[0]])
        labels = labels[labels]
        if (labels == before).all():
            return labels


def compare(a: Panel, b: Panel, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts of a and of b (copies counted), and edges between indices of a and, after them, of b."""
    n = len(a)
    count_a, count_b, edges = np.zeros(n), np.zeros(len(b)), []
    for p in range(0, n, TILE_ROWS):
        for q in range(p if same else 0, len(b), TILE_ROWS):
            sa, sb = slice(p, min(p + TILE_ROWS, n)), slice(q, min(q + TILE_ROWS, len(b)))
            links = tile_links(a, sa, b, sb, threshold)
            if links is None:
                continue
            own = same and p == q
            if isinstance(links, np.ndarray):
                if own:
                    np.fill_diagonal(links, False)
                count_a[sa] += links @ b.copies[sb]
                if not own:
                    count_b[sb] += a.copies[sa] @ links
            else:
                if own:
                    links = tuple(x[links[0] != links[1]] for x in links)
                np.add.at(count_a, links[0] + p, b.copies[links[1] + q])
                if not own:
                    np.add.at(count_b, links[1] + q, a.copies[links[0] + p])
            labels = _forest(links, sa.stop - p, sb.stop - q)
            place = np.concatenate([np.arange(p, sa.stop), np.arange(q, sb.stop) + (0 if same else n)])
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            edges.append(np.stack([place[moved], place[labels[moved]]]))
    if same:
        count_a += count_b
        count_b = np.zeros(0)
    return count_a, count_b, np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)


def _reduced(edges: np.ndarray, n: int) -> np.ndarray:
    """A spanning forest: each node beside the smallest index of its component."""
    labels = np.arange(n)
    while True:
        before = labels.copy()
        np.minimum.at(labels, edges[0], labels[edges[1]])
        np.minimum.at(labels, edges[1], labels[edges[0]])
        labels = labels[labels]
        if (labels == before).all():
            moved = np.flatnonzero(labels != np.arange(n))
            return np.stack([moved, labels[moved]])


def plan_panels(cells: list[tuple[tuple[int, ...], int]], size: int) -> tuple[list[tuple], list[tuple]]:
    """cells: (cell, its vectors). Returns (cell, first panel, panels) and, for groups of cells that touch, (first, panels, first, panels).

    A cell of more than `size` vectors has panels of its own; smaller ones, in order, share one.
    """
    placed, groups, held, upto = [], [], 0, 0  # groups: (first panel, panels, cells)
    for cell, n in sorted(cells):
        parts = -(-n // size)
        if parts == 1 and groups and groups[-1][1] == 1 and held + n <= size:
            groups[-1][2].append(cell)
            held += n
        else:
            groups.append((upto, parts, [cell]))
            upto, held = upto + parts, n
        placed.append((list(cell), groups[-1][0], parts))
    home = {cell: g for g, (_, _, own) in enumerate(groups) for cell in own}
    meet = set()
    for cell, g in home.items():
        for shift in itertools.product((-1, 0, 1), repeat=len(cell)):
            other = home.get(tuple(c + d for c, d in zip(cell, shift, strict=True)))
            if other is not None and g <= other:
                meet.add((g, other))
    return placed, [(*groups[g][:2], *groups[h][:2]) for g, h in sorted(meet)]


def _panels(distinct: DataFrame, dim: int, turn: np.ndarray, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    """panel, ids, copies, raw (packed), one row per panel; left, right of the panels that meet; the number of panels."""
    spark = distinct.sparkSession
    width = float(np.sqrt(max(2 - 2 * threshold, 1e-6))) * (1 + 1e-6)
    dims = min(CELL_DIMS, dim)
    kind = distinct.schema["v"].dataType.elementType.simpleString()

    def locate(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                lead = np.floor(_unit(_matrix(part.column(2))) @ turn[:dims].T / width).astype(np.int32)
                cell = pa.ListArray.from_arrays(pa.array(np.arange(0, lead.size + 1, dims, dtype=np.int32)), pa.array(lead.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, cell], ["rep", "copies", "v", "cell"])

    placed = distinct.where(F.size("v") == dim).select("rep", "copies", "v").mapInArrow(locate, f"rep long, copies long, v array<{kind}>, cell array<int>")
    placed = scratch(placed, "vec-cells")
    cells = [(tuple(r["cell"]), r["n"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()]  # a few for each unit of space
    homes, meet = plan_panels(cells, PANEL_ROWS)
    home = spark.createDataFrame(homes, "cell array<int>, first long, parts long")
    part = F.floor(F.shiftrightunsigned(F.xxhash64("rep"), 11) / float(1 << 53) * F.col("parts"))
    rows = placed.join(F.broadcast(home), "cell").withColumn("panel", F.col("first") + part)  # one row per cell

    def pack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                held = batch.column(1)[k].values
                order = np.argsort(held.field("rep").to_numpy(zero_copy_only=False), kind="stable")
                ids, copies = (held.field(c).to_numpy(zero_copy_only=False)[order] for c in ("rep", "copies"))
                raw = held.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[order]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, copies, raw))], ["panel", "ids", "copies", "raw"])

    grouped = rows.groupBy("panel").agg(F.collect_list(F.struct("rep", "copies", "v")).alias("held"))
    packed = grouped.mapInArrow(pack, "panel long, ids binary, copies binary, raw binary")
    pairs = spark.createDataFrame(meet, "a long, m long, b long, n long").select("a", "b", "n", F.explode(F.expr("sequence(a, a + m - 1)")).alias("x"))
    pairs = pairs.select("x", F.explode(F.expr("sequence(b, b + n - 1)")).alias("y")).where("x <= y")
    even = (F.col("x") + F.col("y")) % 2 == 0  # so that no panel has all its partners to itself
    pairs = pairs.select(F.when(even, F.col("x")).otherwise(F.col("y")).alias("left"), F.when(even, F.col("y")).otherwise(F.col("x")).alias("right"))
    return packed, pairs.where("left <> right"), sum({first: parts for _, first, parts in homes}.values())


def link_vectors(frame: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of frame."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = frame.sparkSession
    vectors = scratch(_vectors(frame, id_col, vector_col), "vec-rows")
    distinct = scratch(vectors.where("ok").groupBy("key").agg(F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vec-distinct")
    counts, edges = [], []
    for dim in sorted(r["d"] for r in distinct.select(F.size("v").alias("d")).distinct().collect()):
        turn = rotation(distinct, dim)
        packed, pairs, n_panels = _panels(distinct, dim, turn, threshold)
        panels = scratch(packed, "vec-panels")
        # a panel, and after it those that it meets
        sides = panels.select(F.col("panel").alias("left"), F.lit(-1).cast("long").alias("right"), "ids", "copies", "raw")
        sides = sides.unionAll(pairs.join(panels.withColumnRenamed("panel", "right"), "right").select("left", "right", "ids", "copies", "raw"))
        number = np.float32 if distinct.schema["v"].dataType.elementType.simpleString() == "float" else float

        def run(batches, turn=turn, dim=dim, number=number):
            one = None
            for batch in batches:
                for k in range(batch.num_rows):
                    left, right, ids, copies, raw = (c[k].as_py() for c in batch.columns)
                    own = Panel(np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), np.frombuffer(raw, number).astype(float).reshape(-1, dim), turn)
                    same = right < 0
                    one = own if same else one
                    count_a, count_b, found = compare(one, own, same, threshold)
                    ids = one.ids if same else np.concatenate([one.ids, own.ids])
                    links = np.concatenate([count_a, count_b]).astype(np.int64)
                    root = np.arange(len(ids))
                    forest = _reduced(found, len(ids))
                    root[forest[0]] = forest[1]
                    hit = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], ["rep", "links", "root"])

        dealt = sides.repartition(4 * n_panels, "left").sortWithinPartitions("left", "right")
        found = scratch(dealt.mapInArrow(run, "rep long, links long, root long"), "vec-links")
        drop_scratch(spark, panels)
        counts.append(found.groupBy("rep").agg(F.sum("links").alias("links")))
        edges.append(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    own = vectors.where("ok").select("vec_id", "key").join(distinct.drop("v"), "key").select("vec_id", "rep", "copies")
    rest = vectors.where("not ok").select("vec_id")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id").isNotNull(), F.lit(False)).alias("kept"))
    if not counts:
        return alone
    all_counts, all_edges = counts[0], edges[0]
    for c, e in zip(counts[1:], edges[1:], strict=True):
        all_counts, all_edges = all_counts.unionAll(c), all_edges.unionAll(e)
    # rows that share an id share a component
    all_edges = all_edges.unionAll(own.where("vec_id <> rep").groupBy("vec_id", "rep").agg(F.count("*").alias("n")).select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    found = components(all_edges)
    linked = own.join(all_counts, "rep", "left").join(found, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return linked.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    ).unionAll(alone)


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_embedding_links": op10_embedding_links}
ORACLE_SQL = {
    "op10_embedding_links": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
r(node, top) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.a, r.top FROM r JOIN e ON e.b = r.node WHERE r.top < e.a),
c AS (SELECT node, min(top) AS component FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component AS component_id, v.vec_id = c.component AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""
}
