"""Exact k-nearest-neighbour join over numeric columns.

1. Equal vectors are folded into one point that keeps its k+1 smallest ids (no more can
   ever be among the k nearest, ties going to the smaller id), so copies cost nothing.
2. A tree of median splits, built from a bounded sample, cuts space into cells of similar
   size. Every query is first answered inside its own cell, which bounds its radius.
3. Only queries whose ball reaches another cell are sent there, and the short candidate
   lists are merged. Cells that many queries reach are split over tasks.

Nothing is capped: a cell is skipped only if its bounding box lies beyond the radius.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import dbl
from ..session import cut_lineage, small_table

CELL_POINTS = 20_000
LEAST_CELL_POINTS = 2_000
CELL_QUERIES = 20_000
MAX_CELLS = 20_000
SAMPLE_POINTS = 400_000
LEAF_POINTS = 64


def _split(points: np.ndarray, parts: int, first: int):
    """Nested (dimension, value, low side, high side) with cell numbers at the ends."""
    if parts > 1 and len(points):
        spread = points.max(0) - points.min(0)
        dimension = int(spread.argmax())
        if spread[dimension] > 0:
            low_parts = parts // 2
            axis = points[:, dimension]
            value = float(np.quantile(axis, low_parts / parts, method="lower"))
            if value == axis.max():
                value = float(axis[axis < value].max())
            below = axis <= value
            low, used_low = _split(points[below], low_parts, first)
            high, used_high = _split(points[~below], parts - low_parts, first + used_low)
            return (dimension, value, low, high), used_low + used_high
    return first, 1


def _cells_of(tree, points: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), dtype=np.int64)

    def walk(node, rows):
        if not len(rows):
            return
        if not isinstance(node, tuple):
            out[rows] = node
            return
        dimension, value, low, high = node
        below = points[rows, dimension] <= value
        walk(low, rows[below])
        walk(high, rows[~below])

    walk(tree, np.arange(len(points)))
    return out


def _box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance to a box, summed in column order like the point distances."""
    total = np.zeros(len(points))
    for i in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[i] - points[:, i], points[:, i] - high[i]), 0.0)
        total += gap * gap
    return total


def _reached(tree, boxes: dict, points: np.ndarray, bound: np.ndarray):
    """(row, cell) pairs whose box is within the row's squared radius."""
    rows_out, cells_out = [], []

    def extent(node):
        if not isinstance(node, tuple):
            return boxes.get(node)
        sides = [e for e in (extent(node[2]), extent(node[3])) if e is not None]
        if not sides:
            return None
        box = (np.minimum.reduce([s[0] for s in sides]), np.maximum.reduce([s[1] for s in sides]))
        inner[id(node)] = box
        return box

    inner: dict = {}
    extent(tree)

    def walk(node, rows):
        box = inner.get(id(node)) if isinstance(node, tuple) else boxes.get(node)
        if box is None or not len(rows):
            return
        rows = rows[_box_distance(points[rows], *box) <= bound[rows]]
        if isinstance(node, tuple):
            walk(node[2], rows)
            walk(node[3], rows)
        elif len(rows):
            rows_out.append(rows)
            cells_out.append(np.full(len(rows), node))

    walk(tree, np.arange(len(points)))
    if not rows_out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(rows_out), np.concatenate(cells_out)


def search(points: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray):
    """k nearest points of each query by (squared distance, point position).

    Returns positions (-1 where there are fewer) and squared distances. ``bound`` is a
    squared radius known to hold enough points; farther points may be left out.
    """
    n, m = len(points), len(queries)
    best = np.full((m, k), np.inf)
    where = np.full((m, k), -1, dtype=np.int64)
    radius = bound.astype(float).copy()
    parts = max(1, -(-n // LEAF_POINTS))
    tree, leaves = _split(points, parts, 0)
    home = _cells_of(tree, points)
    members = [np.flatnonzero(home == leaf) for leaf in range(leaves)] if leaves < 64 else _grouped(home, leaves)
    boxes = {i: (points[rows].min(0), points[rows].max(0)) for i, rows in enumerate(members) if len(rows)}

    def visit(rows, leaf):
        held = members[leaf]
        if not len(held) or not len(rows):
            return
        distance = np.zeros((len(rows), len(held)))
        for i in range(points.shape[1]):
            gap = queries[rows, i][:, None] - points[held, i][None, :]
            distance += gap * gap
        near = distance.min(1) <= radius[rows]
        rows, distance = rows[near], distance[near]
        if not len(rows):
            return
        all_d = np.concatenate([best[rows], distance], axis=1)
        all_p = np.concatenate([where[rows], np.broadcast_to(held, distance.shape)], axis=1)
        order = np.lexsort((all_p, all_d), axis=1)[:, :k]
        best[rows] = np.take_along_axis(all_d, order, 1)
        where[rows] = np.take_along_axis(all_p, order, 1)
        radius[rows] = np.minimum(radius[rows], best[rows, k - 1])

    own = _cells_of(tree, queries)
    for leaf in np.unique(own):
        visit(np.flatnonzero(own == leaf), int(leaf))
    inner: dict = {}

    def extent(node):
        if not isinstance(node, tuple):
            return boxes.get(node)
        sides = [e for e in (extent(node[2]), extent(node[3])) if e is not None]
        inner[id(node)] = box = (np.minimum.reduce([s[0] for s in sides]), np.maximum.reduce([s[1] for s in sides])) if sides else None
        return box

    extent(tree)

    def walk(node, rows):
        box = inner.get(id(node)) if isinstance(node, tuple) else boxes.get(node)
        if box is None or not len(rows):
            return
        rows = rows[_box_distance(queries[rows], *box) <= radius[rows]]
        if isinstance(node, tuple):
            walk(node[2], rows)
            walk(node[3], rows)
        else:
            visit(rows[own[rows] != node], node)

    walk(tree, np.arange(m))
    where[np.isinf(best)] = -1
    return where, best


def _grouped(home: np.ndarray, leaves: int) -> list[np.ndarray]:
    order = np.argsort(home, kind="stable")
    ends = np.searchsorted(home[order], np.arange(leaves + 1))
    return [order[ends[i] : ends[i + 1]] for i in range(leaves)]


def nearest(
    queries: DataFrame,
    points: DataFrame,
    query_id: str,
    point_id: str,
    columns: Sequence[str],
    k: int,
    block: str | None = None,
    exclude_same_id: bool = False,
    cell_points: int | None = None,
    cell_queries: int = CELL_QUERIES,
) -> DataFrame:
    """(query_id, neighbour, distance, rank): the k nearest points of every query.

    Rows with a null coordinate take no part. With ``block`` only points of the same block
    count. Ties go to the smaller point id. Fewer than k points give fewer rows.
    """
    spark = queries.sparkSession
    kept = k + 1 if exclude_same_id else k
    id_type = points.schema[point_id].dataType.simpleString()
    block_type = points.schema[block].dataType.simpleString() if block else "int"

    def vectors(df, key):
        complete = df
        for c in columns:
            complete = complete.where(F.col(c).isNotNull())
        return complete.select(
            F.col(key).alias("id"),
            (F.col(block) if block else F.lit(0)).alias("b"),
            F.array(*[dbl(c) + F.lit(0.0) for c in columns]).alias("x"),
        )

    own = vectors(queries, query_id)
    # The rank filter keeps k ids per vector before the shuffle, however many copies there are.
    first = F.row_number().over(Window.partitionBy("b", "x").orderBy("id"))
    folded = cut_lineage(
        vectors(points, point_id).withColumn("r", first).where(F.col("r") <= kept)
        .groupBy("b", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    asked = folded.select("b", "x") if queries is points else own.select("b", "x").distinct()

    trees, cells = _plan(folded, len(columns), cell_points)
    placed = folded.mapInPandas(_place(trees), f"b {block_type}, x array<double>, ids array<{id_type}>, cell bigint")
    placed = cut_lineage(placed)
    extents = placed.groupBy("cell").agg(
        F.array(*[F.min(F.col("x")[i]) for i in range(len(columns))]).alias("low"),
        F.array(*[F.max(F.col("x")[i]) for i in range(len(columns))]).alias("high"),
    )
    boxes = {r["cell"]: (np.array(r["low"]), np.array(r["high"])) for r in extents.collect()}

    home = asked.mapInPandas(_place(trees), f"b {block_type}, x array<double>, cell bigint")
    home = home.withColumn("bound", F.lit(float("inf")))
    schema = f"b {block_type}, x array<double>, cell bigint, bound double, d array<double>, ids array<{id_type}>"
    local = cut_lineage(_search_cells(spark, home, placed, kept, schema, cell_queries))
    away = local.select("b", "x", "cell", "bound").mapInPandas(
        _other_cells(trees, boxes), f"b {block_type}, x array<double>, cell bigint, bound double"
    )
    wider = _search_cells(spark, away, placed, kept, schema, cell_queries)

    pairs = F.arrays_zip(F.col("d"), F.col("ids").alias("id")).alias("near")
    merged = (
        local.select("b", "x", pairs).unionByName(wider.select("b", "x", pairs))
        .groupBy("b", "x").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, kept).alias("near"))
    )
    joined = own.join(merged, ["b", "x"])
    near = F.filter("near", lambda n: n["id"] != F.col("id")) if exclude_same_id else F.col("near")
    return (
        joined.select("id", F.posexplode(F.slice(near, 1, k)).alias("pos", "n"))
        .select(
            F.col("id").alias(query_id),
            F.col("n.id").alias("neighbour"),
            F.sqrt("n.d").alias("distance"),
            (F.col("pos") + 1).cast("int").alias("rank"),
        )
    )


def _plan(folded: DataFrame, width: int, cell_points: int | None):
    """One split tree per block from a sample of bounded size; cells are numbered across blocks."""
    sizes = {r["b"]: r["count"] for r in folded.groupBy("b").count().limit(MAX_CELLS + 1).collect()}
    if len(sizes) > MAX_CELLS:
        raise ValueError("too many blocks for a nearest-neighbour join")
    total = sum(sizes.values())
    if cell_points is None:
        # enough cells to occupy the cluster, none so small that its overhead dominates
        tasks = 4 * folded.sparkSession.sparkContext.defaultParallelism
        cell_points = min(CELL_POINTS, max(LEAST_CELL_POINTS, total // tasks))
    per_cell = max(cell_points, -(-total // MAX_CELLS))
    share = min(1.0, SAMPLE_POINTS / max(1, total))
    sample = folded if share == 1.0 else folded.where(F.pmod(F.xxhash64("x"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = sample.select("b", "x").toPandas() if total > per_cell else pd.DataFrame({"b": [], "x": []})
    trees, used = {}, 0
    for b, n in sizes.items():
        mine = rows["x"][rows["b"] == b]
        held = np.stack(list(mine)) if len(mine) else np.empty((0, width))
        trees[b], more = _split(held, -(-n // per_cell), used)
        used += more
    return trees, used


def _place(trees):
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = np.full(len(batch), -1, dtype=np.int64)
            for b, rows in batch.groupby("b").indices.items():
                if b in trees:
                    cells[rows] = _cells_of(trees[b], np.stack(list(batch["x"].iloc[rows])))
            yield batch.assign(cell=cells)[cells >= 0]

    return place


def _other_cells(trees, boxes):
    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, rows in batch.groupby("b").indices.items():
                mine = batch.iloc[rows]
                at, cells = _reached(trees[b], boxes, np.stack(list(mine["x"])), mine["bound"].to_numpy(dtype=float))
                elsewhere = mine["cell"].to_numpy()[at] != cells
                yield mine.iloc[at[elsewhere]].assign(cell=cells[elsewhere])[["b", "x", "cell", "bound"]]

    return reach


def _search_cells(spark, queries: DataFrame, placed: DataFrame, kept: int, schema: str, cell_queries: int) -> DataFrame:
    """Answer queries inside their cell; busy cells are dealt over several tasks."""
    loads = queries.groupBy("cell").count().where(F.col("count") > cell_queries).collect()
    parts = small_table(spark, [(r["cell"], -(-r["count"] // cell_queries)) for r in loads], "cell bigint, parts bigint")
    busy = F.broadcast(parts)  # at most one row per cell
    dealt = queries.join(busy, "cell", "left").withColumn(
        "part", F.pmod(F.xxhash64("x"), F.coalesce("parts", F.lit(1).cast("bigint")))
    )
    copies = placed.join(busy, "cell", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1).cast("bigint")) - 1))
    )

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = left[["b", "x", "cell"]].reset_index(drop=True)
        bound = left["bound"].to_numpy(dtype=float)
        distances, names = [[] for _ in range(len(left))], [[] for _ in range(len(left))]
        if len(left) and len(right):
            firsts = np.array([ids[0] for ids in right["ids"]])
            order = np.argsort(firsts, kind="stable")
            ids = [right["ids"].iat[i] for i in order]
            where, squares = search(np.stack(list(right["x"]))[order], np.stack(list(left["x"])), kept, bound)
            bound = np.minimum(bound, squares[:, kept - 1])
            if (where >= 0).all() and max(map(len, ids)) == 1:
                distances, names = list(squares), list(firsts[order][where])
            else:
                for row, (at, square) in enumerate(zip(where, squares)):
                    for p, d in zip(at, square):
                        if p >= 0:
                            names[row].extend(ids[p])
                            distances[row].extend([d] * len(ids[p]))
        return found.assign(bound=bound, d=pd.Series(distances, dtype=object), ids=pd.Series(names, dtype=object))

    left = dealt.select("b", "x", "cell", "bound", "part").groupBy("cell", "part")
    right = copies.select("x", "ids", "cell", "part").groupBy("cell", "part")
    return left.cogroup(right).applyInPandas(answer, schema)


MAX_PATTERNS = 1_000


def knn_fills(
    df: DataFrame, id_column: str, columns: Sequence[str], k: int = 5, donors: DataFrame | None = None, means: Mapping[str, float | None] | None = None, **cells
) -> DataFrame:
    """Fill numeric columns with the mean of the k nearest donors that have the value.

    Donors are the rows themselves, or the training rows given as ``donors``.

    The distance uses the columns both rows have, scaled up for those they do not share.
    Rows are grouped by which columns they have; for each pair of groups this is a plain
    nearest-neighbour join, and the k best over all pairs are averaged. Rows without any
    usable donor get the column mean, of the donors unless ``means`` has it.
    """
    from .aggregates import aggregate_row

    source = df if donors is None else donors
    means = aggregate_row(source, {c: F.avg(dbl(c)) for c in columns}) if means is None else means
    pattern = F.concat(*[F.col(c).isNotNull().cast("int").cast("string") for c in columns])

    def mark(rows):
        return cut_lineage(rows.select(id_column, *[dbl(c).alias(c) for c in columns], pattern.alias("__p")))

    def patterns_of(rows):
        held = [r[0] for r in rows.select("__p").distinct().limit(MAX_PATTERNS + 1).collect()]
        if len(held) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} combinations of missing columns; impute fewer columns at a time")
        return held

    marked = mark(df)
    giving_rows = marked if donors is None else mark(donors)
    patterns, donor_patterns = patterns_of(marked), patterns_of(giving_rows)
    has = {p: [c for c, bit in zip(columns, p) if bit == "1"] for p in {*patterns, *donor_patterns}}
    # Pairs of patterns with the same shared columns are blocks of one neighbour join.
    joins: dict[tuple, list[tuple[str, str]]] = {}
    for p in patterns:
        for donor in donor_patterns:
            shared = tuple(c for c in has[p] if c in has[donor])
            if shared and any(c not in has[p] for c in has[donor]):
                joins.setdefault(shared, []).append((p, donor))
    found = None
    for shared, pairs in joins.items():
        table = F.broadcast(small_table(df.sparkSession, [(p, d, f"{p}|{d}") for p, d in pairs], "p string, d string, __b string"))
        asking = marked.join(table, F.col("__p") == F.col("p")).select(F.concat_ws("|", "__b", id_column).alias("__q"), "__b", *shared)
        giving = giving_rows.join(table, F.col("__p") == F.col("d")).select(id_column, "__b", *shared)
        near = nearest(asking, giving, "__q", id_column, list(shared), k, "__b", **cells)
        scale = (len(columns) / len(shared)) ** 0.5
        part = near.select("__q", "neighbour", F.round(F.col("distance") * scale, 9).alias("distance"))
        found = part if found is None else found.unionByName(part)
    if found is not None:
        asked, gave = F.split_part("__q", F.lit("|"), F.lit(1)), F.split_part("__q", F.lit("|"), F.lit(2))
        wanted = [
            F.when((F.substring(asked, i + 1, 1) == "0") & (F.substring(gave, i + 1, 1) == "1"), F.lit(c))
            for i, c in enumerate(columns)
        ]
        row = F.expr(f"substring(__q, {2 * len(columns) + 3})").cast(df.schema[id_column].dataType)
        found = found.select(
            row.alias(id_column), "neighbour", "distance", F.explode(F.array_compact(F.array(*wanted))).alias("column")
        )
    filled = df
    if found is not None:
        best = F.row_number().over(Window.partitionBy("column", id_column).orderBy("distance", "neighbour"))
        chosen = found.withColumn("r", best).where(F.col("r") <= k)
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
        given = giving_rows.select(F.col(id_column).alias("neighbour"), values.alias("v")).select("neighbour", "v.column", "v.value")
        guesses = (
            chosen.join(given, ["column", "neighbour"]).groupBy(id_column)
            .agg(*[F.avg(F.when(F.col("column") == c, F.col("value"))).alias(f"__g_{c}") for c in columns])
        )
        filled = df.join(guesses, id_column, "left")
    else:
        filled = df.select("*", *[F.lit(None).cast("double").alias(f"__g_{c}") for c in columns])
    return filled.select(
        *[F.coalesce(dbl(c), F.col(f"__g_{c}"), F.lit(means[c])).alias(c) if c in columns else c for c in df.columns]
    )


def local_outlier_factor(df: DataFrame, id_column: str, columns: Sequence[str], k: int = 20, **cells) -> DataFrame:
    """(id, lof): k-distance, reachability, local density and their ratio, as joins on the neighbour table."""
    near = cut_lineage(nearest(df, df, id_column, id_column, columns, k, exclude_same_id=True, **cells))
    reach = near.groupBy(id_column).agg(F.max("distance").alias("kd"))
    neighbour_reach = reach.select(F.col(id_column).alias("neighbour"), "kd")
    density = (
        near.join(neighbour_reach, "neighbour").groupBy(id_column)
        .agg((1 / (F.avg(F.greatest("distance", "kd")) + 1e-10)).alias("lrd"))
    )
    density = cut_lineage(density)
    around = near.join(density.select(F.col(id_column).alias("neighbour"), F.col("lrd").alias("nlrd")), "neighbour")
    return around.groupBy(id_column).agg(F.avg("nlrd").alias("m")).join(density, id_column).select(
        id_column, (F.col("m") / F.col("lrd")).alias("lof")
    )


def fit_lof(train: DataFrame, id_column: str, columns: Sequence[str], k: int = 20, contamination: float = 0.05, **cells) -> dict:
    """Training state for scoring new rows: scaling, neighbour densities and the cut-off.

    ``points`` holds the training rows with their k-distance and density (a written table).
    """
    from .aggregates import exact_quantiles
    from .scale import apply_scaler

    centre = {c: v for c, v in exact_quantiles(train, {c: [0.25, 0.5, 0.75] for c in columns}).items()}
    medians = {c: v[1] for c, v in centre.items()}
    scaling = {c: (v[1], (v[2] - v[0]) or 1.0) for c, v in centre.items()}
    ready = apply_scaler(train.select(id_column, *[F.coalesce(dbl(c), F.lit(medians[c])).alias(c) for c in columns]), scaling)
    near = cut_lineage(nearest(ready, ready, id_column, id_column, columns, k, exclude_same_id=True, **cells))
    reach = near.groupBy(id_column).agg(F.max("distance").alias("kd"))
    density = cut_lineage(
        near.join(reach.select(F.col(id_column).alias("neighbour"), "kd"), "neighbour").groupBy(id_column)
        .agg((1 / (F.avg(F.greatest("distance", "kd")) + 1e-10)).alias("lrd"))
    )
    around = near.join(density.select(F.col(id_column).alias("neighbour"), F.col("lrd").alias("nlrd")), "neighbour")
    lof = around.groupBy(id_column).agg(F.avg("nlrd").alias("m")).join(density, id_column).select((F.col("m") / F.col("lrd")).alias("lof"))
    cutoff = exact_quantiles(lof, {"lof": [1 - contamination]})["lof"][0]
    points = cut_lineage(ready.join(reach, id_column).join(density, id_column))
    return {"columns": list(columns), "medians": medians, "scaling": scaling, "points": points, "cutoff": cutoff, "k": k}


def score_lof(df: DataFrame, id_column: str, fitted: dict, train_id: str | None = None, **cells) -> DataFrame:
    """Add ``lof`` and ``is_outlier_multivariate`` against the training rows only."""
    from .scale import apply_scaler

    train_id = train_id or id_column
    columns, k, points = fitted["columns"], fitted["k"], fitted["points"]
    ready = apply_scaler(
        df.select(id_column, *[F.coalesce(dbl(c), F.lit(fitted["medians"][c])).alias(c) for c in columns]), fitted["scaling"]
    )
    near = nearest(ready, points, id_column, train_id, columns, k, **cells)
    state = points.select(F.col(train_id).alias("neighbour"), "kd", "lrd")
    lof = near.join(state, "neighbour").groupBy(id_column).agg(
        (F.avg("lrd") * (F.avg(F.greatest("distance", "kd")) + 1e-10)).alias("lof")
    )
    return df.join(lof, id_column, "left").withColumn(
        "is_outlier_multivariate", (F.col("lof") > F.lit(fitted["cutoff"])).cast("int")
    )
