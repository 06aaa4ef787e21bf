"""Operator 3: near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components, forest
from .store import Stage

#: Dimensions of a block; fewer make cheaper cells but a looser budget each.
BLOCK_DIMS = 16
#: Vectors of one cell that meet in one task; larger cells are cut into parts, and pairs of parts are dealt out.
PART = 8192
#: Room for rounding where coordinates are compared in single precision.
ROOM = 1e-5


def rotation(dims: int, seed: int = 3) -> np.ndarray:
    """A random orthogonal matrix: it spreads what distinguishes vectors evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _blocks(dims: int) -> list[slice]:
    n = max(1, dims // BLOCK_DIMS)
    edges = np.linspace(0, dims, n + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _budget(least_cosine: float, blocks: int) -> float:
    """Squared distance that at least one block of two linked unit vectors stays within (with room for rounding)."""
    return (2 - 2 * least_cosine) / blocks + 1e-9


def _rotated(lists: list, dims: int) -> np.ndarray:
    x = np.array(lists, float)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(dims)


def _cells(batches, least_cosine: float):
    """Each node once per block, in its own strip and as a guest in the next: strips are as wide as the block's budget.

    Only the block's coordinates go along, in single precision.
    """
    for pdf in batches:
        lists = pdf["vector"].tolist()
        for dims in {len(v) for v in lists}:
            own = np.array([i for i, v in enumerate(lists) if len(v) == dims])
            y = _rotated([lists[i] for i in own], dims)
            for j, block in enumerate(_blocks(dims)):
                width = _budget(least_cosine, len(_blocks(dims))) ** 0.5 + ROOM
                strip = np.floor(y[:, block.start] / width).astype(np.int64)
                at = y[:, block].astype(np.float32)
                for guest in (0, 1):
                    yield pd.DataFrame(
                        {"node": pdf["node"].to_numpy()[own], "label": pdf["label"].to_numpy()[own], "dims": dims, "block": j, "strip": strip + guest, "guest": guest, "at": list(at)}
                    )


def near_pairs(y: np.ndarray, left: np.ndarray, right: np.ndarray, budget: float):
    """Pairs (rows of y) within a squared distance, each from ``left`` and ``right``; also how many were compared in full.

    Both sides are sorted by the first coordinate; runs of the left meet the window of the right that the budget allows.
    There the sum over the first quarter of the coordinates must be within the budget before all of them are compared.
    """
    right = right[np.argsort(y[right, 0])]
    left = left[np.argsort(y[left, 0])]
    reach = budget**0.5
    head = max(1, y.shape[1] // 4)
    compared = 0

    def squares(a, b, columns):
        p, q = y[a][:, columns], y[b][:, columns]
        return (p**2).sum(axis=1)[:, None] + (q**2).sum(axis=1)[None, :] - 2 * (p @ q.T)

    for i in range(0, len(left), 256):
        a = left[i : i + 256]
        lo = np.searchsorted(y[right, 0], y[a[0], 0] - reach, "left")
        hi = np.searchsorted(y[right, 0], y[a[-1], 0] + reach, "right")
        for k in range(lo, hi, 4096):
            b = right[k : min(hi, k + 4096)]
            ia, ib = np.nonzero(squares(a, b, slice(0, head)) <= budget)
            u, v = a[ia], b[ib]
            compared += len(u)
            for c in range(0, len(u), 1 << 16):
                own = slice(c, c + (1 << 16))
                ok = ((y[u[own]] - y[v[own]]) ** 2).sum(axis=1) <= budget
                yield u[own][ok], v[own][ok], compared
                compared = 0
    yield left[:0], left[:0], compared


def _met(pdf: pd.DataFrame):
    """Row numbers of both parts of a cell, which rows are guests, and whether the parts are one."""
    side, guest = pdf["side"].to_numpy(), pdf["guest"].to_numpy().astype(bool)
    same = int(pdf["part"].iloc[0]) == int(pdf["other"].iloc[0])
    every = np.arange(len(pdf))
    return (every, every, guest, same) if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1), guest, same)


def _meets(u, v, guest, same):
    """Pairs that count in this cell: a home with a home or with a guest, each pair once."""
    ok = ~(guest[u] & guest[v])
    return ok & (u < v) if same else ok


def _hopeful(pdf: pd.DataFrame, least_cosine: float) -> pd.DataFrame:
    """The nodes of a cell's pair of parts that are within the block's budget of another."""
    left, right, guest, same = _met(pdf)
    y = np.array(pdf["at"].tolist(), np.float32)
    budget = _budget(least_cosine, len(_blocks(int(pdf["dims"].iloc[0])))) + ROOM
    some = np.zeros(len(y), bool)
    for u, v, _ in near_pairs(y, left, right, budget):
        ok = _meets(u, v, guest, same)
        some[u[ok]] = some[v[ok]] = True
    return pdf.loc[some, _CELL_NODE]


def _links(pdf: pd.DataFrame, least_cosine: float) -> pd.DataFrame:
    """Links among the hopeful nodes of a cell's pair of parts: a count for each node and a forest that spans them.

    A pair is taken only in the first of its blocks that is within budget, and only where a home meets a home of the
    same strip or a guest of the strip before, so each link is counted once in all cells. A node counts as its copies.
    """
    left, right, guest, same = _met(pdf)
    lists = pdf["vector"].tolist()
    dims, j = int(pdf["dims"].iloc[0]), int(pdf["block"].iloc[0])
    x = np.array(lists, float)
    norms = np.linalg.norm(x, axis=1)
    y = _rotated(lists, dims)
    blocks = _blocks(dims)
    budget = _budget(least_cosine, len(blocks))
    copies = pdf["copies"].to_numpy()
    counts, root = np.zeros(len(x), np.int64), np.arange(len(x))

    def within(a: np.ndarray, b: np.ndarray, block: slice) -> np.ndarray:
        return ((y[a, block] - y[b, block]) ** 2).sum(axis=1) <= budget

    for u, v, _ in near_pairs(y[:, blocks[j]], left, right, budget):
        keep = _meets(u, v, guest, same)
        for earlier in blocks[:j]:
            keep &= ~within(u, v, earlier)
        u, v = u[keep], v[keep]
        cosine = np.einsum("ij,ij->i", x[u], x[v]) / (norms[u] * norms[v])
        u, v = u[cosine >= least_cosine], v[cosine >= least_cosine]
        np.add.at(counts, u, copies[v])
        np.add.at(counts, v, copies[u])
        if len(u):  # the forest so far and the new links
            more = np.flatnonzero(root != np.arange(len(root)))
            root = forest(len(x), np.concatenate([u, more]), np.concatenate([v, root[more]]))
    nodes = pdf["node"].to_numpy()
    some = counts > 0
    return pd.DataFrame({"node": nodes[some], "root": nodes[root[some]], "n": counts[some]})


_CELL = ["label", "dims", "block", "strip"]
_CELL_NODE = [*_CELL, "part", "other", "side", "guest", "node"]


def near_vectors(spark: SparkSession, df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least_cosine: float = 0.93) -> DataFrame:
    """``<id>, n_links, component_id, kept`` for every row.

    Rows with equal, non-null labels and vectors of equal length link if their cosine (double precision) reaches
    ``least_cosine``. Equal vectors of a label form one node. Unit vectors are rotated and split into blocks; of two
    that link, some block's squared distance is within its share of 2 - 2 * cosine. Each block is range-joined in strips
    of that width on its coordinates alone; only nodes that are near another in some block meet again with their whole
    vectors, where the union of the candidates is verified and a pair counts in its first block only. Cells of any size
    are cut into parts and the pairs of parts dealt to tasks, which return nodes, counts and spanning forests, not pairs.
    Vectors that are null, empty, zero or not finite, and null labels, link with nothing. Rows with equal ids are rows
    of their own and each gets the smallest id reachable; a null id counts only where its component has no other.
    ``kept`` is id = component_id. An empty table gives an empty result; other columns are not looked at.
    """
    stage = Stage(spark, "embeddings")
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.when(fine & F.col(label_col).isNotNull(), F.col(vector_col)).alias("vector"))
    rows = stage.save(rows)
    known = rows.where("vector is not null")
    nodes = known.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("least_id"))
    nodes = stage.save(nodes.withColumn("node", F.monotonically_increasing_id()))
    spread = nodes.select("node", "label", "vector").mapInPandas(
        lambda batches: _cells(batches, least_cosine), "node long, label string, dims int, block int, strip long, guest int, at array<float>"
    )
    spread = stage.save(spread)
    homes = spread.groupBy(*_CELL).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.min("guest").alias("least"), F.count("*").alias("size")).where("least = 0 and size > 1")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # a row of part p goes to the pairs (p, q >= p) as the left side and (q < p, p) as the right
    dealt = (
        spread.join(homes.select(*_CELL, "parts"), _CELL)
        .withColumn("own", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("part", F.least("own", "with"))
        .withColumn("other", F.greatest("own", "with"))
        .withColumn("side", (F.col("own") > F.col("with")).cast("int"))
    )
    types = "label string, dims int, block int, strip long, part int, other int, side int, guest int, node long"
    hopeful = stage.save(dealt.groupBy(*_CELL, "part", "other").applyInPandas(lambda pdf: _hopeful(pdf, least_cosine), types))
    stage.drop(spread)
    whole = hopeful.join(nodes.select("node", "vector", "copies"), "node")
    found = whole.groupBy(*_CELL, "part", "other").applyInPandas(lambda pdf: _links(pdf, least_cosine), "node long, root long, n long")
    found = stage.save(found)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = stage.save(connected_components(stage, found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    least = parts.join(nodes.select("node", "least_id"), "node").groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_node = nodes.join(counts, "node", "left").join(parts.join(least, "component").select("node", "component_id"), "node", "left").select(
        "label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")
    )
    out = rows.join(of_node, ["label", "vector"], "left")
    component = F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
