"""Components and communities of neighbour graphs, and what becomes of isolated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabseg.operators import pairs
from tabseg.session import broadcast_if_small, forget, gathered, hash32, materialise

#: Rounds of moves after which a level of communities is condensed even if rows would still move.
MOST_TURNS = 24


def _stored(df: DataFrame) -> DataFrame:
    return gathered(materialise(df))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is connected with id.

    Every round each node points to the neighbour of smallest random rank (or stays), takes its pointer's pointer,
    and the graph is contracted along the pointers, so that nodes and edges shrink by a constant factor; it ends
    when no edge is left. The rounds' pointers are then composed from the last to the first.
    """
    left = _stored(edges.select(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b")).where("a <> b").distinct())
    both = _stored(left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    forget(left)
    moves: list[DataFrame] = []
    while not both.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(moves))).alias("h"), F.col(c).alias("v"))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("v"), F.least("near", rank("a"))["v"].alias("to"))
        near = _stored(near)
        move = _stored(near.join(near.select(F.col("v").alias("to"), F.col("to").alias("over")), "to").select("v", F.col("over").alias("to")))
        forget(near)
        step = both.join(move.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(move.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        smaller = _stored(step.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        forget(both)
        both = smaller
        moves.append(move)
    root: DataFrame | None = None
    for move in reversed(moves):
        if root is None:
            root = move
            continue
        longer = _stored(move.join(root.select(F.col("v").alias("to"), F.col("to").alias("end")), "to", "left").select("v", F.coalesce("end", "to").alias("to")))
        forget(root, move)
        root = longer
    ids = nodes.select(F.col("id"))
    if root is None:
        return ids.select("id", F.col("id").alias("component"))
    first = root.groupBy("to").agg(F.least(F.min("v"), F.first("to")).alias("component"))
    held = root.join(first, "to").select(F.col("v").alias("id"), "component")
    return ids.join(held, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _moved(edges: DataFrame, state: DataFrame, resolution: float, seed: object, half: int, m2: float) -> DataFrame:
    """One round of moves by modularity gain: id, label, k (degree), was. One half of the nodes, parted by hash, may move."""
    totals = state.groupBy("label").agg(F.sum("k").alias("total"))
    near = edges.join(state.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label", "w")
    near = near.unionByName(state.select("id", "label", F.lit(0.0).alias("w"))).groupBy("id", "label").agg(F.sum("w").alias("w"))
    scored = near.join(totals, "label").join(state.select("id", "k", F.col("label").alias("own")), "id")
    here = F.col("label") == F.col("own")
    gain = F.col("w") - F.lit(resolution) * F.col("k") * (F.col("total") - F.when(here, F.col("k")).otherwise(0.0)) / F.lit(m2)
    # equal gains: stay, else the smallest label; gains are compared to twelve digits of the node's degree
    order = F.struct(F.round(gain / F.col("k"), 12).alias("g"), here.alias("stay"), (-F.col("label")).alias("less"))
    best = scored.groupBy("id").agg(F.max_by("label", order).alias("best"), F.first("own").alias("was"), F.first("k").alias("k"))
    may = F.pmod(hash32(F.col("id"), f"louvain:{seed}"), F.lit(2)) == half
    return best.select("id", F.when(may, F.col("best")).otherwise(F.col("was")).alias("label"), "k", "was")


def _settle(edges: DataFrame, state: DataFrame, resolution: float, seed: object, m2: float) -> tuple[DataFrame, bool]:
    """Rounds of moves, of one half and then of the other, until both change nothing; whether anything moved. edges: no loops."""
    any_ = False
    for turn in range(MOST_TURNS // 2):
        one = _moved(edges, state, resolution, f"{seed}:{turn}", 0, m2)
        two = _moved(edges, one.drop("was"), resolution, f"{seed}:{turn}", 1, m2).drop("was")
        new = _stored(two.join(state.select("id", F.col("label").alias("was")), "id"))
        moved = not new.where("label <> was").isEmpty()
        forget(state)
        state = new.drop("was")
        state._stored_at = new._stored_at
        any_ |= moved
        if not moved:
            break
    return state, any_


def louvain(nodes: DataFrame, similar: DataFrame, resolution: float = 1.0, seed: int = 42, refine: bool = False) -> DataFrame:
    """(id, label): communities of high modularity. similar: src, dst, w in both directions; nodes without edges stay alone.

    The same at every size: rounds of simultaneous moves in the cluster, then communities are condensed to nodes, until
    nothing moves. With `refine` (Leiden) what is condensed are not the communities but their well connected parts, found
    by moves inside each community that begin from single nodes; so every community is connected.
    """
    edges = _stored(similar.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), F.col("w").cast("double").alias("w")).where("w > 0"))
    m2 = edges.agg(F.sum("w")).first()[0] or 0.0
    place = _stored(nodes.select("id", F.col("id").cast("bigint").alias("node")))
    if not m2:
        return place.select("id", F.col("node").alias("label"))
    state = _stored(edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).select("id", F.col("id").alias("label"), "k"))
    level = 0
    while True:
        inner = edges.where("src <> dst")
        state, moved = _settle(inner, state, resolution, f"{seed}:{level}", m2)
        if not moved and level:
            break
        parts = state
        if refine:
            a, b = state.select(F.col("id").alias("src"), F.col("label").alias("a")), state.select(F.col("id").alias("dst"), F.col("label").alias("b"))
            inside = _stored(inner.join(a, "src").join(b, "dst").where("a = b").select("src", "dst", "w"))
            single = _stored(state.select("id", F.col("id").alias("label"), "k"))
            parts, _ = _settle(inside, single, resolution, f"{seed}:{level}:refine", m2)
            forget(inside)
        # parts become nodes; each starts in the community that its members were in
        whole = _stored(parts.select("id", F.col("label").alias("part"), "k").join(state.select("id", "label"), "id"))
        begin = _stored(whole.groupBy(F.col("part").alias("id")).agg(F.min("label").alias("community"), F.sum("k").alias("k")))
        names = begin.groupBy("community").agg(F.min("id").alias("label"))  # labels are ids of nodes
        begin2 = _stored(begin.join(names, "community").select("id", "label", "k"))
        to_a, to_b = whole.select(F.col("id").alias("src"), F.col("part").alias("a")), whole.select(F.col("id").alias("dst"), F.col("part").alias("b"))
        small = _stored(edges.join(to_a, "src").join(to_b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        on = _stored(place.join(whole.select(F.col("id").alias("node"), "part"), "node", "left").select("id", F.coalesce("part", "node").alias("node")))
        shrunk = begin2.count() < whole.count()
        forget(place, edges, state, parts, whole, begin)
        place, edges, state, level = on, small, begin2, level + 1
        if not shrunk:
            break
    return place.join(state.select(F.col("id").alias("node"), "label"), "node", "left").select("id", F.coalesce("label", "node").alias("label"))


def leiden(nodes: DataFrame, similar: DataFrame, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """Louvain with refinement, so that communities are connected; simultaneous moves could still part one, so its components are the result."""
    found = materialise(louvain(nodes, similar, resolution, seed, refine=True))
    a, b = found.select(F.col("id").alias("src"), F.col("label").alias("a")), found.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    inside = similar.where("w > 0").select("src", "dst").join(a, "src").join(b, "dst").where("a = b").select("src", "dst")
    return components(nodes, inside).select("id", F.col("component").alias("label"))


def modularity(similar: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (id, label) over the weighted edges in both directions."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    e = similar.join(a, "src").join(b, "dst")
    m2 = e.agg(F.sum("w")).first()[0] or 0.0
    inside = e.where("a = b").agg(F.sum("w")).first()[0] or 0.0
    squares = e.groupBy("a").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return inside / m2 - resolution * squares / m2**2 if m2 else 0.0


def renumber(labels: DataFrame) -> DataFrame:
    """Labels 0.. by falling size, then by smallest id; -1 stays. The numbering runs over labels, not rows."""
    from pyspark.sql.window import Window

    size = labels.where("label <> -1").groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    number = size.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("number"))
    return labels.join(broadcast_if_small(number), "label", "left").select("id", F.coalesce("number", F.lit(-1)).cast("int").alias("label"))


def handle_noise(labels: DataFrame, strategy: str = "mark", cells: DataFrame | None = None) -> DataFrame:
    """mark: lone rows get -1 (all lone: one cluster 0); merge: the label of the nearest of all rows in larger clusters (cells: id, cells); singleton: kept."""
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    x = labels.join(broadcast_if_small(size), "label")
    if strategy == "singleton":
        return renumber(labels)
    if size.where("n > 1").isEmpty():
        return labels.select("id", F.lit(0).alias("label"))
    if strategy == "merge":
        x = materialise(x.select("id", "label", "n"))
        lone, crowd = x.where("n = 1").select("id"), x.where("n > 1").select(F.col("id"), F.col("label").alias("to"))
        near = pairs.nearest_other(cells.join(lone, "id", "left_semi"), cells.join(crowd, "id", "left_semi"), "id", "id")
        to = near.select("id", F.col("other")).join(crowd.select(F.col("id").alias("other"), "to"), "other").select("id", "to")
        return renumber(x.join(to, "id", "left").select("id", F.coalesce("to", "label").alias("label")))
    return renumber(x.select("id", F.when(F.col("n") == 1, -1).otherwise(F.col("label")).alias("label")))


def parse_graph(text: str) -> dict:
    """'louvain' or 'leiden:k=20, resolution=1.5' as settings."""
    name, _, rest = text.strip().lower().partition(":")
    if name not in ("louvain", "leiden"):
        raise ValueError(f"unknown graph clusterer {text!r}")
    out: dict = {"algorithm": name}
    for part in filter(None, (p.strip() for p in rest.split(","))):
        key, _, value = (x.strip() for x in part.partition("="))
        if key not in ("k", "gamma", "resolution"):
            raise ValueError(f"unknown setting {key!r}")
        out["k" if key == "k" else "resolution"] = int(value) if key == "k" else float(value)
    return out


def graph_clusters(cells: DataFrame, id_col: str, k: int = 15, resolution: float = 1.0, algorithm: str = "louvain", noise: str = "mark", weight: str = "linear", mutual: bool = False, banding: bool = False, seed: int = 42) -> DataFrame:
    """(id, label): neighbours by Hamming distance, similarities, communities, noise. Copies (distance 0) stay connected.

    Neighbours are exact at every size; banding=True asks for those that share a band instead.
    """
    if cells.isEmpty():
        return cells.select(F.col(id_col).alias("id"), F.lit(0).alias("label"))
    if mutual:
        near = materialise(pairs.knn(cells, id_col, k))
        both = materialise(pairs.mutual(near))
    else:
        both = materialise(pairs.sparse_graph(cells, id_col, k, banding))
    nodes = cells.select(F.col(id_col).alias("id"))
    find = leiden if algorithm == "leiden" else louvain
    found = materialise(find(nodes, pairs.edge_similarity(both, weight), resolution, seed))
    return handle_noise(found, noise, cells.select(F.col(id_col).cast("bigint").alias("id"), "cells"))
