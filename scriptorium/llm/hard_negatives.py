"""Hard negatives for contrastive training, searched in cover trees over norm-augmented vectors."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import table
from scriptorium.llm.vectors import blocks_for, dealt, inner, matrix, meet

#: Rows of one tree, trees of one shard, most children of a node, most rows of a node that isn't split any further.
TREE_ROWS, TREES, FANOUT, LEAF = 4096, 4, 64, 32
ANY = np.iinfo(np.int64).min


def augmented(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """(vectors with one more component, m): all of length sqrt(m) now, so that distance to a query (.., 0) falls as the inner product grows."""
    squares = (vectors * vectors).sum(1)
    m = float(squares.max(initial=0))
    return np.c_[vectors, np.sqrt(np.maximum(0, m - squares))], m


def build(vectors: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree: each node's centre is one of its rows and its first child's centre; children lie within half their parent's covering radius.

    Centres of one level are further apart than that half. Nodes come level by level, children together; a node holds the
    rows order[start:end], the centre first. A node of few rows, or whose rows would need more than FANOUT centres, is a leaf.
    """
    points, m = augmented(vectors)
    order = np.arange(len(vectors))

    def away(centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 * m - 2 * (points[rows] @ points[centre])))

    spans, radius, first, children = [(0, len(order))], [], [], []
    for start, end in spans:  # grows as it is walked
        rows = order[start:end]
        reach = away(rows[0], rows)
        radius.append(reach.max(initial=0))
        first.append(len(spans))
        children.append(0)
        if len(rows) <= LEAF or radius[-1] ** 2 <= 1e-9 * m:
            continue
        owner, near, at = np.full(len(rows), -1), reach, 0
        while True:
            owner[(owner < 0) & (near <= radius[-1] / 2)] = at
            rest = np.flatnonzero(owner < 0)
            if not len(rest) or at + 1 == FANOUT:
                break
            at += 1
            owner[rest[0]] = at
            near = away(rows[rest[0]], rows)
        if len(rest):
            continue
        place = np.argsort(owner, kind="stable")  # a centre is the first row that it owns
        order[start:end] = rows[place]
        edges = start + np.r_[0, np.cumsum(np.bincount(owner))]
        spans += list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        children[-1] = at + 1
    label = [labels[order[a]] if a < b and (labels[order[a:b]] == labels[order[a]]).all() else ANY for a, b in spans]
    return {"order": order, "spans": np.array(spans), "radius": np.array(radius), "first": np.array(first), "children": np.array(children), "label": np.array(label, np.int64)}


def packed(rows: pa.Table) -> pa.Table:
    """One row (block, tree) with the tree of a block's rows (row_key, vec_id, label, v) and the rows in its order."""
    vectors, labels = matrix(rows["v"]), rows["label"].to_numpy()
    tree = build(vectors, labels)
    order = tree.pop("order")
    small = next((t for t in (np.int16, np.int32, np.float64) if t is np.float64 or np.abs(vectors).max(initial=0) <= np.iinfo(t).max), None)
    np.savez(out := io.BytesIO(), vectors=vectors[order].astype(small), labels=labels[order], keys=rows["row_key"].to_numpy()[order], ids=rows["vec_id"].to_numpy()[order], **tree)
    return pa.table([rows["block"].slice(0, 1), pa.array([out.getvalue()], pa.binary())], ["block", "tree"])


class Forest:
    """The trees of a shard, and the bounds of their nodes for a run of anchors."""

    def __init__(self, trees: list[bytes]) -> None:
        self.trees, self.roots, at = [], [], 0
        for data in trees:
            tree = dict(np.load(io.BytesIO(data)))
            tree["vectors"] = tree["vectors"].astype(np.float64)
            points, tree["m"] = augmented(tree["vectors"])
            tree["centres"], tree["most"], tree["at"] = points[tree["spans"][:, 0]], float(np.abs(points).max(initial=0)), at
            self.trees.append(tree)
            self.roots.append(at)
            at += len(tree["radius"])
        self.of = np.repeat(np.arange(len(self.trees)), [len(t["radius"]) for t in self.trees]).tolist()
        self.label = np.concatenate([t["label"] for t in self.trees]).tolist() if self.trees else []

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) inner product of each anchor with any row of each node, from the distance to its centre and its covering radius."""
        squares = (anchors * anchors).sum(1)[:, None]
        low, high = [], []
        for t in self.trees:
            d = min(anchors.shape[1], t["centres"].shape[1] - 1)
            total = squares + t["m"]
            distance = np.sqrt(np.maximum(0, total - 2 * (anchors[:, :d] @ t["centres"][:, :d].T)))
            room = 1e-6 * total + 1e-6  # for rounding
            low.append((total - (distance + t["radius"]) ** 2) / 2 - room)
            high.append((total - np.maximum(0, distance - t["radius"]) ** 2) / 2 + room)
        return np.concatenate(low, 1), np.concatenate(high, 1)

    def descend(self, anchor: dict, low: list, high: list, least: float, most: float, k: int, same: bool) -> list[tuple[int, int]]:
        """The k best (-score, vec_id) of rows with the anchor's label, or with another, whose score is from least to most."""
        best: list[tuple[int, int]] = []

        def open_nodes(nodes) -> Iterator[tuple[float, int]]:
            for n in nodes:
                outside = high[n] < least or low[n] > most
                barren = self.label[n] != ANY and (self.label[n] == anchor["label"]) != same
                if not outside and not barren:
                    yield -min(high[n], most), n

        heap = list(open_nodes(self.roots))
        heapq.heapify(heap)
        while heap:
            reach, node = heapq.heappop(heap)
            if len(best) == k and -reach < -best[-1][0]:
                break  # no other node comes nearer
            tree = self.trees[self.of[node]]
            i = node - tree["at"]
            if tree["children"][i]:
                first = tree["at"] + int(tree["first"][i])
                for entry in open_nodes(range(first, first + int(tree["children"][i]))):
                    heapq.heappush(heap, entry)
                continue
            a, b = tree["spans"][i]
            if node not in anchor["scores"]:
                anchor["scores"][node] = inner(tree["vectors"][a:b], anchor["vector"], tree["most"])
            scores = anchor["scores"][node]
            ok = ((tree["labels"][a:b] == anchor["label"]) == same) & (scores >= max(least, -best[-1][0] if len(best) == k else least)) & (scores <= most)
            at = np.flatnonzero(ok & (tree["keys"][a:b] != anchor["key"]))
            if len(at) > k:
                top = scores[at]
                at = at[top >= (np.sort(top) if top.dtype == object else np.partition(top, -k))[-k]]
            best = sorted([*best, *((-int(scores[x]), int(tree["ids"][a + x])) for x in at)])[:k]
        return best


def anchors_of(rows: pa.Table, forest: Forest, step: int = 256) -> Iterator[tuple[int, dict, list, list]]:
    """(place, anchor, least, most) for each anchor, the bounds of all nodes taken for `step` anchors at a time."""
    vectors, labels, keys = matrix(rows["v"]), rows["label"].to_pylist(), rows["row_key"].to_pylist()
    for a in range(0, len(rows) if forest.trees else 0, step):
        low, high = (x.tolist() for x in forest.bounds(vectors[a : a + step]))
        for i in range(len(low)):
            yield a + i, {"vector": vectors[a + i], "label": labels[a + i], "key": keys[a + i], "scores": {}}, low[i], high[i]


def _positives(anchors: pa.Table, trees: pa.Table, k: int) -> pa.Table:
    forest, out, ids = Forest(trees["tree"].to_pylist()), [], anchors["vec_id"].to_pylist()
    for i, anchor, low, high in anchors_of(anchors, forest):
        out += [(anchor["key"], ids[i], -s, v) for s, v in forest.descend(anchor, low, high, -np.inf, np.inf, k, True)]
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["anchor_key", "anchor_id", "positive_score", "positive_id"])


def _negatives(anchors: pa.Table, trees: pa.Table, k: int, low_share: int, high_share: int) -> pa.Table:
    forest, out, wanted = Forest(trees["tree"].to_pylist()), [], anchors["scores"].to_pylist()
    for i, anchor, low, high in anchors_of(anchors, forest):
        for n, score in enumerate(wanted[i]):
            least, most = -(-low_share * score // 100), high_share * score // 100
            if least <= most:
                out += [(anchor["key"], n, -s, v) for s, v in forest.descend(anchor, low, high, least, most, k, False)]
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["anchor_key", "n", "negative_score", "negative_id"])


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, tree_rows: int = TREE_ROWS, anchor_rows: int = 2000) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, v: whole doubles).

    A score is the exact inner product with the anchor; higher ones come first, ties by smaller vec_id. An anchor's positives
    are its first other rows of its label; for each, the first rows of other labels come back whose score is from low to high
    hundredths of the positive's. Rows are dealt by hash to blocks with one cover tree each, written once; a task searches the
    trees of a shard for a block of anchors, best node first, skips nodes whose bounds lie outside the window or below what
    it has, and scores leaves exactly; shards' results are merged. No row is left out.

    Rows whose vec_id, label or v is null take no part. Rows that repeat a vec_id are rows of their own (each is an anchor,
    and the others with that id are other rows). Shorter vectors count as filled up with zeros. A positive score of 0 leaves a
    window of 0 alone, a negative one none. A score beyond 64 bits is an OverflowError. Extra columns don't matter; an empty
    table, one label, or anchors without others of their label give no rows.
    """
    kept = rows.where("vec_id is not null and label is not null and v is not null")
    held = table(kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v", F.coalesce(anchor, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row_key")), "vectors")
    blocks = blocks_for(held, tree_rows)
    shards = -(-blocks // TREES)
    columns = ["row_key", "vec_id", "label", "v"]
    grown = held.select(*columns, dealt("row_key", blocks).alias("block")).groupBy("block").applyInArrow(packed, "block int, tree binary")
    trees = table(grown, "trees").select("tree", (F.col("block") % shards).alias("block"))
    asked = held.where("asked").select(*columns)

    near = meet(asked, "row_key", trees, shards, lambda a, t: _positives(a, t, positives), "anchor_key long, anchor_id long, positive_score long, positive_id long", anchor_rows)
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("anchor_key").orderBy(F.desc("positive_score"), "positive_id")) - 1).where(F.col("n") < positives)
    first = table(first, "positives")
    listed = first.groupBy(F.col("anchor_key").alias("row_key")).agg(F.sort_array(F.collect_list(F.struct("n", "positive_score")))["positive_score"].alias("scores"))
    windows = table(asked.join(listed, "row_key"), "windows")
    far = meet(windows, "row_key", trees, shards, lambda a, t: _negatives(a, t, negatives, low, high), "anchor_key long, n long, negative_score long, negative_id long", anchor_rows)
    rank = F.row_number().over(Window.partitionBy("anchor_key", "n").orderBy(F.desc("negative_score"), "negative_id"))
    chosen = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return chosen.join(first, ["anchor_key", "n"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
