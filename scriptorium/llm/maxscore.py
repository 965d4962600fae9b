"""Exact top-k search by inner product over posting lists, with the MaxScore split into essential and other terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import table
from scriptorium.llm.vectors import EXACT, blocks_for, dealt, meet, scaled

FOUND = "query_key long, query_id long, vec_id long, score long"


def components(vector: Column) -> tuple[Column, Column]:
    """A dense vector as (terms, weights): its places and values other than 0."""
    placed = F.filter(F.transform(vector, lambda w, i: F.struct(i.cast("long").alias("t"), w.alias("w"))), lambda x: x["w"] != 0)
    return placed["t"], placed["w"]


class Postings:
    """The postings of a block of rows: one list for each term and sign of its weights, rows ascending.

    Lists by sign keep bounds tight: of a term's two lists, one can only add to a query's score and the other only take away.
    """

    def __init__(self, terms: pa.ChunkedArray, weights: pa.ChunkedArray, whole: bool = False) -> None:
        listed = terms.combine_chunks()
        self.n = len(listed)
        flat, w = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64), weights.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(self.n), np.diff(listed.offsets.to_numpy()))
        order = np.lexsort((row, w < 0, flat))
        flat, w, self.row = flat[order], w[order], row[order]
        first = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | ((w[1:] < 0) != (w[:-1] < 0))]) if len(w) else np.zeros(0, np.int64)
        self.start, self.end = first, np.r_[first[1:], len(w)].astype(np.int64)
        self.largest = float(np.abs(w).max(initial=0))
        self.weight = np.array([int(x) for x in w], object) if whole else w
        self.most, self.least = (f.reduceat(self.weight, first) if len(w) else w for f in (np.maximum, np.minimum))
        self.lists: dict[int, list[int]] = {}
        for i, t in enumerate(flat[first].tolist()):
            self.lists.setdefault(t, []).append(i)
        self.dense: dict[int, np.ndarray] = {}

    def looked_up(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Weights of rows in list i, 0 for those not in it: through a column where the list holds an eighth of all rows, else by bisection."""
        a, b = self.start[i], self.end[i]
        if (b - a) * 8 >= self.n:
            if i not in self.dense:
                column = np.zeros(self.n, self.weight.dtype)
                column[self.row[a:b]] = self.weight[a:b]
                self.dense[i] = column
            return self.dense[i][rows]
        at = np.minimum(np.searchsorted(self.row[a:b], rows), b - a - 1) + a
        return np.where(self.row[at] == rows, self.weight[at], 0)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all rows but `own` that can be among the k best: all that reach the k-th score of the block."""
        lists = [(max(0, w * (self.most[i] if w > 0 else self.least[i])), i, w) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) for i in self.lists.get(t, ())]
        lists.sort(key=lambda x: (x[0], abs(x[2])))
        bound = np.cumsum(np.array([0, *(x[0] for x in lists)], self.weight.dtype))  # bound[i]: the most that the i weakest lists can give together
        least = self.seed(lists, k, own)
        # The weakest lists whose bounds together stay below the score to beat are not essential: a row in no other can't win.
        others = max(0, int(np.searchsorted(bound, least, "left")) - 1)
        score = np.zeros(self.n, self.weight.dtype)
        met = np.zeros(self.n, bool)
        for _, i, w in lists[others:]:
            a, b = self.start[i], self.end[i]
            score[self.row[a:b]] += w * self.weight[a:b]
            met[self.row[a:b]] = True
        if least <= 0:  # rows in no list at all have a score of 0
            met[:] = True
        met[own] = False
        rows = np.flatnonzero(met)
        score = score[rows]
        for left in range(others, -1, -1):  # lists[:left] are still to be probed
            competes = score + bound[left] >= least
            if not competes.all():
                rows, score = rows[competes], score[competes]
            if left and len(rows):
                _, i, w = lists[left - 1]
                score = score + w * self.looked_up(i, rows)
        if len(rows) > k:
            kth = np.sort(score)[-k] if score.dtype == object else np.partition(score, -k)[-k]
            rows, score = rows[score >= kth], score[score >= kth]
        return rows, score

    def seed(self, lists: list[tuple], k: int, own: np.ndarray) -> float:
        """A score that k rows reach: the k-th of the heaviest rows of the strongest list, scored in full; none if it has fewer."""
        if not lists or lists[-1][0] <= 0:
            return -np.inf
        a, b = self.start[lists[-1][1]], self.end[lists[-1][1]]
        most = min(b - a, 4 * k + len(own))
        size = np.abs(self.weight[a:b].astype(float))
        heads = np.setdiff1d(self.row[a:b][np.argpartition(-size, most - 1)[:most]], own)
        if len(heads) < k:
            return -np.inf
        scores = sum(w * self.looked_up(i, heads) for _, i, w in lists)
        return np.sort(scores)[-k]


def _search(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    keys, ids = rows["row_key"].to_numpy(), rows["vec_id"].to_numpy()
    asked = queries["weights"].combine_chunks()
    size = max((len(x) for x in asked), default=0)
    largest = float(np.abs(asked.flatten().to_numpy(zero_copy_only=False)).max(initial=0))
    held = Postings(rows["terms"], rows["weights"])
    wide = size * largest * held.largest >= EXACT
    if wide:
        held = Postings(rows["terms"], rows["weights"], whole=True)
    out: list[list] = [[], [], [], []]
    for key, query, terms, weights in zip(queries["row_key"].to_pylist(), queries["vec_id"].to_pylist(), queries["terms"], queries["weights"], strict=True):
        w = weights.values.to_numpy(zero_copy_only=False)
        found, scores = held.best(terms.values.to_numpy(zero_copy_only=False), np.array([int(x) for x in w], object) if wide else w, k, np.flatnonzero(keys == key))
        for vec_id, score in sorted(zip(ids[found].tolist(), map(int, scores), strict=True), key=lambda x: (-x[1], x[0]))[:k]:
            for column, x in zip(out, (key, query, vec_id, score), strict=True):
                column.append(x)
    return pa.table([pa.array(c, pa.int64()) for c in out], ["query_key", "query_id", "vec_id", "score"])


def top_k(rows: DataFrame, asked: Column, k: int = 10, block_rows: int = 16_384, query_rows: int = 2000) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which `asked` holds, the k other rows with the highest inner product.

    rows: vec_id, terms (array<long>, each at most once a row), weights (whole doubles, none 0). Ties go to the smaller vec_id.
    Rows are dealt by hash to shards of about block_rows; each shard builds its postings and answers all queries by MaxScore
    with exact whole scores, and the shards' best are merged. No row is left out: every shard is asked, and only rows that
    provably stay below k others of their shard are passed over. Rows without vec_id, terms or weights take no part, as no
    result could name them; rows that repeat a vec_id are rows of their own, asked and found each for itself; a row of zeros
    scores 0 with all. A score beyond 64 bits is an OverflowError. Extra columns don't matter; an empty table gives no rows.
    """
    kept = rows.where("vec_id is not null and terms is not null and weights is not null")
    held = table(kept.select(F.col("vec_id").cast("long").alias("vec_id"), "terms", "weights", F.coalesce(asked, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row_key")), "weighted")
    blocks = blocks_for(held, block_rows)
    columns = ["row_key", "vec_id", "terms", "weights"]
    found = meet(held.where("asked").select(*columns), "row_key", held.select(*columns, dealt("row_key", blocks).alias("block")), blocks, lambda q, r: _search(q, r, k), FOUND, query_rows)
    rank = F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, asked: Column, k: int = 10, scale: int = 1024, **sizes: int) -> DataFrame:
    """top_k over embeddings (vec_id, embedding): a component's place is its term, floor(scale * x) its weight.

    Vectors that are null or hold a null or non-finite component take no part; of vectors of different lengths the shorter
    counts as filled up with zeros.
    """
    whole = embeddings.select(F.col("vec_id"), scaled(F.col("embedding"), scale).alias("v"), asked.alias("asked"))
    terms, weights = components(F.col("v"))
    return top_k(whole.select("vec_id", terms.alias("terms"), weights.alias("weights"), "asked"), F.col("asked"), k, **sizes)
