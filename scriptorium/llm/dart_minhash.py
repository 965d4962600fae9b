"""MinHash near-dedup with DartMinHash signatures.

Each element (a shingle) owns, for each unit of its weight, a region of darts: a Poisson process of rate 1 whose darts
have a rank (the distance from zero) and a coordinate out of K. The ranks are sums of hashed exponential gaps, so every
text that holds the element throws the same darts in the same order, and stops at the rank bound that gives it about
K (ln K + 5) darts in all: the work is one dart an element and K log K more. A text keeps the earliest dart of each
coordinate. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.

Texts of one content (equal shingles and weights, by a 128-bit name) are joined first and stand for one another; within this
module that name is a text's id, whatever its doc_id. The others meet where a band of the signature agrees. Texts with too
few shingles that any other candidate has are set aside; in each bucket the others are compared, exactly, with the most
central text (and `stars` - 1 others). Texts of buckets that still hold different classes which may be similar enough are
joined by a prefix filter: shingles in order of rarity, where two similar texts must share one of the rarest few. So texts
that lie just below the threshold of one another, and differ in what only they have, never meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import BROADCAST_ROWS, discard, id_type, mixed, released, slices, small, table, word_hashes

WORDS = 5
BANDS, ROWS = 21, 6
K = BANDS * ROWS
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Texts whose darts (about K log K each) are held at once.
TEXTS = 200
#: The name of a text's content.
ID = "struct<c1:bigint,c2:bigint>"


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight): distinct shingles of each text in order of (text, shingle); the weight counts its places.

    A text of fewer words, but not none, is one shingle.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(hashes))
    left = ends[text] - at
    starts = np.flatnonzero((left >= words) | (at == ends[text] - counts[text]))
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):
            inside = left[starts] > i
            h[inside] = mixed(h[inside] * GOLDEN + hashes[starts[inside] + i] + np.uint64(i + 1))
    of = text[starts]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.r_[np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (of[1:] != of[:-1])]
    first = np.flatnonzero(new)
    return of[first], h[first], np.diff(np.r_[first, len(h)])


def signatures(of: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n x K dart names; of a text without elements all are NONE. Weights are whole numbers."""
    cells = np.repeat(np.arange(len(elements)), weights)
    unit = np.arange(len(cells)) - np.repeat(np.cumsum(weights) - weights, weights)
    with np.errstate(over="ignore"):
        region = mixed(elements[cells] + mixed(unit.astype(np.uint64) * GOLDEN + np.uint64(1)))
    text = of[cells]
    total = np.bincount(text, minlength=n)
    sig = np.full((n, K), NONE)
    bound = K * (np.log(K) + 5) / np.maximum(1, total)
    todo = total > 0
    while todo.any():
        mine = todo[text]
        rank, coordinate, name, at = (np.concatenate(x) for x in zip(*throw(region[mine], text[mine], bound), strict=True))
        cell = at * K + coordinate
        order = np.lexsort((name, rank, cell))
        first = order[np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]])] if len(order) else order
        sig[at[first], coordinate[first]] = name[first]
        todo &= (sig == NONE).any(1)
        bound = np.where(todo, bound * 2, bound)
    return sig


def throw(region: np.ndarray, text: np.ndarray, bound: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rounds of (rank, coordinate, name, text): the i-th dart of each region whose darts so far lie within its text's bound."""
    out, rank, i = [], np.zeros(len(region)), 0
    while len(region):
        i += 1
        with np.errstate(over="ignore"):
            name = mixed(region + np.uint64(i) * GOLDEN)
            where = mixed(name + np.uint64(0xD1B54A32D192ED03))
        rank = rank - np.log(((name >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740993.0)
        inside = rank <= bound[text]
        region, text, rank = region[inside], text[inside], rank[inside]
        out.append((rank, (where[inside] % np.uint64(K)).astype(np.int64), name[inside], text))
    return out


def named(of: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int) -> list[np.ndarray]:
    """Two 64-bit names of all shingles with weights of each of n texts."""
    names = []
    with np.errstate(over="ignore"):
        for salt in (np.uint64(3), np.uint64(5)):
            name = np.zeros(n, np.uint64)
            np.add.at(name, of, mixed(elements * salt + mixed(weights.astype(np.uint64) + salt)))
            names.append(name.view(np.int64))
    return names


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, c1, c2, bands): the number of shingle places, a 128-bit name of all shingles with weights, and K / ROWS band keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 19, TEXTS):
                part = batch.slice(a, b - a)
                of, elements, weights = shingles(part.column(1), words)
                sig = signatures(of, elements, weights, len(part))
                size = np.bincount(of, weights, len(part)).astype(np.int64)
                names = named(of, elements, weights, len(part))
                with np.errstate(over="ignore"):
                    key = np.zeros((len(part), BANDS), np.uint64)
                    for r in range(ROWS):
                        key = mixed(key * GOLDEN + sig[:, r::ROWS])
                offsets = pa.array(np.arange(0, len(part) * BANDS + 1, BANDS, dtype=np.int32))
                bands = pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(names[0]), pa.array(names[1]), bands], ["doc_id", "n", "c1", "c2", "bands"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(released(rows), f"doc_id {id_type(docs)}, n long, c1 long, c2 long, bands array<long>")


def contents(docs: DataFrame, wanted: DataFrame, words: int, broadcast_rows: int) -> DataFrame:
    """(id, shingles array<long> in order, weights array<int>) of the wanted (id, first: a doc_id with that content)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 19):
                part = batch.slice(a, b - a)
                of, elements, weights = shingles(part.column(0), words)
                ids = pa.StructArray.from_arrays([pa.array(x) for x in named(of, elements, weights, len(part))], ["c1", "c2"])
                edges = pa.array(np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (elements.view(np.int64), weights.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([ids, *lists], ["id", "shingles", "weights"])

    texts = docs.select(F.col("doc_id").alias("first"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(small(wanted.select("first").distinct(), broadcast_rows), "first", "left_semi").select("text").mapInArrow(released(rows), f"id {ID}, shingles array<long>, weights array<int>")
    return found.join(small(wanted.select("id"), broadcast_rows), "id", "left_semi").dropDuplicates(["id"])  # other texts may have the same doc_id


def shared(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, u): the weight of the shingles of each text that texts of two labels or more have; no overlap with another label is larger."""
    places = held.join(labels, "id").select("id", "label", F.explode(F.arrays_zip("shingles", "weights")).alias("x")).select("id", "label", F.col("x.shingles").alias("s"), F.col("x.weights").alias("w"))
    several = places.groupBy("s").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("s")
    return places.join(several, "s").groupBy("id").agg(F.sum("w").alias("u"))


def hopeful(rows: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Rows (band, key, id, n, label) whose text may be similar enough to one of another label in its bucket, with u; no others.

    A similarity of t takes an overlap of t / (1 + t) times both sizes together, and the overlap is at most u.
    """
    labels = rows.select("id", "label").distinct()
    sized = rows.join(table(shared(held, labels), "shared"), "id")  # written, as it is read twice: one plan would hold all its stages at once
    smallest = sized.groupBy("band", "key").agg(F.min("n").alias("smallest"))
    kept = sized.join(smallest, ["band", "key"]).where(F.col("u") >= threshold / (1 + threshold) * (F.col("n") + F.col("smallest")) - 1e-6).drop("smallest")
    kept = table(kept, "hopeful")
    open_buckets = kept.groupBy("band", "key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("band", "key")
    return table(kept.join(open_buckets, ["band", "key"], "left_semi"), "open")


def prefix_pairs(rest: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of texts of rest (id, n, label) with different labels that may be as similar as the threshold; none that is gets lost.

    Of two texts the smaller must overlap by 2 t / (1 + t) of its own weight and the larger by t of its own. So in any one
    order of shingles their first common one stands within what that leaves of either: the order by rarity makes it rare.
    """
    texts = rest.select("id", "n", "label").distinct()
    places = held.join(texts, "id").select("id", "n", "label", F.explode(F.arrays_zip("shingles", "weights")).alias("x")).select("id", "n", "label", F.col("x.shingles").alias("s"), F.col("x.weights").alias("w"))
    seen = places.groupBy("s").agg(F.count(F.lit(1)).alias("seen"), F.min("label").alias("least"), F.max("label").alias("most"))
    before = F.sum("w").over(Window.partitionBy("id").orderBy("seen", "s").rowsBetween(Window.unboundedPreceding, -1))
    prefix = places.join(seen, "s").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= F.col("n") * (1 - threshold) + 1e-6)
    prefix = table(prefix.where("least < most").select("id", "n", "label", "s", "w", "before"), "prefixes")
    less = prefix.where(F.col("before") <= F.col("n") * (1 - 2 * threshold / (1 + threshold)) + 1e-6)
    more = prefix.select("s", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "label", "w", "before")))
    ordered = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2")))
    overlap = F.least("w", "w2") + F.least(F.col("n") - F.col("before") - F.col("w"), F.col("n2") - F.col("before2") - F.col("w2"))  # at most, from their first common one
    enough = overlap >= threshold / (1 + threshold) * (F.col("n") + F.col("n2")) - 1e-6
    met = less.join(more, "s").where(ordered & (F.col("label") != F.col("label2")) & enough & (F.col("n") >= threshold * F.col("n2") - 1e-6))
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def compared(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact weighted Jaccard similarity is at least the threshold."""
    side = lambda x: held.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"), F.col("weights").alias(f"w{x}"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in zip(*(batch.column(c) for c in ("sa", "wa", "sb", "wb")), strict=True):
                x, p, y, q = (v.values.to_numpy() for v in row)
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                both = int(np.minimum(p[i], q[j]).sum())
                keep.append(both >= threshold * (int(p.sum()) + int(q.sum()) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return table(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(released(alike), f"a {id_type(held, 'id')}, b {id_type(held, 'id')}"), "alike")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, label): the least id that edges (a, b) connect it with; only ids with edges. Alternates large and small stars.

    A star with more than a few rows of one node is not gathered: the least neighbour is an aggregate, joined back. Ends once
    each id has one centre, which is no other's leaf. Raises where `rounds` are not enough (a chain of 2 ** rounds texts would
    take them).
    """
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "stars")
    for _ in range(rounds):
        if is_stars(now):
            break
        least = ends(now).groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # Not made distinct: each edge gives one row at most, and the small stars take repeats out.
        large = table(ends(now).join(least, "v").where("u > v and u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")), "stars")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        made = F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        found = table(large.join(least, "v").select(F.explode(made).alias("x")).select("x.v", "x.u").where("v <> u").distinct(), "stars")
        discard(now, large)
        now = found
    else:
        raise RuntimeError(f"components are not told after {rounds} rounds")
    roots = now.select(F.col("u").alias("id")).distinct()
    return now.select(F.col("v").alias("id"), F.col("u").alias("label")).unionByName(roots.select("id", F.col("id").alias("label")))


def ends(stars: DataFrame) -> DataFrame:
    """(v, u) of each edge both ways."""
    return stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))


def is_stars(edges: DataFrame) -> bool:
    """Whether of distinct edges (v, u), v above u, each v has one edge and no u is a v."""
    of_leaf = ends(edges).groupBy("v").agg(F.count_if(F.col("u") < F.col("v")).alias("below"), F.count(F.lit(1)).alias("all"))
    return of_leaf.where("below > 0 and all > 1").agg(F.count(F.lit(1))).first()[0] == 0


def near_classes(docs: DataFrame, threshold: float = 0.8, words: int = WORDS, stars: int = 1, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, class_id, class_size, class_key for each row of docs (doc_id, text; other columns are ignored).

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; the similarity is the Jaccard similarity of `words`-word shingles
    weighted by how often each occurs. class_id is the least doc_id of the documents that links of at least the threshold
    connect. Null, empty and wordless texts have no shingles: each is a class of its own, as is a null doc_id. Rows that
    repeat one doc_id are texts of their own: unlike ones don't share a class. As both classes may then have the same least
    doc_id, class_key (null where there are no shingles) tells classes apart, and sizes count by it. No rows give none; ids may be of any type that can be ordered. A text's darts are thrown within one task. Links at the threshold itself are found with probability
    0.998 (BANDS, ROWS), more similar ones more surely.
    """
    made = table(signed(docs, words), "signatures")
    full = made.where("n > 0 and doc_id is not null")
    reps = table(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")).select(F.struct("c1", "c2").alias("id"), "first", "n", "bands"), "contents")
    keys = reps.select("id", "n", F.posexplode("bands").alias("band", "key"))
    several = table(keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "key"), "buckets")
    members = table(keys.join(small(several, broadcast_rows), ["band", "key"]).withColumn("label", F.col("id")), "members")
    held = table(contents(docs, table(reps.select("id", "first").join(members.select("id").distinct(), "id", "left_semi"), "candidates"), words, broadcast_rows), "contents")
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    done = links = None
    rest = hopeful(members, held, threshold)
    for i in range(stars):
        # In each bucket all meet one pivot: first the most central text, with the largest share of shingles that others have.
        order = F.struct((F.col("u") / F.col("n") if i == 0 else F.lit(0)).alias("share"), F.xxhash64("id", "band", F.lit(i)).alias("h"), "id", "label")
        pivots = rest.groupBy("band", "key").agg(F.max(order).alias("p")).select("band", "key", F.col("p.id").alias("pivot"), F.col("p.label").alias("of"))
        pairs = rest.join(pivots, ["band", "key"]).where("label <> of").select(*ordered("id", "pivot")).distinct()
        pairs = table(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        found = compared(pairs, held, threshold)
        links = found if links is None else links.unionByName(found)
        joined = table(components(links), "joined")
        labelled = rest.drop("label", "u").join(joined, "id", "left").withColumn("label", F.coalesce("label", "id"))
        rest = hopeful(table(labelled, "labelled"), held, threshold)
    # A pivot may not be similar enough where another member of the bucket is.
    pairs = table(prefix_pairs(rest, held, threshold).join(done, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        found = compared(pairs, held, threshold)
        if not found.isEmpty():  # the classes so far are stars, which the new links join
            joined = components(joined.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(found))
    # Copies hang on the one that stands for them; both kinds of links give the classes, each named after its least doc_id.
    labelled = table(reps.select("id", "first").join(joined, "id", "left").select("id", "first", "label"), "labelled")
    least = labelled.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    name = F.coalesce("label", "id")
    key = F.concat(*(F.lower(F.lpad(F.hex(name[c]), 16, "0")) for c in ("c1", "c2")))
    classes = labelled.join(least, "label", "left").select("id.c1", "id.c2", F.coalesce("least", "first").alias("named"), key.alias("key"))
    of_one = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = made.join(classes, ["c1", "c2"], "left").select("doc_id", F.when(of_one, F.coalesce("named", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(of_one, F.col("key")).alias("class_key"))
    out = table(out, "classes")
    sizes = out.where("class_key is not null").groupBy("class_key").agg(F.count(F.lit(1)).alias("class_size")).where("class_size > 1")
    return out.join(small(table(sizes, "sizes"), broadcast_rows), "class_key", "left").select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "class_key")
