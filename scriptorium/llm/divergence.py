"""How the sources of each language differ in their words, from stripes of counts that are folded within each partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import slices, table

#: Everything that is no letter A to Z and not beyond ASCII becomes a blank; A to Z become small.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
STRIPES = "lang string, term string, df long, sources array<string>, counts array<long>"
ONE = 1_000_000_000
#: Entries (term, language, source) that a partition holds before it spills; groups whose sums may meet in one task.
HELD, GROUPS = 1_000_000, 5000


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document of each term, its code, the distinct terms) of texts without nulls."""
    texts = texts.cast(pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2])[ends[0] : ends[-1]].tobytes().translate(FOLD)
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(raw))
    lists = pc.ascii_split_whitespace(folded)
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(lists.values), 0)
    coded = lists.values.filter(full).dictionary_encode()
    return doc[full.to_numpy(zero_copy_only=False)], coded.indices.to_numpy().astype(np.int64), coded.dictionary


def summed(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with the sums over each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(s[order], first) if len(keys) else s for s in sums)


class Stripes:
    """Term -> (documents, count by source) for each language, as sorted keys with sums; new entries wait until they are as many as those held."""

    def __init__(self) -> None:
        self.terms: dict[str, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.size = self.merged = 0

    def add(self, texts: pa.Array, groups: list[tuple[str, str]]) -> None:
        doc, code, names = terms_of(texts)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        term = np.array([self.terms.setdefault(t, len(self.terms)) for t in names.to_pylist()], np.int64)
        width = max(1, len(names))
        pair, count = summed(doc * width + code, np.ones(len(doc), np.int64))  # a term of a document
        self.runs.append(summed(term[pair % width] << 32 | group[pair // width], count, np.ones(len(pair), np.int64)))
        self.size += len(self.runs[-1][0])
        if self.size > 2 * self.merged:
            self.merge()

    def merge(self) -> None:
        if self.runs:
            self.runs = [summed(*(np.concatenate(x) for x in zip(*self.runs, strict=True)))]
            self.size = self.merged = len(self.runs[0][0])

    def spill(self, rows: int = 5000) -> Iterator[pa.RecordBatch]:
        """All stripes as rows (lang, term, df, sources, counts); nothing is held after."""
        self.merge()
        keys, count, docs = self.runs[0] if self.runs else (np.zeros(0, np.int64),) * 3
        langs: dict[str, int] = {}
        lang_of = np.array([langs.setdefault(g[0], len(langs)) for g in self.groups], np.int64)
        term, group = keys >> 32, keys & 0xFFFFFFFF
        order = np.lexsort((group, lang_of[group] if len(keys) else group, term))
        term, group, count, docs = (x[order] for x in (term, group, count, docs))
        lang = lang_of[group] if len(keys) else group
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])]) if len(keys) else np.zeros(0, np.int64)
        edges = np.r_[first, len(keys)]
        df = np.add.reduceat(docs, first) if len(keys) else docs
        lang_names, term_names, source_names = (pa.array(x, pa.string()) for x in (list(langs), list(self.terms), [g[1] for g in self.groups]))
        for a in range(0, len(first), rows):
            b = min(a + rows, len(first))
            lo, hi = edges[a], edges[b]
            offsets = pa.array((edges[a : b + 1] - lo).astype(np.int32))
            listed = [pa.ListArray.from_arrays(offsets, x) for x in (source_names.take(pa.array(group[lo:hi])), pa.array(count[lo:hi]))]
            yield pa.RecordBatch.from_arrays([lang_names.take(pa.array(lang[first[a:b]])), term_names.take(pa.array(term[first[a:b]])), pa.array(df[a:b]), *listed], ["lang", "term", "df", "sources", "counts"])
        self.__init__()


def fold(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Stripes of all documents (lang, source, text) of a partition; what exceeds the room is passed on early."""
    stripes = Stripes()
    for batch in batches:
        texts = batch.column("text")
        groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        for a, b in slices(texts):
            stripes.add(texts.slice(a, b - a), groups[a:b])
            if max(stripes.size, len(stripes.terms)) > held:
                yield from stripes.spill()
    yield from stripes.spill()


def merge_sorted(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """One stripe for each (lang, term) of rows in order of these, those in at least min_docs documents; the last of a batch waits for the next."""
    names = ["lang", "term", "df", "sources", "counts"]
    carried: pa.RecordBatch | None = None

    def merged(rows: pa.Table) -> pa.RecordBatch:
        lang, term = (rows[c].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("lang", "term"))
        first = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])])
        key = np.cumsum(np.isin(np.arange(len(lang)), first)) - 1
        sources, counts = rows["sources"].combine_chunks(), rows["counts"].combine_chunks()
        coded = sources.flatten().dictionary_encode()
        width = max(1, len(coded.dictionary))
        cell, count = summed(np.repeat(key, np.diff(sources.offsets.to_numpy())) * width + coded.indices.to_numpy(), counts.flatten().to_numpy())
        offsets = pa.array(np.searchsorted(cell, np.arange(len(first) + 1) * width).astype(np.int32))
        listed = [pa.ListArray.from_arrays(offsets, x) for x in (coded.dictionary.take(pa.array(cell % width)), pa.array(count))]
        at = pa.array(first)
        return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks().take(at) for c in ("lang", "term")), pa.array(np.add.reduceat(rows["df"].to_numpy(), first)), *listed], names)

    for batch in batches:
        if batch.num_rows:
            whole = merged(pa.Table.from_batches([b.select(names) for b in (carried, batch) if b is not None]))
            carried = whole.slice(whole.num_rows - 1)
            done = whole.slice(0, whole.num_rows - 1)
            yield done.filter(pc.greater_equal(done.column("df"), min_docs))
    if carried is not None:
        yield carried.filter(pc.greater_equal(carried.column("df"), min_docs))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p = 1 + floor(ONE * (count + 2) / (total + 2 * terms)), exactly, at any size."""
    if counts.max(initial=0) < 1 << 32:
        return 1 + ONE * (counts + 2) // (total + 2 * terms)
    return np.array([1 + ONE * (c + 2) // (total + 2 * terms) for c in counts.ravel().tolist()], np.int64).reshape(counts.shape)


def emitted(batches: Iterator[pa.RecordBatch], groups: dict[str, tuple[list[str], list[int], int]], top: int, cells: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(lang, source, part, item, value): sums over a partition's stripes for each pair of sources, and each source's `top` terms.

    groups: lang -> (its sources, their N, V).
    """
    place = {lang: {s: i for i, s in enumerate(sources)} for lang, (sources, _, _) in groups.items()}
    sums: dict[str, np.ndarray] = {}
    best: dict[tuple[str, int], list[tuple[int, bytes, str]]] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in dict.fromkeys(langs.tolist()):
            sources, totals, kept = groups[lang]
            rows = batch.filter(pa.array(langs == lang))
            step = max(1, cells // len(sources))
            for a in range(0, rows.num_rows, step):
                part = rows.slice(a, step)
                names = part.column("term").to_pylist()
                lists = part.column("sources")
                counts = np.zeros((part.num_rows, len(sources)), np.int64)
                counts[np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy()), [place[lang][s] for s in lists.flatten().to_pylist()]] = part.column("counts").flatten().to_numpy()
                p = np.stack([shares(counts[:, i], n, kept) for i, n in enumerate(totals)], 1)
                q = shares(counts.sum(1), sum(totals), kept)
                pairs = sums.setdefault(lang, np.zeros((len(sources),) * 2, np.int64))
                for i in range(len(sources)):
                    pairs[i] += ((p[:, i : i + 1] - p) ** 2 // (p[:, i : i + 1] + p)).sum(0)
                value = np.where((counts > 0) & (p > q[:, None]), (p - q[:, None]) ** 2 // (p + q[:, None]), -1)
                for i in range(len(sources)):
                    mine = value[:, i]
                    at = np.flatnonzero(mine >= 0)
                    if len(at) > top:
                        at = at[mine[at] >= np.partition(mine[at], -top)[-top]]
                    best[lang, i] = sorted([*best.get((lang, i), []), *((-int(mine[x]), names[x].encode(), names[x]) for x in at)])[:top]
    for lang, pairs in sums.items():
        sources = groups[lang][0]
        for i, source in enumerate(sources):
            n = len(sources)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), pa.array(["pair"] * n), pa.array(sources, pa.string()), pa.array(pairs[i])], ["lang", "source", "part", "item", "value"])
    for (lang, i), terms in best.items():
        n = len(terms)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([groups[lang][0][i]] * n), pa.array(["term"] * n), pa.array([t for _, _, t in terms], pa.string()), pa.array([-v for v, _, _ in terms], pa.int64())], ["lang", "source", "part", "item", "value"])


EMITTED = "lang string, source string, part string, item string, value long"
#: The same in SQL, for more groups than may meet in a task.
SHARE = f"1 + (cast({ONE} as decimal(20, 0)) * ({{c}} + 2)) div greatest({{n}} + 2 * {{v}}, 1)"  # 1: languages without kept terms
GAP = "(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"


def emitted_by_joins(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """What emitted() gives, summed up, by joins on (lang, term) and (lang, source), for any number of groups (lang, source, n, v).

    A pair's sum is V times its value for a term in neither, plus what the terms in one or both change.
    """
    cells = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select("lang", "term", F.col("c.sources").alias("source"), F.col("c.counts").alias("count"))
    zero = F.expr(SHARE.format(c=0, n="n", v="v"))
    groups = groups.withColumn("z", zero)
    cells = cells.join(groups, ["lang", "source"]).withColumn("p", F.expr(SHARE.format(c="count", n="n", v="v")))
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("item_z"))
    held = cells.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"))
    met = cells.join(other, "lang").where("source <> item").join(held, ["lang", "term", "item"], "left")
    both = met.select("lang", "source", "item", (F.expr(GAP.format(p="p", q="coalesce(item_p, item_z)")) - F.expr(GAP.format(p="z", q="item_z"))).alias("change"), F.col("item_p").isNull().alias("alone"))
    # A term that only one of two has is met from that one's side: it counts for both directions.
    back = both.where("alone").select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "change")
    changes = both.select("lang", "source", "item", "change").unionByName(back)
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * F.expr(GAP.format(p="z", q="item_z"))).alias("change"))
    pairs = changes.unionByName(base).groupBy("lang", "source", "item").agg(F.sum("change").alias("value"))
    whole = cells.groupBy("lang", "term").agg(F.sum("count").alias("count"), F.first("v").alias("v"))
    totals = groups.groupBy("lang").agg(F.sum("n").alias("n"))
    q = whole.join(totals, "lang").select("lang", "term", F.expr(SHARE.format(c="count", n="n", v="v")).alias("q"))
    terms = cells.join(q, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(GAP.format(p="p", q="q")).alias("value"))
    return terms.unionByName(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, held: int = HELD, groups_in_task: int = GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source): how far each source is from the others of its
    language (part pair), and the terms that set it apart from its language (part term, `top` ranks).

    Each partition folds whole documents into hash stripes, term -> (documents, count by source), and passes on what exceeds
    its room (`held` entries); stripes are merged by key in order, and the merged ones give the values. A group is what
    meets in a task only if all groups are at most groups_in_task; beyond that the same sums are made by joins.

    Null text, lang and source count as ''. Each row is a document, whether it repeats another or not. Groups without terms
    are groups; a source alone in its language has no pairs; an empty table gives no rows. Extra columns don't matter.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), empty("text"))
    folded = rows.mapInArrow(lambda batches: fold(batches, held), STRIPES)
    met = folded.repartition("lang", "term").sortWithinPartitions("lang", "term")
    kept = table(met.mapInArrow(lambda batches: merge_sorted(batches, min_docs), STRIPES), "stripes")
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = table(rows.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", zero("n"), zero("v")), "groups")
    if groups.count() <= groups_in_task:
        of: dict[str, tuple[list[str], list[int], int]] = {}
        for lang, source, n, v in sorted(map(tuple, groups.collect())):
            of.setdefault(lang, ([], [], v))[0].append(source)
            of[lang][1].append(n)
        values = kept.mapInArrow(lambda batches: emitted(batches, of, top), EMITTED)
        ends = groups.select("lang", "source")
        none = ends.join(ends.withColumnRenamed("source", "item"), "lang").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
        pairs = values.where("part = 'pair'").unionByName(none).where("source <> item").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        values = pairs.unionByName(values.where("part = 'term'"))
    else:
        values = emitted_by_joins(kept, groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return values.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
