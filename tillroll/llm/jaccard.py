"""Exact Jaccard join of documents on word n-grams, as a metric-space join.

Jaccard distance is a metric. The pivots are the single shingles: a document of n
shingles has distance 1 - 1/n to the pivots it holds and 1 to the others, so it lies in
the region of its nearest pivots, and one global order of the pivots breaks their ties.
Two documents within the threshold differ in few shingles, so by the triangle inequality
one of the first n - ceil(share * n) + 1 pivots of either is the region of both: a
document is replicated to just these regions, and no link is lost.

The order puts long shingles first, since they are rare, and pivots that turn out to be
held by many documents last (which moves documents that share a common passage into
smaller regions). Within a region documents first meet a hub: those within the threshold
form one component, and need no comparison with each other. Further hubs are tried for
the rest, and regions that still hold several components are cut into blocks, every two of
which are compared inside a task, across components only.

A set's profile counts its shingles in ``CLASSES`` hash classes. Two profiles differ by
no more than the sets do (the triangle inequality again, for the classes as pivots), so
pairs with profiles too far apart are dropped unread, and of several hubs a document
is compared with the one of the nearest profile. Every link is verified on the texts.

Documents with equal sets are one class from the start; a class is named by its least
doc_id. Defined cases: a text without a word has no shingle and links with nothing (its
component is itself); a null doc_id keeps its row with a null component; rows that share
a doc_id are one document with the links of all of them; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tillroll.llm import textbytes as tb
from tillroll.llm.components import components
from tillroll.operators.scratch import materialize, scratch_path

WORDS = 3
PERCENT = 90
#: A pivot of more documents than this goes to the end of the order ...
HOT = 32
#: ... if it is among so many most frequent ones (8 bytes each reach every task). This
#: and the two numbers below steer work only; links do not depend on them.
MAX_HOT = 500_000
HUB_ROUNDS = 2
#: In a round a document meets the hubs of about one in so many of its regions.
HUB_SHARE = 6
CLASSES = 96
#: Pairs of a hub that are verified together.
HUB_PART = 256
#: Documents of a region in one block, rows of a block and pairs that are compared at a time.
BLOCK = 1024
PAIR_ROWS, PAIR_BATCH = 128, 1 << 15


class Sets:
    """The shingle sets of a slice of texts, as sorted 64-bit keys, rows one after another.

    The key of a shingle has its length in letters, longest first, above 56 bits of hash.
    """

    def __init__(self, texts: tb.Texts, width: int = WORDS):
        words = tb.Spans(texts, tb.NOT_SPACE)
        hashes = words.hashes(lower=True)
        size = np.minimum(np.concatenate(([0], np.cumsum(words.ends - words.starts))), 1 << 40)
        row_of = words.rows()
        rows, keys = [], []
        counts = words.counts()
        for w in range(1, width + 1):
            at, value = words.windows(hashes, w)
            if w < width:  # a shorter text is one shingle
                use = counts[row_of[at]] == w
                at, value = at[use], value[use]
            length = np.minimum(size[at + w] - size[at], 255).astype(np.uint64)
            rows.append(row_of[at])
            keys.append(((np.uint64(255) - length) << np.uint64(56)) | (value >> np.uint64(8)))
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        if len(row):
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))
            row, key = row[new], key[new]
        self.row, self.key = row, key
        self.counts = np.bincount(row, minlength=texts.rows)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums per row that equal sets share."""
        out = []
        for salt in (0x51, 0xA7):
            total = np.concatenate(([0], np.cumsum(tb.mix(self.key ^ tb.seeds(1, salt)[0]), dtype=np.uint64)))
            total = total.astype(np.uint64)
            out.append((total[self.first[1:]] - total[self.first[:-1]]).view(np.int64))
        return out[0], out[1]

    def profiles(self) -> pa.Array:
        """Per row, how many keys each hash class has, up to 255."""
        kind = (self.key % np.uint64(CLASSES)).astype(np.int64)
        rows = len(self.counts)
        counts = np.bincount(self.row * CLASSES + kind, minlength=rows * CLASSES)
        counts = np.minimum(counts, 255).astype(np.uint8).reshape(rows, CLASSES)
        return pa.array([c.tobytes() for c in counts], pa.binary())

    def heads(self, lengths: np.ndarray) -> pa.ListArray:
        """The first ``lengths`` keys of each row."""
        place = np.arange(len(self.key)) - np.repeat(self.first[:-1], self.counts)
        keep = place < np.repeat(lengths, self.counts)
        ends = np.concatenate(([0], np.cumsum(np.minimum(lengths, self.counts))))
        return pa.ListArray.from_arrays(
            pa.array(ends.astype(np.int32)), pa.array(self.key[keep].view(np.int64))
        )


def reach(n: np.ndarray, percent: int) -> np.ndarray:
    """Regions of a document of n shingles."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def spare(regions: np.ndarray) -> np.ndarray:
    """Pivots kept beyond a document's regions, in case some of them are hot."""
    return 8 + regions // 8


def _sets(docs: DataFrame, percent: int, width: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            data, offsets = tb.buffers(tb.column(batch, "text"))
            ids = tb.column(batch, "doc_id")
            for lo, hi in tb.row_slices(offsets):
                sets = Sets(tb.Texts(data, offsets[lo : hi + 1]), width)
                one, two = sets.signatures()
                regions = reach(sets.counts, percent)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(sets.counts),
                        pa.array(one),
                        pa.array(two),
                        sets.heads(regions + spare(regions)),
                        sets.profiles(),
                    ],
                    ["doc_id", "n", "sig1", "sig2", "head", "profile"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, n long, sig1 long, sig2 long, head array<long>, profile binary"
    )


def _in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _regions(
    classes: DataFrame, counts: DataFrame, docs: DataFrame, hot, percent: int, width: int
) -> DataFrame:
    """(pivot, doc, n, at): the regions of every class under the order (hot, key) and the
    pivot's place in it, without most regions of one document. ``counts`` has the pivots of two heads or more."""

    def from_heads(batches):
        table = hot.value
        for batch in batches:
            head = tb.column(batch, "head")
            n = np.asarray(tb.column(batch, "n"))
            keys = np.asarray(head.flatten()).view(np.uint64)
            ends = np.concatenate(([0], np.cumsum(np.asarray(head.value_lengths()))))
            row = np.repeat(np.arange(len(n)), np.diff(ends))
            cold = ~_in_sorted(keys, table)
            before = np.concatenate(([0], np.cumsum(cold)))
            rank = before[:-1] - before[ends[:-1]][row]
            want = reach(n, percent)
            known = (np.diff(before[ends]) >= want) | (np.diff(ends) == n)
            # All keys of a small set are known: its hot ones follow the others.
            total_cold = np.diff(before[ends])
            hot_rank = (np.arange(len(keys)) - ends[:-1][row]) - rank + total_cold[row]
            rank = np.where(cold, rank, hot_rank)
            take = known[row] & (rank < want[row])
            ids = np.asarray(tb.column(batch, "doc"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((keys[take].view(np.int64), np.zeros((~known).sum(), np.int64)))),
                    pa.array(np.concatenate((ids[row[take]], ids[~known]))),
                    pa.array(np.concatenate((n[row[take]], n[~known]))),
                    pa.array(np.concatenate((rank[take], np.zeros((~known).sum(), np.int64)))),
                    pa.array(np.concatenate((np.ones(take.sum(), bool), np.zeros((~known).sum(), bool)))),
                ],
                ["pivot", "doc", "n", "at", "known"],
            )

    def from_texts(batches):
        table = hot.value
        for batch in batches:
            data, offsets = tb.buffers(tb.column(batch, "text"))
            all_ids = np.asarray(tb.column(batch, "doc_id"))
            for lo, hi in tb.row_slices(offsets):
                sets = Sets(tb.Texts(data, offsets[lo : hi + 1]), width)
                order = np.lexsort((sets.key, _in_sorted(sets.key, table), sets.row))
                key, row = sets.key[order], sets.row
                place = np.arange(len(key)) - sets.first[:-1][row]
                take = place < reach(sets.counts, percent)[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[take].view(np.int64)),
                        pa.array(all_ids[lo:hi][row[take]]),
                        pa.array(sets.counts[row[take]]),
                        pa.array(place[take]),
                    ],
                    ["pivot", "doc", "n", "at"],
                )

    told = classes.mapInArrow(from_heads, "pivot long, doc long, n long, at long, known boolean")
    # Where most of the first pivots are hot, the order needs the whole set.
    open_ids = told.where("not known").select(F.col("doc").alias("doc_id"))
    again = docs.select(F.col("doc_id").cast("long"), "text").join(open_ids, "doc_id", "left_semi")
    whole = materialize(again.mapInArrow(from_texts, "pivot long, doc long, n long, at long"), "whole")
    # A pivot of two documents is in both heads, or in a set that was read as a whole.
    shared = counts.select("pivot").unionByName(whole.select("pivot")).distinct()
    regions = told.where("known").select("pivot", "doc", "n", "at").unionByName(whole)
    return materialize(regions.join(shared, "pivot", "left_semi"), "regions")


def stored_texts(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, str]:
    """(id, text) of the documents that ``ids`` names, stored in buckets of the id, and the
    name of that table. Joins on the id then move the other side only; texts move once."""
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    name = f"tillroll_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by id first, so that a bucket is one file.
    wanted = named.repartition(buckets, "id").join(ids, "id", "left_semi")
    written = wanted.write.bucketBy(buckets, "id").sortBy("id").option("compression", "zstd")
    written.option("path", scratch_path(spark, "texts")).saveAsTable(name)
    return spark.table(name), name


def _verify(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose sets are within the threshold.

    Texts move, not sets, since they compress. The pairs of a hub b are dealt into parts
    of about ``HUB_PART``; the hub's text moves once to each part, and is followed there by
    the texts of its a.
    """

    def compare(batches):
        hub = None
        for batch in batches:
            a, b = tb.column(batch, "a"), np.asarray(tb.column(batch, "b"))
            is_hub = np.asarray(a.is_null())
            keep = np.zeros(batch.num_rows, bool)
            data, offsets = tb.buffers(tb.column(batch, "text"))
            for lo, hi in tb.row_slices(offsets):
                sets = Sets(tb.Texts(data, offsets[lo : hi + 1]), width)
                for k in range(lo, hi):
                    own = sets.key[sets.first[k - lo] : sets.first[k - lo + 1]]
                    if is_hub[k]:  # comes before the others of its part
                        hub = own.copy()
                        continue
                    shared = int(_in_sorted(own, hub).sum())
                    keep[k] = shared > 0 and 100 * shared >= percent * (len(own) + len(hub) - shared)
            yield pa.RecordBatch.from_arrays([a, pa.array(b)], ["a", "b"]).filter(pa.array(keep))

    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_PART).alias("parts"))
    dealt = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    of = lambda x: texts.select(F.col("id").alias(x), "text")
    rows = dealt.join(of("a"), "a").select("b", "part", "a", "text")
    hubs = dealt.select("b", "part").distinct().join(of("b"), "b")
    rows = rows.unionByName(hubs.select("b", "part", F.lit(None).cast("long").alias("a"), "text"))
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
    return rows.select("a", "b", "text").mapInArrow(compare, "a long, b long")


def _labelled(regions: DataFrame, links: DataFrame) -> DataFrame:
    """Regions with the component of each document, without regions of one component."""
    labels = components(links).withColumnRenamed("id", "doc")
    found = regions.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    split = (
        found.groupBy("pivot")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"))
        .where("least < most")
        .select("pivot")
    )
    return materialize(found.join(split, "pivot").select("pivot", "doc", "n", "at", "label"), "open")


def _sizes_fit(a: str, b: str, percent: int):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _near(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose profiles allow a link, with the distance of the profiles."""

    def matrix(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
        data = np.frombuffer(column.buffers()[2], np.uint8)
        return data[offsets[0] : offsets[len(column)]].reshape(-1, CLASSES).astype(np.int16)

    def measure(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            gap = np.abs(matrix(tb.column(batch, "pa")) - matrix(tb.column(batch, "pb"))).sum(1)
            total = np.asarray(tb.column(batch, "na")) + np.asarray(tb.column(batch, "nb"))
            shared = -(-percent * total // (100 + percent))
            yield pa.RecordBatch.from_arrays(
                [tb.column(batch, "a"), tb.column(batch, "b"), pa.array(gap.astype(np.int64))], ["a", "b", "gap"]
            ).filter(pa.array(gap <= total - 2 * shared))

    side = lambda x: profiles.select(
        F.col("doc").alias(x), F.col("n").alias("n" + x), F.col("profile").alias("p" + x)
    )
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(_sizes_fit("na", "nb", percent))
    return joined.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(measure, "a long, b long, gap long")


def _hub(label: str, turn: int):
    """A document of the region, by a hash that differs from region to region and turn to turn."""
    return F.min(
        F.struct(
            F.xxhash64(label, "pivot", F.lit(turn)).alias("h1"),
            F.xxhash64("doc", "pivot", F.lit(turn)).alias("h2"),
            F.col("doc").alias("doc"),
            F.col(label).alias("label"),
        )
    )


def _hub_pairs(met: DataFrame, profiles: DataFrame, percent: int, turn: int) -> DataFrame:
    """From rows (pivot, doc, n, hub): each document's nearest hub of this turn, as (a, b = hub)."""
    sampled = (F.pmod(F.xxhash64("pivot"), F.lit(HUB_SHARE)) == turn % HUB_SHARE) | (F.col("n") < 100)
    pairs = met.where(sampled & (F.col("doc") != F.col("hub"))).select(
        F.col("doc").alias("a"), F.col("hub").alias("b")
    )
    near = _near(pairs.distinct(), profiles, percent)
    best = near.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"))


def _survivors(left, right, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (in left, in right) of the pairs that no bound rules out, and how far their
    profiles are apart.

    A side is (doc, n, at, label, profile rows). A pair within the threshold shares no pivot
    before its first region, so there neither has passed more pivots than the sets may
    differ in; and profiles differ by no more than the sets.
    """
    doc, n, at, label, profile = left
    doc2, n2, at2, label2, profile2 = right
    kept = []
    for k in range(0, len(doc), PAIR_ROWS):
        here = slice(k, k + PAIR_ROWS)
        total = n[here, None] + n2[None]
        fits = label[here, None] != label2[None]
        fits &= (100 * n[here, None] >= percent * n2[None]) & (100 * n2[None] >= percent * n[here, None])
        rest = np.minimum((n - at)[here, None], (n2 - at2)[None])
        fits &= (100 + percent) * rest >= percent * total
        if same:
            fits &= doc[here, None] < doc2[None]
        a, b = np.nonzero(fits)
        for lo in range(0, len(a), PAIR_BATCH):
            x, y = a[lo : lo + PAIR_BATCH], b[lo : lo + PAIR_BATCH]
            p, q = profile[here][x], profile2[y]
            gap = (np.maximum(p, q) - np.minimum(p, q)).sum(1, dtype=np.int64)
            shared = -(-percent * total[x, y] // (100 + percent))
            near = gap <= total[x, y] - 2 * shared
            kept.append((x[near] + k, y[near], gap[near]))
    if not kept:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(column) for column in zip(*kept))


def _rest_pairs(open_regions: DataFrame, profiles: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """The pairs (a, b) of one region and different components that may be within the
    threshold; or, of these, for each document the one whose profile is ``nearest``.

    A region is dealt into blocks of about ``BLOCK`` documents, and every two of its blocks are
    compared in a task of their own: the pairs of a region are never rows, only those that
    the bounds leave are.
    """
    sizes = open_regions.groupBy("pivot").agg(F.count("*").alias("docs"))
    rows = open_regions.join(sizes, "pivot").join(profiles.select("doc", "profile"), "doc")
    blocks = F.ceil(F.col("docs") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc"), blocks.cast("bigint")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = ["pivot", "i", "j"]
    rows = rows.select(
        "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "doc", "n", "at", "label", "profile",
    )

    def side(table: pa.Table):
        column = lambda c: table.column(c).to_numpy()
        data = b"".join(table.column("profile").to_pylist())
        profile = np.frombuffer(data, np.uint8).reshape(-1, CLASSES)
        return column("doc"), column("n"), column("at"), column("label"), profile

    def compared(table: pa.Table):
        if table.column("i")[0].as_py() == table.column("j")[0].as_py():
            left = right = side(table)
            same = True
        else:
            first = pc.equal(table.column("own"), table.column("i"))
            left, right, same = side(table.filter(first)), side(table.filter(pc.invert(first))), False
        x, y, gap = _survivors(left, right, percent, same)
        return left[0][x], right[0][y], gap

    def pairs(batches):
        for table in runs(batches, cell):
            a, b, gap = compared(table)
            if nearest:  # for the documents of either side
                a, b, gap = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((gap, gap))
                order = np.lexsort((b, gap, a))
                new = np.ones(len(a), bool)
                new[1:] = np.diff(a[order]) != 0
                first = order[new]
                a, b, gap = a[first], b[first], gap[first]
            else:
                a, b = np.minimum(a, b), np.maximum(a, b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(gap)], ["a", "b", "gap"])

    dealt = rows.repartition(*cell).sortWithinPartitions(*cell)
    found = dealt.mapInArrow(pairs, "a long, b long, gap long")
    if nearest:
        found = found.groupBy("a").agg(F.min(F.struct("gap", "b")).getField("b").alias("b"))
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.select("a", "b").distinct()


def runs(batches, keys: list[str]):
    """Tables of equal keys from a stream sorted by them, however batches cut it."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                yield table.slice(lo, hi - lo)
        held = table.slice(cuts[-1]).combine_chunks()
    if held is not None and held.num_rows > 1:
        yield held


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id."""
    spark = docs.sparkSession
    members = materialize(_sets(docs, percent, width), "sets")
    classes = materialize(
        members.where("n > 0 and doc_id is not null")
        .groupBy("sig1", "sig2", "n")
        .agg(
            F.min("doc_id").alias("doc"),
            F.first("head").alias("head"),
            F.first("profile").alias("profile"),
        ),
        "classes",
    )
    profiles = classes.select("doc", "n", "profile")
    counts = materialize(
        classes.select(F.explode("head").alias("pivot")).groupBy("pivot").count().where("count > 1"),
        "counts",
    )
    frequent = (
        counts.where(F.col("count") > HOT)
        .orderBy(F.desc("count"), "pivot")
        .limit(MAX_HOT)
        .select("pivot")
        .toArrow()
    )
    table = np.sort(np.asarray(frequent.column("pivot").combine_chunks()).view(np.uint64))
    hot = spark.sparkContext.broadcast(table)
    regions = _regions(classes.select("doc", "n", "head"), counts, docs, hot, percent, width)
    hubs = (
        regions.groupBy("pivot")
        .agg(F.count("*").alias("docs"), _hub("doc", 0).alias("hub"))
        .where("docs > 1")
        .select("pivot", F.col("hub.doc").alias("hub"))
    )
    regions = materialize(regions.join(hubs, "pivot"), "regions")

    # Only documents that share a region are ever read again.
    texts, name = stored_texts(docs, regions.select(F.col("doc").alias("id")).distinct())
    pairs = materialize(_hub_pairs(regions, profiles, percent, 0), "pairs")
    links = materialize(_verify(pairs, texts, percent, width), "found")
    still = _labelled(regions.select("pivot", "doc", "n", "at"), links)
    for turn in range(1, HUB_ROUNDS):
        hubs = still.groupBy("pivot").agg(_hub("label", turn).alias("h"))
        met = still.join(hubs, "pivot").where(F.col("label") != F.col("h.label"))
        met = met.select("pivot", "doc", "n", F.col("h.doc").alias("hub"))
        pairs = materialize(_hub_pairs(met, profiles, percent, turn), "pairs")
        links = links.unionByName(materialize(_verify(pairs, texts, percent, width), "found"))
        still = _labelled(still.select("pivot", "doc", "n", "at"), links)
    # First each document's nearest, which joins most components that can be joined.
    for nearest in (True, False):
        pairs = materialize(_rest_pairs(still, profiles, percent, nearest), "pairs")
        links = links.unionByName(materialize(_verify(pairs, texts, percent, width), "found"))
        if nearest:
            still = _labelled(still.select("pivot", "doc", "n", "at"), links)
    spark.sql(f"DROP TABLE {name}")
    labels = components(links).select(F.col("id").alias("doc"), "label")
    named = classes.select("sig1", "sig2", "n", "doc").join(labels, "doc", "left")
    named = named.select("sig1", "sig2", "n", F.coalesce("label", "doc").alias("component"))
    return members.join(named, ["sig1", "sig2", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """One row of each component, that of the least doc_id, with its columns.

    Rows without a doc_id come last in their component. Where ids repeat or are missing,
    rows are numbered (and stored) and take part as rows; equal rows are one component
    like any copies. Texts without a word link with nothing and stay, except that rows of
    one doc_id and no word are kept once.
    """
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if not odd.limit(1).count():
        kept = jaccard_components(rows, percent, width).where("doc_id = component_id").select("doc_id")
        return rows.join(kept, "doc_id", "left_semi")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"), percent, width)
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("of"), (F.col("n_shingles") > 0).alias("worded"))
    named = rows.select("row", "doc_id").join(found, "row")
    # Wordless rows of one doc_id are one, whatever their row.
    alone = ~F.col("worded") & F.col("doc_id").isNotNull()
    group = [F.when(~alone, F.col("of")).alias("of"), F.when(alone, F.col("doc_id")).alias("id")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row"))
    kept = named.groupBy(*group).agg(first.getField("row").alias("row"))
    return rows.join(kept.select("row"), "row", "left_semi").drop("row")
