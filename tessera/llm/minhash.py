"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges, full-set confirmation.

1. Each whole text becomes the set of its distinct word shingles, a digest of that set, the keys of its buckets (one per
   band of a densified one-permutation signature) and a 512-bit sketch.
2. Rows with equal sets collapse into a class, named by its smallest id; a group of exact copies of any size costs one
   grouped minimum.
3. In each bucket the class that comes first in one seeded order of all classes is the hub, and every member is paired
   with it: at most one pair for a bucket row, and mostly the same hub in all buckets of a group.
4. Pairs whose sizes or sketches rule the threshold out go (a sketch only where both sets are large enough for its error
   to be negligible); the rest are confirmed on the full sets, contracted part by part and closed into components.
5. A bucket whose members all are in one component has nothing more to say.  Members of the other buckets are compared
   exactly: two of different components meet where they share a shingle of their rarest ones.  These prefixes are as long
   as the threshold asks for, so no link between such members is lost, and they leave out what a group has in common.
   Groups of a rare shingle of more than `block` members are compared block by block, so that no task holds more than
   two blocks; blocks of one component never meet.  This is done twice: first only the likeliest pair of any two components of a block goes on, which joins
   the parts of a large group by a few pairs; then all pairs of members that are still apart.  What sizes, places, sketches and bitmaps let through is confirmed on the full sets, and the components
   closed again.  A bitmap has a bit for each shingle's hash; a bit that only one of two sets has stands for a shingle that
   they do not share, so a bitmap never rules out a link.

Defined cases: a null or word-less text has an empty set and is linked with nothing; a text with fewer words than a
shingle is one shingle; very long texts are read whole; rows are judged by their own text, so repeated rows of an id agree,
and where an id has several texts each row follows its own (an id that is the smallest of two texts links them); a null id
is its own class with a null component; columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, frugal, text_runs, written
from .shingles import MASK, OnePermutation, WordHashes, mix, shingle_set

SIGNATURE = "doc_id long, n_shingles long, set_hash binary, band_keys array<long>, sketch binary"
#: Sketch bits: one-bit minima.  Two sets of similarity s agree in about (1 + s) / 2 of them.
SKETCH_BITS = 512
#: Of these bits, sets at the threshold differ in 64 with a deviation of 7.5 to 9; the bound lies 15 points of similarity
#: lower.  Sets of fewer shingles than SURE are not judged by the sketch.
MARGIN, SURE = 15, 100
#: Bits of the bitmap of a set.
BITMAP_BITS = 1024
#: Bins that count shingles.  Which shingles are rare only matters for speed, so those that fall together do no harm.
COUNT_BINS = 1 << 19
#: Ids (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Text handled at a time in a task.
PART_BYTES = 4_000_000


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set size, set digest, band keys and sketch of every row of (doc_id, text)."""

    def run(batches):
        hashes, banded, sketcher = WordHashes(), OnePermutation(bands, rows), OnePermutation(SKETCH_BITS, 1, seed=7)
        one = np.uint64(1)
        for batch in batches:
            ids, sizes, digests, keys, sketches = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingle_set(text.as_py(), hashes, width)
                ids.append(doc_id)
                sizes.append(len(found))
                if len(found):
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    keys.append(banded.band_keys(found))
                    bits = (mix(sketcher.signature(mix_sorted(found))) & one).astype(np.uint8)
                    sketches.append(np.packbits(bits).tobytes())
                else:
                    digests.append(None)
                    keys.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "band_keys", "sketch"],
            )

    return docs.mapInArrow(frugal(run), SIGNATURE)


def mix_sorted(found: np.ndarray) -> np.ndarray:
    """The same set under another hash function, sorted again."""
    return np.sort(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5 & MASK)))


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, the digest of its shingle set, and the sorted distinct shingle hashes."""

    def run(batches):
        hashes = WordHashes()
        for whole in batches:
            for batch in text_runs(whole, 1, PART_BYTES):
                sets = [shingle_set(text.as_py(), hashes, width) for text in batch.column(1)]
                digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["rid", "set_hash", "shingles"])

    return docs.mapInArrow(frugal(run), "rid long, set_hash binary, shingles array<long>")


def ordered(one: str | Column, two: str | Column) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def star_pairs(buckets: DataFrame, seed: int = 1) -> DataFrame:
    """Distinct (a, b), a < b: every member of a bucket with the bucket's hub.  `buckets`: key, rid.

    The order in which hubs are chosen is the same in all buckets, so the buckets of one group mostly share their hub.
    """
    hubs = buckets.groupBy("key").agg(F.min_by("rid", F.xxhash64(F.lit(seed), "rid")).alias("hub"), F.count("*").alias("members"))
    met = buckets.join(hubs.filter("members > 1").select("key", "hub"), "key").filter("rid <> hub")
    return met.select(*ordered("rid", "hub")).distinct()


def screened(pairs: DataFrame, facts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches leave the threshold possible.  `facts`: rid, n, sketch."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = possible(na, nb, *(bit_words(batch.column(k), SKETCH_BITS) for k in (4, 5)), threshold)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    both = pairs.join(facts.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    both = both.join(facts.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(frugal(run), "a long, b long").distinct()


def bit_words(column: pa.Array, bits: int) -> np.ndarray:
    """uint64[rows, bits / 64] of a column of sketches or bitmaps."""
    words = bits // 64
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words) if len(column) else np.empty((0, words), np.uint64)


def bitmaps(sets: DataFrame) -> DataFrame:
    """rid and `bitmap` of every set of (rid, shingles)."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1):
                bits = np.zeros(BITMAP_BITS, np.uint8)
                bits[x.values.to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(BITMAP_BITS)] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["rid", "bitmap"])

    return sets.select("rid", "shingles").mapInArrow(frugal(run), "rid long, bitmap binary")


def overlap_bound(na, nb, ma: np.ndarray, mb: np.ndarray):
    """The most shingles that sets of these sizes and bitmaps can share."""
    return np.minimum(na - np.bitwise_count(ma & ~mb).sum(axis=1, dtype=np.int64), nb - np.bitwise_count(mb & ~ma).sum(axis=1, dtype=np.int64))


def possible(na, nb, sa: np.ndarray, sb: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets of these sizes and sketches may be similar enough."""
    differ = np.bitwise_count(sa ^ sb).sum(axis=1, dtype=np.int64)
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (small * 100 >= large * threshold) & ((differ * 200 <= SKETCH_BITS * (100 - threshold + MARGIN)) | (small < SURE))


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach `threshold` percent of their union.  `sets`: rid, shingles."""
    joined = pairs.join(sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb")), "b")
    joined = joined.join(sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa")), "a")
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    sized = joined.select("a", "b", (F.size("sa") + F.size("sb")).cast("long").alias("n"), inter.alias("inter"))
    return sized.filter(F.col("inter") * 100 >= (F.col("n") - F.col("inter")) * threshold).select("a", "b")


def unresolved(buckets: DataFrame, merged: DataFrame) -> DataFrame:
    """Distinct (rid, comp) of the members of buckets that hold more than one component."""
    within = buckets.join(merged.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", F.coalesce("component", "rid").alias("comp"))
    mixed = within.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most").select("key")
    return within.join(mixed, "key").select("rid", "comp").distinct()


def prefix(found: np.ndarray, counts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest shingles of a set, their places in its order, and whether a set no smaller than this one may need them.

    Sets of n and m shingles that are similar enough share `least(n, m)` of them or more, so in an order that is the same
    for all sets, the first n - least + 1 of one and the first m - least + 1 of the other have a shingle in common.  `least`
    grows with the other set's size.  A shingle that only one set holds is left out.
    """
    n = len(found)
    often = counts[found & np.uint64(COUNT_BINS - 1)]
    places = np.arange(n - least(n, -(-n * threshold // 100), threshold) + 1)
    order = np.lexsort((found, often))[: len(places)]
    shared = often[order] > 1
    return found[order][shared], places[shared], places[shared] <= n - least(n, n, threshold)


def least(n, m, threshold: int):
    """How many shingles sets of n and m share at the threshold."""
    return -(-threshold * (n + m) // (100 + threshold))


def rare_rows(sets: DataFrame, threshold: int) -> DataFrame:
    """key, rid, comp, place, n, short: the prefix of every set of (rid, comp, shingles)."""

    def count(batches):
        counts = np.zeros(COUNT_BINS, np.uint32)
        for batch in batches:
            found = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            counts += np.bincount((found & np.uint64(COUNT_BINS - 1)).astype(np.int64), minlength=COUNT_BINS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    counts = np.zeros(COUNT_BINS, np.int64)
    for row in sets.select("shingles").coalesce(32).mapInArrow(frugal(count), "counts binary").toLocalIterator():
        counts += np.frombuffer(row["counts"], np.uint32)
    counts = np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)

    def run(batches):
        for batch in batches:
            of = [prefix(x.values.to_numpy(zero_copy_only=False).view(np.uint64), counts, threshold) for x in batch.column(2)]
            sizes = [len(x[0]) for x in of]
            rid, comp = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))
            n = np.repeat([len(x.values) for x in batch.column(2)], sizes).astype(np.int64)
            keys, places, short = (np.concatenate(x) for x in zip(*of, strict=True)) if of else (np.empty(0, t) for t in (np.uint64, np.int64, bool))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(rid), pa.array(comp), pa.array(places), pa.array(n), pa.array(short)], names=["key", "rid", "comp", "place", "n", "short"])

    return sets.select("rid", "comp", "shingles").mapInArrow(frugal(run), "key long, rid long, comp long, place long, n long, short boolean")


def dealt_blocks(rows: DataFrame, block: int) -> DataFrame:
    """The rows of keys that hold several components, dealt into blocks: `own`, the row's block, and `other`, one it meets.

    A component of more than `block` members of a key is cut into blocks of its own, which never meet one another; all
    smaller ones share blocks.  So a group that is one large component and a few others moves once, however large it is.
    """
    of_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.bool_or("short").alias("short"))
    large = F.col("n") > block
    keys = of_comp.groupBy("key").agg(
        F.count("*").alias("comps"), F.bool_or("short").alias("short"), F.ceil(F.sum(F.when(large, 0).otherwise(F.col("n"))) / block).alias("shared"),
        F.sort_array(F.collect_list(F.when(large, F.struct("comp", F.ceil(F.col("n") / block).alias("blocks"))))).alias("large"),
    )
    # The smaller set of a pair has the shingle in its short prefix.
    keys = keys.filter("comps > 1 AND short")
    upto = lambda i: F.aggregate(F.slice("large", F.lit(1), i), F.col("shared"), lambda acc, x: acc + x["blocks"])
    keys = keys.select("key", "shared", F.transform("large", lambda x, i: F.struct(x["comp"].alias("comp"), upto(i).alias("first"), x["blocks"].alias("blocks"))).alias("large"), upto(F.size("large")).alias("all"))
    own = F.get(F.filter("large", lambda x: x["comp"] == F.col("comp")), F.lit(0))
    dealt = rows.join(keys, "key").withColumn("mine", own)
    place = F.when(F.col("mine").isNull(), F.pmod(F.xxhash64("comp"), F.col("shared"))).otherwise(F.col("mine.first") + F.pmod(F.xxhash64("rid"), F.col("mine.blocks")))
    meets = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda j: F.col("mine").isNull() | (j < F.col("mine.first")) | (j >= F.col("mine.first") + F.col("mine.blocks")))
    return dealt.select("key", "rid", "comp", "place", "n", place.alias("own"), F.explode(meets).alias("other"))


def hidden_pairs(rows: DataFrame, facts: DataFrame, threshold: int, block: int, best: bool) -> DataFrame:
    """Distinct candidates (a, b) of different components among `rows` (see rare_rows).  `facts`: rid, sketch, bitmap.
    `best`: of the candidates of two components in a block, only the likeliest.

    A key's members are dealt into blocks of about `block`; each pair of blocks that meet is a group of its own.
    """
    dealt = dealt_blocks(rows, block).join(facts.select("rid", "sketch", "bitmap"), "rid")
    met = dealt.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = met.agg(F.collect_list(F.struct("rid", "comp", "place", "n", "own", "sketch", "bitmap")).alias("members")).filter(F.size("members") > 1)

    def run(batches):
        for batch in batches:
            found = [(np.empty(0, np.int64),) * 2]
            for i, j, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rid, comp, place, n, own = (members.values.field(k).to_numpy() for k in ("rid", "comp", "place", "n", "own"))
                bits = (bit_words(members.values.field(k), size) for k, size in (("sketch", SKETCH_BITS), ("bitmap", BITMAP_BITS)))
                found.append(similar_pairs(rid, comp, place, n, own if i < j else None, *bits, threshold, best))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a):
                a, b = np.unique(np.stack([a, b]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return met.select("i", "j", "members").mapInArrow(frugal(run), "a long, b long").distinct()


def similar_pairs(rid, comp, place, n, own, sketch, bitmap, threshold: int, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of different comp (and of different `own` where that is given) that may reach the threshold."""
    order = np.lexsort((rid, comp))
    rid, comp, place, n, sketch, bitmap = (x[order] for x in (rid, comp, place, n, sketch, bitmap))
    own = own[order] if own is not None else None
    one, two = [], []
    for k, begin in enumerate(np.searchsorted(comp, comp).tolist()):  # each with those of all components before its own
        if not begin:
            continue
        both = least(n[:begin], n[k], threshold)
        met = (place[:begin] <= n[:begin] - both) & (place[k] <= n[k] - both)
        if own is not None:
            met &= own[:begin] != own[k]
        at = np.flatnonzero(met)
        if len(at):
            at = at[overlap_bound(n[at], n[k], bitmap[at], bitmap[k]) >= both[at]]
        if len(at):
            at = at[possible(n[at], n[k], sketch[at], sketch[k], threshold)]
            one.append(at)
            two.append(np.full(len(at), k))
    if not one:
        return rid[:0], rid[:0]
    one, two = np.concatenate(one), np.concatenate(two)
    if best and len(one) > 1:
        differ = np.bitwise_count(sketch[one] ^ sketch[two]).sum(axis=1)
        order = np.lexsort((differ, comp[two], comp[one]))
        first = np.ones(len(order), bool)
        first[1:] = (comp[one][order][1:] != comp[one][order][:-1]) | (comp[two][order][1:] != comp[two][order][:-1])
        one, two = one[order[first]], two[order[first]]
    return np.minimum(rid[one], rid[two]), np.maximum(rid[one], rid[two])


def contracted(edges: DataFrame, per_task: int = 250_000) -> DataFrame:
    """Edges (u, v) with the same components but no cycles within a part of `per_task` edges: a partial aggregation.

    A dense group has many times more links than members; each part keeps a star per component that it sees.
    """

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        stars = [(x, root(x)) for x in list(parent)]
        stars = [s for s in stars if s[0] != s[1]]
        yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], names=["u", "v"])

    parts = max(1, -(-edges.count() // per_task))
    return edges.repartition(parts).mapInArrow(frugal(run), "u long, v long")


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node with an edge in (a, b).

    Edges are contracted part by part first.  Then large-star and small-star in turn until the edges no longer change;
    every round is written to the shared folder, and a hot node's neighbours are reduced by a partial minimum and
    rejoined, never gathered.
    """
    edges = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "links")
    edges = scratch.keep(contracted(edges), "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.keep(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 75, bands: int = 32, rows: int = 4, block: int = 4000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links of `threshold` percent similarity or more, kept tells whether
    it is the row's own id.  See the module's text for nulls, empty texts and repeated rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "op4")
    signed = scratch.keep(signatures(docs, width, bands, rows), "signatures")
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "n_shingles", "band_keys", "sketch"))
    classes = full.groupBy("set_hash").agg(first.alias("f")).select("set_hash", F.col("f.doc_id").alias("rid"), F.col("f.n_shingles").alias("n"), "f.band_keys", "f.sketch")
    classes = scratch.keep(classes, "classes")
    facts = classes.select("rid", "n", "sketch")

    met = scratch.keep(star_pairs(classes.select("rid", F.explode("band_keys").alias("key"))), "met")
    members = scratch.keep(met.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "members")
    # Only ids that share a bucket are read again; as long as they are few enough their ids go to the texts, not the reverse.
    small = members.count() <= BROADCAST_IDS
    sets = full_sets(docs.join(F.broadcast(members) if small else members, docs["doc_id"] == members["rid"], "left_semi"), width)
    # A row of a member's id counts if its text is that of a class, and once.
    sets = sets.join(classes.select("set_hash", "rid"), ["set_hash", "rid"], "left_semi").dropDuplicates(["set_hash"])
    sets = scratch.keep(sets.select("rid", "shingles"), "sets")
    merged = components(confirmed(screened(met, facts, threshold), sets, threshold), scratch)

    shared = classes.join(members, "rid", "left_semi").select("rid", F.explode("band_keys").alias("key"))
    left = scratch.keep(unresolved(shared, merged), "left")
    if not left.isEmpty():
        left_sets = scratch.keep(sets.join(left, "rid").select("rid", "comp", "shingles"), "left-sets")
        rare = scratch.keep(rare_rows(left_sets, threshold), "rare")
        marks = scratch.keep(facts.select("rid", "sketch").join(bitmaps(left_sets), "rid"), "marks")
        scratch.drop("left-sets")
        for best in (True, False):
            pairs = scratch.keep(hidden_pairs(rare, marks, threshold, block, best), "hidden")
            more = confirmed(pairs, sets, threshold)
            merged = components(merged.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch)
            now = merged.select(F.col("node").alias("rid"), "component")
            rare = rare.join(now, "rid", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")
    of_class = classes.select("set_hash", "rid").join(merged, F.col("rid") == F.col("node"), "left").select("set_hash", F.coalesce("component", "rid").alias("found_id"))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(of_class, "set_hash", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("found_id")).otherwise(F.col("doc_id"))
    result = written(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "op4-result")
    scratch.drop()
    return result


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each group: the ids of which some row is kept (see near_duplicates), and null ids."""
    gone = free_name(docs, "gone_id")
    ids = near_duplicates(docs, **options).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("NOT kept")
    return docs.join(ids.select(F.col("doc_id").alias(gone)), F.col("doc_id") == F.col(gone), "left_anti")
