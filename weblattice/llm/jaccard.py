"""N-gram Jaccard join by prefix trees, exact, for documents and their components.

A document's set holds 64-bit hashes of its distinct word n-grams. Sets join in five steps, none of which collects pairs:

1. Counts. Documents are dealt into blocks of a bounded number of bytes. Each block sends every distinct n-gram of a
   fixed part of the hash range once to the bucket of that n-gram, with its number of documents; the bucket answers
   each block with its n-grams that others share, and their total. A frequent n-gram is thus one row for each block,
   not one for each document.
2. Suspects. The global order of n-grams is by that count, then by hash, uncounted ones last. A set with a partner has
   to share an n-gram within its prefix of |x| - ceil(t|x|) + 1 n-grams, so a document whose prefix consists of n-grams
   that nothing else has is done. All others keep their sets.
3. Candidates. Equal sets become one class, which has the least id of its rows. Sets that share an n-gram within their
   prefixes fall into one candidate component; n-grams link them to the least id that has them, which takes as many
   edges as postings.
4. Prefix trees. The sets of a candidate component are stored in a prefix tree in that component's global order, rarest
   first, as a sorted list with common prefix lengths. All queries walk the tree together: the overlap up to a node is
   counted once for all sets below it, and a query leaves a subtree as soon as the overlap and what remains of it or of
   the subtree cannot reach the bound. Every link between different sets is found, once, and counted for both, with the
   documents that have the other set as its weight; links are not sent one by one. Large components are split into
   blocks, of which every two meet in a task of their own.
5. Of each task's links a spanning forest gives the components; the counts of all tasks add up to the links of a set.

The join that gives rows their class is skewed where very many rows have one set. Classes with more rows than a part in
4 times the number of partitions, of which there are at most as many as that, are therefore broadcast, all others joined by a shuffle.

Defined cases: null texts and texts without words have an empty set and link with nothing; a text with fewer words than
an n-gram has the one n-gram of all its words. Rows that share an id are one document: they have one component, to which
all their sets belong. ``n_links`` of a row counts the other pairs of an id and a set that are similar to the row's own
set; where ids stand once, documents. Repeated rows stay repeated and count once. A row with a null id has no component
and no links, and counts for none. Equal hashes of different n-grams are not told apart (64 bits, within two texts),
nor are sets with equal 128-bit digests. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblattice.llm.arrow import ASCII_LOWER, BLANK, mix64, run_hashes, runs, utf8
from weblattice.llm.components import components
from weblattice.sources.scratch import cut, drop

#: The part of the hash range in which n-grams are counted. Any value gives the same result; a smaller one leaves more suspects.
COUNTED = 0.35
#: The most n-grams and sets in a block of a large component.
BLOCK_TOKENS, BLOCK_SETS = 1 << 20, 1 << 11
#: About the most bytes of text in a block of documents; a longer text is a block of its own at least.
BLOCK_BYTES = 1 << 26
_STEP = np.uint64(0xD6E8FEB86659FD93)


def gram_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    data, text_ends = utf8(texts)
    data = ASCII_LOWER[data]
    starts, ends = runs(data, BLANK)
    words = run_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, np.concatenate(([0], text_ends)))
    count = max(len(words) - width + 1, 0)
    total = np.zeros(count, np.uint64)
    for k in range(width):
        total = total * _STEP + words[k : k + count]
    total = mix64(total)
    out = []
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - b >= width:
            own = np.sort(total[b : e - width + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        elif e > b:
            short = np.array([e - b], np.uint64)
            for h in words[b:e]:
                short = mix64(short * _STEP + h)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(own: np.ndarray) -> bytes:
    a = np.bitwise_xor.reduce(mix64(own)) + np.uint64(len(own))
    b = np.add.reduce(mix64(own ^ _STEP))
    return np.array([a, b], "<u8").tobytes()


def prefix_size(n: int, share: tuple[int, int]) -> int:
    """n - ceil(t n) + 1."""
    top, below = share
    return n - -(-top * n // below) + 1


def _block_sets(table: pa.Table, width: int) -> tuple[list, list[np.ndarray]]:
    """Ids and sets of a block, a slice of texts at a time."""
    ids, sets, held, size = table.column("doc_id").to_pylist(), [], [], 0
    for value in table.column("text"):
        text = value.as_py()
        held.append(text)
        size += len(text or "")
        if size >= 1 << 18:
            sets += gram_sets(held, width)
            held, size = [], 0
    return ids, sets + (gram_sets(held, width) if held else [])


def _count_block(width: int, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, sets = _block_sets(table, width)
        top = np.uint64(int(COUNTED * 2**64))
        every = np.concatenate([np.zeros(0, np.uint64), *(s[: np.searchsorted(s, top)] for s in sets)])
        grams, count = np.unique(every, return_counts=True)
        bucket = (grams % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        grams, count = grams[order], count[order].astype("<u4")
        full = np.flatnonzero(np.diff(cuts))
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "block": pa.array([key[0].as_py()] * len(full), pa.int32()),
            "grams": pa.array([grams[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()), "counts": pa.array([count[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()),
        })

    return run


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    blocks = table.column("block").to_pylist()
    grams = [np.frombuffer(x, "<u8") for x in table.column("grams").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
    _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(inverse, weights=counts)[inverse].astype("<u4")
    out, at = {"block": [], "grams": [], "counts": []}, 0
    for block, own in zip(blocks, grams, strict=True):
        sums = total[at : at + len(own)]
        at += len(own)
        shared = sums >= 2
        if shared.any():
            out["block"].append(block)
            out["grams"].append(own[shared].tobytes())
            out["counts"].append(sums[shared].tobytes())
    return pa.table({"block": pa.array(out["block"], pa.int32()), "grams": pa.array(out["grams"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})


def _suspects(width: int, share: tuple[int, int]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sets = _block_sets(left, width)
        known = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in right.column("grams").to_pylist())])
        totals = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x, "<u4") for x in right.column("counts").to_pylist())])
        order = np.argsort(known)
        known, totals = known[order], totals[order].astype(np.int64)
        top = np.uint64(int(COUNTED * 2**64))
        carrier: dict[bytes, int] = {}
        prefixes: dict[int, np.ndarray] = {}
        digests: list[bytes | None] = [None] * len(sets)
        for k, own in enumerate(sets):
            cut_at = int(np.searchsorted(own, top))
            count = np.full(len(own), 1 << 40, np.int64)
            if cut_at and len(known):
                at = np.minimum(np.searchsorted(known, own[:cut_at]), len(known) - 1)
                count[:cut_at] = np.where(known[at] == own[:cut_at], totals[at], 1)
            else:
                count[:cut_at] = 1
            size = prefix_size(len(own), share)
            alone = count == 1
            if not len(own) or int(alone.sum()) >= size:
                continue
            first = np.argsort(count, kind="stable")[:size]  # hashes are in order already
            prefixes[k] = own[first][~alone[first]]
            digest = digests[k] = _digest(own)
            if ids[k] is not None and (digest not in carrier or ids[k] < ids[carrier[digest]]):
                carrier[digest] = k
        held = set(carrier.values())
        return pa.table({
            "doc_id": pa.array(ids, left.schema.field("doc_id").type), "block": left.column("block").combine_chunks().cast(pa.int32()), "n": pa.array(map(len, sets), pa.int64()), "digest": pa.array(digests, pa.binary()),
            "grams": pa.array([sets[k].astype("<u8").tobytes() if k in held else None for k in range(len(sets))], pa.binary()),
            "prefix": pa.array([prefixes[k].view(np.int64) if k in held else None for k in range(len(sets))], pa.list_(pa.int64())),
        })

    return run


class PrefixTree:
    """Sets of ranks (rarest first) in lexicographic order, with the lengths of common prefixes; nodes are ranges of it."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[k] for k in self.order]
        self.common = np.zeros(max(len(sets) - 1, 0), np.int64)
        for k, (a, b) in enumerate(zip(self.sets, self.sets[1:])):
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            self.common[k] = differ.argmax() if differ.any() else m
        self.lengths = np.array([len(s) for s in self.sets], np.int64)


def linked(
    query_sets: list[np.ndarray], query_sizes: np.ndarray, tree: PrefixTree, tree_sizes: np.ndarray, vocabulary: int, share: tuple[int, int],
    labels: np.ndarray, query_at: np.ndarray, tree_at: np.ndarray, weights: np.ndarray, counts: np.ndarray, later: bool, step: int = 128,
) -> list[tuple[int, int]]:
    """Find all links between queries and the tree's sets; return those that join two of ``labels``, which they change.

    Each link adds the weight of either end to the ``counts`` of the other. ``query_at`` and ``tree_at`` are the places of the sets in ``labels``, ``weights`` and ``counts``; sizes are those of the
    whole sets. With ``later`` the queries are sets of the tree, and each meets only those behind it.
    """
    top, below = share
    found: list[tuple[int, int]] = []
    sizes, places = tree_sizes[tree.order], tree_at[tree.order]
    n = len(query_sets)
    has = np.zeros((vocabulary, n), np.uint8)  # an n-gram's queries lie side by side
    for k, own in enumerate(query_sets):
        has[own, k] = 1
    # n-grams of each query before every 64th rank
    before = np.zeros((vocabulary // 64 + 2, n), np.int32)
    np.cumsum(np.add.reduceat(has, np.arange(0, vocabulary, 64), axis=0, dtype=np.int32), axis=0, out=before[1 : -(-vocabulary // 64) + 1])
    lengths = np.array([len(own) for own in query_sets], np.int64)
    every = np.arange(n)
    behind = np.full(n, -1)
    if later:
        row = np.zeros(len(labels), np.int64)
        row[places] = np.arange(len(places))
        behind = row[query_at]
    stack = [(0, len(tree.sets), 0, every, np.zeros(len(every), np.int64))]
    while stack:
        low, high, depth, active, overlap = stack.pop()
        end = int(tree.common[low : high - 1].min()) if high - low > 1 else int(tree.lengths[low])
        least, rest_end = sizes[low:high].min(), int(tree.lengths[low:high].max())
        if later:
            ahead = behind[active] < high - 1
            active, overlap = active[ahead], overlap[ahead]
        need = -(-top * (query_sizes[active] + least) // (top + below))
        own = tree.sets[low]
        while depth < end and len(active):
            more = own[depth : min(end, depth + step)]
            # at most 255 n-grams a step, so that bytes can hold the sums
            some = has[more].sum(axis=0, dtype=np.uint8)[active] if 8 * len(active) >= n else has[np.ix_(more, active)].sum(axis=0, dtype=np.uint8)
            overlap = overlap + some
            depth += len(more)
            used = before[int(more[-1]) // 64, active]  # or a few more
            hope = overlap + np.minimum(lengths[active] - used, rest_end - depth) >= need
            active, overlap, need = active[hope], overlap[hope], need[hope]
        if not len(active):
            continue
        at = low
        while at < high and tree.lengths[at] == end:  # sets that end here
            union = query_sizes[active] + sizes[at] - overlap
            hits, place = query_at[active[(below * overlap >= top * union) & (overlap > 0) & (behind[active] < at)]], places[at]
            counts[hits] += weights[place]
            counts[place] += weights[hits].sum()
            apart = hits[labels[hits] != labels[place]]
            while len(apart):
                found.append((int(apart[0]), int(place)))
                labels[labels == labels[place]] = labels[apart[0]]
                apart = apart[labels[apart] != labels[place]]
            at += 1
        if at < high:
            cuts = [at, *(at + 1 + np.flatnonzero(tree.common[at : high - 1] == end)).tolist(), high]
            stack += [(x, y, end, active, overlap) for x, y in zip(cuts, cuts[1:])]
    return found


def join_sets(left: list[np.ndarray], right: list[np.ndarray] | None, share: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links of ``left`` with ``right``, or within ``left``; right sets are numbered after the left ones."""
    return join_counts(left, right, share, np.ones(len(left) + len(right or []), np.int64))[0]


def join_counts(left: list[np.ndarray], right: list[np.ndarray] | None, share: tuple[int, int], weights: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """That forest, and for each set the summed weights of all sets it links with."""
    every = left + (right or [])
    sizes, counts = np.array([len(s) for s in every], np.int64), np.zeros(len(every), np.int64)
    if len(every) < 2:
        return [], counts
    grams, inverse, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    order = np.lexsort((grams, count))
    rank = np.full(len(grams), -1, np.int64)
    order = order[count[order] > 1]  # n-grams of one set alone only count in its size
    rank[order] = np.arange(len(order))
    ranks = rank[inverse]
    bounds = np.cumsum([0, *sizes])
    ranked = []
    for b, e in zip(bounds[:-1], bounds[1:]):
        own = ranks[b:e]
        ranked.append(np.sort(own[own >= 0]))
    labels, vocabulary = np.arange(len(every)), max(len(order), 1)
    queries = np.arange(len(left))
    held = queries if right is None else np.arange(len(left), len(every))
    tree = PrefixTree([ranked[k] for k in held])
    found, chunk = [], max(1, (1 << 25) // vocabulary)
    for b in range(0, len(queries), chunk):
        part = queries[b : b + chunk]
        found += linked([ranked[k] for k in part], sizes[part], tree, sizes[held], vocabulary, share, labels, part, held, weights, counts, right is None)
    return found, counts


def _walk(share: tuple[int, int]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        ids, parts, comps, digests = (table.column(c).to_pylist() for c in ("v", "part", "comp", "digest"))
        sets = [np.frombuffer(x, "<u8") for x in table.column("grams").to_pylist()]
        weights = table.column("w").to_numpy()
        pairs: list[tuple] = []
        sums = np.zeros(len(ids), np.int64)
        if i >= 0:
            left, right = [k for k, p in enumerate(parts) if p == i], [k for k, p in enumerate(parts) if p == j]
            both = left if i == j else left + right
            found, sums[both] = join_counts([sets[k] for k in left], None if i == j else [sets[k] for k in right], share, weights[both])
            pairs = [(ids[both[a]], ids[both[b]]) for a, b in found]
        else:
            order = sorted(range(len(ids)), key=comps.__getitem__)
            start = 0
            for k in range(1, len(order) + 1):
                if k == len(order) or comps[order[k]] != comps[order[start]]:
                    own = order[start:k]
                    found, sums[own] = join_counts([sets[x] for x in own], None, share, weights[own])
                    pairs += [(ids[own[a]], ids[own[b]]) for a, b in found]
                    start = k
        some = np.flatnonzero(sums).tolist()
        return pa.table({
            "a": pa.array([*(a for a, _ in pairs), *[None] * len(some)], pa.int64()), "b": pa.array([*(b for _, b in pairs), *[None] * len(some)], pa.int64()),
            "digest": pa.array([*[None] * len(pairs), *(digests[k] for k in some)], pa.binary()), "n": pa.array([*[None] * len(pairs), *sums[some].tolist()], pa.int64()),
        })

    return run


def similar(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row; two documents link when their sets' Jaccard similarity is at least the share."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = max(parts, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))  # rows of one id, or of none, do not meet

    counted = rows.groupBy("block").applyInArrow(_count_block(width, blocks), "bucket int, block int, grams binary, counts binary")
    answers = counted.groupBy("bucket").applyInArrow(_answer, "block int, grams binary, counts binary")
    seen = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_suspects(width, share), "doc_id long, block int, n long, digest binary, grams binary, prefix array<long>")
    seen = cut(seen, "sets")

    grouped = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    members = seen.where(grouped).groupBy("doc_id", "digest").agg(F.min("block").alias("block"), F.count("*").alias("rows"))
    first = F.min(F.struct("doc_id", "block"))
    classes = members.groupBy("digest").agg(first.alias("first"), F.count("*").alias("w"), F.sum("rows").alias("rows")).select("digest", F.col("first.doc_id").alias("v"), F.col("first.block").alias("at"), "w", "rows")
    held = seen.where(F.col("grams").isNotNull()).join(classes, "digest").where("doc_id = v AND block = at").select("digest", "v", "w", "n", "grams", "prefix")

    postings = cut(held.select("v", F.explode("prefix").alias("gram")), "postings")
    heads = postings.groupBy("gram").agg(F.min("v").alias("head"), F.max("v").alias("tail")).where("head <> tail").select("gram", "head")
    candidate = components(postings.join(heads, "gram").where("v <> head").select(F.col("v").alias("a"), F.col("head").alias("b")))
    drop(postings)

    of = candidate.withColumnRenamed("label", "comp")
    sets = held.join(of, "v")
    per = held.select("v", "n").join(of, "v").groupBy("comp").agg(F.sum("n").alias("grams_in"), F.count("*").alias("sets_in"))
    split = F.greatest(F.ceil(F.col("grams_in") / BLOCK_TOKENS), F.ceil(F.col("sets_in") / BLOCK_SETS)).cast("int")
    tasks = sets.join(per.select("comp", split.alias("blocks")), "comp").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    small = F.col("blocks") == 1
    tasks = tasks.select(
        F.when(small, F.pmod(F.xxhash64("comp"), F.lit(4 * blocks))).otherwise(F.col("comp")).alias("k"),
        F.when(small, -1).otherwise(F.least("part", "other")).alias("i"), F.when(small, -1).otherwise(F.greatest("part", "other")).alias("j"), "comp", "part", "v", "w", "digest", "grams",
    )
    links = cut(tasks.groupBy("k", "i", "j").applyInArrow(_walk(share), "a long, b long, digest binary, n long"), "links")
    drop(candidate)

    # ids with several rows: all their sets are of one document
    ids = seen.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count("digest").alias("sets"))
    several = cut(ids.where("rows > 1 AND sets > 0").select("doc_id"), "several")
    edges = links.where("b IS NOT NULL").select("a", "b")
    repeated = not several.isEmpty()
    if repeated:
        own = members.join(several, "doc_id").join(classes.select("digest", "v"), "digest").where("doc_id <> v")
        edges = edges.unionByName(own.select(F.col("doc_id").alias("a"), F.col("v").alias("b")))
    found = components(edges)
    least = found.groupBy("label").agg(F.min("v").alias("component_id"))
    counts = links.where("n IS NOT NULL").groupBy("digest").agg(F.sum("n").alias("others"))
    final = found.join(least, "label").select("v", "component_id")
    known = classes.join(final, "v", "left").join(counts, "digest", "left")
    known = cut(known.select("digest", F.coalesce("component_id", "v").alias("component_id"), (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "rows"), "classes")
    drop(links)

    rest = seen.where(~grouped).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.expr("IF(doc_id IS NULL, NULL, 0L)").alias("n_links"))
    if repeated:  # rows without a partner that share their id with one that has some
        mine = final.join(several, F.col("v") == F.col("doc_id")).select(F.col("doc_id").alias("same"), F.col("component_id").alias("theirs"))
        rest = rest.join(mine, F.col("doc_id") == F.col("same"), "left").withColumn("component_id", F.coalesce("theirs", "component_id")).drop("same", "theirs")
    # at most 4 * parts classes can have so many rows
    most = max(1, -(-seen.where(grouped).count() // (4 * parts)))
    result = ("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    frequent, slim = known.where(F.col("rows") >= most), seen.where(grouped).select("doc_id", "n", "digest")
    often = slim.join(F.broadcast(frequent), "digest").select(*result)
    seldom = slim.join(F.broadcast(frequent.select("digest")), "digest", "left_anti").join(known.where(F.col("rows") < most), "digest").select(*result)
    return rest.unionByName(often).unionByName(seldom)


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: of its smallest id, and of several rows of that id the one whose text sorts first. Rows with a null id have no component and all stay."""
    ids = similar(docs, **options).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("component_id") != F.col("doc_id")).alias("gone"), F.count("*").alias("rows"))
    marks = cut(ids.where("_id IS NOT NULL AND (gone OR rows > 1)"), "marks")
    again = marks.where("NOT gone").select("_id")  # none where ids stand once
    names = docs.columns
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    doc_id, text = (f"c{names.index(options.get(x, y))}" for x, y in (("id_col", "doc_id"), ("text_col", "text")))
    single = rows.join(marks, F.col(doc_id).cast("long") == F.col("_id"), "left_anti")
    order = Window.partitionBy("_id").orderBy(F.col(text).asc_nulls_last())
    first = rows.join(again, F.col(doc_id).cast("long") == F.col("_id")).withColumn("_row", F.row_number().over(order)).where("_row = 1")
    return single.unionByName(first.select(*rows.columns)).toDF(*names)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[k : k + 4], ' ') END AS gram
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS k FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(reach.y), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id
"""
#: The same with the number of links.
LINKS_ORACLE = ORACLE.replace("SELECT d.doc_id, ", "SELECT d.doc_id, (SELECT count(*) FROM links WHERE links.x = d.doc_id) AS n_links, ")
