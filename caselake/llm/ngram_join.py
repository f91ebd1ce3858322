"""Jaccard self-join of documents on word n-grams by a prefix tree.

1. Every document's set of n-gram hashes is made in one scan, which keeps its size, a digest of the set and the hashes
   of one residue class (a quarter of them). Documents with equal sets are one class, its smallest id stands for it.
2. A document whose n-grams of that residue class miss all other documents in more places than the threshold allows
   can have no link. This leaves few of the documents that are no near copies, and reads only the kept quarter.
3. The rest are shingled again whole. N-grams are ordered by how many of these documents hold them, rarest first; two
   linked documents share one of the first floor((1-t) n) + 1, and documents that share one fall into one bucket
   (connected components of that relation, stars around each n-gram's smallest id, so rows stay linear).
4. A bucket goes to one task, which makes it a prefix tree of sets in descending order of frequency; each set runs
   down the tree, sharing the partial overlaps of common prefixes, and subtrees are cut by size and remaining-length
   bounds. A pair whose ends are connected already is not verified; the links found span the components. A bucket of
   more than BLOCK sets or TOKENS n-grams is compared by the n-grams that make it one (common.links_by_key), each
   n-gram's sets against one of them first, and then as trees of those that are not connected yet.
5. Components of those links, over classes, give each document its component.

Defined cases: a null, empty or blank text has no n-grams and is a component of its own; fewer than n words are one
n-gram; ties break by the smaller id; rows are told apart by their place, so rows that repeat an id with other texts
each have the links of their own text; rows with a null id are linked like others, a component of nothing but such
rows has the id null. Sets are equal when their 128-bit digests are. Very long texts need memory in proportion to one
text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import classes_within, components, links_by_key, map_arrow, placed, scratch, stage
from .shingles import Shingler

PART, BLOCK, TOKENS = 4, 2000, 8_000_000


class PrefixTree:
    """Radix tree over bit masks of ranked n-grams. sets: int arrays of ranks, ascending; sizes: sizes of whole sets
    (n-grams that no other set here holds are left out of `sets`)."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], percent: int):
        self.percent, self.sizes = percent, sizes
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.root = self._node(sets, order, 0)

    @staticmethod
    def mask(ranks: np.ndarray) -> int:
        if not len(ranks):
            return 0
        bits = np.zeros(int(ranks[-1]) + 1, np.uint8)
        bits[ranks] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def _node(self, sets: list, order: list[int], depth: int) -> tuple:
        """(mask of the edge, sets that end here, children, smallest size, largest size, most n-grams below)."""
        root, work = [0, [], [], 0, 0, 0], []
        work.append((root, order, depth))
        while work:
            node, members, depth = work.pop()
            first, last = sets[members[0]], sets[members[-1]]
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:n] != last[depth:n])
            common = depth + int(differ[0]) if len(differ) else n
            node[0] = self.mask(first[depth:common])
            node[3], node[4] = min(self.sizes[i] for i in members), max(self.sizes[i] for i in members)
            node[5] = max(len(sets[i]) for i in members) - common
            run: list[int] = []
            for i in members:
                if len(sets[i]) == common:
                    node[1].append(i)
                elif run and sets[run[-1]][common] != sets[i][common]:
                    node[2].append([0, [], [], 0, 0, 0])
                    work.append((node[2][-1], run, common))
                    run = [i]
                else:
                    run.append(i)
            if run:
                node[2].append([0, [], [], 0, 0, 0])
                work.append((node[2][-1], run, common))
        return root

    def links(self, mask: int, size: int, skip) -> Iterator[int]:
        """Sets whose Jaccard similarity with the probe is percent / 100 or more; skip(i): need not be looked at."""
        t, work = self.percent, [(self.root, 0)]
        while work:
            node, shared = work.pop()
            if node[3] * t > 100 * size or node[4] * 100 < t * size:
                continue
            shared += (mask & node[0]).bit_count()
            if (shared + node[5]) * (100 + t) < t * (size + node[3]):
                continue
            for i in node[1]:
                if shared * (100 + t) >= t * (size + self.sizes[i]) and not skip(i):
                    yield i
            for child in node[2]:
                work.append((child, shared))


def spanning_links(ids: list[int], sets: list[np.ndarray], percent: int, groups: list[int] | None = None, left: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the sets' similarity graph; groups: sets of one are connected already; left:
    only links from a left to a right set."""
    flat = np.concatenate(sets)
    values, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -count))] = np.arange(len(values))
    cut = np.split(inverse, np.cumsum([len(s) for s in sets])[:-1])
    held = [np.sort(rank[c[count[c] > 1]]) for c in cut]
    sizes = [len(s) for s in sets]
    parent, heads = list(range(len(sets))), {}
    for i, g in enumerate(groups or ()):
        parent[i] = heads.setdefault(g, i)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    into = [i for i in range(len(sets)) if left is None or left[i]]
    if not into:
        return []
    tree = PrefixTree([held[i] for i in into], [sizes[i] for i in into], percent)
    out = []
    for x in range(len(sets)):
        if left is not None and left[x]:
            continue
        for k in tree.links(PrefixTree.mask(held[x]), sizes[x], lambda k, x=x: find(into[k]) == find(x)):
            y = into[k]
            if find(y) != find(x):
                parent[find(y)] = find(x)
                out.append((ids[x], ids[y]))
    return out


def star_links(ids: list[int], sets: list[np.ndarray], head: int, percent: int) -> list[tuple[int, int]]:
    """Links of one set with the others."""
    shared = (len(np.intersect1d(sets[head], s, assume_unique=True)) for s in sets)
    return [(ids[head], ids[i]) for i, k in enumerate(shared) if i != head and 100 * k >= percent * (len(sets[head]) + len(sets[i]) - k)]


def set_rows(sets: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string())


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """docs(file, place, id, t1, t2, text) -> the same with n, digest and part (the hashes that are 0 modulo PART) for text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for b in batches:
            sets = make.sets(b.column(5).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([len(s) for s in sets], pa.int64()), digests(sets), set_rows([s[s % PART == 0] for s in sets])], ["file", "place", "id", "t1", "t2", "n", "digest", "part"])

    return map_arrow(docs, run, "file long, place long, id long, t1 long, t2 long, n long, digest string, part array<long>")


def whole_sets(texts: DataFrame, words: int) -> DataFrame:
    """texts(text) -> digest, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for b in batches:
            sets = make.sets(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([digests(sets), set_rows(sets)], ["digest", "tokens"])

    return map_arrow(texts, run, "digest string, tokens array<long>")


def shared_tokens(rows: DataFrame, name: str) -> DataFrame:
    """rows(id, token) -> token, df of the tokens that two ids or more hold."""
    return stage(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), name)


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """ids of the sets that step 2 leaves."""
    rows = reps.select("id", F.explode("part").alias("token"))
    shared = shared_tokens(rows, "shared-part")
    held = rows.join(shared.hint("merge"), "token").groupBy("id").agg(F.count("*").alias("held"))
    missed = F.size("part") - F.coalesce("held", F.lit(0))
    return reps.join(held, "id", "left").where(missed * 100 <= F.col("n") * (100 - percent)).select("id")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """sets(id, tokens) -> id, key: of each set its rarest n-grams, so many that linked sets share one."""
    rows = sets.select("id", F.explode("tokens").alias("token"))
    shared = shared_tokens(rows, "shared-tokens")
    held = rows.join(shared.hint("merge"), "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    n = F.size("tokens")
    first = F.floor(n * (100 - percent) / 100).cast("int") + 1 - (n - F.size("held"))
    return stage(sets.join(held, "id").where(first > 0).select("id", F.explode(F.slice("held", 1, first)).alias("t")).select("id", F.col("t.token").alias("key")), "prefix")


def buckets(prefix: DataFrame) -> DataFrame:
    """id, component: sets that may be linked directly or over others share a bucket."""
    least = stage(prefix.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("k")).where("k > 1"), "least")
    return components(prefix.join(least.hint("merge"), "key").select(F.col("id").alias("a"), F.col("least").alias("b")), "buckets")


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """sets(id, tokens) -> id, component of the sets that have links."""
    prefix = prefixes(sets, percent)
    dealt = buckets(prefix)
    rows = stage(sets.join(dealt.hint("merge"), "id"), "bucket-sets")
    large = stage(rows.groupBy("component").agg(F.count("*").alias("k"), F.sum(F.size("tokens").cast("long")).alias("n")).where((F.col("k") > BLOCK) | (F.col("n") > TOKENS) & (F.col("k") > 2)).select("component"), "large-buckets")

    def unpack(t: pa.Table) -> tuple[list[int], list[np.ndarray]]:
        tokens = t.column("tokens").combine_chunks()
        return t.column("id").to_pylist(), [x.values.to_numpy() for x in tokens] if len(tokens) < 2 else np.split(tokens.flatten().to_numpy(), np.cumsum(tokens.value_lengths().to_numpy())[:-1])

    def link(t: pa.Table, groups: list[int] | None, left: list[bool] | None) -> list[tuple[int, int]]:
        return spanning_links(*unpack(t), percent, groups, left)

    def star(t: pa.Table, head: int) -> list[tuple[int, int]]:
        return star_links(*unpack(t), head, percent)

    found = classes_within(rows.join(large.hint("merge"), "component", "left_anti"), link)
    over = stage(rows.join(large.hint("merge"), "component", "left_semi").select("id", "tokens"), "large-sets")
    if not over.isEmpty():
        near = links_by_key(prefix.join(over.select("id").hint("merge"), "id", "left_semi"), over, star, link, BLOCK, "sets")
        found = found.union(components(near, "linked"))
    return stage(found, "linked-sets")


def grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """docs(file, place, id, text) -> file, place, id, n, class_id, component, group: one row each. group numbers the
    component, class_id and component are the smallest ids of its class of equal sets and of it; rows without words have
    their own id and no group."""
    with scratch(docs.sparkSession):
        text = F.coalesce("text", F.lit(""))
        docs = docs.select("file", "place", "id", F.xxhash64(text).alias("t1"), F.crc32(text.cast("binary")).alias("t2"), "text")
        made = stage(sets_of(docs, words), "shingles")
        kinds = made.where("n > 0").groupBy("digest").agg(F.min("id").alias("class_id"), F.min(F.struct("t1", "t2")).alias("t"), F.first("n").alias("n"), F.first("part").alias("part"))
        reps = stage(kinds.withColumn("id", F.monotonically_increasing_id()), "reps")
        wanted = stage(reps.join(candidates(reps, percent).hint("merge"), "id", "left_semi").select("id", "digest", "t.t1", "t.t2"), "wanted")
        once = docs.select("t1", "t2", "text").dropDuplicates(["t1", "t2"])  # before the shuffle, so that no text is hot
        texts = once.join(wanted.select("t1", "t2").hint("shuffle_hash"), ["t1", "t2"], "left_semi").select("text")
        sets = stage(whole_sets(texts, words).join(wanted.select("id", "digest").hint("merge"), "digest").select("id", "tokens"), "sets")
        found = linked_sets(sets, percent)
        known = stage(reps.select("id", "digest", "class_id").join(found.hint("merge"), "id", "left").select("digest", "class_id", F.coalesce("component", "id").alias("group")), "groups")
        least = known.groupBy("group").agg(F.min("class_id").alias("component"))
        known = stage(known.join(least.hint("merge"), "group"), "known")
        joined = made.select("file", "place", "id", "n", "digest").join(known.hint("merge"), "digest", "left")
        own = F.col("n") == 0
        return stage(joined.select("file", "place", "id", "n", F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.col("id")).otherwise(F.col("component")).alias("component"), "group"), "jaccard-groups", keep=True)


def rows_of(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    rows = placed(df)
    return rows, rows.select(F.col("__file").alias("file"), F.col("__place").alias("place"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id, n (set size), class_id (smallest id with an equal set), component, one per row."""
    return grouped(rows_of(df, id_col, text_col)[1], words, percent).select("id", "n", "class_id", "component")


def firsts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """df's rows but those that have an earlier one in their component: smaller id, then place; null ids come last."""
    with scratch(df.sparkSession):
        rows, docs = rows_of(df, id_col, text_col)
        found = grouped(docs, words, percent).where("group is not null")
        heads = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "file", "place")).alias("head"), F.count("*").alias("k")).where("k > 1").drop("k")
        gone = found.join(heads.hint("merge"), "group").where("file <> head.file or place <> head.place")
        gone = stage(gone.select(F.col("file").alias("__f"), F.col("place").alias("__p")), "near-copies", keep=True)
    return rows.join(gone.hint("shuffle_hash"), (F.col("__file") == F.col("__f")) & (F.col("__place") == F.col("__p")), "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
