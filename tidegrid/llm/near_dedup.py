"""MinHash near-dedup on bottom-k sketches from one hash function.

1. Rows with the same word sequence form one class; classes are the nodes.
2. A node's sketch is the ``K`` smallest hashes of its shingles. Every run of
   three neighbouring values of the sketch is an entry of the inverted lists.
   The lists are kept by runs because a list of a single value grows with every
   passage that many documents share. Sets of at most five values also list
   runs of two, sets of one value that value. For two sets of similarity 0.8
   the chance that no run of three is common among the first 64 values of the
   union is below 1e-10; for sets held whole a common run always exists.
3. Nodes are paired with a few centers of the lists they are in: the member
   that shares most lists with others, and members picked by hash, so that the
   same ones recur. Sketches of the union estimate the similarity, the best
   pairs of a node are verified on whole sets and make components.
4. Lists that still hold several components are searched for the links missed,
   block by block inside tasks; a pair is looked at in the first list it shares.
   A first search emits only a spanning forest of what passes the estimate,
   best overlaps first, and of those one pair per two components. A second one
   fetches the whole texts of the members that still have an unresolved
   partner, compares whole sets inside the task, confirms every link on the
   words and joins members on the spot. Neither emits more rows than a block
   has members, and no pair is left out: what is skipped lies inside one
   component already.
5. Components of the verified links by alternating large and small stars.

The links are confirmed on the full sets of shingles as words, not hashes.

Nulls and edges: null and blank texts have an empty set and stand alone; with
fewer words than a shingle has, the whole sequence is the only shingle; a null
``doc_id`` ranks below all others but names a component only if no other id is
in it; rows equal in id and text share their result; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import groupby
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm.common import batches_of_texts, free_worker, fresh_names, id_text, keep_columns, materialize, text_of

WIDTH, PERCENT = 4, 80
K, RUN = 64, 3
#: Lowest percentage the lists are made for, and the chance of a linked pair to fail the estimate.
LEAST_PERCENT, CHANCE = 80, 1e-11
#: Centers of a list, and pairs of a node that are verified in a round.
CENTERS, BEST = 6, 3
#: Members of a list that one task compares with each other at a time, and sketch values it holds as columns.
BLOCK, COLUMNS = 512, 8192
#: Hashes of words that a task keeps.
WORDS_HELD = 250_000
#: Stands for a null doc_id where rows are told apart by id.
NO_ID = -(2**63)


def least_common(percent: int, k: int = K, chance: float = CHANCE) -> int:
    """Values in both sets, of the ``k`` smallest of the union, that let a pair pass.

    Two sets of that similarity have fewer with at most the given chance.
    """
    p, below = percent / 100, 0.0
    for c in range(k + 1):
        below += comb(k, c) * p**c * (1 - p) ** (k - c)
        if below > chance:
            return c
    return k


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str) -> list[bytes]:
    """ASCII lower case, split at ASCII white space."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(words) - width + 1, 1)
    take = min(width, len(words))
    total = np.full(n, take, np.uint64)
    for i in range(take):
        total = (total ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(_mixed(total))


def shingle_set(words: list[bytes], width: int) -> set:
    """The shingles themselves."""
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(width))))


def run_keys(sketch: np.ndarray, n: int) -> np.ndarray:
    """Keys of the inverted lists a sketch of a set of ``n`` shingles is in."""
    if n == 0:
        return np.empty(0, np.int64)
    lengths = [1] if n == 1 else [2] if n == 2 else [2, 3] if n <= 5 else [RUN]
    keys = []
    for length in lengths:
        m = len(sketch) - length + 1
        total = np.full(m, length, np.uint64)
        for i in range(length):
            total = _mixed((total ^ sketch[i:i + m]) * np.uint64(0x9E3779B97F4A7C15))
        keys.append(total)
    return np.concatenate(keys).view(np.int64)


def sketched(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, text_hash, class (digest of the words), n_shingles, sketch for every row."""

    def run(stream):
        free_worker()
        hashes = _WordHashes()
        for batch in stream:
            for part in batches_of_texts([batch]):
                classes, sizes, sketches = [], [], []
                for text in part.column(2).to_pylist():
                    words = words_of(text)
                    found = shingle_hashes(words, width, hashes)
                    classes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    sizes.append(len(found))
                    sketches.append(found[:k].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(sketches, pa.binary())],
                    ["doc_id", "text_hash", "class", "n_shingles", "sketch"])

    rows = id_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, class binary, n_shingles long, sketch binary")


def list_entries(nodes: DataFrame) -> DataFrame:
    """key, node, size: one row per list a node is in."""

    def run(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                keys = [run_keys(np.frombuffer(s, np.uint64), n)
                        for n, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                counts = [len(x) for x in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)),
                     *(pa.array(np.repeat(part.column(i).to_numpy(), counts)) for i in (0, 1))], ["key", "node", "size"])

    return nodes.select("node", "n_shingles", "sketch").mapInArrow(run, "key long, node long, size long")


def union_overlap(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """Of the ``k`` smallest values of the union: how many there are, and how many are in both."""
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return len(union), int(np.searchsorted(both, union[-1], side="right")) if len(union) else 0


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, k: int, least: int, percent: int) -> float | None:
    """Share of the union sketch in both sets, None if too low; exact when both sets are held whole."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return None
    size, both = union_overlap(a, b, k)
    if n_a <= len(a) and n_b <= len(b) and size < k:
        return both / size if 100 * both >= percent * size else None
    return both / size if both >= least * size / k else None


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b, score of the pairs that pass the union-sketch estimate."""
    with_a = pairs.select("a", "b").join(
        nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
    both = with_a.join(nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"),
                                    F.col("sketch").alias("sketch_b")), "b")
    least = least_common(percent)

    def run(stream):
        for batch in stream:
            out = []
            for a, b, n, m, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                score = estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), n, m, K, least, percent)
                if score is not None:
                    out.append((a, b, score))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                ["a", "b", "score"])

    return both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, score double")


def best_of(scored: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` pairs with the highest estimates per key; the filter works inside each task first."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "a", "b")
    return scored.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n).drop("__rank")


def texts_of(needed: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the nodes needed."""
    needed = needed.select("node").distinct().join(nodes.select("node", "rep_id", "rep_hash"), "node")
    rows = id_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.join(
        needed, rows["doc_id"].eqNullSafe(needed["rep_id"]) & (rows["text_hash"] == needed["rep_hash"])
    ).groupBy("node").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough."""
    pairs = pairs.select("a", "b")
    texts = materialize(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, nodes))
    # Sorted by b, the set of a frequent partner is built once per task.
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    ).select("a", "b", "text_a", "text_b")

    def run(stream):
        held, other = None, set()
        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                mask = []
                for b, x, y in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    if b != held:
                        held, other = b, shingle_set(words_of(y), width)
                    own = shingle_set(words_of(x), width)
                    common = len(own & other)
                    mask.append(100 * common >= percent * (len(own) + len(other) - common))
                yield part.filter(pa.array(mask, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of a link (a, b)."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        # Large star: every larger neighbour is hung onto the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small star: the smaller neighbours and the node itself.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialize(moved.select("e.u", "e.v").filter("u <> v").distinct())
        told = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if told == before:
            break
        before = told
    # Now every edge leads to the smallest node of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class _Joined:
    """Union-find over numbers of components."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def join(self, x: int, y: int) -> None:
        self.parent[self.find(x)] = self.find(y)


def _common_counts(values: list[np.ndarray], left: int, second: slice) -> np.ndarray:
    """Common values of the first ``left`` members with those of ``second``; values with one holder are left out."""
    n = len(values)
    _, where, holders = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    several = holders > 1
    used = several[where]
    column = (np.cumsum(several) - 1)[where[used]]
    member = np.repeat(np.arange(n), [len(v) for v in values])[used]
    out = np.zeros((left, second.stop - second.start), np.float32)
    for start in range(0, int(several.sum()), COLUMNS):
        here = (column >= start) & (column < start + COLUMNS)
        held = np.zeros((n, min(COLUMNS, int(several.sum()) - start)), np.float32)
        held[member[here], column[here] - start] = 1
        out += held[:left] @ held[second].T
    return out


def _runs_before(sketch: np.ndarray, size: int, key: int) -> np.ndarray:
    runs = run_keys(sketch, size)
    return runs[:int(np.argmax(runs == key))] if (runs == key).any() else runs


def _candidates(key, comps, sizes, marks, left: int, percent: int, least: int) -> list[tuple[int, int]]:
    """Index pairs of different components that may pass the estimate and share no list before ``key``; best first.

    Pairs are between the first ``left`` members and the rest, or among all if there is no rest. A pair
    is looked at in the first list it shares only.
    """
    n = len(marks)
    if n <= 12:
        sets, early, found = [frozenset(m.tolist()) for m in marks], {}, []

        def before(i):
            if i not in early:
                early[i] = frozenset(_runs_before(marks[i], sizes[i], key).tolist())
            return early[i]

        for i in range(left):
            for j in range(left if left < n else i + 1, n):
                if comps[i] != comps[j] and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    common = len(sets[i] & sets[j])
                    if K * common >= least * max(len(sets[i]), len(sets[j])) and before(i).isdisjoint(before(j)):
                        found.append((-common, i, j))
        return [(i, j) for _, i, j in sorted(found)]
    second = slice(left, n) if left < n else slice(0, n)
    common = _common_counts(marks, left, second)
    lengths, comps, sizes = np.array([len(m) for m in marks]), np.asarray(comps), np.asarray(sizes, float)
    small, large = (f.outer(sizes[:left], sizes[second]) for f in (np.minimum, np.maximum))
    ok = (K * common >= least * np.maximum.outer(lengths[:left], lengths[second])) & (100 * small >= percent * large)
    ok &= comps[:left, None] != comps[None, second]
    if left == n:
        ok &= np.arange(n)[:, None] < np.arange(n)[None]
    if not ok.any():
        return []
    runs = [_runs_before(m, int(s), key) for m, s in zip(marks, sizes)]
    ok &= _common_counts(runs, left, second) == 0
    i, j = np.nonzero(ok)
    order = np.argsort(-common[i, j], kind="stable")
    return list(zip(i[order].tolist(), (j[order] + second.start).tolist()))


#: The group of rows a task compares: list, band of sizes, within it or with the band below, blocks.
GROUP = ["key", "band", "across", "lo", "hi"]


def mixed_members(entries: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """GROUP, second, node, component, size: the members of lists that hold several components.

    A list of up to ``BLOCK`` members is one group. A longer one is cut into bands of sizes, so that a
    pair that can be linked is in one band or in two neighbouring ones, and bands into blocks; a member
    goes to the groups of its block with each block of its own and of the neighbouring bands.
    """
    placed = entries.join(comps, "node", "left").select(
        "key", "node", "size", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"),
                                      F.max("component").alias("high")).filter("low <> high").select("key", "n")
    step = log(100 / percent) if percent < 100 else 1.0
    band = F.when(F.col("n") > BLOCK, F.floor(F.log("size") / step + 1e-9)).otherwise(-1)
    members = placed.join(mixed, "key").withColumn("band", band.cast("int"))
    held = members.filter(F.col("n") > BLOCK).groupBy("key", "band").count()
    blocks = held.groupBy("key").agg(F.map_from_entries(F.collect_list(
        F.struct("band", F.ceil(F.col("count") / BLOCK).cast("int").alias("n")))).alias("blocks"))
    members = members.join(blocks, "key", "left")
    own, below, above = (F.coalesce(F.try_element_at("blocks", F.col("band") + k), F.lit(0 if k else 1)) for k in (0, -1, 1))
    part = F.pmod(F.xxhash64("node"), own).cast("int")
    members = members.select("key", "node", "component", "size", "band", own.alias("own"), below.alias("below"),
                             above.alias("above"), part.alias("part"))

    def each(n, make):
        return F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")),
                           lambda other: F.struct(*[c.alias(name) for c, name in zip(make(other), [*GROUP[1:], "second"])]))

    b, p, yes, no = F.col("band"), F.col("part"), F.lit(True), F.lit(False)
    groups = F.concat(each("own", lambda o: (b, no, F.least(p, o), F.greatest(p, o), p > o)),
                      each("below", lambda o: (b, yes, p, o, no)), each("above", lambda o: (b + 1, yes, o, p, yes)))
    return members.select("key", F.explode(groups).alias("g"), "node", "component", "size").select(
        "key", "g.*", "node", "component", "size")


def in_groups(members: DataFrame) -> DataFrame:
    return members.repartition(*GROUP).sortWithinPartitions(*GROUP, "second", "node")


def _left(group: list[tuple]) -> int:
    """Rows of the group's first block, or all if it has one block only."""
    _, _, across, lo, hi, *_ = group[0]
    return sum(not g[5] for g in group) if across or lo != hi else len(group)


def _by_group(stream, handle):
    """``handle`` the rows of the groups of each batch; a group may go on in the next batch."""
    free_worker()
    waiting = []
    for batch in stream:
        rows = waiting + list(zip(*(c.to_pylist() for c in batch.columns)))
        groups = [list(g) for _, g in groupby(rows, key=lambda r: r[:5])]
        waiting = groups.pop() if groups else []
        yield handle(groups)
    if waiting:
        yield handle([waiting])


def _compared(group: list[tuple], percent: int, least: int):
    """Index pairs that may pass, and the estimate of a pair, for rows of GROUP, second, node, component, size, sketch."""
    comps, sizes = [g[7] for g in group], [g[8] for g in group]
    left = _left(group)
    if len(set(comps)) < 2 or not 0 < left:
        return [], None
    marks = [np.frombuffer(g[9], np.uint64) for g in group]
    return (_candidates(group[0][0], comps, sizes, marks, left, percent, least),
            lambda i, j: estimate(marks[i], marks[j], sizes[i], sizes[j], K, least, percent))


def forest_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that span, in each group, the components which the estimate would join; one of two components."""
    least = least_common(percent)

    def handle(groups):
        out = []
        for group in groups:
            joined = _Joined()
            pairs, score = _compared(group, percent, least)
            for i, j in pairs:
                ci, cj = group[i][7], group[j][7]
                if joined.find(ci) != joined.find(cj) and (s := score(i, j)) is not None:
                    joined.join(ci, cj)
                    out.append((*sorted([ci, cj]), *sorted([group[i][6], group[j][6]]), s))
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.float64())],
            ["first", "other", "a", "b", "score"])

    found = members.mapInArrow(lambda stream: _by_group(stream, handle), "first long, other long, a long, b long, score double")
    best = F.max_by(F.struct("a", "b"), F.struct("score", -F.col("a"), -F.col("b")))
    return found.groupBy("first", "other").agg(best.alias("pair")).select("pair.*")


def open_members(members: DataFrame, percent: int) -> DataFrame:
    """GROUP, second, node, component: the members of a group that still have a partner which passes the estimate."""
    least = least_common(percent)

    def handle(groups):
        out = []
        for group in groups:
            pairs, score = _compared(group, percent, least)
            held = set()
            for i, j in pairs:
                if not (i in held and j in held) and score(i, j) is not None:
                    held |= {i, j}
            out += [group[i][:8] for i in sorted(held)]
        columns = list(zip(*out)) or [()] * 8
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          [*GROUP, "second", "node", "component"])

    schema = "key long, band int, across boolean, lo int, hi int, second boolean, node long, component long"
    return members.mapInArrow(lambda stream: _by_group(stream, handle), schema)


def exact_links(open_rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that span what is linked in each group, compared on whole sets and confirmed on the words."""
    least = least_common(percent)
    rows = in_groups(open_rows.join(texts, "node").select(*GROUP, "second", "node", "component", "text"))

    def links(group):
        joined, hashes = _Joined(), _WordHashes()
        words = lambda i: words_of(group[i][8])
        sets = [shingle_hashes(words(i), width, hashes) for i in range(len(group))]
        sizes, comps = [len(x) for x in sets], [g[7] for g in group]
        pairs = _candidates(group[0][0], comps, sizes, [x[:K] for x in sets], _left(group), percent, least)
        for i, j in pairs:
            if joined.find(comps[i]) == joined.find(comps[j]):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                own, other = (shingle_set(words(x), width) for x in (i, j))
                common = len(own & other)
                if 100 * common >= percent * (len(own) + len(other) - common):
                    joined.join(comps[i], comps[j])
                    yield min(group[i][6], group[j][6]), max(group[i][6], group[j][6])

    def handle(groups):
        found = [p for g in groups for p in links(g)]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(lambda stream: _by_group(stream, handle), "a long, b long")


def center_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of a node and a center of its lists.

    The centers are the member with the largest lists and members picked by a hash of the node. Of
    similar sets about half of the lists are shared; pairs that share fewer than an eighth are left to
    the search of the lists.
    """
    picked = [F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node"))["node"] for i in range(CENTERS - 1)]
    picked.append(F.max_by("node", F.struct("weight", -F.col("node"))))
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"), F.count("*").alias("n_keys"))
    weighted = shared.join(weights, "node")
    centers = weighted.groupBy("key").agg(F.array_distinct(F.array(*picked)).alias("centers"))
    met = weighted.join(centers, "key").select("node", "n_keys", F.explode("centers").alias("b"))
    return met.filter("node <> b").groupBy(F.col("node").alias("a"), "b").agg(
        F.count("*").alias("n"), F.max("n_keys").alias("n_keys")).filter("8 * n >= n_keys").select("a", "b")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component, component_id, kept for every row.

    ``component`` is the number of the group's smallest node, null for an empty set.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"the lists find links of {LEAST_PERCENT} percent and more")
    rows = materialize(sketched(docs, width))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rep")
    nodes = materialize(rows.filter("n_shingles > 0").groupBy("class", "n_shingles", "sketch").agg(first).select(
        F.monotonically_increasing_id().alias("node"), "class", "n_shingles", "sketch",
        F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")))
    entries = list_entries(nodes)
    lists = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(entries.join(lists, "key"))  # key, node, size, n; lists with several members only
    members = shared.select("key", "node", "size")
    scored = materialize(estimated(center_pairs(shared), nodes, percent))
    links = materialize(verified(best_of(scored, ["a"], BEST), docs, nodes, width, percent))

    def mixed(links):
        placed = mixed_members(members, components(links), percent)
        return in_groups(placed.join(nodes.select("node", "sketch"), "node").select(
            *GROUP, "second", "node", "component", "size", "sketch"))

    forest = materialize(forest_pairs(mixed(links), percent))
    links = links.unionByName(materialize(verified(forest, docs, nodes, width, percent)))
    unresolved = materialize(open_members(mixed(links), percent))
    more = exact_links(unresolved, materialize(texts_of(unresolved, docs, nodes)), width, percent)
    labels = components(links.unionByName(more))
    named = nodes.join(labels, "node", "left").select(
        "class", F.coalesce("component", "node").alias("component"), "rep_id")
    smallest = named.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    by_class = named.join(smallest, "component").select("class", "component", "component_id")
    out = rows.drop("sketch").join(by_class, "class", "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "text_hash", "n_shingles", "component",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def near_dedup(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of every group of near duplicates, and every row without words."""
    decided = near_duplicates(docs, width, percent).filter("kept")
    # Rows of a group that repeat its id are one document; the text with the smallest hash stands for it.
    one = decided.groupBy(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce("component", "text_hash").alias("group")
    ).agg(F.min("text_hash").alias("hash")).select("id", "hash").distinct()
    own_id, own_hash = fresh_names(docs, "id", "hash")
    rows = docs.withColumn(own_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(
        own_hash, F.xxhash64(text_of()))
    one = one.select(F.col("id").alias(own_id), F.col("hash").alias(own_hash))
    return keep_columns(docs, rows.join(one, [own_id, own_hash], "left_semi").dropDuplicates([own_id, own_hash]))
