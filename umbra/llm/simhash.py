"""SimHash near-duplicates: fingerprints, and a binary-trie self-join that finds all pairs within a few differing bits.

The trie of fingerprints joins with itself: pairs of nodes go down together, the bits in which they differ add up, and a pair
is given up once they exceed the budget. Of 64 bits in four blocks, two fingerprints that differ in three bits or fewer agree
in one block; so four tries, each led by another block, are cut at that block's nodes, and each subtree joins with itself in
a task of its own. A subtree too large for one task is dealt into salted parts, and each pair of parts is a task.

Documents with one fingerprint count as one in all this. A task returns not every pair but a spanning forest of its links,
so a dense group of m fingerprints gives m - 1 rows; components over all tasks come from repeated joins and grouping.

`dedupe` keeps one document of each group whose members are alike: texts linked by sets of five-word shingles of which they
share 0.8 or more. Such a pair differs in ten of 64 fingerprint bits on average, far more than a trie can prune by, so the trie
only proposes the nearer ones; the others are proposed by keys made of least hashes (24 keys of four; two sets that share 0.8
agree in one of them but for 3 cases in a million). Every proposal is held against the exact sets. What a group of equal keys
still holds of different components is compared in salted parts, each in a task, all against all; so no candidate is left out.

Null and empty texts and texts without words have fingerprint zero, linked like any other. Equal rows each get a result. Very long texts are read
whole. Empty tables give empty tables. Fingerprints read the id and the text only; `dedupe` returns all columns as they were, and adds one of
its own, `__key`, on the way, which must not be there before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import release, small_batches, written

SEED = 42
WORDS = 3
BUDGET = 3
BLOCK = 16
#: Fingerprints of one subtree that a single task joins; more are dealt into parts of about this size.
PART = 100_000
#: Node pairs that a task holds at a time.
FRONTIER = 1_000_000
#: Near-duplicates of `dedupe`: words of a shingle, least share of shingles as a fraction, and the trie's budget for proposals.
WIDE_WORDS, ALIKE, WIDE_BUDGET = 5, (4, 5), 3
#: Keys of least hashes, and hashes in a key.
KEYS, KEY_ROWS = 24, 4
#: Classes of one group in a part, and shingles that a task lays out at a time.
GROUP_PART, COLUMNS = 400, 8192


def shingles(text: str | None, words: int) -> np.ndarray:
    """The XXH64 (seed 42) of all runs of `words` words, repeats included; of the whole sequence, if it has fewer."""
    # bytes.lower() changes A-Z only, bytes.split() cuts at \x20 and \x09-\x0D only.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes)
    starts, stops = (ends - sizes)[:n], (ends - 1)[min(words, len(parts)) - 1 :]
    one, out = xxhash.xxh64_intdigest, np.empty(n, np.uint64)
    for lo in range(0, n, 65536):
        out[lo : lo + 65536] = [one(joined[a:b], SEED) for a, b in zip(starts[lo : lo + 65536].tolist(), stops[lo : lo + 65536].tolist(), strict=True)]
    return out


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[lo : lo + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    return majority(shingles(text, words))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, fp): one row a document, fp the 64 bits as a signed long."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text_hash": b["text_hash"], "fp": np.array([_signed(fingerprint(t)) for t in b["text"]], np.int64)})

    read = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return small_batches(read).mapInPandas(each, "id bigint, text_hash bigint, fp bigint")


class _Forest:
    """Union-find over 0..n-1 by arrays; the root of a set is its smallest member."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            a, b, lo, hi = a[differ], b[differ], np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
            np.minimum.at(self.root, hi, lo)
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def trie_links(keys: np.ndarray, group: np.ndarray, budget: int = BUDGET, frontier: int = FRONTIER) -> np.ndarray:
    """A spanning forest of the links within each group: an array whose entry i is the first member linked with i.

    keys: uint64, distinct within a group. group: ids, ascending; keys ascend within a group.
    Nodes are ranges of the sorted keys; a node's children come from running counts of ones in the next bit.
    """
    n = len(keys)
    forest = _Forest(n)
    if n < 2:
        return forest.root
    counts = [None] * 64

    def zeros_end(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        if counts[depth] is None:
            bit = (keys >> np.uint64(63 - depth)) & np.uint64(1)
            counts[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
        c = counts[depth]
        return hi - (c[hi] - c[lo])

    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    lo, hi = edges, np.concatenate((edges[1:], [n]))
    big = hi - lo > 1
    # Of each entry: depth and the arrays a_lo, a_hi, b_lo, b_hi, differing bits so far.
    stack = [(0, lo[big], hi[big], lo[big], hi[big], np.zeros(int(big.sum()), np.int64))]
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if not len(al):
            continue
        if len(al) > frontier:
            for k in reversed(range(0, len(al), frontier)):
                stack.append((depth, *(x[k : k + frontier] for x in (al, ah, bl, bh, err))))
            continue
        # Nodes all of whose members are linked already need no more.
        change = np.concatenate(([0], np.cumsum(forest.root[1:] != forest.root[:-1])))
        done = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (forest.root[al] == forest.root[bl])
        al, ah, bl, bh, err = (x[~done] for x in (al, ah, bl, bh, err))
        # What remains of the budget covers all remaining bits: everything below links.
        sure = err + (64 - depth) <= budget
        single = (ah - al == 1) & (bh - bl == 1) & ~sure
        if single.any():
            x, y = al[single], bl[single]
            near = np.bitwise_count(keys[x] ^ keys[y]) <= budget
            forest.link(x[near], y[near])
        if sure.any():
            for lo_, hi_ in ((al[sure], ah[sure]), (bl[sure], bh[sure])):
                size = hi_ - lo_
                member = np.arange(size.sum()) + np.repeat(lo_ - (np.cumsum(size) - size), size)
                forest.link(np.repeat(al[sure], size), member)
        open_ = ~single & ~sure
        al, ah, bl, bh, err = (x[open_] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        am, bm, own = zeros_end(al, ah, depth), zeros_end(bl, bh, depth), al == bl
        same = [np.concatenate(p) for p in ((al, am), (am, ah), (bl, bm), (bm, bh), (err, err))]
        cross_own = np.flatnonzero(~own)
        cross = [np.concatenate(p) for p in ((al, am[cross_own]), (am, ah[cross_own]), (bm, bl[cross_own]), (bh, bm[cross_own]), (err + 1, err[cross_own] + 1))]
        for part in (cross, same):  # the nearer ones are popped first
            a1, a2, b1, b2, e = part
            ok = (a2 > a1) & (b2 > b1) & (e <= budget) & ~((a1 == b1) & (a2 - a1 == 1))
            stack.append((depth + 1, a1[ok], a2[ok], b1[ok], b2[ok], e[ok]))
    return forest.root


def links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp`, enough of them to connect all that are connected; a < b unsigned.

    A budget of more than three bits is refused: four blocks wouldn't find all its pairs.
    """
    if not 0 <= budget < 64 // BLOCK:
        raise ValueError(f"a budget of 0 to {64 // BLOCK - 1} bits")
    turned = [F.expr(f"shiftleft(fp, {BLOCK * i}) | shiftrightunsigned(fp, {64 - BLOCK * i})") if i else F.col("fp") for i in range(64 // BLOCK)]
    led = prints.select(F.posexplode(F.array(*turned)).alias("trie", "key")).withColumn("node", F.shiftrightunsigned("key", 64 - BLOCK))
    sizes = led.groupBy("trie", "node").count().where(F.col("count") > 1).withColumn("parts", F.ceil(F.col("count") / PART).cast("int")).drop("count")
    # A node alone in its subtree has no partner there. Large subtrees: part i of p goes to the pairs of parts with i.
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    tasks = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j"))))
    dealt = led.join(sizes, ["trie", "node"]).select("trie", "node", "key", F.explode(tasks).alias("task")).select("trie", "node", "task.i", "task.j", "key")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(b: pd.DataFrame) -> pd.DataFrame:
            keys = b["key"].to_numpy().view(np.uint64)
            head = b[["trie", "node", "i", "j"]].to_numpy()
            group = np.concatenate(([0], np.cumsum((head[1:] != head[:-1]).any(axis=1))))
            order = np.lexsort((keys, group))
            keys, trie = keys[order], head[order, 0].astype(np.uint64)
            root = trie_links(keys, group[order], budget)
            hit = np.flatnonzero(root != np.arange(len(keys)))
            back = lambda at: (keys[at] >> (s := trie[at] * np.uint64(BLOCK))) | np.where(s > 0, keys[at] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
            x, y = back(hit), back(root[hit])
            return pd.DataFrame({"a": np.minimum(x, y).view(np.int64), "b": np.maximum(x, y).view(np.int64)})

        # Whole subtrees together, as many as fit PART; the rows come sorted.
        held: list[pd.DataFrame] = []
        rows = 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            rows += len(b)
            if rows >= PART:
                now = pd.concat(held, ignore_index=True)
                head = now[["trie", "node", "i", "j"]].to_numpy()
                last = np.flatnonzero((head != head[-1]).any(axis=1))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield work(now.iloc[:cut])
                held, rows = [now.iloc[cut:]], len(now) - cut
        if held:
            yield work(pd.concat(held, ignore_index=True))

    by = ["trie", "node", "i", "j"]
    found = dealt.repartition(*by).sortWithinPartitions(*by).mapInPandas(join, "a bigint, b bigint")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of `edges` (a, b: long) reaches; nodes with a smaller one only.

    Alternates two steps until the edges stay: each node's larger neighbours move to its smallest one (large star), then each
    node's smaller ones do (small star). Every round is a grouping and a join over a written table, nothing goes to the driver.
    """
    # Signed order throughout: any total order gives the same components.
    own: list[str] = []
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links", own)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join below reads two plain tables and a hub's edges can be split over tasks.
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", own)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_min.select("u", F.col("m").alias("v")))
        last, own = own, []
        now = written(moved.where("u <> v").distinct(), "links", own)
        release(last)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = state


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp, component_id, head): the component's smallest id, and its first row by (id, text_hash), a null id last."""
    marked = written(fingerprints(docs, id_col, text_col), "prints")
    row = F.struct(F.col("id").isNull().alias("void"), "id", "text_hash")
    heads = written(marked.groupBy("fp").agg(F.min(row).alias("head")), "heads")
    comps = components(links(heads.select("fp")))
    owned = heads.join(comps, heads["fp"] == comps["node"], "left").select("fp", F.coalesce("comp", "fp").alias("comp"), "head")
    lowest = owned.groupBy("comp").agg(F.min("head").alias("head"))
    named = owned.drop("head").join(lowest, "comp").select("fp", "head")
    return marked.join(named, "fp").select("id", "text_hash", "fp", F.col("head.id").alias("component_id"), "head")


def sketch(text: str | None) -> tuple[int, int, int, list[int]]:
    """Of a text's distinct five-word shingles: a hash of all of them, how many, their fingerprint, and the keys of least hashes."""
    hashes = shingles(text, WIDE_WORDS)
    distinct = np.unique(hashes)
    least = np.full(KEYS * KEY_ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(distinct), 4096):
        least = np.minimum(least, ((distinct[lo : lo + 4096, None] ^ _XORS) * _ODDS).min(axis=0))
    key = np.zeros(KEYS, np.uint64)
    for part in least.reshape(KEYS, KEY_ROWS).T:
        key = (key ^ part) * _ODDS[0]
        key ^= key >> np.uint64(29)
    return _signed(xxhash.xxh64_intdigest(distinct.tobytes())), len(distinct), _signed(majority(hashes)), key.view(np.int64).tolist() if len(distinct) else []


_XORS, _ODDS = (np.random.default_rng(k).integers(0, 1 << 63, KEYS * KEY_ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for k in (SEED, SEED + 1))


def alike(both: Column | np.ndarray, sizes: Column | np.ndarray) -> Column | np.ndarray:
    """Whether sets of these sizes, added up, share ALIKE of their union, `both` being in both."""
    p, q = ALIKE
    return (p + q) * both >= p * sizes


def alike_links(sets: list[np.ndarray], comps: np.ndarray) -> np.ndarray:
    """A spanning forest of the links between sets of different components: entry i is the first set linked with set i."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    owner, (value, at, times) = np.repeat(np.arange(m), sizes), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[at] > 1)
    number = np.cumsum(times > 1) - 1
    order = shared[np.argsort(at[shared], kind="stable")]
    who, what = owner[order], number[at[order]]
    both = np.zeros((m, m), np.float32)
    for lo in range(0, int((times > 1).sum()), COLUMNS):
        x, y = np.searchsorted(what, [lo, lo + COLUMNS])
        has = np.zeros((m, COLUMNS), np.float32)
        has[who[x:y], what[x:y] - lo] = 1
        both += has @ has.T
    near = alike(both.astype(np.int64), sizes[:, None] + sizes[None, :]) & (comps[:, None] != comps[None, :])
    forest = _Forest(m)
    forest.link(*np.nonzero(np.triu(near, 1)))
    return forest.root


def _sets(docs: DataFrame, key: Column, text_col: str, classes: DataFrame) -> DataFrame:
    """(cls, set): the distinct shingles of one document of each class in `classes` (cls, key)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cls": b["cls"], "set": [np.unique(shingles(t, WIDE_WORDS)).view(np.int64) for t in b["text"]]})

    texts = docs.select(key.alias("key"), F.col(text_col).alias("text")).join(classes, "key").select("cls", "text")
    return small_batches(texts).mapInPandas(each, "cls bigint, set array<bigint>")


def _compared(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between classes of different components in one group. groups: (group, parts, cls, comp)."""
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j")))
    dealt = groups.select("group", "cls", "comp", F.explode(tasks).alias("task")).select("group", "task.i", "task.j", "cls", "comp").join(sets, "cls")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(b: pd.DataFrame) -> pd.DataFrame:
            b = b.drop_duplicates("cls")
            ids = b["cls"].to_numpy()
            root = alike_links(list(b["set"]), b["comp"].to_numpy())
            hit = np.flatnonzero(root != np.arange(len(ids)))
            return pd.DataFrame({"a": ids[hit], "b": ids[root[hit]]})

        held: list[pd.DataFrame] = []
        for b in batches:
            for _, one in b.groupby(["group", "i", "j"], sort=False):
                if held and (held[0][["group", "i", "j"]].iloc[0] != one[["group", "i", "j"]].iloc[0]).any():
                    yield work(pd.concat(held, ignore_index=True))
                    held = []
                held.append(one)
        if held:
            yield work(pd.concat(held, ignore_index=True))

    by = ["group", "i", "j"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInPandas(compare, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, head): of each document the hash of its id and text, and the first one of its group, by id, then text, a null id last."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    read = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), key.alias("key"), F.col(text_col).alias("text"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [sketch(t) for t in b.pop("text")]
            for k, c in enumerate(("cls", "n", "fp")):
                b[c] = np.array([x[k] for x in done], np.int64)
            b["keys"] = [x[3] for x in done]
            yield b

    marked = written(small_batches(read).mapInPandas(each, "id bigint, text_hash bigint, key bigint, cls bigint, n bigint, fp bigint, keys array<bigint>"), "sketches")
    row = F.struct(F.col("id").isNull().alias("void"), "id", "text_hash", "key")
    # Texts of one set of shingles are one class from here on.
    classes = written(marked.groupBy("cls").agg(F.min(row).alias("head"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "classes")
    led = classes.select("cls", F.posexplode("keys").alias("no", "key"))
    groups = led.groupBy("no", "key").agg(F.min("cls").alias("first"), F.count("*").alias("size")).where("size > 1")
    members = written(led.join(groups, ["no", "key"]).select("no", "key", "cls", "first", "size"), "members")
    # Proposals of the trie, by fingerprints, and of the keys: each class goes with the least first one of all its groups.
    prints = classes.groupBy("fp").agg(F.min("cls").alias("a"))
    own = classes.join(prints, "fp").where("cls <> a").select("a", F.col("cls").alias("b"))
    far = links(prints.select("fp"), WIDE_BUDGET).alias("l")
    near = far.join(prints.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = members.groupBy("cls").agg(F.min("first").alias("a")).where("a <> cls").select("a", F.col("cls").alias("b"))
    count = classes.select("cls", "n")
    proposed = own.unionByName(near).unionByName(first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sized = proposed.join(count.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a").join(count.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b")
    pairs = written(sized.where(alike(F.least("na", "nb"), F.col("na") + F.col("nb"))).select("a", "b"), "pairs")
    needed = members.select("cls").unionByName(pairs.select(F.col("a").alias("cls"))).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = written(_sets(docs, key, text_col, classes.join(needed, "cls").select("cls", F.col("head.key").alias("key")).distinct()).dropDuplicates(["cls"]), "sets")
    held = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
    sure = written(held.where(alike(F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y"))).select("a", "b"), "sure")
    comps = components(sure)
    # Groups that still hold several components; of groups with the same members, one.
    placed = members.join(comps, members["cls"] == comps["node"], "left").select("no", "key", "cls", F.coalesce("comp", "cls").alias("comp"))
    mixed = placed.groupBy("no", "key").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.bit_xor(F.xxhash64("cls")).alias("s"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("t")).where("low <> high")
    chosen = mixed.groupBy("size", "s", "t").agg(F.min(F.struct("no", "key")).alias("g")).select("g.*", F.ceil(F.col("size") / GROUP_PART).cast("int").alias("parts"))
    open_groups = placed.join(chosen, ["no", "key"]).select(F.xxhash64("no", "key").alias("group"), "parts", "cls", "comp")
    found = written(_compared(open_groups, sets), "found")
    whole = components(sure.unionByName(found)) if not found.isEmpty() else comps
    owned = classes.join(whole, classes["cls"] == whole["node"], "left").select("cls", F.coalesce("comp", "cls").alias("comp"), "head")
    lowest = owned.groupBy("comp").agg(F.min("head").alias("head"))
    done = written(marked.select("cls", "key").join(owned.select("cls", "comp").join(lowest, "comp"), "cls").select("key", F.col("head.key").alias("head")), "groups")
    return done


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; of equal rows, one. Columns as they were."""
    groups = near_groups(docs, id_col, text_col)
    gone = groups.where("key <> head").select(F.col("key").alias("__key")).distinct()
    again = groups.where("key = head").groupBy(F.col("key").alias("__key")).count().where("count > 1").select("__key")
    marked = docs.withColumn("__key", F.xxhash64(id_col, text_col))
    single = marked.join(gone.unionByName(again), "__key", "left_anti")
    repeated = marked.join(again, "__key", "left_semi").dropDuplicates(["__key"])
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    found = grouped(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
