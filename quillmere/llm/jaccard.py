"""Exact Jaccard join of documents' word n-grams by prefix trees.

All n-grams have one order, the rarest first, and a document is the ordered list of its n-grams.  Two documents of a Jaccard
similarity of t share an n-gram among the first n - ceil(t n) + 1 of each, so documents meet in groups, one an n-gram that
several have there.  Within a group the lists are stored in a trie.  A document is looked for in it from the root: what it shares with a
node's n-grams is counted once for all documents below, and a subtree is left where what remains of its longest list, or of the
document, cannot make up what is lacking.

Only components are asked for, so most of the work can be spared.  Groups that have documents in common are a family, found by
ids alone, and a family of bounded size is joined as one group.  In larger ones each document goes first to the most crowded of its groups alone, where a group of near copies becomes one component; then one document of each component goes to each group that still
holds several; at last all documents of the groups that hold several components even then, crowded ones as pairs of blocks.  In each
group the trie is flooded from one document after another: what has been reached is not looked for again.

The order needs the number of documents of each n-gram.  Blocks of rows send the hashes of their n-grams to buckets, many in a row,
and get the numbers back in the same order, as files by scan partition; nothing is broadcast, and the texts do not move.

N-grams are 64-bit hashes of their words; 58 bits of them and a rank of rarity stand in the lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, PLACE_BITS, U64, as_binary, as_bytes, decided, pieces, read_part, release, shingle_hashes, skew_join, stash, tidy, word_hashes, word_spans, write_decisions, write_parts
from .components import components

#: Rows that are counted together, and n-grams that a bucket of hashes holds, about.
BLOCK_ROWS, BUCKET = 1024, 1 << 21
#: Documents of a group that are joined at a time, and rows of groups that one task gets together, about.
MOST, SHARD_ROWS = 2048, 2000
HASH_BITS = 58


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The distinct n-grams of each document, as sorted hashes; no words: none."""
    for x, y in pieces(offsets):
        raw = LOWER[data[offsets[x] : offsets[y]]]
        starts, ends, firsts = word_spans(raw, offsets[x : y + 1] - offsets[x])
        hashes, at = shingle_hashes(word_hashes(raw, starts, ends), firsts, k)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(hashes[a:b])


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """N-grams that sets of n and m must share: 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    """So many of the first n-grams of a set hold one that any set similar to it has among its own first."""
    return n - -(-percent * n // 100) + 1


class Trie:
    """Ordered lists of numbers.  Nodes end at fixed depths (8, 24, 56, ...): a node is a run of lists, in their order, that agree so far."""

    def __init__(self, lists: list[np.ndarray], percent: int) -> None:
        self.percent, self.n = percent, len(lists)
        self.order = np.array(sorted(range(len(lists)), key=lambda i: lists[i].astype(">u4").tobytes()), np.int64)
        lists = [lists[i] for i in self.order.tolist()]
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        common = np.zeros(len(lists), np.int64)  # numbers that a list has in common with the one before
        for i in range(1, len(lists)):
            m = min(len(lists[i - 1]), len(lists[i]))
            differ = lists[i - 1][:m] != lists[i][:m]
            common[i] = int(differ.argmax()) if differ.any() else m
        self.depths, longest = [8], int(self.sizes.max(initial=0))
        while self.depths[-1] < longest:
            self.depths.append(self.depths[-1] * 2 + 8)
        #: By depth: the first list of each node, the node each belongs to one depth before, and least and greatest size below.
        self.nodes, self.ups, self.least, self.most = [], [], [], []
        before = np.zeros(len(lists), np.int64)
        for depth in self.depths:
            new = common < depth
            new[:1] = True
            first = np.flatnonzero(new)
            self.nodes.append(first)
            self.ups.append(before[first])
            self.least.append(np.minimum.reduceat(self.sizes, first))
            self.most.append(np.maximum.reduceat(self.sizes, first))
            before = np.cumsum(new) - 1

    def similar(self, query: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The lists that are similar to ``query`` (sorted), by position in the given order; ``marks`` has a false for every number, and
        has again afterwards."""
        n, percent = len(query), self.percent
        smallest, largest = -(-percent * n // 100), 100 * n // percent
        marks[query] = True
        alive, shared, start = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
        for depth, first, up, least, most in zip(self.depths, self.nodes, self.ups, self.least, self.most, strict=True):
            # the children of what is alive
            place = np.searchsorted(alive, up)
            held = np.flatnonzero((place < len(alive)) & (alive[np.minimum(place, len(alive) - 1)] == up) & (least <= largest) & (most >= smallest))
            if not len(held):
                alive = held
                break
            sofar, lists = shared[place[held]], first[held]
            a = self.at[lists] + np.minimum(start, self.sizes[lists])
            b = self.at[lists] + np.minimum(depth, self.sizes[lists])
            length = b - a
            if length.any():
                which = np.repeat(np.arange(len(held)), length)
                hit = marks[self.flat[np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(a, length)]]
                sofar = sofar + np.bincount(which[hit], minlength=len(held))
            longest, shortest = np.minimum(most[held], largest), np.maximum(least[held], smallest)
            passed = np.searchsorted(query, self.flat[np.maximum(b - 1, 0)], "right")
            able = (sofar + longest - np.minimum(depth, longest) >= needed(n, longest, percent)) & (sofar + np.where(longest > depth, n - passed, 0) >= needed(n, shortest, percent))
            alive, shared, start = held[able], sofar[able], depth
            if not len(alive):
                break
        marks[query] = False
        if not len(alive):
            return np.zeros(0, np.int64)
        # nodes of the last depth are lists that agree to their ends
        last, ends = self.nodes[-1], np.append(self.nodes[-1][1:], self.n)
        good = shared >= needed(n, self.sizes[last[alive]], percent)
        return self.order[np.concatenate([np.zeros(0, np.int64), *(np.arange(last[i], ends[i]) for i in alive[good].tolist())])]


def joined(lists: list[np.ndarray], known: np.ndarray, percent: int) -> np.ndarray:
    """Links (m x 2) of positions that connect what chains of similar ``lists`` (sorted hashes) connect, beyond what is ``known``
    to be of one component; the trie is flooded from one list after another."""
    if len(lists) < 2 or len(np.unique(known)) < 2:
        return np.zeros((0, 2), np.int64)
    names, flat = np.unique(np.concatenate(lists), return_inverse=True)
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    local = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    marks = np.zeros(len(names), bool)
    mates: dict[int, list[int]] = {}
    for i, c in enumerate(known.tolist()):
        mates.setdefault(c, []).append(i)
    left, links = np.ones(len(lists), bool), []
    inside = np.arange(len(lists))  # of the trie
    trie, remaining = Trie(local, percent), len(lists)
    for hub in range(len(lists)):
        if not left[hub]:
            continue
        front = mates[int(known[hub])][:]
        left[front] = False
        remaining -= len(front)
        while front and remaining:
            if remaining * 2 < len(inside):
                inside = np.flatnonzero(left)
                trie = Trie([local[i] for i in inside.tolist()], percent)
            q = front.pop()
            hits = inside[trie.similar(local[q], marks)]
            for i in hits.tolist():
                if left[i]:
                    links.append((q, i))
                    more = mates[int(known[i])]
                    left[more] = False
                    remaining -= len(more)
                    front += more
    return np.array(links, np.int64).reshape(-1, 2)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a scan partition in blocks by their place in it, however they come in batches."""
    held: list[pa.RecordBatch] = []
    now = -1
    for b in batches:
        block = (b.column(0).to_numpy() & ((1 << PLACE_BITS) - 1)) // BLOCK_ROWS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            if held and block[x] != now:
                yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = int(block[x])
            held.append(b.slice(x, y - x))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Chosen:
    """The sets of the rows of a block that stand for all copies of theirs."""

    def __init__(self, folder: str, k: int) -> None:
        self.find, self.k = decided(folder), k

    def of(self, b: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        n, there = self.find(b.column(0).to_numpy(), b.column(1).to_numpy())
        at = np.flatnonzero(there & (n > 0))
        data, offsets = as_bytes(b.column(2).take(pa.array(at)))
        return b.column(0).to_numpy()[at], list(sets_of(data, offsets, self.k))


def _slots(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """The bucket of each hash, in ``bits``, and 32 bits more of it."""
    whole = np.concatenate([np.zeros(0, U64), *sets])
    return whole >> U64(64 - bits - 32)


def rarity(docs: DataFrame, chosen: str, k: int, bits: int) -> str:
    """Write for each scan partition (block, bucket, codes): of the distinct slots of a block, in order, the rank of
    rarity, 0 for those of one document alone.  Returns the folder."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Chosen(chosen, k)
        for block, b in _blocks(batches):
            slots, n = np.unique(_slots(rows.of(b)[1], bits), return_counts=True)
            bucket = (slots >> U64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(slots) else np.zeros(0, np.int64)
            spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(slots)], strict=False))
            low, n = slots.astype("<u4"), np.minimum(n, 65535).astype("<u2")
            part = b.column(0)[0].as_py() >> PLACE_BITS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(cuts), part)), pa.array(np.full(len(cuts), block)), pa.array(bucket[cuts]),
                    pa.array([low[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([n[x:y].tobytes() for x, y in spans], pa.binary()),
                ],
                ["part", "block", "bucket", "slots", "n"],
            )

    def count(t: pa.Table) -> pa.Table:
        slots = [np.frombuffer(x, "<u4") for x in t["slots"].to_pylist()]
        _, which = np.unique(np.concatenate(slots), return_inverse=True)
        total = np.bincount(which, np.frombuffer(b"".join(t["n"].to_pylist()), "<u2"))
        code = np.where(total > 1, np.minimum(np.ceil(2 * np.log2(np.maximum(total, 1))), (1 << (64 - HASH_BITS)) - 1), 0).astype(np.uint8)[which]
        cuts = np.cumsum([0, *map(len, slots)]).tolist()
        out = pa.table({"part": t["part"], "block": t["block"], "bucket": t["bucket"], "codes": pa.array([code[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})
        release()
        return out

    sent = docs.select("row", F.xxhash64("doc_id").alias("key"), as_binary("text")).mapInArrow(tidy(send), "part long, block long, bucket long, slots binary, n binary")
    return write_parts(sent.groupBy("bucket").applyInArrow(count, "part long, block long, bucket long, codes binary"), ["block", "bucket"])


def ordered_sets(docs: DataFrame, chosen: str, codes: str, k: int, bits: int, percent: int) -> DataFrame:
    """(id, n, grams, prefix) of the chosen rows that share one of their first n-grams with another: all their n-grams in order,
    and those of the first that others have."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known, t = _Chosen(chosen, k), None, None
        for block, b in _blocks(batches):
            if known is None:
                t = read_part(codes, b.column(0)[0].as_py() >> PLACE_BITS)
                known = t["block"].to_numpy() if t is not None else np.zeros(0, np.int64)
            ids, sets = rows.of(b)
            x, y = np.searchsorted(known, [block, block + 1])
            code = np.frombuffer(b"".join(t["codes"].slice(x, y - x).to_pylist()), np.uint8) if t is not None else np.zeros(0, np.uint8)
            slots, which = np.unique(_slots(sets, bits), return_inverse=True)
            if len(slots) != len(code):
                raise ValueError("the n-grams are not those that were counted: the table or its split has changed")
            mixed = code[which].astype(U64) << U64(HASH_BITS) | np.concatenate([np.zeros(0, U64), *sets]) >> U64(64 - HASH_BITS)
            at, out = 0, []
            for i, s in zip(ids.tolist(), sets, strict=True):
                grams = np.sort(mixed[at : at + len(s)])
                at += len(s)
                first = grams[: prefix(len(grams), percent)]
                first = first[first >> U64(HASH_BITS) > 0]
                if len(first):
                    out.append((i, len(grams), grams.astype("<u8").tobytes(), first.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                ["id", "n", "grams", "prefix"],
            )

    return docs.select("row", F.xxhash64("doc_id").alias("key"), as_binary("text")).mapInArrow(tidy(each), "id long, n long, grams binary, prefix array<long>")


def _links(rows: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) within each group of ``rows`` (gram, part, id, root), about ``n`` in all; a task gets many small groups."""
    shards = max(32, -(-n // SHARD_ROWS))
    keyed = rows.select(F.pmod(F.xxhash64("gram", "part"), F.lit(shards)).alias("shard"), "gram", "part", "id", "root")

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by([("gram", "ascending"), ("part", "ascending"), ("id", "ascending")])
        gram, part, ids, root = (t[c].to_numpy() for c in ("gram", "part", "id", "root"))
        cuts = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])]))
        found, grams = [np.zeros((0, 2), np.int64)], t["grams"]
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(gram)], strict=True):
            if y - x > 1:
                made = joined([np.frombuffer(g, "<u8") for g in grams.slice(x, y - x).to_pylist()], root[x:y], percent)
                found.append(ids[x:y][made])
        both = np.concatenate(found)
        release()
        return pa.table({"u": both[:, 0], "v": both[:, 1]})

    return keyed.join(sets.select("id", "grams"), "id").groupBy("shard").applyInArrow(join, "u long, v long")


def similar_links(sets: DataFrame, percent: int, most: int = MOST) -> DataFrame:
    """(u, root) of all of ``sets`` (id, n, grams, prefix) that are linked with others: the smallest id of their component."""
    entries = sets.select("id", F.explode("prefix").alias("gram"))
    # n-grams of the same documents (a shared passage has many) are one group: told by the number, the ends and two sums of hashes of the ids
    sums = [F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(38,0)")).alias(f"sum{i}") for i in (0, 1)]
    crowd = entries.groupBy("gram").agg(F.count("*").alias("members"), F.min("id").alias("least"), F.max("id").alias("greatest"), *sums).where("members > 1")
    crowd = crowd.groupBy("members", "least", "greatest", "sum0", "sum1").agg(F.min("gram").alias("gram")).select("gram", "members", F.col("members").alias("size"))
    met = stash(skew_join(entries, crowd, "gram", "size", entries.count()), "met")
    # families: what meets in any group, by ids alone.  One that is small enough is joined as a whole, each set sent once
    stars = met.groupBy("gram").agg(F.min("id").alias("v"))
    families = components(skew_join(met.select("gram", "id", "members"), stars.join(met.groupBy("gram").agg(F.count("*").alias("size")), "gram"), "gram", "size", met.count()).select(F.col("id").alias("u"), "v"))
    sizes = families.groupBy("root").agg(F.count("*").alias("family"))
    families = stash(skew_join(families, sizes.withColumn("size", F.col("family")), "root", "size", families.count()).select(F.col("u").alias("id"), F.col("root").alias("of"), "family"), "families")
    small = families.where(F.col("family") <= most).select(F.col("of").alias("gram"), F.lit(0).cast("long").alias("part"), "id", F.col("id").alias("root"))
    links = stash(_links(small, sets, small.count(), percent), "links")
    crowded = families.where(F.col("family") > most).select("id")
    if crowded.isEmpty():
        return components(links)
    # the others: each in its most crowded group, in parts
    met = stash(met.join(crowded, "id", "left_semi"), "met")
    alone = met.groupBy("id").agg(F.max(F.struct("members", "gram")).alias("at")).select("id", F.col("at.gram").alias("gram"), F.col("at.members").alias("members"))
    alone = alone.select("gram", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / most)).cast("long").alias("part"), "id", F.col("id").alias("root"))
    links = stash(links.unionByName(_links(alone, sets, alone.count(), percent)), "links")

    def mixed() -> tuple[DataFrame, DataFrame]:
        """What is met in groups that hold several components, as (gram, members, id, root), and (u, root)."""
        roots = stash(components(links), "roots")
        now = met.join(roots.withColumnRenamed("u", "id"), "id", "left").select("gram", "members", "id", F.coalesce("root", "id").alias("root"))
        several = now.groupBy("gram").agg(F.min("root").alias("least"), F.max("root").alias("greatest"), F.count("*").alias("of")).where("least < greatest").select("gram", "of")
        return stash(skew_join(now, several, "gram", "of", met.count()), "mixed"), roots

    # one of each component in each group
    now, _ = mixed()
    one = now.groupBy("gram", "root").agg(F.min("id").alias("id"))
    crowds = one.groupBy("gram").agg(F.count("*").alias("roots"))
    one = stash(one.join(crowds, "gram").select("gram", F.pmod(F.xxhash64("root"), F.ceil(F.col("roots") / most)).cast("long").alias("part"), "id", "root"), "one")
    links = stash(links.unionByName(_links(one, sets, one.count(), percent)), "links")
    # all that is left, in blocks of which each pair is joined
    now, _ = mixed()
    half = most // 2
    blocks = F.ceil(F.col("members") / half).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = now.withColumn("blocks", F.when(F.col("members") <= most, 1).otherwise(blocks)).withColumn("mine", mine)
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = stash(pairs.select("gram", (F.least("mine", "other").cast("long") * F.col("blocks") + F.greatest("mine", "other")).alias("part"), "id", "root"), "pairs")
    links = stash(links.unionByName(_links(pairs, sets, pairs.count(), percent)), "links")
    return components(links)


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (row, doc_id, text; other columns are not looked at).

    ``docs`` must be a stored table or one that comes out the same each time, ``row`` numbered by :func:`numbered`.  Rows link
    when their sets of ``k``-word n-grams (the whole sequence of fewer words) have a Jaccard similarity of ``percent`` (1 to 100) hundredths;
    component_id is the smallest doc_id that links reach.  Null and wordless texts have no n-grams and link with nothing: their
    component is their own doc_id.  Rows that repeat are copies; a null doc_id gets its row and the smallest doc_id of its
    component, null if there is none.  Texts of any length are taken whole; an empty table gives an empty one."""
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = as_bytes(b.column(2))
            made = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()) for s in sets_of(data, offsets, k)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], ["row", "doc_id", "n", "copy"])

    prints = stash(docs.select("row", "doc_id", as_binary("text")).mapInArrow(tidy(each), "row long, doc_id long, n long, copy binary"), "prints")
    whole = prints.where("n > 0").groupBy("copy").agg(F.min(F.struct("row", "doc_id")).alias("first"), F.min("doc_id").alias("least"), F.min("n").alias("n"), F.count("*").alias("copies"))
    classes = stash(whole.select(F.col("first.row").alias("id"), "first.doc_id", "least", "copy", "n", "copies"), "classes")
    chosen = write_decisions(classes.select(F.col("id").alias("row"), "doc_id", F.lit(1).alias("n")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = min(31, max(5, (total // BUCKET).bit_length()))
    sets = stash(ordered_sets(docs, chosen, rarity(docs, chosen, k, bits), k, bits, percent), "sets")
    roots = similar_links(sets, percent).withColumnRenamed("u", "id")
    placed = stash(classes.join(roots, "id", "left").select("copy", "least", "copies", F.coalesce("root", "id").alias("root")), "placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = skew_join(placed, named, "root", "members", placed.count()).select("copy", "copies", "component_id")
    linked = skew_join(prints.where("n > 0").select("doc_id", "n", "copy"), named, "copy", "copies", prints.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
