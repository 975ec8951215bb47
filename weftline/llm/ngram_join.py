"""Operator 2: documents whose word n-gram sets have a Jaccard similarity of at least t, joined by prefix trees.

1. One pass over the texts hashes every document's n-gram set and sends each n-gram to its hash range. A batch
   sends an n-gram twice at most: the rest of a frequent one is known to be shared there and then, and is dealt
   out evenly, so no hot n-gram gathers in a task. The ranges say which n-grams occur in two sets or more, and how often.
2. A set can only link when ceil(t * size) of its n-grams are shared, so most sets end here (nothing is lost:
   the others have too many n-grams of their own for any link).
3. The rest meet at the n-grams of their prefix, in one order of all n-grams: rarest first, those of one set alone at the
   very front, of equally rare ones by hash. So a passage that many texts share comes last and is in few prefixes. Of two sets that link the
   smaller one has a common n-gram in a shorter prefix yet, which looks for overlaps of 2t / (1 + t) of it: a set beyond
   that prefix only looks for smaller ones within theirs, and where all are beyond it nothing is compared. Sets that
   meet are compared by size and by folded parity bitmaps, whose distance never exceeds the sets' difference.
   Only a spanning forest of what may link leaves a meeting place, so no group is expanded into its pairs.
4. Each candidate component is stored in a radix trie, frequent n-grams first. Every set walks it once: sets below a
   node share the overlap so far, and a subtree is left as soon as its remaining lengths cannot reach the bound.
   Overlaps are counted over all n-grams, told apart by 56 bits of their hashes. A set that is linked leaves the trie, so a family of copies is walked about once.
5. Connected components over the links found.

Groups too large for a task (of a meeting place or a component) are cut into blocks. Blocks are connected inside, then
one set of each component meets those of other blocks; only sets that are still apart are compared block by block, and
blocks of sets beyond the shorter prefix only with blocks within it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import components, prepared, table, text_bytes
from weftline.llm.kernels import shingle_sets

#: Bytes of text whose n-grams one hash range gets, about 2 million n-grams.
RANGE_BYTES = 12 << 20
#: Sets of a block; two blocks are compared or walked at once.
BLOCK = 2000
#: A table of so many large groups, or of components of theirs, may be broadcast (60 bytes each).
MOST_BROADCAST = 200_000
#: Bits of a bitmap at most; larger sets are told apart by fewer bits than n-grams.
MOST_BITS = 2048

#: Bytes of an n-gram's hash that leave a task: the high ones. Two n-grams of a pair of sets of 400 are taken for one with a
#: chance of 2e-12.
HASH_BYTES = 7


def _need(size: int, percent: int) -> int:
    """The least overlap of any set with one of this size for a link."""
    return (size * percent + 99) // 100


def _bitmap(tokens: np.ndarray, size: int) -> np.ndarray:
    """Parity of the n-grams by bit; as many bits as the power of two above the set's size, so that bitmaps fold."""
    bits = max(256, min(1 << int(size).bit_length(), MOST_BITS))
    odd = np.bincount((tokens >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little")


def _index_need(size: int, percent: int) -> int:
    """The least overlap for a link with a set that is not smaller."""
    return -(-2 * percent * size // (100 + percent))


def _exchange_schema() -> str:
    return "r int, bid long, tokens binary, owners binary, known binary, known_owners binary, often binary, times binary, meta binary"


def _by_owner(tokens: np.ndarray, owner: np.ndarray) -> tuple[bytes, bytes]:
    """Tokens in their owners' order and the steps from owner to owner: a byte a token, or four where a step is large.

    So a row's bytes follow its tokens, however few of a batch's n-grams a range gets.
    """
    steps = np.diff(owner, prepend=0)
    return _packed(tokens), steps.astype(np.uint8 if steps.max(initial=0) < 256 else np.uint32).tobytes()


def _owners(steps: bytes, tokens: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint8 if len(steps) == tokens else np.uint32), dtype=np.int64)


def _send(n: int, ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc_id, text_hash, text) to a row for each hash range; the first also tells of the batch's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for no, batch in enumerate(b for b in batches if b.num_rows):
            place: dict[bytes, int] = {}
            kept, of_doc, sizes = [], [], []
            for grams in shingle_sets(batch.column(2), n):
                key = xxhash.xxh3_128_digest(grams.tobytes())
                if len(grams) and key not in place:
                    place[key] = len(kept)
                    kept.append(grams)
                of_doc.append(place[key] if len(grams) else -1)
                sizes.append(len(grams))
            meta = pickle.dumps((batch.column(0).to_pylist(), batch.column(1).to_pylist(), of_doc, sizes, list(place)))
            tokens = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(kept)), [len(x) for x in kept])
            order = np.argsort(tokens, kind="stable")
            ordered = tokens[order]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(ordered)])
            nth = np.arange(len(ordered)) - np.repeat(first, times)
            known = np.zeros(len(ordered), bool)
            known[order] = nth >= 2
            home_of = lambda x: ((x >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            often, more = ordered[first[times > 2]], (times[times > 2] - 2).astype(np.uint32)  # what the ranges don't see
            often_bounds = np.searchsorted(home_of(often), np.arange(ranges + 1))
            target = home_of(tokens)
            target[known] = (owner[known] + no + part) % ranges
            by_target = np.argsort(target, kind="stable")
            bounds = np.searchsorted(target[by_target], np.arange(ranges + 1))
            home = (no + part) % ranges  # the range that also gets the batch's documents
            out: list[tuple] = []
            for r in sorted({home, *np.flatnonzero(np.diff(bounds)).tolist()}):
                own = by_target[bounds[r] : bounds[r + 1]]
                new, old = own[~known[own]], own[known[own]]
                counted = slice(often_bounds[r], often_bounds[r + 1])
                row = (*_by_owner(tokens[new], owner[new]), *_by_owner(tokens[old], owner[old]), _packed(often[counted]), more[counted].tobytes())
                out.append((r, part << 32 | no, *row, meta if r == home else None))
            yield _batch(out, "r:i,bid:l,tokens:b,owners:b,known:b,known_owners:b,often:b,times:b,meta:b")

    return run


_ARROW = {"i": pa.int32(), "l": pa.int64(), "b": pa.binary(), "o": pa.bool_()}


def _arrow_schema(spec: str) -> pa.Schema:
    return pa.schema([(k, _ARROW[t]) for k, t in (x.split(":") for x in spec.split(","))])


def _batch(rows: list[tuple], spec: str) -> pa.RecordBatch:
    schema = _arrow_schema(spec)
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _table(rows: list[tuple], spec: str) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, spec)])


def _packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes()


def _u64(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // HASH_BYTES, 8), np.uint8)
    out[:, 8 - HASH_BYTES :] = np.frombuffer(packed, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def _shared_in_range(rows: pa.Table) -> pa.Table:
    """Of one hash range's n-grams those that two sets or more have, to the batches that sent them, with how common they are.

    That is a byte on a logarithmic scale; 0 where the batch can tell it from the same n-gram of another of its sets.
    """
    sent = [_u64(x) for x in rows["tokens"].to_pylist()]
    every = np.concatenate(sent)
    order = np.argsort(every)
    first = np.flatnonzero(np.r_[True, np.diff(every[order]) != 0]) if len(every) else np.zeros(0, np.int64)
    times, values = np.diff(np.r_[first, len(every)]), every[order[first]]
    often = np.concatenate([_u64(x) for x in rows["often"].to_pylist()])
    np.add.at(times, np.searchsorted(values, often), np.concatenate([np.frombuffer(x, np.uint32) for x in rows["times"].to_pylist()]))
    common = np.zeros(len(every), np.uint8)
    common[order] = np.repeat(np.where(times > 1, np.minimum(8 * np.log2(times), 255), 0).astype(np.uint8), np.diff(np.r_[first, len(every)]))
    del order, every, values
    out, at = [], 0
    for row, tokens in zip(rows.select(["bid", "owners", "known", "known_owners", "meta"]).to_pylist(), sent, strict=True):
        rank, known = common[at : at + len(tokens)], _u64(row["known"])
        at += len(tokens)
        owner = np.r_[_owners(row["owners"], len(tokens))[rank > 0], _owners(row["known_owners"], len(known))]
        found, ranks = np.r_[tokens[rank > 0], known], np.r_[rank[rank > 0], np.zeros(len(known), np.uint8)]
        place = np.argsort(owner, kind="stable")
        if len(found) or row["meta"] is not None:
            out.append((row["bid"], *_by_owner(found[place], owner[place]), ranks[place].tobytes(), row["meta"]))
    return _table(out, "bid:l,tokens:b,owners:b,ranks:b,meta:b")


def _survivors_of_batch(percent: int) -> Callable[[pa.Table], pa.Table]:
    """A row for each document of the batch; the first of a set that may link carries its shared n-grams, rarest first."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        docs, hashes, of_doc, sizes, prints = pickle.loads(next(r["meta"] for r in rows if r["meta"] is not None))
        sent = [_u64(r["tokens"]) for r in rows]
        tokens = np.concatenate(sent)
        owner = np.concatenate([_owners(r["owners"], len(t)) for r, t in zip(rows, sent, strict=True)])
        rank = np.concatenate([np.frombuffer(r["ranks"], np.uint8) for r in rows])
        told, asked = np.flatnonzero(rank), np.flatnonzero(rank == 0)
        if len(asked):
            told = told[np.argsort(tokens[told])]
            rank[asked] = rank[told[np.searchsorted(tokens[told], tokens[asked])]]
        order = np.lexsort((tokens, rank, owner))
        tokens, bounds = tokens[order], np.searchsorted(owner[order], np.arange(len(prints) + 1))
        out, seen = [], set()
        for doc, text_hash, k, size in zip(docs, hashes, of_doc, sizes, strict=True):
            found = None
            if k >= 0 and k not in seen:
                seen.add(k)
                own = tokens[bounds[k] : bounds[k + 1]]
                if len(own) >= _need(size, percent):
                    found = _packed(own)
            out.append((doc, text_hash, size, prints[k] if k >= 0 else None, found))
        return _table(out, "doc_id:l,text_hash:l,n_shingles:l,fp:b,tokens:b")

    return run


def _prefixes(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each n-gram in the prefix of a set: without one of them in common two sets cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                tokens, size = _u64(row["tokens"]), row["n_shingles"]
                bits = _bitmap(tokens, size).tobytes()
                within = len(tokens) - _index_need(size, percent) + 1
                for i, t in enumerate(tokens[: len(tokens) - _need(size, percent) + 1].view(np.int64).tolist()):
                    out.append((t, row["fp"], size, len(tokens), bits, i < within))
            yield _batch(out, "token:l,fp:b,n:l,shared:l,bits:b,within:o")

    return run


def _spanning(labels: list[bytes], near: Callable[[int], list[int]], leave: Callable[[int], None]) -> list[tuple[int, int]]:
    """Edges that connect whatever links. near(x) tells the sets that link with x and have not left yet.

    Sets of one label are connected already: they leave together and get no edge among themselves.
    """
    alike: dict[bytes, list[int]] = {}
    for i, label in enumerate(labels):
        alike.setdefault(label, []).append(i)
    edges, gone = [], [False] * len(labels)
    for root in range(len(labels)):
        stack, new = [], [] if gone[root] else [root]
        while new or stack:
            for i in (k for y in new for k in alike[labels[y]] if not gone[k]):
                gone[i] = True
                leave(i)
                stack.append(i)
            x, found = stack.pop(), {}
            for y in near(x):
                found.setdefault(labels[y], y)
            new = list(found.values())
            edges += [(x, y) for y in new]
    return edges


def _may_link(n: np.ndarray, own: np.ndarray, bits: list[bytes], within: np.ndarray, percent: int) -> tuple[Callable[[int], list[int]], Callable[[int], None]]:
    """What _spanning asks of a meeting place; own: n-grams that no other set has, within: it is in the shorter prefix of the set."""
    width = np.array([len(b) for b in bits])
    levels = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    maps = {w: np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1) for w, at in levels.items()}
    open_ = np.ones(len(n), bool)

    def near(x: int) -> list[int]:
        w, found = len(bits[x]), []
        for v in (w // 2, w, w * 2):
            at = levels.get(v)
            if at is None:
                continue
            pick = open_[at] & (within[at] & (n[at] <= n[x]) | within[x] & (n[x] <= n[at]))
            if not pick.any():
                continue
            to, other = at[pick], maps[v][pick]
            mine = np.frombuffer(bits[x], np.uint64)[None, :]
            least = min(w, v) // 8
            far = np.bitwise_count(_fold(mine, least) ^ _fold(other, least)).sum(axis=1, dtype=np.int64)
            both = n[x] + n[to]
            need = -(-percent * both // (100 + percent))
            close = far <= both - 2 * need - own[x] - own[to]
            close &= np.minimum(n[x], n[to]) >= need
            found += to[close].tolist()
        return found

    def leave(x: int) -> None:
        open_[x] = False

    return near, leave


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    """A longer bitmap as the shorter one its n-grams would have made."""
    return rows if rows.shape[1] == words else np.bitwise_xor.reduce(rows.reshape(len(rows), -1, words), axis=1)


def _meet(percent: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        keys = np.stack([rows[k].to_numpy() for k in ("token", "lo", "hi")])
        order = np.lexsort(keys)
        keys = keys[:, order]
        first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        fp, bits, labels = (rows[k].to_pylist() for k in ("fp", "bits", "label"))
        n, shared, within = (rows[k].to_numpy() for k in ("n", "shared", "within"))
        found = set()
        for a, b in zip(first, np.r_[first[1:], len(order)], strict=True):
            own = order[a:b]
            if b - a > 1 and within[own].any():
                near, leave = _may_link(n[own], (n - shared)[own], [bits[i] for i in own], within[own], percent)
                for x, y in _spanning([labels[i] for i in own], near, leave):
                    found.add((fp[own[x]], fp[own[y]]))
        return _table(sorted(found), "u:b,v:b")

    return run


class _Trie:
    """Sets of ordered n-grams in a radix trie: each node is a run of n-grams and what the sets below allow.

    A node is [start, end, least size, most n-grams to come, children, sets that end here, parent, sets that are left].
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.pool, self.root = [], [0, 0, 0, 0, [], [], None, 0]
        self.sizes = sizes
        length = 0
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        path: list[tuple[list, int]] = [(self.root, 0)]  # nodes of the last set and the depth at which each ends
        last = np.zeros(0, np.int64)
        for i in order:
            s = sets[i]
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            while path[-1][1] > common:
                node, end = path.pop()
                above = path[-1][1]
                if above < common:  # cut the node's run in two
                    head = [node[0], node[0] + common - above, 0, 0, [node], [], None, 0]
                    node[0] += common - above
                    path[-1][0][4][-1] = head
                    path.append((head, common))
            if len(s) > common:
                node = [length, length + len(s) - common, 0, 0, [], [], None, 0]
                self.pool.append(s[common:])
                length += len(s) - common
                path[-1][0][4].append(node)
                path.append((node, len(s)))
            path[-1][0][5].append(i)
            last = s
        self.pool = np.concatenate(self.pool) if self.pool else np.zeros(0, np.int64)
        self.ends: dict[int, list] = {}
        stack = [(self.root, False)]
        while stack:  # below each node: the smallest set, the most n-grams still to come
            node, done = stack.pop()
            if done:
                node[2] = min([self.sizes[i] for i in node[5]] + [c[2] for c in node[4]])
                node[3] = max([0] + [c[3] + c[1] - c[0] for c in node[4]])
                node[7] = len(node[5]) + sum(c[7] for c in node[4])
                for c in node[4]:
                    c[6] = node
                self.ends.update(dict.fromkeys(node[5], node))
            else:
                stack.append((node, True))
                stack.extend((c, False) for c in node[4])

    def leave(self, i: int) -> None:
        node = self.ends[i]
        node[5].remove(i)
        while node is not None:
            node[7] -= 1
            node = node[6]

    def walk(self, tokens: np.ndarray, size: int, universe: int, percent: int) -> Iterator[int]:
        """The sets left that link with a set."""
        if not self.root[7]:
            return
        has = np.zeros(universe, bool)
        has[tokens] = True
        whole = 100 + percent
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            overlap += np.count_nonzero(has[self.pool[node[0] : node[1]]])
            if whole * min(overlap + node[3], len(tokens)) < percent * (size + node[2]):
                continue
            for i in node[5]:
                if whole * overlap >= percent * (size + self.sizes[i]):
                    yield i
            stack.extend((c, overlap) for c in node[4] if c[7])


def _links(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Exact links within a candidate component, as edges to each linked group's first set."""

    def run(rows: pa.Table) -> pa.Table:
        fp, sizes = rows["fp"].to_pylist(), rows["n_shingles"].to_pylist()
        sets = [_u64(x) for x in rows["tokens"].to_pylist()]
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, -counts))] = np.arange(len(values))
        ranked = np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])
        ranked = [np.sort(x) for x in ranked]
        trie = _Trie(ranked, sizes)
        edges = _spanning(rows["label"].to_pylist(), lambda i: list(trie.walk(ranked[i], sizes[i], len(values), percent)), trie.leave)
        return _table([(fp[x], fp[y]) for x, y in edges], "u:b,v:b")

    return run


def _few(df: DataFrame) -> DataFrame:
    """The table, which is checkpointed, marked for a broadcast if it is small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _connected(rows: DataFrame, key: str, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (u, v) between fps that connect whatever links in a group of equal keys.

    link finds such edges among rows of one (key, lo, hi), of 4 * BLOCK rows at most. Most groups are one such block. Two rows of which
    none is within need not meet, nor do the rows of a group without any.
    """
    large = rows.groupBy(key).agg(F.count("*").alias("n"), F.max("within").alias("some")).where(F.col("n") > BLOCK)
    large = large.select(key, "some", F.ceil(F.col("n") / BLOCK).alias("blocks")).checkpoint()
    if large.isEmpty():
        return link(rows.withColumns({"label": F.col("fp"), "lo": F.lit(0), "hi": F.lit(0)}))
    hashed = F.xxhash64("fp")
    cut = rows.join(_few(large), key, "left").where(F.coalesce("some", F.lit(True))).withColumn("lo", F.coalesce(F.pmod(hashed, "blocks"), F.lit(0)).cast("int"))

    def stars(edges: DataFrame) -> DataFrame:
        """An edge from each set to its component's least one."""
        return components(edges).select(F.col("node").alias("u"), F.col("component").alias("v")).checkpoint()

    found = stars(link(cut.drop("blocks", "some").withColumns({"label": F.col("fp"), "hi": F.col("lo")})))
    big = rows.join(_few(large.where("some")), key, "left_semi")

    def labelled() -> DataFrame:
        return big.join(_few(found).withColumnRenamed("u", "fp"), "fp", "left").withColumn("label", F.coalesce("v", "fp")).drop("v")

    # one set of each component of a group, one that is within if there is any
    others = [c for c in big.columns if c not in (key, "fp", "within")]
    one = labelled().groupBy(key, "label").agg(F.min(F.struct((~F.col("within")).alias("beyond"), "fp", "within", *others)).alias("one"))
    one = one.select(key, "label", "one.*").drop("beyond").checkpoint()
    many = one.groupBy(key).count().where("count > 1").select(key, F.ceil(F.col("count") / BLOCK).alias("blocks")).checkpoint()
    one = one.join(_few(many), key).withColumn("lo", F.pmod(hashed, "blocks").cast("int"))
    found = stars(found.union(link(one.drop("blocks").withColumn("hi", F.col("lo")))))

    # what is still apart: large components have blocks of their own, small ones of a group share some; those within come first
    rest = labelled()
    sizes = rest.groupBy(key, "within", "label").count().checkpoint()
    apart = sizes.groupBy(key).agg((F.min("label") != F.max("label")).alias("some")).where("some").select(key).checkpoint()
    if apart.isEmpty():
        return found
    sizes = sizes.join(_few(apart), key, "left_semi")
    spans = sizes.where(F.col("count") >= BLOCK).union(sizes.where(F.col("count") < BLOCK).groupBy(key, "within").agg(F.lit(None).cast("binary").alias("label"), F.sum("count").alias("count")))
    spans = spans.withColumn("width", F.ceil(F.col("count") / BLOCK))
    own = Window.partitionBy(key)
    sums = {
        "end": F.sum("width").over(own.orderBy(F.col("within").desc(), "label")),
        "blocks": F.sum("width").over(own),
        "open": F.coalesce(F.sum(F.when(F.col("within"), F.col("width"))).over(own), F.lit(0)),
    }
    spans = spans.withColumns(sums).withColumn("to", F.when(F.col("within"), F.col("blocks")).otherwise(F.col("open"))).drop("count", "blocks", "open").checkpoint()
    wide = spans.where("label is not null")
    pool = spans.where("label is null").select(key, "within", *(F.col(c).alias(f"pool_{c}") for c in ("end", "width", "to")))
    rest = rest.join(_few(apart), key, "left_semi").join(_few(wide), [key, "within", "label"], "left").join(_few(pool), [key, "within"], "left")
    lone = F.col("width").isNull()
    at = F.when(lone, F.col("pool_end") - F.col("pool_width") + F.pmod(F.xxhash64("label"), "pool_width")).otherwise(F.col("end") - F.col("width") + F.pmod(hashed, "width"))
    every = F.sequence(F.lit(0), F.coalesce("to", "pool_to").cast("int") - 1)
    with_ = F.explode(F.filter(every, lambda x: lone | (x < F.col("end") - F.col("width")) | (x >= F.col("end"))))
    rest = rest.where(F.coalesce("to", "pool_to") > 0).withColumn("at", at.cast("int")).withColumn("with", with_).withColumns({"lo": F.least("at", "with"), "hi": F.greatest("at", "with")})
    return found.union(link(rest.drop("width", "end", "to", "pool_end", "pool_width", "pool_to", "at", "with")))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, text_hash, component) of every row: its set's size and the smallest id that links lead to.

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of n-word shingles (A-Z lower-cased;
    fewer words: the whole sequence as one). A null or wordless text has the empty set and links with nothing.
    Ids must be integers, and not null: rows with a null id are kept as components of their own with a null
    component_id. text_hash is Spark's xxhash64 of the text and component a key of the component, whatever its ids are; it is null for
    the empty set. Repeated rows give repeated results. An empty table gives an empty one. Other columns are not read. A very long text is
    one set as any other. The table must read the same twice (files, or a checkpoint), as a batch is known by its place.
    """
    spark = prepared(docs.sparkSession)
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    ranges = max(4, -(-text_bytes(docs) // RANGE_BYTES))
    sent = docs.mapInArrow(_send(n, ranges), _exchange_schema())
    back = sent.groupBy("r").applyInArrow(_shared_in_range, "bid long, tokens binary, owners binary, ranks binary, meta binary")
    sets = back.groupBy("bid").applyInArrow(_survivors_of_batch(percent), "doc_id long, text_hash long, n_shingles long, fp binary, tokens binary").checkpoint()

    own = sets.where("tokens is not null").select("fp", "n_shingles", "tokens").dropDuplicates(["fp"]).checkpoint()
    prefixes = own.mapInArrow(_prefixes(percent), "token long, fp binary, n long, shared long, bits binary, within boolean")
    buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 4

    def meet(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("token", "lo", "hi"), F.lit(buckets)))
        return dealt.groupBy("bucket").applyInArrow(_meet(percent), "u binary, v binary")

    candidates = components(_connected(prefixes, "token", meet)).checkpoint()

    inside = own.join(_few(candidates).withColumnRenamed("node", "fp"), "fp").withColumn("within", F.lit(True))
    walked = lambda rows: rows.groupBy("group", "lo", "hi").applyInArrow(_links(percent), "u binary, v binary")
    linked = components(_connected(inside.withColumnRenamed("component", "group"), "group", walked)).withColumnRenamed("node", "fp")

    # tables that are joined by a key of many rows are stored first: a small one is broadcast, else the many rows are split at run time
    least = sets.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = least.join(linked, "fp", "left").checkpoint()
    shared = member.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id")).checkpoint()
    named = member.join(_few(shared), "component", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least").alias("component_id")).checkpoint()
    least_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sets.drop("tokens").join(_few(named), "fp", "left").select(F.col("doc_id").alias(id_col), "n_shingles", least_id.alias("component_id"), "text_hash", "component")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ngram_jaccard_join of all documents: five words, a similarity of 0.8."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op2_ngram_join": op2_ngram_join}

ORACLE_SQL = {
    "op2_ngram_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (
  select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as gram from w),
n as (select doc_id, count(*) as size from g group by doc_id),
classes as (select doc_id, min(doc_id) over (partition by h) as rep from (select doc_id, md5(string_agg(gram, chr(10) order by gram)) as h from g group by doc_id)),
s as (select g.doc_id, gram from g join classes c on c.doc_id = g.doc_id and c.rep = g.doc_id),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as shared from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
links as (select u, v from pairs join n a on a.doc_id = u join n b on b.doc_id = v where 100 * shared >= 80 * (a.size + b.size - shared)),
sides as (select u, v from links union select v, u from links union select doc_id, rep from classes union select rep, doc_id from classes),
reach(d, m) as (select doc_id, doc_id from w union select reach.d, sides.v from reach join sides on reach.m = sides.u)
select d as doc_id, coalesce(size, 0)::bigint as n_shingles, min(m) as component_id from reach left join n on n.doc_id = d group by d, size
"""
}
