"""Embedding near-duplicates with hierarchical navigable small-world graphs, one a shard.

Vectors are compared only with those of the same label and length, by cosine.

1. Equal vectors of a label are one node with its number of ids and its smallest id.  A label's nodes are dealt to
   shards of bounded bytes, and to blocks of queries.
2. Each shard becomes a graph of levels, built in batches: a beam search finds the neighbours of a batch, a diversity
   rule chooses among them.  Vectors within half the threshold's angle of a vector of the graph fold into its ball
   instead: any two of a ball are linked by the triangle inequality, so a dense group of near copies is a few balls.
3. Every block of queries searches every shard of its label.  The beam of a query is widened while all that it holds
   could be linked; the beams of the block are widened until an audit passes: a spread of its queries is compared
   with the whole shard, and ``recall`` of their links must have been found.
4. What the search finds is verified on the full vectors in double precision.  A ball counts as a whole where the
   angle to its centre and its radius prove that all (or none) of it is linked, member by member else.  Counts and a
   link for each vector and ball leave the task, never the pairs inside a group.
5. Links become components by the rounds of large and small stars.

Found links are never under the threshold; recall is that of the audits (measured in README).  A vector's own ball is
always counted.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components link with nothing, nor
do rows without a label or an id (without an id: component null, kept); repeated rows (same id, label and vector) count
once and have equal results; an id with several vectors or labels is reachable through each of them; vectors of
different lengths don't link; ties don't matter, as links are sets and components take the smallest id; very long
vectors make smaller shards; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .minhash import components
from .storage import written

COSINE, RECALL = 0.93, 0.99
#: Bytes of a shard's vectors; rows of a block of queries; queries that an audit compares with the whole shard.
SHARD_BYTES, BLOCK_ROWS, AUDITED = 64 << 20, 65_536, 512
#: Neighbours of a node on upper levels (twice as many on the lowest), width of beams while building and at first in queries.
DEGREE, BUILD, WIDTH = 12, 64, 48
_MARGIN = 1e-6  # of angles in double precision
_FLOAT = 1e-4  # of cosines in single precision


def _chosen(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1: none), the ``most`` neighbours: nearest first, those nearer to a chosen one than to the row come last."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    own = x[np.maximum(ids, 0)]
    among = own @ own.transpose(0, 2, 1)
    taken = np.zeros(ids.shape, dtype=bool)
    for j in range(ids.shape[1]):
        blocked = ((among[:, j] > sims[:, j : j + 1]) & taken).any(axis=1)
        taken[:, j] = (ids[:, j] >= 0) & ~blocked & (taken.sum(axis=1) < most)
    rank = np.where(ids < 0, -9.0, sims + 4.0 * taken)
    first = np.argsort(-rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, first, 1)
    if out.shape[1] < most:
        out = np.concatenate((out, np.full((len(out), most - out.shape[1]), -1, dtype=out.dtype)), axis=1)
    return out


class Graph:
    """Levels of links over unit vectors in single precision."""

    def __init__(self, dim: int, seed: int = 11):
        self.x = np.zeros((0, dim), dtype=np.float32)
        self.level = np.zeros(0, dtype=np.int64)
        self.links: list[np.ndarray] = []  # of each level, for all nodes below the level's last (upper levels are sparse in use)
        self.entry = -1
        self.rng = np.random.default_rng(seed)

    def __len__(self) -> int:
        return len(self.x)

    def beam(self, level: int, q: np.ndarray, entries: np.ndarray, width: int, fan: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the ``width`` nearest found for each query on a level, in no order; -1 where there are fewer."""
        n, count = len(self.x), len(q)
        ids = np.full((count, width), -1, dtype=np.int64)
        sims = np.full((count, width), -4.0, dtype=np.float32)
        closed = np.ones((count, width), dtype=bool)
        seen = np.zeros((count, n), dtype=bool)
        links, flat = self.links[level], seen.reshape(-1)
        rows, cols = np.nonzero(entries >= 0)
        key = np.unique(rows * n + entries[rows, cols])
        while len(key):
            flat[key] = True
            who, node = key // n, key % n
            near = np.einsum("ij,ij->i", self.x[node], q[who])
            live, start, number = np.unique(who, return_index=True, return_counts=True)
            most = int(number.max())
            new_ids, new_sims = np.full((len(live), most), -1, dtype=np.int64), np.full((len(live), most), -4.0, dtype=np.float32)
            row = np.repeat(np.arange(len(live)), number)
            col = np.arange(len(key)) - np.repeat(start, number)
            new_ids[row, col], new_sims[row, col] = node, near
            every = np.concatenate((sims[live], new_sims), axis=1)
            best = np.argpartition(-every, width - 1, axis=1)[:, :width]
            sims[live] = np.take_along_axis(every, best, 1)
            ids[live] = np.take_along_axis(np.concatenate((ids[live], new_ids), axis=1), best, 1)
            closed[live] = np.take_along_axis(np.concatenate((closed[live], new_ids < 0), axis=1), best, 1)
            key = key[:0]
            while not len(key):  # the best open nodes of each query are expanded; a step may bring nothing new
                left = np.where(closed, -5.0, sims)
                step = min(fan, width)
                pick = np.argpartition(-left, step - 1, axis=1)[:, :step]
                r, c = np.nonzero(np.take_along_axis(left, pick, 1) > -4.5)
                if not len(r):
                    break
                place = pick[r, c]
                closed[r, place] = True
                found = links[ids[r, place]]
                key = (r[:, None] * n + found)[found >= 0]
                key = np.unique(key[~flat[key]])
        return ids, sims

    def descend(self, q: np.ndarray, down_to: int = 0, width: int = 8) -> np.ndarray:
        """Entries for a level: the best nodes found on the level above."""
        entries = np.full((len(q), 1), self.entry, dtype=np.int64)
        for level in range(len(self.links) - 1, down_to, -1):
            entries = self.beam(level, q, entries, width)[0]
        return entries

    def nearest(self, q: np.ndarray, width: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam of the lowest level; ``known``: one more entry for each query (-1: none)."""
        entries = self.descend(q)
        return self.beam(0, q, entries if known is None else np.concatenate((entries, known[:, None]), axis=1), width)

    def insert(self, x: np.ndarray) -> None:
        """Add a batch of unit vectors."""
        first, count = len(self.x), len(x)
        level = np.minimum((-np.log(1 - self.rng.random(count)) / math.log(DEGREE)).astype(np.int64), 12)
        before = len(self.links)
        searched = {l: self.beam(l, x, self.descend(x, l), min(BUILD, first)) for l in range(before)} if first else {}
        self.x = np.concatenate((self.x, x))
        self.level = np.concatenate((self.level, level))
        for l in range(max(before, int(level.max()) + 1)):
            degree = DEGREE * (2 if l == 0 else 1)
            if l == len(self.links):
                self.links.append(np.full((0, degree), -1, dtype=np.int32))
            grown = np.full((first + count, degree), -1, dtype=np.int32)
            grown[: len(self.links[l])] = self.links[l]
            self.links[l] = grown
        among = x @ x.T
        for l in range(len(self.links)):
            new = np.flatnonzero(level >= l)
            if not len(new):
                continue
            mates = among[np.ix_(new, new)].copy()
            np.fill_diagonal(mates, -4.0)
            k = min(16, len(new))
            best = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            ids = first + new[best]
            sims = np.take_along_axis(mates, best, 1)
            ids = np.where(sims > -3, ids, -1)
            if l in searched:
                ids, sims = np.concatenate((searched[l][0][new], ids), axis=1), np.concatenate((searched[l][1][new], sims), axis=1)
            degree = self.links[l].shape[1]
            own = _chosen(self.x, ids, sims, DEGREE)
            self.links[l][first + new, :DEGREE] = own
            self._linked_back(l, np.repeat(first + new, DEGREE), own.reshape(-1), degree)
        if self.entry < 0 or level.max() > self.level[self.entry]:
            self.entry = first + int(np.argmax(level))

    def _linked_back(self, l: int, source: np.ndarray, target: np.ndarray, degree: int) -> None:
        """Reverse links; where a node has too many, the diversity rule chooses."""
        keep = target >= 0
        source, target = source[keep], target[keep]
        sims = np.einsum("ij,ij->i", self.x[source], self.x[target])
        order = np.lexsort((-sims, target))
        source, target, sims = source[order], target[order], sims[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(start, count)
        short = place < degree
        ids = np.full((len(nodes), degree), -1, dtype=np.int64)
        ids[np.repeat(np.arange(len(nodes)), count)[short], place[short]] = source[short]
        held = self.links[l][nodes].astype(np.int64)
        ids = np.where((ids[:, :, None] == held[:, None, :]).any(axis=2), -1, ids)
        both = np.concatenate((held, ids), axis=1)
        size = (both >= 0).sum(axis=1)
        fits = np.flatnonzero(size <= degree)
        packed = np.take_along_axis(both[fits], np.argsort(both[fits] < 0, axis=1, kind="stable"), 1)[:, :degree]
        self.links[l][nodes[fits]] = packed
        full = np.flatnonzero(size > degree)
        for i in range(0, len(full), 512):
            at = full[i : i + 512]
            own = self.x[np.maximum(both[at], 0)]
            near = np.where(both[at] >= 0, np.einsum("ijk,ik->ij", own, self.x[nodes[at]]), -4.0)
            self.links[l][nodes[at]] = _chosen(self.x, both[at], near, degree)


class Shard:
    """A shard's vectors, folded into balls, and the graph of their leaders."""

    def __init__(self, node: np.ndarray, weight: np.ndarray, x: np.ndarray, cosine: float):
        order = np.argsort(node, kind="stable")
        self.node, self.weight, self.x, self.cosine = node[order], weight[order], x[order], cosine
        self.norm = np.sqrt((self.x**2).sum(axis=1))
        unit = self.x / self.norm[:, None]
        single = unit.astype(np.float32)
        dim = x.shape[1]
        self.graph = Graph(dim)
        fold = math.cos(math.acos(cosine) / 2 - _MARGIN)  # within it of a leader: linked with all of the ball
        batch = int(min(256, max(16, (1 << 21) // (80 * dim))))
        self.ball = np.full(len(x), -1, dtype=np.int64)
        leaders: list[np.ndarray] = []
        n_leaders = 0
        for i in range(0, len(x), batch):
            at = np.arange(i, min(i + batch, len(x)))
            if n_leaders:
                ids, sims = self.graph.nearest(single[at], min(BUILD, n_leaders))
                best = np.take_along_axis(ids, sims.argmax(axis=1)[:, None], 1)[:, 0]
                lead = np.concatenate(leaders)[best]
                near = (unit[at] * unit[lead]).sum(axis=1) >= fold
                self.ball[at[near]] = best[near]
            rest = at[self.ball[at] < 0]
            close = unit[rest] @ unit[rest].T >= fold
            new = []
            for k in range(len(rest)):
                if self.ball[rest[k]] < 0:
                    mates = np.flatnonzero(close[k] & (self.ball[rest] < 0))
                    self.ball[rest[mates]] = self.ball[rest[k]] = n_leaders + len(new)
                    new.append(int(rest[k]))
            if new:
                leaders.append(np.array(new))
                n_leaders += len(new)
                self.graph.insert(single[new])
        self.leader = np.concatenate(leaders)
        # members of each ball, its weight, smallest id, centre and radii
        self.members = np.argsort(self.ball, kind="stable")
        self.first = np.searchsorted(self.ball[self.members], np.arange(n_leaders + 1))
        total = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(self.weight[self.members])))
        self.ball_weight = total[self.first[1:]] - total[self.first[:-1]]
        self.least = np.minimum.reduceat(self.node[self.members], self.first[:-1])
        centre = np.add.reduceat(unit[self.members], self.first[:-1], axis=0)
        self.centre = centre / np.sqrt((centre**2).sum(axis=1))[:, None]
        owner = self.ball[self.members]
        angle = lambda a, b: np.arccos(np.clip((a * b).sum(axis=1), -1, 1))
        self.radius = np.maximum.reduceat(angle(unit[self.members], self.centre[owner]), self.first[:-1])
        reach = np.maximum.reduceat(angle(unit[self.members], unit[self.leader][owner]), self.first[:-1])
        #: a leader's cosine under which none of its ball is linked
        self.near = (np.cos(np.minimum(np.pi, math.acos(cosine) + reach + _MARGIN)) - _FLOAT).astype(np.float32)

    def links(self, x: np.ndarray, known: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, ball, weight of the ball's linked members), none twice; ``known``: a query's own ball, always among them (-1: not of this shard)."""
        norm = np.sqrt((x**2).sum(axis=1))
        unit = (x / norm[:, None]).astype(np.float32)
        found = []
        rows = max(1, min(256, (64 << 20) // max(1, len(self.leader))))
        for i in range(0, len(x), rows):
            left, wide = np.arange(i, min(i + rows, len(x))), min(width, len(self.leader))
            while len(left):
                ids, sims = self.graph.nearest(unit[left], wide, np.where(known[left] >= 0, known[left], -1))
                r, c = np.nonzero((ids >= 0) & (sims >= self.near[np.maximum(ids, 0)]))
                full = (sims.min(axis=1) >= self.near.min()) & (wide < len(self.leader))
                ready = ~full[r]
                found.append(left[r[ready]] * len(self.leader) + ids[r[ready], c[ready]])
                left, wide = left[full], min(2 * wide, len(self.leader))
        own = np.flatnonzero(known >= 0)
        query, ball = np.divmod(np.unique(np.concatenate((own * len(self.leader) + known[own], *found))), len(self.leader))
        angle = np.concatenate([np.zeros(0)] + [np.arccos(np.clip((x[query[i : i + 65_536]] * self.centre[ball[i : i + 65_536]]).sum(axis=1) / norm[query[i : i + 65_536]], -1, 1)) for i in range(0, len(query), 65_536)])
        limit = math.acos(self.cosine)
        whole = (angle + self.radius[ball] <= limit - _MARGIN) | (ball == known[query])
        weight = np.where(whole, self.ball_weight[ball], 0)
        open_ = np.flatnonzero(~whole & (angle - self.radius[ball] <= limit + _MARGIN))
        open_ = open_[np.argsort(ball[open_], kind="stable")]
        edges = np.flatnonzero(np.diff(ball[open_], prepend=-1)).tolist()
        single = (np.diff(self.first) == 1)[ball[open_]]
        at = open_[single]
        member = self.members[self.first[ball[at]]]
        for i in range(0, len(at), 65_536):
            a, m = at[i : i + 65_536], member[i : i + 65_536]
            cosine = (x[query[a]] * self.x[m]).sum(axis=1) / (norm[query[a]] * self.norm[m])
            weight[a] = np.where(cosine >= self.cosine, self.weight[m], 0)
        for a, b in zip(edges, [*edges, len(open_)][1:]):
            own = ball[open_[a]]
            if self.first[own + 1] - self.first[own] == 1:
                continue
            member = self.members[self.first[own] : self.first[own + 1]]
            for i in range(a, b, 1024):
                at = open_[i : min(b, i + 1024)]
                for j in range(0, len(member), 4096):
                    m = member[j : j + 4096]
                    linked = (x[query[at]] @ self.x[m].T) / (norm[query[at]][:, None] * self.norm[m]) >= self.cosine
                    weight[at] += linked @ self.weight[m]
        keep = weight > 0
        return query[keep], ball[keep], weight[keep]

    def audited(self, x: np.ndarray, known: np.ndarray, *, recall: float, audited: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``links`` with beams so wide that an audit passes."""
        spread = np.unique(np.linspace(0, len(x) - 1, min(audited, len(x))).astype(np.int64))
        truth = np.zeros(len(spread), dtype=np.int64)
        for i in range(0, len(spread), 32):
            q = x[spread[i : i + 32]]
            truth[i : i + 32] = ((q @ self.x.T) / (np.sqrt((q**2).sum(axis=1))[:, None] * self.norm) >= self.cosine) @ self.weight
        mine = np.where(known >= 0, self.ball_weight[known], 0)  # its own ball is no find of the search
        while True:
            query, ball, weight = self.links(x, known, width)
            total = np.bincount(query, weights=weight, minlength=len(x)).astype(np.int64)
            if width >= len(self.leader) or (total - mine)[spread].sum() >= recall * (truth - mine[spread]).sum():
                return query, ball, weight
            width *= 2


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _built(cosine: float):
    def run(key, table):
        shard = Shard(table.column("node").to_numpy(), table.column("weight").to_numpy(), _vectors(table.column("embedding")), cosine)
        return pa.table({"label": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()), "shard": pa.array([key[2].as_py()], pa.int64()), "blocks": table.column("blocks")[:1], "graph": pa.array([pickle.dumps(shard, protocol=5)], pa.binary())})

    return run


_LINKS = "a long, b long, n long"


def _searched(recall: float, audited: int):
    """Rows (a, null, n): vectors linked with node a in a shard; rows (a, b, null): links for the components."""

    def run(key, graphs, queries):
        nothing = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not graphs.num_rows or not queries.num_rows:
            return nothing
        shard: Shard = pickle.loads(graphs.column("graph")[0].as_py())
        node, x = queries.column("node").to_numpy(), _vectors(queries.column("embedding"))
        place = np.minimum(np.searchsorted(shard.node, node), len(shard.node) - 1)
        known = np.where(shard.node[place] == node, shard.ball[place], -1)
        query, ball, weight = shard.audited(x, known, recall=recall, audited=audited)
        total = np.bincount(query, weights=weight, minlength=len(x)).astype(np.int64)
        # one of a ball of this shard stands for the ball
        source = np.where(known >= 0, shard.least[np.maximum(known, 0)], node)
        edges = np.unique(np.stack((np.minimum(source[query], shard.least[ball]), np.maximum(source[query], shard.least[ball])), axis=1), axis=0)
        edges = np.concatenate((edges, np.stack((source, node), axis=1)))
        edges = edges[edges[:, 0] != edges[:, 1]]
        some = np.flatnonzero(total)
        return pa.concat_tables([
            pa.table({"a": node[some], "b": pa.nulls(len(some), pa.int64()), "n": total[some]}),
            pa.table({"a": edges[:, 0], "b": edges[:, 1], "n": pa.nulls(len(edges), pa.int64())}),
        ])

    return run


def valid(vectors: DataFrame) -> DataFrame:
    """Distinct rows (vec_id, label, embedding) that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and label is not null and size(embedding) > 0")
    return rows.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)).distinct()


def near_vectors(vectors: DataFrame, *, cosine: float = COSINE, recall: float = RECALL, shard_bytes: int = SHARD_BYTES, block_rows: int = BLOCK_ROWS, audited: int = AUDITED) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding, label)."""
    rows = written(valid(vectors), "vectors")
    dim = F.size("embedding")
    # equal vectors are one node; nodes are numbered by their place, as an id may have several vectors
    nodes = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")).withColumn("dim", dim)
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("rows")).select("label", "dim", F.ceil(F.col("rows") * F.col("dim") * 8 / shard_bytes).cast("long").alias("shards"), F.ceil(F.col("rows") / block_rows).cast("long").alias("blocks"))
    placed = nodes.join(written(sizes, "sizes"), ["label", "dim"])
    own = F.pmod(F.xxhash64("node"), F.col("shards"))
    graphs = placed.withColumn("shard", own).select("label", "dim", "shard", "blocks", "node", "weight", "embedding").groupBy("label", "dim", "shard").applyInArrow(_built(cosine), "label long, dim int, shard long, blocks long, graph binary")
    graphs = written(graphs, "graphs")
    count = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    keys = ["label", "dim", "shard", "block"]
    given = graphs.select("label", "dim", "shard", count("blocks", "block"), "graph")
    asked = placed.select("label", "dim", count("shards", "shard"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).alias("block"), "node", "embedding")
    found = written(given.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_searched(recall, audited), _LINKS), "links")
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    # ids join what they stand for: a node's smallest id links it, others of the node follow it
    ids = nodes.select("node", "vec_id", "label", "embedding")
    links = found.where("b is not null").select("a", "b").join(ids.select(F.col("node").alias("a"), F.col("vec_id").alias("x")), "a").join(ids.select(F.col("node").alias("b"), F.col("vec_id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    members = written(rows.join(ids.withColumnRenamed("vec_id", "head"), ["label", "embedding"]).select("vec_id", "label", "embedding", "node", "head"), "members")
    links = links.unionByName(members.where("vec_id != head").select(F.col("head").alias("a"), F.col("vec_id").alias("b")))
    group = written(components(links, "vector-components"), "vector-labels")
    known = members.join(counts, "node", "left").select("vec_id", "label", "embedding", F.greatest(F.coalesce("n", F.lit(1)) - 1, F.lit(0)).alias("n_links"))
    given_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = given_rows.join(known, ["vec_id", "label", "embedding"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = out.join(group.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    return out.select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def brute_force(rows: list[tuple[int, int | None, list | None]], cosine: float = COSINE) -> dict[tuple, tuple[int, int]]:
    """Reference answer {(id, label, vector): (links, component)} by comparing all pairs of a label, for tests."""
    good = sorted({(i, l, tuple(map(float, v))) for i, l, v in rows if i is not None and l is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)})
    parent = {i: i for i, _, _ in good}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n = [0] * len(good)
    for a, (i, l, v) in enumerate(good):
        for b in range(a):
            j, m, w = good[b]
            if l == m and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= cosine:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {key: (n[a], find(key[0])) for a, key in enumerate(good)}
