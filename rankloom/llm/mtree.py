"""Exact top-k search by an M-tree: paged metric nodes with covering radii and distances to their parents.

Three levels hold all vectors: heads, each with a subtree; pages of a subtree; vectors of a page. Each node has a routing
object, a covering radius and its distance to the routing object above it, and each vector its distance to its page's. A
vector goes down to the nearest routing object of each level. The heads, a bounded number of them, are sent to every task;
subtrees stay where they are.

Queries visit subtrees best first, in rounds: the one of least possible distance, the few that follow, the rest. A node is
passed over when the triangle inequality puts all it holds beyond the k-th distance that a query has already; whether to
compute the distance to a node's routing object, or to a vector, is itself decided from the stored distance to the one above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import cut

#: Vectors of a subtree, about and at most; of a page, at most.
SUBTREE = 2048
PAGE = 64
#: Bytes of routing objects sent to each task, at most: subtrees grow beyond SUBTREE only past this.
ROUTING_BYTES = 16 << 20
#: Subtrees that a query visits in the first rounds; the last round takes all others that its bounds don't rule out.
ROUNDS = (1, 7)
#: Queries that one task holds against a subtree, about: a subtree that more queries visit is sent to several tasks.
QUERIES_A_TASK = 8192
#: Distances are compared after rounding to this many places, so that equal vectors tie whatever the order of summing.
PLACES = 9
SLACK = 1e-7


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b."""
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0))


def build(ids: np.ndarray, x: np.ndarray, page: int = PAGE) -> dict[str, np.ndarray]:
    """A subtree: its routing object (the medoid of a few) and radius, and pages of near vectors in contiguous rows.

    Pages come from parting the rows by which of two far objects is nearer, or if that leaves next to nothing on one side into
    halves along the line between them, and so on down to the page size. Any vectors, equal ones too, end in pages of at most
    `page`.
    """
    order, todo = [], [np.arange(len(ids))]
    while todo:
        rows = todo.pop()
        if len(rows) <= page:
            order.append(rows)
            continue
        far = int(np.argmax(((x[rows] - x[rows[0]]) ** 2).sum(1)))
        other = int(np.argmax(((x[rows] - x[rows[far]]) ** 2).sum(1)))
        a, b = x[rows[far]], x[rows[other]]
        along = np.round(x[rows] @ (b - a) - (b @ b - a @ a) / 2, 9)  # above 0: nearer to b
        side = np.lexsort((ids[rows], along))
        at = int((along <= 0).sum())
        if min(at, len(rows) - at) * 8 < len(rows):  # too uneven: halves, in whole pages
            at = -(-len(rows) // (2 * page)) * page
        todo += [rows[side[at:]], rows[side[:at]]]
    bounds = np.cumsum([0, *map(len, order)])
    rows = np.concatenate(order)
    ids, x = ids[rows], x[rows]
    mean = x.mean(0)
    center = x[int(np.argmin(((x - mean) ** 2).sum(1)))]
    routing = np.stack([x[lo + int(np.argmin(((x[lo:hi] - x[lo:hi].mean(0)) ** 2).sum(1)))] for lo, hi in zip(bounds, bounds[1:])])
    cover = np.array([np.sqrt(((x[lo:hi] - r) ** 2).sum(1)).max() for lo, hi, r in zip(bounds, bounds[1:], routing)])
    return {"ids": ids, "x": x, "center": center, "radius": np.sqrt(((x - center) ** 2).sum(1)).max(), "bounds": bounds, "routing": routing, "cover": cover, "parent": np.sqrt(((routing - center) ** 2).sum(1)),
            "entry": np.concatenate([np.sqrt(((x[lo:hi] - r) ** 2).sum(1)) for lo, hi, r in zip(bounds, bounds[1:], routing)])}


class Best:
    """The k best neighbours so far of a block of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.d = np.full((len(ids), k), np.inf)
        self.n = np.full((len(ids), k), np.iinfo(np.int64).max)

    @property
    def worst(self) -> np.ndarray:
        return self.d[:, -1]

    def offer(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        d = distances(self.x[rows], x)
        near = d <= self.worst[rows][:, None] + SLACK
        r, c = np.nonzero(near)
        apart = ids[c] != self.ids[rows[r]]
        r, c = r[apart], c[apart]
        if not len(r):
            return
        exact = np.round(np.sqrt(((self.x[rows[r]] - x[c]) ** 2).sum(1)), PLACES)
        who = np.unique(r)
        at = np.concatenate((r, np.repeat(who, self.k)))
        dist = np.concatenate((exact, self.d[rows[who]].ravel()))
        name = np.concatenate((ids[c], self.n[rows[who]].ravel()))
        order = np.lexsort((name, dist, at))
        at, dist, name = at[order], dist[order], name[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        take = (first[:, None] + np.arange(self.k)).ravel()
        self.d[rows[who]] = dist[take].reshape(-1, self.k)
        self.n[rows[who]] = name[take].reshape(-1, self.k)

    def search(self, tree: dict[str, np.ndarray], group: int = 8) -> int:
        """Search a subtree for all queries; returns how many distances to routing objects and vectors were computed."""
        done = len(self.x)
        to_center = distances(self.x, tree["center"][None])[:, 0]
        rows = np.flatnonzero(to_center - tree["radius"] <= self.worst + SLACK)
        if not len(rows):
            return done
        by_parent = np.abs(to_center[rows][:, None] - tree["parent"][None]) - tree["cover"][None] <= self.worst[rows][:, None] + SLACK
        bound = np.full((len(rows), len(tree["cover"])), np.inf)
        some = by_parent.any(1)
        done += int(by_parent.sum())
        bound[some] = np.where(by_parent[some], distances(self.x[rows[some]], tree["routing"]) - tree["cover"][None], np.inf)
        spans = [np.arange(lo, hi) for lo, hi in zip(tree["bounds"], tree["bounds"][1:])]

        reach = bound + tree["cover"][None]  # distance to each page's routing object

        def visit(who: np.ndarray, pages: np.ndarray) -> int:
            """Offers the vectors of pages, without those that their distance to the page's object rules out for all of `who`."""
            worst = self.worst[rows[who]][:, None] + SLACK
            at = np.concatenate([spans[p][(np.abs(reach[who, p][:, None] - tree["entry"][spans[p]][None]) <= worst).any(0)] for p in pages])
            if len(at):
                self.offer(rows[who], tree["ids"][at], tree["x"][at])
            return len(who) * len(at)

        # each query's best page first
        best = bound.argmin(1)
        alive = bound[np.arange(len(rows)), best] <= self.worst[rows] + SLACK
        for p in np.unique(best[alive]):
            done += visit(np.flatnonzero(alive & (best == p)), np.array([p]))
        bound[np.arange(len(rows)), best] = np.inf
        # then the others, best first for all together; several at once unless most of that would be in vain
        pages = np.argsort(bound.min(0), kind="stable")
        for i in range(0, len(pages), group):
            part = pages[i : i + group]
            alive = np.isfinite(bound[:, part]) & (bound[:, part] <= self.worst[rows][:, None] + SLACK)
            who, wanted = np.flatnonzero(alive.any(1)), part[alive.any(0)]
            if len(who) and alive.sum() > 0.7 * len(who) * len(wanted):
                # a query's best page lies in some group: it was visited and must not be offered again
                seen = np.isin(best[who], wanted)
                if not seen.any():
                    done += visit(who, wanted)
                    continue
                if (~seen).any():
                    done += visit(who[~seen], wanted)
                who = who[seen]
            for p in wanted if len(who) else ():
                one = who[bound[who, p] <= self.worst[rows[who]] + SLACK]
                one = one[np.isfinite(bound[one, p])]
                if len(one):
                    done += visit(one, np.array([p]))
        return done


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that can be searched, repeats kept, of whatever length."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    return v.where("id is not null and v is not null and size(v) > 0 and not exists(v, e -> e is null or isnan(e) or abs(e) = double('infinity'))")


class Heads:
    """The upper level: each head's subtree, routing object and covering radius, and pages of near heads above them."""

    def __init__(self, names: np.ndarray, x: np.ndarray, radius: np.ndarray, page: int = PAGE):
        above = build(np.arange(len(x)), x, page)
        order = above["ids"]
        self.names, self.x, self.radius, self.bounds, self.above = names[order], x[order], radius[order], above["bounds"], above["routing"]
        self.to_above = above["entry"]  # of each head to its page's object
        self.cover = np.array([(self.to_above[i:j] + self.radius[i:j]).max() for i, j in zip(self.bounds, self.bounds[1:])])

    def least(self, x: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, int]:
        """(least possible distance of each query to what each head holds, infinite where it lies beyond the query's worst;
        number of distances computed)."""
        to_above = distances(x, self.above)
        out, done = np.full((len(x), len(self.x)), np.inf), to_above.size
        limit = worst + SLACK
        for p, (i, j) in enumerate(zip(self.bounds, self.bounds[1:])):
            who = np.flatnonzero(to_above[:, p] - self.cover[p] <= limit)
            if not len(who):
                continue
            by_parent = np.abs(to_above[who, p][:, None] - self.to_above[None, i:j]) - self.radius[None, i:j] <= limit[who][:, None]
            some = by_parent.any(1)
            who, by_parent = who[some], by_parent[some]
            if len(who):
                bound = np.maximum(distances(x[who], self.x[i:j]) - self.radius[None, i:j], 0)
                out[who, i:j] = np.where(by_parent & (bound <= limit[who][:, None]), bound, np.inf)
                done += int(by_parent.sum())
        return out, done


def top_k(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    subtree: int = SUBTREE, page: int = PAGE, counted: Accumulator | None = None,
) -> DataFrame:
    """(vec_id, rank, neighbor, distance) of the k nearest other vectors of every query, exactly; distance to 6 places.

    queries: rows like those of vectors, all of them if not given. Ties in distance (to 9 places) go to the lesser id. Rows
    whose id or vector is null, whose vector is empty, holds a null, NaN or infinity, or isn't of the vectors' commonest
    length, are left out; repeated rows count once; an id with several vectors is a query for each; neighbours of one's own id
    never count. With fewer than k others all are given; an empty table gives an empty result; further columns don't matter.

    Of equal vectors only the k + 1 least ids can be anyone's neighbours, so no more enter the tree, however many rows share
    one vector. counted: gets the number of distances computed.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    schema = "vec_id bigint, rank int, neighbor bigint, distance double"
    base = usable(vectors, id_col, vec_col)
    sizes = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n = sizes[0]
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    rows = base.where(F.size("v") == dim).withColumn("copy", place).where(F.col("copy") <= k + 1).select("id", "v").distinct()
    asked = cut(usable(queries if queries is not None else vectors, id_col, vec_col).where(F.size("v") == dim).distinct()).withColumn("q", F.monotonically_increasing_id())

    number = max(1, min(-(-n // subtree), ROUTING_BYTES // (8 * dim)))
    size = max(subtree, -(-n // number))
    drawn = base.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id", "v").limit(number).select("v").toArrow()
    routing = np.unique(_matrix(drawn.column("v").combine_chunks(), dim), axis=0)
    upper = build(np.arange(len(routing)), routing, page)
    sent = sc.broadcast((upper["x"], upper["bounds"], upper["routing"]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Down to the nearest page of routing objects, and the nearest object there."""
        objects, bounds, above = sent.value
        for b in batches:
            x, part = _matrix(b.column("v"), dim), np.zeros(b.num_rows, np.int64)
            at = np.concatenate([np.argmin(distances(x[i : i + 4096], above), axis=1) for i in range(0, len(x), 4096)]) if len(x) else part
            for p in np.unique(at):
                own = np.flatnonzero(at == p)
                part[own] = bounds[p] + np.argmin(distances(x[own], objects[bounds[p] : bounds[p + 1]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column("id"), b.column("v")], ["part", "id", "v"])

    assigned = cut(rows.mapInArrow(assign, "part bigint, id bigint, v array<float>"))
    # a crowded routing object gives several subtrees
    chunks = F.broadcast(assigned.groupBy("part").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("chunks")))  # a row an object
    tree = (F.col("part") * (1 << 32) + F.pmod(F.xxhash64("id", "v"), F.col("chunks"))).alias("tree")
    split = assigned.join(chunks, "part").select(tree, "id", "v")

    def plant(key: tuple, t: pa.Table) -> pa.Table:
        ids, v = t.column("id").combine_chunks(), t.column("v").combine_chunks()
        one = build(ids.to_numpy(), _matrix(v, dim), page)
        spans = list(zip(one["bounds"], one["bounds"][1:]))
        raw = lambda a: a.tobytes()
        return pa.table({
            "tree": [key[0].as_py()] * len(spans), "page": list(range(len(spans))), "center": [raw(one["center"])] * len(spans), "radius": [float(one["radius"])] * len(spans),
            "routing": [raw(r) for r in one["routing"]], "cover": one["cover"], "parent": one["parent"],
            "ids": [raw(one["ids"][i:j]) for i, j in spans], "x": [raw(one["x"][i:j].astype(np.float32)) for i, j in spans], "entry": [raw(one["entry"][i:j]) for i, j in spans],
        })

    kinds = "tree bigint, page bigint, center binary, radius double, routing binary, cover double, parent double, ids binary, x binary, entry binary"
    pages = cut(split.groupBy("tree").applyInArrow(plant, kinds))
    top = pages.where("page = 0").select("tree", "center", "radius").orderBy("tree").toArrow()  # 2 * number, at most
    heads = sc.broadcast(Heads(top.column("tree").to_numpy(), np.frombuffer(b"".join(top.column("center").to_pylist()), np.float64).reshape(-1, dim), top.column("radius").to_numpy(), page))

    def visits(lo: int, hi: int | None):
        """For each query the subtrees lo to hi in order of least possible distance, as far as its k-th distance doesn't rule them out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h: Heads = heads.value
            for b in batches:
                x, worst = _matrix(b.column("v"), dim), np.array([w if w is not None else np.inf for w in b.column("worst").to_pylist()])
                for i in range(0, len(x), 128):
                    bound, done = h.least(x[i : i + 128], worst[i : i + 128])
                    if counted is not None:
                        counted.add(done)
                    # places in order of (bound, head) are the same in every round: what a bound rules out comes last
                    order = np.argsort(bound, axis=1, kind="stable")[:, lo:hi]
                    who, c = np.nonzero(np.isfinite(np.take_along_axis(bound, order, 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(h.names[order[who, c]]), b.column("q").take(pa.array(who + i))], ["tree", "q"])

        return run

    def search(key: tuple, p: pa.Table, a: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "neighbor": pa.array([], pa.int64())})
        if not p.num_rows or not a.num_rows:
            return none
        p = p.sort_by("page")
        read = lambda c, kind: np.frombuffer(b"".join(p.column(c).to_pylist()), kind)
        ids = read("ids", np.int64)
        one = {
            "ids": ids, "x": read("x", np.float32).astype(np.float64).reshape(-1, dim), "entry": read("entry", np.float64), "routing": read("routing", np.float64).reshape(-1, dim),
            "cover": p.column("cover").to_numpy(), "parent": p.column("parent").to_numpy(), "center": np.frombuffer(p.column("center")[0].as_py(), np.float64), "radius": p.column("radius")[0].as_py(),
            "bounds": np.cumsum([0, *(len(x) // 8 for x in p.column("ids").to_pylist())]),
        }
        best = Best(a.column("id").to_numpy(), _matrix(a.column("v").combine_chunks(), dim), k)
        worst = np.array([w if w is not None else np.inf for w in a.column("worst").to_pylist()])
        best.d[:] = np.where(np.isfinite(worst), worst, np.inf)[:, None]  # no more than this, from elsewhere; ties go by id later
        best.d[np.isfinite(worst)] += SLACK
        done = best.search(one)
        if counted is not None:
            counted.add(done)
        r, c = np.nonzero(np.isfinite(best.d) & (best.n < np.iinfo(np.int64).max))
        return pa.table({"q": a.column("q").to_numpy()[r], "d": best.d[r, c], "neighbor": best.n[r, c]}) if len(r) else none

    found = spark.createDataFrame([], "q bigint, d double, neighbor bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "neighbor"))
    edges = np.cumsum([0, *ROUNDS]).tolist()
    for lo, hi in zip(edges, [*edges[1:], None]):
        worst = found.groupBy("q").agg(F.when(F.count("*") >= k, F.max("d")).alias("worst"))
        state = asked.join(worst, "q", "left") if lo else asked.withColumn("worst", F.lit(None).cast("double"))
        to = cut(state.select("q", "v", "worst").mapInArrow(visits(lo, hi), "tree bigint, q bigint"))
        blocks = F.broadcast(to.groupBy("tree").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("blocks")))  # a row a subtree
        left = pages.join(blocks, "tree").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = to.join(blocks, "tree").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).join(state, "q").select("tree", "block", "q", "id", "v", "worst")
        new = left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(search, "q bigint, d double, neighbor bigint")
        found = cut(found.unionByName(new).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
    named = found.withColumn("rank", rank).join(asked.select("q", "id"), "q")
    return named.select(F.col("id").alias("vec_id"), "rank", "neighbor", (F.floor(F.col("d") * 1e6 + 0.5) / 1e6).alias("distance"))


#: The query's rows: of the vectors whose id is divisible by 100, against all.
SQL = """
with v as (select distinct vec_id, embedding::double[] as e from embeddings where vec_id is not null and len(embedding) > 0),
d as (select a.vec_id, a.e, b.vec_id as neighbor, round(list_distance(a.e, b.e), 9) as d from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select vec_id, cast(row_number() over (partition by vec_id, e order by d, neighbor) as integer) as rank, neighbor, d from d)
select vec_id, rank, neighbor, floor(d * 1e6 + 0.5) / 1e6 as distance from r where rank <= 10
"""
