"""Nearest neighbours by inner product: a navigable small-world graph for each shard, results merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def _top(sims, ids, n: int):
    """The n best columns of each row, best first."""
    import numpy as np

    if sims.shape[1] > 2 * n:
        part = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        sims, ids = np.take_along_axis(sims, part, 1), np.take_along_axis(ids, part, 1)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)


def _beam(x, graph, queries, entry, ef: int, wide: int | None = None):
    """Best-first search of one layer for many queries at once: (sims, ids), `ef` columns, best first, -1 where empty.

    A step expands the best `wide` nodes of each beam; wide beams take more of them, so that the number of steps stays.
    """
    import numpy as np

    wide = wide or max(4, ef // 12)
    q, n = len(queries), len(graph)
    rows = np.arange(q)[:, None]
    seen = np.zeros(q * n, bool)
    ids = np.full((q, ef), -1, np.int64)
    sims = np.full((q, ef), -np.inf, np.float32)
    done = np.ones((q, ef), bool)
    ids[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.einsum("qd,qkd->qk", queries, x[entry])
    done[:, : entry.shape[1]] = False
    seen[rows * n + entry] = True
    while True:
        live = np.flatnonzero(~done.all(axis=1))
        if not len(live):
            return sims, ids
        # The best `wide` entries of each beam that are still to be expanded.
        todo = ~done[live]
        todo &= np.cumsum(todo, axis=1) <= wide
        at, col = np.nonzero(todo)
        done[live[at], col] = True
        at = live[at]
        nb = graph.take(ids[at, col], axis=0)
        # Pairs of query and node as one number, in order; a node that two of them share is taken once.
        key = np.repeat(at * np.int64(n), nb.shape[1])
        nb = nb.ravel()
        key += nb
        key = key[nb >= 0]
        key = key[~seen.take(key)]
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
        seen[key] = True
        src = key // n
        nb = key - src * n
        s = np.einsum("md,md->m", queries.take(src, axis=0), x.take(nb, axis=0))
        ok = s > sims[:, -1].take(src)
        src, nb, s = src[ok], nb[ok], s[ok]
        if not len(src):
            continue
        count = np.bincount(src, minlength=q)
        m = np.flatnonzero(count)
        place = np.arange(len(src)) - np.repeat((np.cumsum(count) - count)[m], count[m])
        new_s, new_i = np.full((len(m), count.max()), -np.inf, np.float32), np.full((len(m), count.max()), -1, np.int64)
        row = np.repeat(np.arange(len(m)), count[m])
        new_s[row, place], new_i[row, place] = s, nb
        all_s, all_i = np.concatenate([sims[m], new_s], 1), np.concatenate([ids[m], new_i], 1)
        all_d = np.concatenate([done[m], new_i < 0], 1)
        order = np.argsort(-all_s, axis=1)[:, :ef]
        sims[m], ids[m], done[m] = (np.take_along_axis(a, order, 1) for a in (all_s, all_i, all_d))


def _diverse(x, sims, ids, most: int):
    """Of candidates (best first) those nearer to the node than to any taken before; then the best of the others, up to `most`."""
    import numpy as np

    q, c = ids.shape
    v = x[np.maximum(ids, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    taken, n = np.zeros((q, c), bool), np.zeros(q, int)
    for j in range(c):
        ok = (ids[:, j] >= 0) & (n < most) & ~((between[:, j, :] > sims[:, j, None]) & taken).any(axis=1)
        taken[:, j] = ok
        n += ok
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    if c < most:
        out = np.concatenate([out, np.full((q, most - c), -1, ids.dtype)], 1)
    return out


def _link_back(x, graph, new, chosen, extra: int = 32):
    """Add the new nodes to the lists of those they chose; a list that overflows is chosen anew, to three quarters, so that the next ones find room."""
    import numpy as np

    src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    if not len(dst):
        return
    s = np.einsum("kd,kd->k", x[src], x[dst])
    order = np.lexsort((-s, dst))
    src, dst = src[order], dst[order]
    nodes, first = np.unique(dst, return_index=True)
    place = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
    more = np.full((len(nodes), extra), -1, np.int64)
    ok = place < extra
    more[np.searchsorted(nodes, dst[ok]), place[ok]] = src[ok]
    degree = graph.shape[1]
    for k in range(0, len(nodes), 2048):
        at = nodes[k : k + 2048]
        both = np.concatenate([graph[at], np.where((more[k : k + 2048, :, None] == graph[at][:, None, :]).any(axis=2), -1, more[k : k + 2048])], 1)
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        full = (both >= 0).sum(axis=1) > degree
        graph[at[~full]] = both[~full, :degree]
        for j in range(0, int(full.sum()), 256):
            own, ids = at[full][j : j + 256], both[full][j : j + 256]
            ids = ids[:, (ids >= 0).any(axis=0)]
            sims = np.einsum("qd,qkd->qk", x[own], x[np.maximum(ids, 0)])
            sims[ids < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")
            best = _diverse(x, np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1), degree - degree // 4)
            graph[own] = -1
            graph[own[:, None], np.arange(best.shape[1])] = best


def _raise_norms(v):
    """Vectors with one more component that makes all norms equal: nearness by inner product and by distance then agree."""
    import numpy as np

    norms = (v.astype(np.float64) ** 2).sum(axis=1)
    return np.concatenate([v, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], 1).astype(np.float32)


def build_graph(vectors, m: int = 24, ef: int = 32, seed: int = 0) -> dict:
    """The hierarchy over the rows of `vectors`: sizes of the layers and one flat neighbour array for each.

    Row k of a permutation lies in layers 0 to its level; levels fall geometrically, so each layer is the start of
    the permutation.  Layers are built from the top; nodes join in batches by a search of what is there already.
    The last column of layer 0 links each row to the next one, so that every row can be reached from any other and a
    beam as wide as the shard finds the exact answer.
    """
    import numpy as np

    n = len(vectors)
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(n)) / np.log(m)).astype(int)
    perm = np.argsort(-level, kind="stable")
    x = _raise_norms(np.asarray(vectors))[perm]
    sizes = [int((level >= k).sum()) for k in range(level.max() + 1)] if n else [0]
    graphs: list = [None] * len(sizes)
    for k in range(len(sizes) - 1, -1, -1):
        size, degree = sizes[k], m if k else 2 * m
        g = np.full((size, degree), -1, np.int32)
        start = min(size, 512)
        s = x[:start] @ x[:start].T
        np.fill_diagonal(s, -np.inf)
        if start > 1:
            c = min(start - 1, ef)
            sims, ids = _top(s, np.broadcast_to(np.arange(start), s.shape), c)
            g[:start] = _diverse(x, sims, ids, degree)
            _link_back(x, g, np.arange(start), g[:start].astype(np.int64))
        while start < size:
            end = min(size, start + min(512, start))
            q = x[start:end]
            entry = _descend(x, graphs, q, k)
            entry = np.where(entry < start, entry, entry % start)
            sims, ids = _beam(x, g[:start], q, entry, ef)
            chosen = _diverse(x, sims, ids, degree)
            g[start:end] = chosen
            _link_back(x, g, np.arange(start, end), chosen[:, :m])
            start = end
        graphs[k] = g
    if n:
        graphs[0] = np.concatenate([graphs[0], ((np.arange(n, dtype=np.int32) + 1) % n)[:, None]], 1)
    return {"perm": perm, "x": x, "sizes": sizes, "graphs": graphs}


def _descend(x, graphs, queries, to: int):
    """An entry for each query into layer `to`, by greedy search of the layers above."""
    import numpy as np

    entry = np.zeros((len(queries), 1), np.int64)
    for k in range(len(graphs) - 1, to, -1):
        entry = _beam(x, graphs[k], queries, entry, 4, 2)[1][:, :1]
    return entry


def search_graph(index: dict, queries, ef: int):
    """(sims, rows of the permutation) of the `ef` nearest found for each query, best first."""
    import numpy as np

    q = np.concatenate([np.asarray(queries, np.float32), np.zeros((len(queries), 1), np.float32)], 1)
    return _beam(index["x"], index["graphs"][0], q, _descend(index["x"], index["graphs"], q, 0), ef)


def calibrate(index: dict, k: int, aim: float = 0.95, probes: int = 128) -> int:
    """The beam width at which the graph finds `aim` of the k nearest of probe rows, against a scan of the shard; as wide as the shard if need be."""
    import numpy as np

    x, n = index["x"], len(index["x"])
    at = np.unique(np.linspace(0, n - 1, min(n, probes)).astype(int))
    q = x[at].copy()
    q[:, -1] = 0
    most = min(k, n)
    exact = np.sort(q @ x.T, axis=1)[:, -most][:, None] - 1e-6
    ef = max(64, 3 * k)
    while ef < n:
        sims, _ = search_graph(index, q[:, :-1], ef)
        if np.minimum((sims >= exact).sum(axis=1), most).mean() >= aim * most:
            return ef
        ef += ef // 2
    return n


def find_cells(sample, cells: int, top: float, k: int, aim: float = 0.98, rounds: int = 8, seed: int = 0):
    """(centres, cells to look into) from a bounded sample of vectors, whose largest squared norm is `top`.

    Centres are means of the sample with raised norms, by Lloyd's rounds.  A query looks into as many cells as it takes
    to meet `aim` of the k nearest of probe rows in the sample; nearer neighbours than a sample holds are easier to meet.
    """
    import numpy as np

    v = np.asarray(sample, np.float64)
    x = np.concatenate([v, np.sqrt(np.maximum(top - (v**2).sum(axis=1), 0))[:, None]], 1).astype(np.float32)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        own = (x @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
    own = (x @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
    at = np.unique(np.linspace(0, len(x) - 1, min(len(x), 256)).astype(int))
    q = x[at].copy()
    q[:, -1] = 0
    sims = q @ x.T
    sims[np.arange(len(at)), at] = -np.inf
    near = own[np.argsort(-sims, axis=1)[:, : min(k, len(x) - 1)]]
    rank = np.argsort(np.argsort(-(q @ c.T - (c**2).sum(axis=1) / 2), axis=1), axis=1)
    need = np.take_along_axis(rank, near, 1).ravel() if near.size else np.zeros(1, int)
    found = np.cumsum(np.bincount(need, minlength=len(c))) / len(need)
    return c, int(np.searchsorted(found, aim - 1e-12)) + 1


def nearest(embeddings: DataFrame, is_query=None, k: int = 20, shard_rows: int = 65_536, block_rows: int = 2048, sample_rows: int = 16_384, m: int = 24, ef: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query row among all other rows.

    Nearness is the inner product.  Rows lie in cells around centres, which are fitted on a sample of at most `sample_rows`
    vectors; cells of more than about `shard_rows` rows are split by hash, and each shard is indexed by one task as flat
    neighbour arrays, which are written to the shared checkpoint folder.  Queries (a condition; by default ids divisible by
    20) go to the shards of the cells next to them, as many as the sample says (find_cells), and search there in blocks of about
    `block_rows`, so no task holds more than one shard and one block; an index is copied only for a shard that more queries than
    a block holds come to, and costs little beside their searches.  The beam of each shard is widened until probes against
    a scan of the shard reach a recall of 0.95, up to the whole shard.  The shards' k nearest are merged;
    scores are sums of products in double precision, in order of the components; ties go to the smaller id.

    Vectors null, empty, zero or with null or non-finite components take no part, neither do rows with a null id.
    Rows repeating an id are rows of their own: each is a candidate for all rows but itself, and each query row has its
    own k (query_id is then repeated).  Of equal vectors only the k + 1 smallest ids can be among the k nearest, and only they are
    indexed; equal vectors of a shard are one node of its graph, so copies in any number crowd out nothing.  Only vectors
    of as many components as the query's are compared.  With fewer candidates than k, all are returned; an empty table
    gives no rows; other columns are not read.
    """
    double = "double" in embeddings.schema[vector_col].dataType.simpleString()
    query = (F.col("id") % 20 == 0) if is_query is None else is_query
    good = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    good = good.where(F.coalesce(finite, F.lit(False)))
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    good = cut(good.select(F.monotonically_increasing_id().alias("row"), "id", "v", F.size("v").alias("dim"), norm.alias("norm"), query.alias("q")))
    dtype = "float64" if double else "float32"
    # Dimensions of more rows than a shard: there are no more of them than shards.
    large = good.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).where(F.col("n") > shard_rows).collect()
    routes = {}
    for r in large:
        unit = F.shiftrightunsigned(F.xxhash64("row", F.lit("sample")), 1) / F.lit(float(1 << 63))
        some = good.where((F.col("dim") == r.dim) & (unit < 2.0 * sample_rows / r.n)).select("row", "v").limit(sample_rows).collect()
        routes[r.dim] = (*find_cells([x.v for x in sorted(some, key=lambda x: x.row)], -(-r.n // shard_rows), r.top, k), r.top)

    def cells(pdf_v, dim, raised, most):
        """The `most` nearest cells of each vector, nearest first."""
        import numpy as np

        c, _, top = routes[dim]
        v = np.array(pdf_v.tolist(), np.float64)
        last = np.sqrt(np.maximum(top - (v**2).sum(axis=1), 0)) if raised else np.zeros(len(v))
        d = np.concatenate([v, last[:, None]], 1).astype(np.float32) @ c.T - (c**2).sum(axis=1) / 2
        return np.argsort(-d, axis=1, kind="stable")[:, :most]

    def assign(frames):
        for pdf in frames:
            out = [[0]] * len(pdf)
            for dim in set(pdf.dim) & set(routes):
                for i, c in zip(*(lambda own: (own.nonzero()[0], cells(pdf.v[own], dim, True, 1)))((pdf.dim == dim).to_numpy()), strict=True):
                    out[i] = c.tolist()
            yield pdf.assign(cell=[c[0] for c in out])

    def route(frames):
        for pdf in frames:
            out = [[0]] * len(pdf)
            for dim in set(pdf.dim) & set(routes):
                for i, c in zip(*(lambda own: (own.nonzero()[0], cells(pdf.v[own], dim, False, routes[dim][1])))((pdf.dim == dim).to_numpy()), strict=True):
                    out[i] = c.tolist()
            yield pdf.assign(cells=out)

    elem = "double" if double else "float"
    first = Window.partitionBy("v").orderBy("id", "row")
    nodes = good.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).select("row", "id", F.col("v").cast(f"array<{elem}>").alias("v"), "dim")
    nodes = nodes.mapInPandas(assign, f"row bigint, id bigint, v array<{elem}>, dim int, cell int") if routes else nodes.withColumn("cell", F.lit(0))
    nodes = cut(nodes)
    # Cells and the shards that each is split into: about as many rows as there are shards.
    shards = nodes.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / (1.25 * shard_rows)).cast("int").alias("split"))
    nodes = nodes.join(shards, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row"), "split").cast("int"))

    def build(pdf):
        import numpy as np
        import pandas as pd

        # Equal vectors are one node; its ids follow each other, smallest first.
        v, node = np.unique(np.array(pdf.v.tolist(), dtype), axis=0, return_inverse=True)
        index = build_graph(v, m, ef)
        wide = calibrate(index, k)
        perm = index["perm"]
        place = np.empty(len(perm), np.int64)
        place[perm] = np.arange(len(perm))
        node, ids, rows = place[node.ravel()], pdf.id.to_numpy(np.int64), pdf.row.to_numpy(np.int64)
        order = np.lexsort((rows, ids, node))
        counts = np.bincount(node).astype(np.int64)
        one = pdf.iloc[0]
        out = (int(one.dim), int(one.cell), int(one["sub"]), ids[order].tobytes(), rows[order].tobytes(), counts.tobytes(), v[perm].tobytes(), index["x"][:, -1].tobytes(), index["sizes"], [g.tobytes() for g in index["graphs"]], wide)
        return pd.DataFrame([out], columns=["dim", "cell", "sub", "ids", "rows", "counts", "vectors", "last", "sizes", "graphs", "ef"])

    kind = "dim int, cell int, sub int, ids binary, rows binary, counts binary, vectors binary, last binary, sizes array<int>, graphs array<binary>, ef int"
    index = cut(nodes.groupBy("dim", "cell", "sub").applyInPandas(build, kind))
    q = good.where("q").select("row", "id", F.col("v").cast(f"array<{elem}>").alias("v"), "dim")
    q = q.mapInPandas(route, f"row bigint, id bigint, v array<{elem}>, dim int, cells array<int>") if routes else q.withColumn("cells", F.array(F.lit(0)))
    q = cut(q.withColumn("cell", F.explode("cells")).join(shards, ["dim", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("split") - 1))).select("row", "id", "v", "dim", "cell", "sub"))
    loads = cut(q.groupBy("dim", "cell", "sub").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")))
    q = q.join(loads, ["dim", "cell", "sub"]).withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int")).drop("blocks")
    left = index.join(loads, ["dim", "cell", "sub"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(ix, qs):
        import numpy as np
        import pandas as pd

        out = []
        for r in ix.itertuples(index=False) if len(qs) else ():
            ids, rows, counts = (np.frombuffer(x, np.int64) for x in (r.ids, r.rows, r.counts))
            starts, copies = np.cumsum(counts) - counts, np.arange(min(k + 1, counts.max()))
            v = np.frombuffer(r.vectors, dtype).reshape(-1, r.dim)
            x = np.concatenate([v.astype(np.float32), np.frombuffer(r.last, np.float32)[:, None]], 1)
            graphs = [np.frombuffer(g, np.int32).reshape(s, -1) for g, s in zip(r.graphs, r.sizes, strict=True)]
            for begin in range(0, len(qs), 256):
                part = qs.iloc[begin : begin + 256]
                qv = np.array(part.v.tolist(), dtype)
                _, found = search_graph({"x": x, "graphs": graphs}, qv, r.ef)
                # Exact scores of what was found, in double precision and in the order of the components.
                s = np.zeros(found.shape)
                for j in range(r.dim):
                    s += qv[:, j, None].astype(np.float64) * v[np.maximum(found, 0), j].astype(np.float64)
                s[found < 0] = -np.inf
                # The k + 1 best nodes, and of each the k + 1 smallest ids, hold the k best of all other rows.
                order = np.lexsort((ids[starts[np.maximum(found, 0)]], -s), axis=1)[:, : k + 1]
                s, node = np.take_along_axis(s, order, 1), np.maximum(np.take_along_axis(found, order, 1), 0)
                qrow = part.row.to_numpy(np.int64)
                at = np.minimum(starts[node][:, :, None] + copies, len(ids) - 1)
                s = np.where((copies < counts[node][:, :, None]) & (rows[at] != qrow[:, None, None]), s[:, :, None], -np.inf).reshape(len(qrow), -1)
                hit = ids[at].reshape(s.shape)
                order = np.lexsort((hit, -s), axis=1)[:, :k]
                s, hit = np.take_along_axis(s, order, 1), np.take_along_axis(hit, order, 1)
                ok = s > -np.inf
                out.append(pd.DataFrame({"row": np.repeat(qrow, ok.sum(1)), "query_id": np.repeat(part.id.to_numpy(np.int64), ok.sum(1)), "vec_id": hit[ok], "score": s[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    key = ("dim", "cell", "sub", "block")
    found = left.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(search, "row bigint, query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
