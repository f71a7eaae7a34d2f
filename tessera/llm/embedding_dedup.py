"""Embedding near-duplicates by sorted projection passes.

In each pass every vector gets random hashes (the axis, of a random rotation, it is nearest to), and vectors are ordered
lexicographically by the concatenated hashes. Each vector is compared with the WINDOW next ones, and all vectors of a run,
those equal in their first hashes, with each other: a run longer than a window is compared exactly, in blocks, so nothing
hangs on how dense the neighbourhood is. Cosines are decided in double precision. Each block gives a forest of the links
it found, and the forests of all passes are united to components.

Two vectors meet in a pass if their first hashes agree, which depends on the angle between them only. The probability at
the threshold is measured on random pairs, and there are as many passes as leave a link of that angle unmet with a
probability of MISS (links of smaller angles far more rarely). How many hashes name a run is chosen by cost: more of them make
runs shorter and passes more numerous as tables grow, so work stays below the square of the table.

Links are then counted exactly within each component: its vectors lie in blocks in the order of the first pass, and a pair
of blocks is compared only if the angles between and around the blocks' centres don't say that all or none of its pairs
link. What is lost is a link that no pass met and that alone joins two components; the tests measure how many by angle.

The order is total (hashes, then vector), so results don't depend on how rows are partitioned. Equal vectors are one class
with a count and are compared once.

Defined results: null, empty and zero vectors and those with null or non-finite components link with nothing, not even
copies of themselves, and are components of their own. Vectors of different lengths never link; a cosine of exactly 0.9
does. Each row counts as a vector, so repeated rows link with each other. A null vec_id is kept as null and never is a
component's id unless all its ids are null. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import acos, ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import components, forget, global_rank, load, saved

COSINE = 0.9
WINDOW, BLOCK = 24, 2048
#: Probability that no pass meets a link at the threshold, and hashes of a key beside those that name a run.
MISS, MORE_HASHES = 1e-4, 2
#: Passes whose rows are in the exchange at one time.
AT_ONCE = 8
SEED = 20_260


def _packed(x: np.ndarray) -> bytes:
    """A vector's components, as single precision where that holds them exactly."""
    small = x.astype("<f4")
    return b"4" + small.tobytes() if (small == x).all() else b"8" + x.astype("<f8").tobytes()


def _dims(vecs) -> np.ndarray:
    return np.array([(len(v) - 1) // (4 if v[:1] == b"4" else 8) for v in vecs], np.int64)


def _unit(vecs) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length in double precision, and their norms."""
    x = np.stack([np.frombuffer(v, "<f4" if v[:1] == b"4" else "<f8", offset=1).astype("<f8") for v in vecs])
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def _linked(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Which of the first vectors link with which of the second."""
    cos = (x / nx[:, None]) @ (y / ny[:, None]).T
    hit = cos >= COSINE
    for r, k in zip(*np.nonzero(np.abs(cos - COSINE) < 1e-12)):  # decided by one formula, whatever the blocks
        hit[r, k] = x[r] @ y[k] / (nx[r] * ny[k]) >= COSINE
    return hit


def _unite(label: np.ndarray, hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
    """Unite in place the labels of rows with those of the columns they hit."""
    for r in np.flatnonzero(hit.any(1)):
        met = label[cols[hit[r]]]
        if (met != label[rows[r]]).any():
            met = np.unique(np.append(met, label[rows[r]]))
            label[np.isin(label, met)] = met[0]


def _classes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(vec_id, id) and classes(id, n, least, vec): id is a digest of the components, null for vectors that can't link."""

    def read(batches):
        for pdf in batches:
            ids, vecs = [], []
            for e in pdf["e"]:
                x = np.array([np.nan if v is None else v for v in e], "<f8") if e is not None else np.zeros(0)
                ok = len(x) and np.isfinite(x).all() and x.any() and np.isfinite(x @ x) and x @ x > 0
                vecs.append(_packed(x) if ok else None)
                ids.append(hashlib.md5(x.tobytes()).digest() if ok else None)
            yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64"), "id": ids, "vec": vecs})

    base = saved(embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e")).mapInPandas(read, "vec_id long, id binary, vec binary"), "vectors")
    classes = saved(base.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vec").alias("vec")), "classes")
    return base.select("vec_id", "id"), classes


def _hashes(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The signed axis of largest size of each vector under each rotation of g (hashes, dims, axes)."""
    p = np.einsum("nd,hda->nha", x, g, optimize=True)
    axis = np.abs(p).argmax(2)
    return 2 * axis + (np.take_along_axis(p, axis[:, :, None], 2)[:, :, 0] > 0)


def _rotations(dims: int, turn: int, hashes: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims, turn]).standard_normal((hashes, dims, max(2, dims)))


@lru_cache(maxsize=None)
def meeting(dims: int, cosine: float = COSINE) -> float:
    """How often two vectors of that cosine agree in one hash, measured on random pairs."""
    rng, agree = np.random.default_rng([SEED, dims]), []
    for _ in range(4):
        u, v = rng.standard_normal((2, 2000, dims))
        u /= np.sqrt((u * u).sum(1))[:, None]
        v -= (v * u).sum(1)[:, None] * u
        v /= np.maximum(np.sqrt((v * v).sum(1)), 1e-300)[:, None]
        g = rng.standard_normal((1, dims, max(2, dims)))
        agree.append(np.mean(_hashes(u, g) == _hashes(cosine * u + (1 - cosine**2) ** 0.5 * v, g)))
    return float(np.clip(np.mean(agree), 0.05, 0.95))


def plan(rows: int, dims: int, miss: float = MISS) -> tuple[int, int]:
    """(hashes of a run, passes) of least cost: what is exchanged, and what is compared in runs of spread vectors."""

    def cost(k: int) -> tuple[float, int]:
        passes = ceil(log(miss) / log(1 - meeting(dims) ** k))
        return passes * (1 + rows / (2 * max(2, dims)) ** k / BLOCK), passes

    k = min(range(1, 9), key=lambda k: cost(k)[0])
    return k, cost(k)[1]


def _keys(classes: DataFrame, dims: int, turns: range, hashes: int) -> DataFrame:
    """(turn, run, key, id): each class's concatenated hashes in each of the passes; run is the first `hashes` of them."""

    def run(batches):
        rotations = [_rotations(dims, t, hashes + MORE_HASHES) for t in turns]
        for pdf in batches:
            x, norm = _unit(pdf["vec"])
            for turn, g in zip(turns, rotations):
                keys = [k.tobytes() for k in _hashes(x / norm[:, None], g).astype(">u2")]
                yield pd.DataFrame({"turn": turn, "run": [k[: 2 * hashes] for k in keys], "key": keys, "id": pdf["id"]})

    return classes.select("id", "vec").mapInPandas(run, "turn int, run binary, key binary, id binary")


def _met(classes: DataFrame, dims: int, turns: range, hashes: int, window: int, rows: int = 0) -> DataFrame:
    """(a, b): a forest, for each block and pair of blocks, of the links met in the passes."""
    ranked = global_rank(_keys(classes, dims, turns, hashes), ["turn", "key", "id"], "place", rows * len(turns)).select("turn", "run", "id", "place")
    block = F.floor(F.col("place") / BLOCK).cast("long")
    # The first rows of a block are also the last of the block before: their windows end there.
    two = F.when((F.col("place") % BLOCK < window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    one = ranked.withColumn("i", F.explode(two)).select("turn", "run", "id", "place", "i", F.lit(-1).cast("long").alias("j"))
    # Runs over several blocks: each pair of their blocks meets once.
    ends = ranked.groupBy("turn", "run").agg(F.floor(F.min("place") / BLOCK).alias("_lo"), F.floor(F.max("place") / BLOCK).alias("_hi")).where("_lo < _hi")
    more = ranked.join(ends, ["turn", "run"]).withColumn("_b", block).withColumn("_o", F.explode(F.sequence("_lo", "_hi"))).where("_o <> _b")
    more = more.select("turn", "run", "id", "place", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"))
    dealt = one.unionByName(more).join(classes.select("id", "vec"), "id")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        x, norm = _unit(pdf["vec"])
        label, every = np.arange(len(pdf)), np.arange(len(pdf))

        def meet(rows, cols):
            for s in range(0, len(rows), 512):
                r = rows[s : s + 512]
                _unite(label, _linked(x[r], norm[r], x[cols], norm[cols]), r, cols)

        if key[1] >= 0:
            first = (pdf["place"] // BLOCK == key[0]).to_numpy()
            for _, at in pdf.groupby(["turn", "run"]).indices.items():
                meet(at[first[at]], at[~first[at]])
        else:
            for _, at in pdf.groupby(["turn", "run"]).indices.items():
                if len(at) > 1:
                    meet(at, at)
            turn = pdf["turn"].to_numpy()
            for k in range(1, min(window, len(pdf) - 1) + 1):
                cos = np.einsum("ij,ij->i", x[:-k], x[k:]) / (norm[:-k] * norm[k:])
                for i in np.flatnonzero((cos >= COSINE) & (turn[:-k] == turn[k:])):
                    if label[i] != label[i + k]:
                        label[label == label[i + k]] = label[i]
        ids = pdf["id"].to_numpy()
        out = pd.DataFrame({"a": ids[label], "b": ids})
        return out[label != every]

    # A number of partitions is given because groups are small in bytes and large in work: AQE would make them few tasks.
    dealt = dealt.repartition(_tasks(classes), "i", "j")
    found = saved(dealt.groupBy("i", "j").applyInPandas(compare, "a binary, b binary").where("a <> b").distinct(), "met")
    forget(ranked)
    return found


def _tasks(df: DataFrame) -> int:
    """Tasks for work on blocks: a shuffle's partitions, and more where the table has more blocks."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // (16 * BLOCK))


def met(classes: DataFrame, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """(a, b): links of all passes, enough of them to connect all that met."""
    out = classes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    sized = classes.withColumn("dims", F.when(F.substring("vec", 1, 1) == F.lit(b"4"), (F.octet_length("vec") - 1) / 4).otherwise((F.octet_length("vec") - 1) / 8).cast("int"))
    # One row for each length of vectors.
    for r in sized.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect():
        hashes, passes = plan(r["n"], r["dims"], miss)
        mine = sized.where(F.col("dims") == r["dims"])
        for t in range(0, passes, AT_ONCE):
            out = out.unionByName(_met(mine, r["dims"], range(t, min(passes, t + AT_ONCE)), hashes, window, r["n"]))
    return out


def _links(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, links): vectors of other classes each class links with, all in its component."""
    m = roots.join(classes.select("id", "n", "vec"), "id")

    def order(batches):
        for pdf in batches:
            dims, key = _dims(pdf["vec"]), np.empty(len(pdf), object)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x, norm = _unit(pdf["vec"].to_numpy()[at])
                key[at] = [k.tobytes() for k in _hashes(x / norm[:, None], _rotations(int(d), 0, 1 + MORE_HASHES)).astype(">u2")]
            yield pd.DataFrame({"root": pdf["root"], "id": pdf["id"], "key": key})

    ranked = global_rank(m.select("root", "id", "vec").mapInPandas(order, "root binary, id binary, key binary"), ["root", "key", "id"], "place")
    start = ranked.groupBy("root").agg(F.min("place").alias("_s"))
    ranked = ranked.join(start, "root").select("id", F.floor((F.col("place") - F.col("_s")) / BLOCK).cast("int").alias("block"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, norm = _unit(pdf["vec"])
        u = x / norm[:, None]
        mean = u.mean(0)
        length = np.sqrt(mean @ mean)
        centre = mean / length if length > 1e-9 else u[0]
        width = float(np.arccos(np.clip(u @ centre, -1, 1)).max())
        n = pdf["n"].to_numpy("<i8")
        one = {"root": key[0], "block": key[1], "ids": b"".join(pdf["id"]), "n": n.tobytes(), "vecs": x.astype("<f8").tobytes(), "centre": centre.tobytes(), "width": width, "total": int(n.sum())}
        return pd.DataFrame([one])

    blocks = saved(m.join(ranked, "id").groupBy("root", "block").applyInPandas(pack, "root binary, block int, ids binary, n binary, vecs binary, centre binary, width double, total long"), "blocks")
    slim = blocks.select("root", "block", "centre", "width", "total")
    two = slim.select("root", F.col("block").alias("i"), F.col("centre").alias("ci"), F.col("width").alias("wi"), F.col("total").alias("ti"))
    two = two.join(slim.select("root", F.col("block").alias("j"), F.col("centre").alias("cj"), F.col("width").alias("wj"), F.col("total").alias("tj")), "root").where("i <= j")

    def bound(batches):
        limit = acos(COSINE)
        for pdf in batches:
            far = np.array([np.arccos(np.clip(np.frombuffer(a) @ np.frombuffer(b), -1, 1)) for a, b in zip(pdf["ci"], pdf["cj"])])
            around = pdf["wi"].to_numpy() + pdf["wj"].to_numpy()
            how = np.where(far + around < limit - 1e-6, "all", np.where(far - around > limit + 1e-6, "none", "some"))
            yield pd.DataFrame({"root": pdf["root"], "i": pdf["i"], "j": pdf["j"], "ti": pdf["ti"], "tj": pdf["tj"], "how": how})

    two = saved(two.mapInPandas(bound, "root binary, i int, j int, ti long, tj long, how string").where("how <> 'none'"), "bounds")
    whole = two.where("how = 'all'").select("root", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.col("tj").alias("more"), F.lit(1).alias("self")))).otherwise(F.array(F.struct(F.col("i").alias("block"), F.col("tj").alias("more"), F.lit(0).alias("self")), F.struct(F.col("j").alias("block"), F.col("ti").alias("more"), F.lit(0).alias("self"))))).alias("x"))
    whole = whole.groupBy("root", F.col("x.block").alias("block")).agg(F.sum("x.more").alias("more"), F.max("x.self").alias("self"))

    def spread(batches):
        for pdf in batches:
            for ids, n, more, self in zip(pdf["ids"], pdf["n"], pdf["more"], pdf["self"]):
                k = np.frombuffer(n, "<i8")
                yield pd.DataFrame({"id": [ids[t : t + 16] for t in range(0, len(ids), 16)], "links": more - self * k})

    out = blocks.select("root", "block", "ids", "n").join(whole, ["root", "block"]).mapInPandas(spread, "id binary, links long")
    side = lambda x: blocks.select("root", F.col("block").alias(x), F.col("ids").alias(f"ids_{x}"), F.col("n").alias(f"n_{x}"), F.col("vecs").alias(f"vecs_{x}"))
    some = two.where("how = 'some'").select("root", "i", "j").join(side("i"), ["root", "i"]).join(side("j"), ["root", "j"])

    def count(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                n, k = np.frombuffer(r.n_i, "<i8"), np.frombuffer(r.n_j, "<i8")
                x, y = np.frombuffer(r.vecs_i).reshape(len(n), -1), np.frombuffer(r.vecs_j).reshape(len(k), -1)
                nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
                mine, theirs = np.zeros(len(n), np.int64), np.zeros(len(k), np.int64)
                for s in range(0, len(n), 512):
                    hit = _linked(x[s : s + 512], nx[s : s + 512], y, ny)
                    if r.i == r.j:
                        at = np.arange(len(hit))
                        hit[at, s + at] = False
                    mine[s : s + 512] = hit @ k
                    if r.i != r.j:
                        theirs += n[s : s + 512] @ hit
                for ids, links in ((r.ids_i, mine), (r.ids_j, theirs)):
                    if links.any():
                        yield pd.DataFrame({"id": [ids[t : t + 16] for t in range(0, len(ids), 16)], "links": links})

    # Few large rows: a number of partitions is given for the work they are.
    some = some.repartition(_tasks(classes)).mapInPandas(count, "id binary, links long")
    return out.unionByName(some).groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(embeddings: DataFrame, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding)."""
    rows, classes = _classes(embeddings)
    roots = saved(components(met(classes, window, miss)), "roots")
    links = saved(_links(classes, roots), "links")
    least = roots.join(classes.select("id", "least"), "id").groupBy("root").agg(F.min("least").alias("_least"))
    per = classes.select("id", "n", "least").join(roots, "id", "left").join(least, "root", "left").join(links, "id", "left")
    per = per.select("id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("_least", "least").alias("component_id"))
    out = rows.join(per, "id", "left")
    alone = F.col("n_links").isNull()
    comp = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))


#: All links, by a self-join.
SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT r.a, min(v.vec_id) AS least FROM r JOIN v ON v.r = r.b GROUP BY r.a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least(m.least, v.vec_id), v.vec_id) AS component_id, v.vec_id = coalesce(least(m.least, v.vec_id), v.vec_id) AS kept
FROM v LEFT JOIN m ON m.a = v.r LEFT JOIN n ON n.a = v.r
"""
