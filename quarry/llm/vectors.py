"""Operator 3, embedding near-dedup by sorted projection passes.

Equal vectors form one class. In each pass the classes are ordered lexicographically by concatenated
random hyperplane hashes and each is compared, in double precision, with its neighbours in a bounded
window of that order, over the bounds of tasks too. Pairs that reach NEAR, which is less than the
threshold, are united across all passes into groups, so that a dense crowd below the threshold is one
group. Then the pairs within each group are compared in blocks, so that links and n_links are exact
there whatever the windows saw, and only spanning trees of the links are emitted. That costs the square
of a group's size, dealt out in pairs of blocks; what no pass brought together is missed.

The number of passes follows from the number of classes: two vectors at the threshold meet in a window
if they share about log2(classes / window) leading bits, and there are passes enough that a pair with
nothing else near it is missed once in 1 / MISS times (measured: README). Where vectors crowd together
without reaching NEAR, more bits are shared: the bits that rows a window apart share are counted over all
rows without a near neighbour, and if by these counts more than WORST of such pairs would be missed, as
many further passes follow as bring it down to that. exact=True compares all
classes in blocks after the passes, which is quadratic in their number: it is there to measure recall.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of another dimension are compared only with their like; rows that repeat are vectors
of their own; a null vec_id takes part and is null's component only where no other id is; an empty
table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import components, cut, forest

THRESHOLD, NEAR, MISS, WORST, WINDOW, BITS = 0.95, 0.8, 1e-4, 1e-3, 24, 48
BLOCK, SPAN = 512, 8192  # vectors of a block of a group, and of all classes
LAST = 2**63 - 1


def passes_for(n: int, *, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a lone pair at the threshold among n vectors is missed with probability `miss`."""
    same = 1 - np.arccos(threshold) / np.pi  # how often two such vectors lie on one side of a plane
    met = same ** max(0.0, np.log2(max(1, n) / window))
    return int(np.ceil(np.log(miss) / np.log1p(-min(met, 0.9))))


def passes_by(shared: dict[int, int], passes: int, *, threshold: float = THRESHOLD, worst: float = WORST) -> int:
    """Passes, at least those given, after which `worst` of the pairs at the threshold are missed, where shared
    counts rows by the leading bits that they share with the row a window away."""
    bits = np.array(list(shared), float)
    rows = np.array(list(shared.values()), float)
    met = np.minimum((1 - np.arccos(threshold) / np.pi) ** bits, 0.9)
    missed = lambda p: float(rows @ (1 - met) ** p) > worst * rows.sum()
    if not len(rows) or not missed(passes):
        return passes
    low, high = passes, 2 * passes
    while missed(high):
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if missed(mid) else (low, mid)
    return high


def _unit(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors as float64) for each dimension in an array of vectors without nulls."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    out = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        x = flat[begin[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
        out.append((rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return out


def _planes(dim: int, passes: int, bits: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, passes * bits))


def _project(passes: int, bits: int, seed: int):
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows, x in _unit(batch.column(1)):
                dim = x.shape[1]
                if dim not in planes:
                    planes[dim] = _planes(dim, passes, bits, seed)
                for k in range(0, len(rows), 2048):
                    sign = (x[k : k + 2048] @ planes[dim] > 0).reshape(-1, passes, bits)
                    key = sign @ weights
                    at = pa.array(np.repeat(rows[k : k + 2048], passes))
                    m = key.size
                    which = np.tile(np.arange(passes, dtype=np.int64), len(key))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, dim, np.int64)), pa.array(which), pa.array(key.ravel()), batch.column(0).take(at), batch.column(1).take(at)],
                        names=["dim", "pass", "key", "rep", "v"],
                    )

    return run


def _neighbours(window: int, threshold: float, bits: int, kind: pa.DataType):
    """Streams rows in the order of a pass; yields spanning edges (a, b) of the pairs that reach the
    threshold; with a null, how many rows without such a pair (key) share b leading bits with the row a
    window away; and with both null, the task's first and last `window` rows, for pairs over its bounds."""
    names = ["dim", "pass", "key", "rep", "v"]

    def edges(us, vs) -> pa.RecordBatch:
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *(pa.nulls(len(u), t) for t in (*(pa.int64(),) * 4, kind))], names=["a", "b", *names])

    def ends(table: pa.Table) -> list[pa.RecordBatch]:
        none = pa.nulls(table.num_rows, pa.int64())
        return pa.table([none, none, *(table.column(n).cast(kind if n == "v" else pa.int64()) for n in names)], names=["a", "b", *names]).combine_chunks().to_batches()

    def histogram(counts: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(at, pa.int64()), none, none, pa.array(counts[at], pa.int64()), none, pa.nulls(len(at), kind)], names=["a", "b", *names])

    def run(batches):
        held, seen = None, 0
        near, shared = np.zeros(0, bool), np.zeros(bits + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            if seen < window:
                yield from ends(new.slice(0, window - seen))
            seen += batch.num_rows
            table = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            near = np.concatenate([near, np.zeros(batch.num_rows, bool)])
            cols = [table.column(n).combine_chunks() for n in ("dim", "pass", "rep", "key", "v")]
            dim, which, rep, key = (c.to_numpy(zero_copy_only=False) for c in cols[:4])
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rows, x in _unit(cols[4]):
                for d in range(1, window + 1):
                    if len(rows) <= d:
                        break
                    a, b = rows[:-d], rows[d:]
                    ok = (b - a == d) & (which[a] == which[b]) & (dim[a] == dim[b])
                    ok &= np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold
                    us.append(rep[a[ok]])
                    vs.append(rep[b[ok]])
                    near[a[ok]] = near[b[ok]] = True
            if sum(map(len, us)):
                yield edges(us, vs)
            apart = (which[:-window] == which[window:]) & (dim[:-window] == dim[window:]) & ~near[:-window]
            differing = np.frexp((key[:-window] ^ key[window:])[apart].astype(float))[1]  # the length of the first difference and what follows
            shared += np.bincount(bits - differing, minlength=bits + 1)
            last = max(0, table.num_rows - window)
            held, near = table.slice(last), near[last:]
        if shared.any():
            yield histogram(shared)
        if held is not None and seen > window:
            yield from ends(held.slice(max(0, held.num_rows - (seen - window))))

    return run


def _count(threshold: float):
    """Streams rows sorted by (g, i, j); yields for each class the rows it is linked with, and spanning edges (rep, to)."""

    def one(table: pa.Table):
        b, rep, n = (table.column(c).to_numpy() for c in ("b", "rep", "n"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        total = np.zeros(len(rep), np.int64)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows, x in _unit(table.column("v").combine_chunks()):
            left, right = rows[b[rows] == i], rows[b[rows] == j]
            y, z = x[b[rows] == i], x[b[rows] == j]
            for k in range(0, len(left), BLOCK):
                near = y[k : k + BLOCK] @ z.T >= threshold
                p, q = np.nonzero(near)
                if not len(p):
                    continue
                here = left[k : k + BLOCK]
                np.add.at(total, here[p], n[right[q]])
                if i != j:
                    np.add.at(total, right[q], n[here[p]])
                x1, y1 = forest(rep[here[p]], rep[right[q]])
                us.append(x1)
                vs.append(y1)
            if i == j:  # a class is always its own neighbour, though rounding may put it below
                own = np.einsum("ij,ij->i", y, y) >= threshold
                total[left] -= np.where(own, n[left], 0)
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((rep, u), (total, 0 * u), (rep, v))], names=["rep", "linked", "to"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            keys = [table.column(c).to_numpy() for c in ("g", "i", "j")]
            if not len(keys[0]):
                continue
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            bounds = [0, *new.tolist()]
            for s, e in zip(bounds[:-1], bounds[1:]):
                yield one(table.slice(s, e - s))
            held = table.slice(bounds[-1])
        if held is not None and held.num_rows:
            yield one(held)

    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, near: float = NEAR, passes: int | None = None, window: int = WINDOW, bits: int = BITS, seed: int = 7, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).select("vec_id", F.when(usable, v).alias("v"))
    valid = d.where("v is not null")
    # several vectors can share an id, so classes have node numbers of their own, fixed by the checkpoint
    classes = valid.groupBy("v").agg(F.coalesce(F.min("vec_id"), F.lit(LAST)).alias("first"), F.count("*").alias("n"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("rep"), "v", "first", "n"))
    kind = classes.schema["v"].dataType
    shape = f"dim long, pass long, key long, rep long, v {kind.simpleString()}"
    order = ["dim", "pass", "key", "rep"]
    arrow = pa.list_(pa.float64() if "double" in kind.simpleString() else pa.float32())
    compare = _neighbours(window, threshold if exact else min(near, threshold), bits, arrow)

    def sweep(passes: int, seed: int) -> tuple[DataFrame, DataFrame]:
        """(u, v) of the pairs found in so many passes, and what their tasks counted."""
        keyed = classes.select("rep", "v").mapInArrow(_project(passes, bits, seed), shape)
        met = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, f"a long, b long, {shape}"))
        # the ends of all tasks in one: a few dozen rows for each
        over = met.where("a is null and b is null").select(*order, "v").coalesce(1).sortWithinPartitions(*order).mapInArrow(compare, f"a long, b long, {shape}")
        return met.unionByName(over).where("a is not null").select(F.col("a").alias("u"), F.col("b").alias("v")), met

    planned = passes or passes_for(classes.count(), threshold=threshold, window=window)
    pairs, met = sweep(planned, seed)
    if not passes and not exact:
        shared = met.where("a is null and b is not null").groupBy("b").agg(F.sum("key").alias("n"))  # a row for each number of bits
        further = passes_by(dict(map(tuple, shared.collect())), planned, threshold=threshold) - planned
        if further:
            pairs = pairs.unionByName(sweep(further, seed + 1)[0])
    if exact:
        spans = max(1, -(-classes.count() // SPAN))
        m = classes.select("rep", "n", "v", F.lit(0).cast("long").alias("g"), F.lit(spans).cast("long").alias("k"))
    else:
        group = cut(components(pairs)).select(F.col("id").alias("rep"), F.col("component").alias("g"))
        blocks = group.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("k"))
        m = classes.join(group.join(blocks, "g"), "rep")
    m = m.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("k"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    m = m.select("g", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "rep", "n", "v")
    found = cut(m.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_count(threshold), "rep long, linked long, to long"))
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    links = found.select(F.col("rep").alias("u"), F.col("to").alias("v"))
    comp = cut(components(pairs.unionByName(links) if exact else links))
    facts = classes.join(linked, "rep", "left").join(comp, classes.rep == comp.id, "left").withColumn("c", F.coalesce("component", "rep"))
    names = facts.groupBy("c").agg(F.min("first").alias("low"))
    facts = facts.join(names, "c").select(F.col("v").alias("_v"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("low") < LAST, F.col("low")).alias("component_id"))
    linked_rows = valid.join(facts, F.col("v") == F.col("_v")).select("vec_id", "n_links", "component_id")
    alone = d.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
