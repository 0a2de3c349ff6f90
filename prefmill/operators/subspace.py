"""Low-rank updates, spectra, null-space bases and projections over tables of vectors (module, row, vec).

Matrices are never built whole on the driver. Products and large projections run on blocks of rows; a Gram matrix is
summed per partition first; only the d x d eigen problem of a module meets in one task.
"""

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from prefmill.functions.numeric import dot, let
from prefmill.operators.rowindex import null_safe, row_hash
from prefmill.session import settled, width

KEPT_SHARE = 0.80  # fixed value: share of the smallest singular directions that form the basis
FLOAT32_EPS = 2.0 ** -23
BLOCK_ROWS = 1024
TREE_WIDTH = 256
BROADCAST_BYTES = 64 << 20
VEC = "array<double>"


def join_ab_factors(factors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Factor rows (key, row, vec) to (A rows, B rows, modules without B); keys end in .lora_A.weight or .lora_B.weight."""
    a = factors.filter(F.col("key").endswith(".lora_A.weight")).withColumn("module", F.regexp_replace("key", r"\.lora_A\.weight$", "")).drop("key")
    b = factors.filter(F.col("key").endswith(".lora_B.weight")).withColumn("module", F.regexp_replace("key", r"\.lora_B\.weight$", "")).drop("key")
    modules_b = b.select("module").distinct()
    missing = a.select("module").distinct().join(modules_b, "module", "left_anti")
    return a.join(modules_b, "module", "left_semi"), b, missing


def lowrank_product(a: DataFrame, b: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Rows of B.A per module (B.A^T when only that fits). Blocks of B rows meet a copy of the small A of their module,
    so a module's product is spread over its blocks."""
    left = b.withColumn("_block", F.floor(F.col("row") / block))
    blocks = left.select("module", "_block").distinct()
    right = a.join(blocks, "module").select(*[F.col(c).alias(c) for c in ("module", "row", "vec", "_block")])

    def multiply(pb: pd.DataFrame, pa: pd.DataFrame) -> pd.DataFrame:
        if len(pa) == 0 or len(pb) == 0:
            return pd.DataFrame({"module": [], "row": [], "vec": []})
        ma, mb = np.stack(pa.sort_values("row")["vec"].to_list()), np.stack(pb["vec"].to_list())
        if mb.shape[1] != ma.shape[0]:
            if mb.shape[1] != ma.shape[1]:
                return pd.DataFrame({"module": [], "row": [], "vec": []})
            ma = ma.T
        return pd.DataFrame({"module": pb["module"].values, "row": pb["row"].values, "vec": list(mb @ ma)})

    kind = dict(b.dtypes)["module"]
    return left.groupBy("module", "_block").cogroup(right.groupBy("module", "_block")).applyInPandas(
        multiply, f"module {kind}, row bigint, vec {VEC}")


def columns_of(rows: DataFrame) -> DataFrame:
    """Transpose (module, row, vec): one output row per column."""
    cells = rows.select("module", F.col("row").alias("_i"), F.posexplode("vec").alias("row", "x"))
    packed = cells.groupBy("module", "row").agg(F.array_sort(F.collect_list(F.struct("_i", "x"))).alias("_c"))
    return packed.select("module", F.col("row").cast("bigint").alias("row"), F.transform("_c", lambda c: c["x"]).alias("vec"))


def gram(vectors: DataFrame) -> DataFrame:
    """module, row, vec: rows of the sum of v v^T, with n = number of vectors. Each partition adds up its own vectors and
    hands over one matrix per module; matrices are then added row by row."""
    kind = dict(vectors.dtypes)["module"]
    schema = f"module {kind}, row bigint, vec {VEC}, n bigint, part int"

    def partial(batches):
        current, total, count = None, None, 0
        part = TaskContext.get().partitionId() % TREE_WIDTH

        def out():
            return pd.DataFrame({"module": current, "row": np.arange(len(total)), "vec": list(total), "n": count, "part": part})

        for pdf in batches:
            for module, rows in pdf.groupby("module", sort=False):
                m = np.stack(rows["vec"].to_list())
                if module != current:
                    if current is not None:
                        yield out()
                    current, total, count = module, np.zeros((m.shape[1], m.shape[1])), 0
                total += m.T @ m
                count += len(m)
        if current is not None:
            yield out()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        vec = np.sum(np.stack(pdf["vec"].to_list()), axis=0)
        return pd.DataFrame({"module": pdf["module"].iloc[:1], "row": pdf["row"].iloc[:1], "vec": [vec], "n": [pdf["n"].sum()], "part": [0]})

    parts = vectors.select("module", "vec").sortWithinPartitions("module").mapInPandas(partial, schema)
    context = vectors.sparkSession.sparkContext
    if max(context.defaultParallelism, width(vectors.sparkSession)) > TREE_WIDTH:
        # Wide jobs add in two levels, so that no group holds a row of every partition.
        parts = parts.groupBy("module", "row", "part").applyInPandas(add, schema)
    return parts.groupBy("module", "row").applyInPandas(add, schema).drop("part")


def spectrum(grams: DataFrame) -> DataFrame:
    """module, k, sigma, vec, n, dim: singular values of the vector table, largest first, with their directions.
    Directions beyond min(n, dim) belong to no singular value and are left out."""
    kind = dict(grams.dtypes)["module"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        m, n = np.stack(pdf["vec"].to_list()), int(pdf["n"].iloc[0])
        values, vectors = np.linalg.eigh(m)
        count = min(n, len(m))
        order = np.argsort(-values, kind="stable")[:count]
        return pd.DataFrame({"module": pdf["module"].iloc[0], "k": np.arange(count), "sigma": np.sqrt(np.maximum(values[order], 0.0)),
                             "vec": list(vectors[:, order].T), "n": n, "dim": len(m)})

    return grams.groupBy("module").applyInPandas(solve, f"module {kind}, k bigint, sigma double, vec {VEC}, n bigint, dim bigint")


def singular_report(spectra: DataFrame) -> DataFrame:
    """Per module: number of values, numerical rank (values above eps * longer side, not scaled by the largest), sums of
    squares and fourth powers."""
    seen = F.col("sigma") > FLOAT32_EPS * F.greatest("n", "dim")
    return spectra.groupBy("module").agg(F.count(F.lit(1)).alias("values"), F.sum(seen.cast("bigint")).alias("rank"),
                                         F.sum(F.pow("sigma", F.lit(2.0))).alias("energy"), F.sum(F.pow("sigma", F.lit(4.0))).alias("quartic"))


def topk_singular(spectra: DataFrame, count: int = 10) -> DataFrame:
    return spectra.filter(F.col("k") < count).select("module", "k", "sigma")


def nullspace_basis(spectra: DataFrame, share: float = KEPT_SHARE) -> DataFrame:
    """module, vec_no, vec, sigma: the directions of the smallest max(1, int(share * k)) singular values; a module whose
    whole spectrum would be kept is skipped."""
    total = F.least("n", "dim")
    count = F.greatest(F.lit(1), F.floor(total * share))
    kept = spectra.filter((count < total) & (F.col("k") >= total - count))
    return kept.select("module", (F.col("k") - (total - count)).alias("vec_no"), "vec", "sigma")


def basis_matrix(basis: DataFrame) -> DataFrame:
    """One row per module: basis vectors as a list, and their dimension."""
    packed = basis.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("vec_no", "vec"))).alias("_b"))
    return packed.select("module", F.transform("_b", lambda b: b["vec"]).alias("basis"), F.size(F.col("_b")[0]["vec"]).alias("basis_dim"))


def projected(vec: Column, basis: Column) -> Column:
    """U (U^T v) with two matrix-vector products; the projector is never built."""
    def spread(weights):
        cells = F.zip_with(basis, weights, lambda u, w: F.struct(u.alias("u"), w.alias("w")))
        zero = F.transform(vec, lambda x: F.lit(0.0))
        return F.aggregate(cells, zero, lambda acc, c: F.zip_with(acc, c["u"], lambda a, u: a + c["w"] * u))
    return let(F.transform(basis, lambda u: dot(u, vec)), spread)


#: Modules whose dimension is sent to every task; more join by a shuffle.
MODULES = 1 << 16


def join_module_basis(vectors: DataFrame, basis: DataFrame) -> DataFrame:
    """Vectors with the dimension of their module's basis (``basis_dim``, null without one); ``fits`` is false without a basis
    or on another dimension. Only one small row per module travels, never a basis."""
    dims = settled(basis.groupBy("module").agg(F.max(F.size("vec")).alias("basis_dim")))
    if dims.count() <= MODULES:
        dims = F.broadcast(dims)
    joined = vectors.join(dims, "module", "left")
    return joined.withColumn("fits", F.coalesce(F.size("vec") == F.col("basis_dim"), F.lit(False)))


def project_vectors(vectors: DataFrame, basis: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """vectors with ``projected``; vectors without a fitting basis pass through unchanged.

    Bases up to ``limit`` bytes (measured) are broadcast, and the vectors do not move. Larger bases are copied to blocks
    of vectors and multiplied there.
    """
    size = basis.agg(F.coalesce(F.sum(F.size("vec").cast("bigint")), F.lit(0)).alias("cells")).first()["cells"] * 8
    if size <= limit:
        joined = vectors.join(F.broadcast(basis_matrix(basis)), "module", "left")
        fits = F.size("vec") == F.col("basis_dim")
        return joined.withColumn("projected", F.when(fits, projected(F.col("vec"), F.col("basis"))).otherwise(F.col("vec"))).drop("basis", "basis_dim")
    return _project_blocks(vectors, basis)


def _project_blocks(vectors: DataFrame, basis: DataFrame, block: int = 4 * BLOCK_ROWS) -> DataFrame:
    names = vectors.columns
    sizes = vectors.groupBy("module").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    left = null_safe(vectors, sizes, ["module"]).withColumn("_block", F.pmod(row_hash(vectors), F.col("_blocks"))).drop("_blocks")
    right = basis.join(sizes, "module").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_blocks")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def project(pv: pd.DataFrame, pb: pd.DataFrame) -> pd.DataFrame:
        out = pv[names].copy()
        out["projected"] = out["vec"]
        if len(pb) and len(pv):
            u = np.stack(pb.sort_values("vec_no")["vec"].to_list())
            fits = out["vec"].map(len).to_numpy() == u.shape[1]
            if fits.any():
                v = np.stack(out.loc[fits, "vec"].to_list())
                out.loc[fits, "projected"] = pd.Series(list((v @ u.T) @ u), index=out.index[fits])
        return out

    schema = ", ".join(f"{n} {t}" for n, t in vectors.dtypes) + f", projected {VEC}"
    return left.groupBy("module", "_block").cogroup(right.groupBy("module", "_block")).applyInPandas(project, schema)


def project_two_sided(grads: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Gradient rows (module, side, row, vec): side A rows g become (g V) V^T; the columns of side B become U (U^T g).
    Rows whose dimension does not fit pass through."""
    a = project_vectors(grads.filter("side = 'A'").drop("side"), right)
    b = project_vectors(columns_of(grads.filter("side = 'B'").drop("side")), left)
    b = columns_of(b.select("module", "row", F.col("projected").alias("vec"))).withColumnRenamed("vec", "projected")
    return a.select("module", F.lit("A").alias("side"), "row", "projected").unionByName(
        b.select("module", F.lit("B").alias("side"), "row", "projected"))


def basis_memory(shapes: DataFrame, share: float = KEPT_SHARE, width: int = 4) -> DataFrame:
    """Per module (d_out, d_in): bytes of the basis and of the full projector; skipped modules are left out."""
    k = F.least("d_out", "d_in")
    count = F.greatest(F.lit(1), F.floor(k * share))
    kept = shapes.filter(count < k)
    return kept.select("module", (F.col("d_out") * count * width).cast("bigint").alias("basis_bytes"),
                       (F.col("d_out") * F.col("d_out") * width).cast("bigint").alias("projector_bytes"))


def memory_total(per_module: DataFrame) -> DataFrame:
    out = per_module.agg(F.sum("basis_bytes").alias("basis_bytes"), F.sum("projector_bytes").alias("projector_bytes"))
    return out.withColumn("ratio", F.col("basis_bytes") / F.col("projector_bytes"))


def projection_residual(projected_rows: DataFrame) -> DataFrame:
    """Adds squared norms before and after, and the share kept."""
    out = projected_rows.withColumn("norm", dot(F.col("vec"), F.col("vec"))).withColumn("kept", dot(F.col("projected"), F.col("projected")))
    return out.withColumn("share", F.try_divide("kept", "norm"))
