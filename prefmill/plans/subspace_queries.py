"""Low-rank products, spectra and projections over the embeddings."""

import math

from pyspark.sql import functions as F

from prefmill.functions.numeric import r6
from prefmill.operators import subspace as S
from prefmill.plans import fixtures as X
from prefmill.plans.base import query
from prefmill.plans.loss_queries import r

DIM, FIRST = 64, 13


def vectors(spark, folder, by_label=True):
    module = F.concat(F.lit("layer."), F.col("label").cast("string")) if by_label else F.lit("all")
    return X.table(spark, folder, "embeddings").select(module.alias("module"), F.col("vec_id").alias("row"),
                                                       F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def factors(spark, folder):
    """LoRA-like factors of rank 4 per label: A rows are means of a quarter of the label's vectors, B is A turned around
    and doubled; one module has no B."""
    cells = X.table(spark, folder, "embeddings").select("label", (F.col("vec_id") % 4).alias("r"), F.posexplode("embedding").alias("j", "x"))
    a = cells.groupBy("label", "r", "j").agg(F.avg(F.col("x").cast("double")).alias("x"))
    key = F.concat(F.lit("layer."), F.col("label").cast("string"), F.lit(".lora_"))
    def rows(df, side, row, pos):
        packed = df.groupBy("label", F.col(row).cast("bigint").alias("row")).agg(F.array_sort(F.collect_list(F.struct(pos, "x"))).alias("c"))
        return packed.select(F.concat(key, F.lit(f"{side}.weight")).alias("key"), "row", F.transform("c", lambda c: c["x"]).alias("vec"))
    b = a.filter("label <> 9").select("label", (DIM - 1 - F.col("j")).alias("i"), "r", (F.col("x") * 2).alias("x"))
    return rows(a, "A", "r", "j").unionByName(rows(b, "B", "i", "r"))


CELLS = """cells AS (SELECT label, vec_id%4 AS r, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings),
a AS (SELECT label, r, j, avg(x) AS x FROM cells GROUP BY ALL), b AS (SELECT label, 63-j AS i, r, 2*x AS x FROM a WHERE label<>9)"""


@query("join_ab_factors", """SELECT 'layer.'||label AS module, count(DISTINCT vec_id%4)::BIGINT AS a_rows, CASE WHEN label=9 THEN 0 ELSE 64 END::BIGINT AS b_rows, label=9 AS missing_b FROM embeddings GROUP BY label""")
def join_ab_factors(spark, folder):
    a, b, missing = S.join_ab_factors(factors(spark, folder))
    counts = a.groupBy("module").agg(F.count(F.lit(1)).alias("a_rows")).join(b.groupBy("module").agg(F.count(F.lit(1)).alias("b_rows")), "module")
    lost = factors(spark, folder).withColumn("module", F.regexp_replace("key", r"\.lora_A\.weight$", "")).join(missing, "module")
    alone = lost.groupBy("module").agg(F.count(F.lit(1)).alias("a_rows")).withColumn("b_rows", F.lit(0).cast("bigint"))
    return counts.withColumn("missing_b", F.lit(False)).unionByName(alone.withColumn("missing_b", F.lit(True)))


@query("lowrank_product", f"""WITH {CELLS} SELECT 'layer.'||a.label AS module, b.i AS row, a.j AS col, {r('sum(b.x*a.x)')} AS value FROM a JOIN b ON a.label=b.label AND a.r=b.r GROUP BY ALL""")
def lowrank_product(spark, folder):
    a, b, _ = S.join_ab_factors(factors(spark, folder))
    out = S.lowrank_product(a, b, block=16).select("module", "row", F.posexplode("vec").alias("col", "value"))
    return out.select("module", "row", F.col("col").cast("bigint").alias("col"), r6(F.col("value")).alias("value"))


@query("gram", f"""WITH v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT a.i AS row, b.i AS col, {r('sum(a.x*b.x)')} AS value FROM v a JOIN v b ON a.vec_id=b.vec_id AND a.i<=b.i GROUP BY ALL""")
def gram(spark, folder):
    out = S.gram(vectors(spark, folder, False)).select("row", F.posexplode("vec").alias("col", "value"))
    return out.filter("row <= col").select("row", F.col("col").cast("bigint").alias("col"), r6(F.col("value")).alias("value"))


@query("singular_values", f"""WITH v AS (SELECT label, vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
g AS (SELECT a.label, a.i, b.i AS j, sum(a.x*b.x) AS x FROM v a JOIN v b ON a.vec_id=b.vec_id GROUP BY ALL),
n AS (SELECT label, least(count(*),64) AS k FROM embeddings GROUP BY 1)
SELECT 'layer.'||label AS module, max(k)::BIGINT AS values, max(k)::BIGINT AS rank, {r('sum(CASE WHEN i=j THEN x END)')} AS energy, {r('sum(x*x)')} AS quartic FROM g JOIN n USING (label) GROUP BY label""")
def singular_values(spark, folder):
    out = S.singular_report(S.spectrum(S.gram(vectors(spark, folder))))
    return out.withColumn("energy", r6(F.col("energy"))).withColumn("quartic", r6(F.col("quartic")))


def _total(parts, name, keys=()):
    """One row per key: the sum of a column over several tables."""
    first, *more = [p.select(*keys, F.col(name).alias("x")) for p in parts]
    for p in more:
        first = first.unionByName(p)
    return first.groupBy(*keys).agg(F.sum("x").alias("x"))


@query("topk_singular", f"""WITH e AS (SELECT label, sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))) AS x FROM embeddings GROUP BY 1)
SELECT 'layer.'||label AS module, 'energy' AS fact, {r('x')} AS value FROM e UNION ALL SELECT 'layer.'||label, 'count', 10.0::DOUBLE FROM e
UNION ALL SELECT 'layer.'||label, 'residual', 0.0::DOUBLE FROM e""")
def topk_singular(spark, folder):
    """The squares of the ten values and of the rest add up to the table's energy, and each value's direction solves
    G v = sigma^2 v."""
    grams = S.gram(vectors(spark, folder))
    spectra = S.spectrum(grams)
    top = S.topk_singular(spectra)
    square = F.pow("sigma", F.lit(2.0))
    energy = _total([top.withColumn("s", square), spectra.filter("k >= 10").withColumn("s", square)], "s", ["module"])
    pairs = grams.select("module", "row", F.col("vec").alias("g")).join(spectra.filter("k < 10"), "module")
    off = F.abs(S.dot(F.col("g"), F.col("vec")) - square * F.get("vec", F.col("row").cast("int")))
    return (energy.select("module", F.lit("energy").alias("fact"), r6(F.col("x")).alias("value"))
            .unionByName(top.groupBy("module").agg(F.count(F.lit(1)).cast("double").alias("value")).select("module", F.lit("count").alias("fact"), "value"))
            .unionByName(pairs.groupBy("module").agg(r6(F.max(off)).alias("value")).select("module", F.lit("residual").alias("fact"), "value")))


@query("nullspace_basis", f"""SELECT 'vectors' AS fact, 51.0::DOUBLE AS value UNION ALL SELECT 'trace', 51.0::DOUBLE UNION ALL SELECT 'largest_inner', 0.0::DOUBLE
UNION ALL SELECT 'energy', {r('sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE)))')} FROM embeddings""")
def nullspace_basis(spark, folder):
    """51 orthonormal directions; what they keep of the vectors and the energy of the 13 largest values add up to all."""
    # A constant module would make the optimiser turn joins by module into nested loops.
    rows = vectors(spark, folder, False).withColumn("module", F.when(F.col("row") >= 0, F.col("module")))
    spectra = S.spectrum(S.gram(rows))
    basis = S.nullspace_basis(spectra)
    pairs = F.flatten(F.transform("basis", lambda u, i: F.transform("basis", lambda v, j: F.when(i < j, F.abs(S.dot(u, v))).otherwise(0.0))))
    kept = S.project_vectors(rows, basis).select(S.dot(F.col("projected"), F.col("projected")).alias("s"))
    facts = {"vectors": basis.agg(F.count(F.lit(1)).cast("double").alias("x")),
             "trace": basis.agg(F.sum(S.dot(F.col("vec"), F.col("vec"))).alias("x")),
             "largest_inner": S.basis_matrix(basis).select(F.array_max(pairs).alias("x")),
             "energy": _total([kept, spectra.filter("k < 13").withColumn("s", F.pow("sigma", F.lit(2.0)))], "s")}
    first, *more = [df.select(F.lit(name).alias("fact"), r6(F.col("x")).alias("value")) for name, df in facts.items()]
    for df in more:
        first = first.unionByName(df)
    return first


def cosines(modules, dim=DIM, first=FIRST):
    """The upper cosine vectors as an orthonormal basis, for each module in the table."""
    span = modules.withColumn("k", F.explode(F.sequence(F.lit(first), F.lit(dim - 1))))
    scale = math.sqrt(2.0 / dim)
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: scale * F.cos(math.pi * (j + 0.5) * F.col("k") / dim))
    return span.select("module", (F.col("k") - first).cast("bigint").alias("vec_no"), vec.alias("vec"))


def bases(spark, folder):
    """Layers 0..7 have a basis of their dimension, layer 8 one of another dimension, layer 9 none."""
    modules = vectors(spark, folder).select("module").distinct()
    fit = cosines(modules.filter(~F.col("module").isin("layer.8", "layer.9")))
    return fit.unionByName(cosines(modules.filter("module = 'layer.8'"), 32, 6))


_BASIS = "u AS (SELECT k, list_transform(range(64), lambda j: sqrt(2.0/64)*cos(pi()*(j+0.5)*k/64)) AS u FROM range(13,64) t(k))"
_PROJ = f"""{_BASIS}, p AS (SELECT i, j, sum(u[i+1]*u[j+1]) AS x FROM u, range(64) a(i), range(64) b(j) GROUP BY ALL),
v AS (SELECT label, vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings),
pv AS (SELECT label, vec_id, p.i, sum(p.x*v.x) AS y FROM v JOIN p ON p.j=v.j WHERE label<8 GROUP BY ALL UNION ALL SELECT label, vec_id, j, x FROM v WHERE label>=8)"""


def _weighed(vec):
    return F.aggregate(F.transform(vec, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


@query("project_vectors", f"WITH {_PROJ} SELECT 'layer.'||label AS module, vec_id AS row, {r('sum(y*(i+1))')} AS mark, {r('sum(y*y)')} AS kept FROM pv GROUP BY ALL")
def project_vectors(spark, folder):
    out = S.project_vectors(vectors(spark, folder), bases(spark, folder))
    return out.select("module", "row", r6(_weighed(F.col("projected"))).alias("mark"), r6(S.dot(F.col("projected"), F.col("projected"))).alias("kept"))


@query("projection_residual", f"""WITH {_PROJ}, n AS (SELECT vec_id, sum(x*x) AS norm FROM v GROUP BY 1), k AS (SELECT vec_id, sum(y*y) AS kept FROM pv GROUP BY 1)
SELECT vec_id AS row, {r('norm')} AS norm, {r('kept')} AS kept, {r('kept/norm')} AS share FROM n JOIN k USING (vec_id)""")
def projection_residual(spark, folder):
    out = S.projection_residual(S.project_vectors(vectors(spark, folder), bases(spark, folder)))
    return out.select("row", *[r6(F.col(c)).alias(c) for c in ("norm", "kept", "share")])


@query("join_module_basis", "SELECT 'layer.'||label AS module, vec_id AS row, label<8 AS fits FROM embeddings")
def join_module_basis(spark, folder):
    return S.join_module_basis(vectors(spark, folder), bases(spark, folder)).select("module", "row", "fits")


@query("project_two_sided", f"""WITH {CELLS}, {_BASIS}, p AS (SELECT i, j, sum(u[i+1]*u[j+1]) AS x FROM u, range(64) q(i), range(64) w(j) GROUP BY ALL),
ga AS (SELECT label, r, p.i, sum(p.x*a.x) AS y FROM a JOIN p ON p.j=a.j WHERE label<8 GROUP BY ALL UNION ALL SELECT label, r, j, x FROM a WHERE label>=8),
gb AS (SELECT label, p.i, b.r, sum(p.x*b.x) AS y FROM b JOIN p ON p.j=b.i WHERE label<8 GROUP BY ALL UNION ALL SELECT label, i, r, x FROM b WHERE label>=8)
SELECT 'layer.'||label AS module, 'A' AS side, r AS row, {r('sum(y*(i+1))')} AS mark FROM ga GROUP BY ALL
UNION ALL SELECT 'layer.'||label, 'B', i, {r('sum(y*(r+1))')} FROM gb GROUP BY ALL""")
def project_two_sided(spark, folder):
    sides = factors(spark, folder).select(F.regexp_replace("key", r"\.lora_[AB]\.weight$", "").alias("module"),
                                          F.regexp_extract("key", r"lora_([AB])", 1).alias("side"), "row", "vec")
    out = S.project_two_sided(sides, bases(spark, folder), bases(spark, folder))
    return out.select("module", "side", "row", r6(_weighed(F.col("projected"))).alias("mark"))


@query("basis_memory", """WITH m AS (SELECT label, count(*) AS n, least(64, count(*)) AS k FROM embeddings GROUP BY 1)
SELECT 'layer.'||label AS module, (64*greatest(1,floor(k*0.8::DOUBLE))*4)::BIGINT AS basis_bytes, 16384::BIGINT AS projector_bytes FROM m WHERE greatest(1,floor(k*0.8::DOUBLE))<k
UNION ALL SELECT 'total', sum(64*greatest(1,floor(k*0.8::DOUBLE))*4)::BIGINT, (count(*)*16384)::BIGINT FROM m WHERE greatest(1,floor(k*0.8::DOUBLE))<k""")
def basis_memory(spark, folder):
    shapes = vectors(spark, folder).groupBy("module").agg(F.lit(DIM).alias("d_out"), F.count(F.lit(1)).alias("d_in"))
    per = S.basis_memory(shapes)
    return per.unionByName(S.memory_total(per).select(F.lit("total").alias("module"), "basis_bytes", "projector_bytes"))
