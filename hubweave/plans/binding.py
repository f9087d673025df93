"""How the queries bind the driver's tables: embeddings as observations, ten labels as groups, all 64 components as nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubweave.functions.stats import rounded
from hubweave.operators import correlate, graph_metrics, network, persistence, scoring
from hubweave.sources.observations import areas_of, embedding_vectors, to_long
from hubweave.sources.scratch import settled

DIMS = 64
CUT = 0.15
PAIRS = DIMS * (DIMS - 1) // 2
AREAS = {f"a{k}": [f"d{i:02d}" for i in range(4 * k, 4 * k + 4)] for k in range(DIMS // 4)}


def obs(spark, sf_dir):
    return embedding_vectors(spark, sf_dir, DIMS)


def gappy(spark, sf_dir):
    """The same observations with gaps: of every third subject, (vec_id * 7 + dim) % 19 = 0 is missing."""
    rows, nodes = obs(spark, sf_dir)
    holes = F.transform("values", lambda v, i: F.when((F.col("subject") % 3 != 0) | ((F.col("subject") * 7 + i) % 19 != 0), v))
    return rows.select("grp", "subject", holes.alias("values")), nodes


def tied(spark, sf_dir):
    rows, nodes = obs(spark, sf_dir)
    return rows.select("grp", "subject", F.transform("values", lambda v: F.round(v, 1)).alias("values")), nodes


def long_gappy(spark, sf_dir):
    rows, nodes = gappy(spark, sf_dir)
    return to_long(rows, nodes)


def corr2(spark, sf_dir):
    """Pearson and Spearman networks, the correlation table of most queries; every later stage reads it, so it is cached."""
    rows, nodes = obs(spark, sf_dir)
    return correlate.correlations(rows, nodes, ("pearson", "spearman")).cache(), nodes


def pearson(spark, sf_dir):
    rows, nodes = obs(spark, sf_dir)
    return correlate.pearson(rows, nodes).cache(), nodes


#: The five methods of the consensus over methods; the biweight midcorrelation has two, by name and in fact.
FIVE = ("pearson", "spearman", "biweight", "bicor", "shrinkage")
SWEEP = (0.052, 0.05, 8)


def corr5(spark, sf_dir, methods=FIVE):
    """Networks of all five methods, written once: every approach reads them."""
    rows, nodes = obs(spark, sf_dir)
    return settled(correlate.correlations(rows, nodes, methods)), nodes


_WRITTEN: dict[tuple, object] = {}


def scores5(spark, sf_dir, methods=FIVE):
    """Eigenvector and strength of every node in every network of three approaches and five methods.

    A session writes the table once, as all consensus queries start from it.
    """
    key = (spark.sparkContext.applicationId, sf_dir, methods)
    if key not in _WRITTEN:
        corr, _ = corr5(spark, sf_dir, methods)
        _WRITTEN[key] = settled(scoring.approach_scores(corr, settled(network.percolation_thresholds(corr)), persistence.threshold_grid(spark, *SWEEP)))
    return _WRITTEN[key]


def cut_edges(spark, sf_dir):
    corr, nodes = pearson(spark, sf_dir)
    return network.threshold_network(corr, CUT), graph_metrics.nodes_of(corr), nodes


def areas(spark):
    return areas_of(spark, AREAS)


def q(build):
    """A query whose doubles are rounded for comparison."""
    return lambda spark, sf_dir: rounded(build(spark, sf_dir))


# --- SQL twins -----------------------------------------------------------------------------------

OBS = f"obs AS (SELECT 'g' || label AS grp, vec_id AS subject, 'd' || lpad(CAST(k - 1 AS VARCHAR), 2, '0') AS node, k - 1 AS dim, CAST(embedding[k] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(1, {DIMS + 1})) AS k))"
GAPPY = f"{OBS}, gap AS (SELECT grp, subject, node, dim, CASE WHEN subject % 3 = 0 AND (subject * 7 + dim) % 19 = 0 THEN NULL ELSE value END AS value FROM obs)"


def corr_sql(name: str, source: str, method: str) -> str:
    return f"""{name} AS (SELECT '{method}' AS method, a.grp, a.node AS i, b.node AS j,
      CASE WHEN stddev_pop(a.value) * stddev_pop(b.value) = 0 THEN NULL ELSE round(covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)), 12) END AS r
      FROM {source} a JOIN {source} b ON a.grp = b.grp AND a.subject = b.subject AND a.node < b.node WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.grp, a.node, b.node)"""


def rank_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT grp, subject, node, rank() OVER (PARTITION BY grp, node ORDER BY value) + (count(*) OVER (PARTITION BY grp, node, value) - 1) / 2.0 AS value FROM {source})"


PEARSON = f"{OBS}, {corr_sql('corr', 'obs', 'pearson')}"
CORR2 = f"{OBS}, {corr_sql('pe', 'obs', 'pearson')}, {rank_sql('rk', 'obs')}, {corr_sql('sp', 'rk', 'spearman')}, corr AS (SELECT * FROM pe UNION ALL SELECT * FROM sp)"
EDGES = f"{PEARSON}, edges AS (SELECT method, grp, i AS src, j AS dst, abs(r) AS w FROM corr WHERE abs(r) >= {CUT} AND abs(r) > 0), nodes AS (SELECT DISTINCT 'pearson' AS method, grp, node FROM obs), dbl AS (SELECT method, grp, src AS node, dst AS other, w FROM edges UNION ALL SELECT method, grp, dst, src, w FROM edges)"
AREA_SQL = f"areas AS (SELECT 'a' || k AS area, k AS area_ord, 'd' || lpad(CAST(4 * k + m AS VARCHAR), 2, '0') AS node FROM (SELECT unnest(range(0, {DIMS // 4})) AS k), (SELECT unnest(range(0, 4)) AS m))"


def r6(*cols: str) -> str:
    return ", ".join(f"round({c.split(' AS ')[0]}, 6) + 0.0 AS {c.split(' AS ')[-1].split('.')[-1]}" for c in cols)


BICOR = """md AS (SELECT *, value - median(value) OVER (PARTITION BY grp, node) AS d FROM obs),
ma AS (SELECT *, median(abs(d)) OVER (PARTITION BY grp, node) AS mad FROM md),
mu AS (SELECT grp, subject, node, d, d / (9 * mad) AS u FROM ma),
mw AS (SELECT grp, subject, node, CASE WHEN abs(u) < 1 THEN d * (1 - u * u) * (1 - u * u) ELSE 0 END AS value FROM mu),
bc AS (SELECT 'bicor' AS method, x.grp, x.node AS i, y.node AS j,
         round(sum(x.value * y.value) / (sqrt(sum(x.value * x.value)) * sqrt(sum(y.value * y.value))), 12) AS r
       FROM mw x JOIN mw y ON x.grp = y.grp AND x.subject = y.subject AND x.node < y.node GROUP BY ALL)"""
SHRUNK = """sz AS (SELECT grp, subject, node, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM obs WINDOW w AS (PARTITION BY grp, node)),
sq AS (SELECT x.grp, x.node AS i, y.node AS j, avg(x.value * y.value) AS a, avg(x.value * y.value * x.value * y.value) AS q, count(*) AS n
       FROM sz x JOIN sz y ON x.grp = y.grp AND x.subject = y.subject AND x.node < y.node GROUP BY ALL),
sl AS (SELECT grp, least(1, greatest(0, (sum(q) - sum(a * a)) / sum(a * a) / (max(n) - 1))) AS lam FROM sq GROUP BY grp),
sr AS (SELECT 'shrinkage' AS method, grp, i, j, round((1 - lam) * a * n / (n - 1), 12) AS r FROM sq JOIN sl USING (grp))"""
CORR5 = f"""{OBS}, {corr_sql('pe', 'obs', 'pearson')}, {rank_sql('rk', 'obs')}, {corr_sql('sp', 'rk', 'spearman')}, {BICOR}, {SHRUNK},
corr AS MATERIALIZED (SELECT * FROM pe UNION ALL SELECT * FROM sp UNION ALL SELECT 'biweight', grp, i, j, r FROM pe UNION ALL SELECT * FROM bc UNION ALL SELECT * FROM sr)"""

SQUARINGS = 14


def labels_sql(p: str, edges: str, rounds: int = 8) -> str:
    """{p}_lab (net, node, comp) of ``edges`` (net, a, b, w; both ways): smallest labels, hooked to each other, unrolled."""
    out = [f"{p}_l0 AS MATERIALIZED (SELECT net, a AS node, least(a, min(b)) AS comp FROM {edges} GROUP BY net, a)"]
    for k in range(rounds):
        old, new = f"{p}_l{k}", f"{p}_l{k + 1}" if k + 1 < rounds else f"{p}_lab"
        out.append(
            f"{p}_n{k} AS (SELECT e.net, o.comp AS own, min(l.comp) AS low FROM {edges} e JOIN {old} o ON o.net = e.net AND o.node = e.a JOIN {old} l ON l.net = e.net AND l.node = e.b GROUP BY ALL), "
            f"{p}_h{k} AS MATERIALIZED (SELECT o.net, o.node, least(o.comp, n.low) AS comp FROM {old} o JOIN {p}_n{k} n ON n.net = o.net AND n.own = o.comp), "
            f"{new} AS MATERIALIZED (SELECT h.net, h.node, least(h.comp, f.comp) AS comp FROM {p}_h{k} h JOIN {p}_h{k} f ON f.net = h.net AND f.node = h.comp)"
        )
    return ",\n".join(out)


def eigen_sql(p: str, edges: str, nodes: str) -> str:
    """{p}_eig (net, node, eigenvector) for all of ``nodes`` (net, node): each component's matrix, squared again and
    again, tends to the product of its leading eigenvector with itself."""
    out = [labels_sql(p, edges)]
    out.append(f"{p}_pl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY net, comp ORDER BY node) AS pos FROM {p}_lab)")
    out.append(f"{p}_sh AS (SELECT net, comp, sum(w) / count(DISTINCT a) / 4 AS sh FROM {edges} e JOIN {p}_pl l USING (net) WHERE l.node = e.a GROUP BY ALL)")
    out.append(
        f"{p}_m0 AS MATERIALIZED (SELECT x.net, x.comp, x.pos, list(CASE WHEN x.pos = y.pos THEN sh ELSE coalesce(e.w, 0) END ORDER BY y.pos) AS r "
        f"FROM {p}_pl x JOIN {p}_pl y ON x.net = y.net AND x.comp = y.comp JOIN {p}_sh s ON s.net = x.net AND s.comp = x.comp "
        f"LEFT JOIN {edges} e ON e.net = x.net AND e.a = x.node AND e.b = y.node GROUP BY ALL)"
    )
    for k in range(SQUARINGS):
        out.append(
            f"{p}_q{k} AS (SELECT x.net, x.comp, x.pos, list(list_dot_product(x.r, y.r) ORDER BY y.pos) AS r FROM {p}_m{k} x JOIN {p}_m{k} y ON x.net = y.net AND x.comp = y.comp GROUP BY ALL), "
            f"{p}_m{k + 1} AS MATERIALIZED (SELECT net, comp, pos, list_transform(r, lambda cell: cell / top) AS r FROM (SELECT *, max(list_max(r)) OVER (PARTITION BY net, comp) AS top FROM {p}_q{k}))"
        )
    out.append(f"{p}_v AS MATERIALIZED (SELECT net, comp, pos, r[first(pos) OVER w] / first(r[pos]) OVER w AS v FROM {p}_m{SQUARINGS} WINDOW w AS (PARTITION BY net, comp ORDER BY r[pos] DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")
    out.append(f"{p}_nv AS MATERIALIZED (SELECT net, comp, node, v FROM {p}_v JOIN {p}_pl USING (net, comp, pos))")
    out.append(
        f"{p}_ev AS (SELECT x.net, x.comp, sum(e.w * x.v * y.v) / any_value(s.n) AS ev FROM {edges} e JOIN {p}_nv x ON x.net = e.net AND x.node = e.a "
        f"JOIN {p}_nv y ON y.net = e.net AND y.node = e.b JOIN (SELECT net, comp, sum(v * v) AS n FROM {p}_nv GROUP BY ALL) s ON s.net = x.net AND s.comp = x.comp GROUP BY ALL)"
    )
    out.append(f"{p}_top AS (SELECT net, comp FROM (SELECT *, row_number() OVER (PARTITION BY net ORDER BY round(ev, 9) DESC, comp) AS place FROM {p}_ev) WHERE place = 1)")
    out.append(f"{p}_eig AS MATERIALIZED (SELECT n.net, n.node, coalesce(v, 0) AS eigenvector FROM {nodes} n LEFT JOIN (SELECT * FROM {p}_nv JOIN {p}_top USING (net, comp)) t ON t.net = n.net AND t.node = n.node)")
    return ",\n".join(out)
