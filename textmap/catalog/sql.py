"""DuckDB SQL pieces shared by the reference queries of the catalog."""

import math

from textmap.params import SomParams

FOLD = r"regexp_replace(strip_accents(lower({0})), '[^\x00-\x7F]', '', 'g')"
TOKENS = rf"regexp_extract_all({FOLD}, '\w\w+')"
TITLE = "trim(split_part(text, chr(10), 1))"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def tokens_of(table: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    return f"tok AS MATERIALIZED (SELECT {key} AS doc_id, {TOKENS.format(column)} AS terms FROM {table})"


def vocabulary(low: str = "0.01::DOUBLE * n", high: str = "0.6::DOUBLE * n") -> list[str]:
    return [
        "size AS (SELECT count(*) AS n FROM tok)",
        "freq AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM tok) GROUP BY term)",
        f"""voc AS MATERIALIZED (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, df
            FROM freq, size WHERE df >= {low} AND df <= {high})""",
    ]


RAW_CELLS = """raw AS MATERIALIZED (SELECT doc_id, term_id, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS v
    FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY ALL)
    JOIN voc USING (term), size)"""
UNIT_CELLS = """cells AS MATERIALIZED (SELECT doc_id, term_id,
    v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM raw)"""


def tfidf_ctes(**bounds: str) -> list[str]:
    return [tokens_of(), *vocabulary(**bounds), RAW_CELLS, UNIT_CELLS]


X = "x AS MATERIALIZED (SELECT vec_id AS doc_id, label, [e::DOUBLE for e in embedding] AS vec FROM embeddings)"
UNIT = "CASE WHEN list_dot_product({0}, {0}) > 0 THEN [e / sqrt(list_dot_product({0}, {0})) for e in {0}] ELSE {0} END"
XU = f"xu AS MATERIALIZED (SELECT doc_id, {UNIT.format('vec')} AS u FROM x)"


def first_rows(n: int, name: str = "k0") -> str:
    return f"""{name} AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INTEGER) AS node, vec
        FROM x ORDER BY doc_id LIMIT {n})"""


def random_rows(n: int, seed: int, name: str = "k0") -> str:
    return f"""{name} AS MATERIALIZED (SELECT node, list(w ORDER BY f) AS vec FROM (
        SELECT CAST(node AS INTEGER) AS node, f,
               ('0x' || md5('{seed}:' || node || ':' || f)[1:8])::BIGINT / 4294967296.0::DOUBLE AS w
        FROM range({n}) a(node), range((SELECT max(len(vec)) FROM x)) b(f)) GROUP BY node)"""


def assign(codebook: str, name: str, rows: str = "xu") -> str:
    """Best node of each row by cosine; equal to twelve digits means the lowest node."""
    return f"""{name} AS MATERIALIZED (SELECT doc_id, node, sim, 1.0 / (1.0e-4::DOUBLE + sim) - 1.0 AS qe FROM (
        SELECT doc_id, node, sim, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 12) DESC, node) AS rn
        FROM (SELECT doc_id, node, list_dot_product(r.u, k.u) AS sim
              FROM {rows} r, (SELECT node, {UNIT.format('vec')} AS u FROM {codebook}) k)) WHERE rn = 1)"""


def grid(params: SomParams) -> str:
    rows, cols = params.kshape
    return f"grid AS MATERIALIZED (SELECT CAST(n AS INTEGER) AS node, CAST(n // {cols} AS INTEGER) AS gx, CAST(n % {cols} AS INTEGER) AS gy FROM range({rows * cols}) t(n))"


def distance(params: SomParams) -> str:
    """Distance between grid cells a and b, as an expression."""
    rows, cols = params.kshape
    if params.topology == "hex":
        dx = "((b.gx - b.gy // 2) - (a.gx - a.gy // 2))"
        dy = "((b.gx + (b.gy + 1) // 2) - (a.gx + (a.gy + 1) // 2))"
        return f"(CASE WHEN {dx} * {dy} >= 0 THEN greatest(abs({dx}), abs({dy})) ELSE abs({dx}) + abs({dy}) END)::DOUBLE"
    dx, dy = "abs(a.gx - b.gx)", "abs(a.gy - b.gy)"
    if params.topology == "torus":
        dx, dy = f"least({dx}, {rows} - {dx})", f"least({dy}, {cols} - {dy})"
    return f"sqrt(({dx} * {dx} + {dy} * {dy})::DOUBLE)"


def kernel(params: SomParams, it: int, name: str, cut: bool = True) -> str:
    """(b, j, h): influence of node b on node j in epoch ``it``."""
    low, high = min(params.kshape), max(params.kshape)
    span = high if params.decay == "sparse" else low
    fade = f"exp(-{it}::DOUBLE / ({params.n_iter}::DOUBLE / ln({span}::DOUBLE)))"
    radius = f"({span} * {fade})"
    rate = f"({params.learning_rate}::DOUBLE * {fade})"
    shape = f"exp(-d * d / (2 * {radius} * {radius}))"
    if params.decay == "sparse":
        shape = f"exp(-d / (2 * {radius} * {it}))"
    if params.decay == "sigma":
        part = f"({it}::DOUBLE / {params.n_iter})"
        rate = f"({params.learning_rate}::DOUBLE * pow(0.05::DOUBLE, {part}))"
        sigma = f"({math.sqrt(params.n_nodes)!r}::DOUBLE * pow(0.2::DOUBLE / {math.sqrt(params.n_nodes)!r}::DOUBLE, {part}))"
        shape = f"exp(-d * d / ({sigma} * {sigma}))"
    value = f"CASE WHEN d <= {radius} + 1e-9::DOUBLE THEN {rate} * {shape} ELSE 0.0 END"
    kept = f"CASE WHEN h > {params.min_influence!r}::DOUBLE THEN h ELSE 0.0 END" if cut else "h"
    return f"""{name} AS MATERIALIZED (SELECT b, j, d, {kept} AS h FROM (SELECT b, j, d, {value} AS h
        FROM (SELECT a.node AS b, b.node AS j, {distance(params)} AS d FROM grid a, grid b)))"""


def epoch(params: SomParams, it: int) -> list[str]:
    """CTEs a{it} (best units), h{it} (kernel) and k{it} (codebook after the epoch), from k{it-1}."""
    before = f"k{it - 1}"
    if params.update == "mean":
        moved = "CASE WHEN w > 0 THEN p / w ELSE old END"
    else:
        moved = "old + p - w * old"
    return [
        assign(before, f"a{it}"),
        f"""s{it} AS MATERIALIZED (SELECT node, f, sum(v) AS s, count(*) AS n FROM (
            SELECT node, unnest(vec) AS v, generate_subscripts(vec, 1) AS f FROM a{it} JOIN x USING (doc_id)) GROUP BY ALL)""",
        kernel(params, it, f"h{it}"),
        f"""k{it} AS MATERIALIZED (SELECT node, list(w ORDER BY f) AS vec FROM (
            SELECT o.node, o.f, {moved} AS w FROM
            (SELECT node, unnest(vec) AS old, generate_subscripts(vec, 1) AS f FROM {before}) o
            JOIN (SELECT j, f, sum(h * s) AS p, sum(h * n) AS w FROM h{it} JOIN s{it} ON b = node GROUP BY j, f) m
            ON o.node = m.j AND o.f = m.f) GROUP BY node)""",
    ]


def trained(params: SomParams, epochs: int) -> list[str]:
    """x, xu, grid, k0 (first rows) and all epochs; the last codebook is k{epochs}."""
    parts = [X, XU, grid(params), first_rows(params.n_nodes)]
    for it in range(1, epochs + 1):
        parts += epoch(params, it)
    return parts


def ward(codebook: str, params: SomParams, n_clusters: int) -> list[str]:
    """node_clusters by greedy Ward merges between side neighbours, one CTE per merge."""
    parts = [
        "side AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM grid a, grid b WHERE abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1)",
        f"g0 AS MATERIALIZED (SELECT node, node AS region, vec FROM {codebook})",
    ]
    merges = params.n_nodes - n_clusters
    for step in range(merges):
        g = f"g{step}"
        parts += [
            f"""c{step}_ AS MATERIALIZED (SELECT region, max(n) AS n, list(m ORDER BY f) AS m FROM (
                SELECT region, f, avg(v) AS m, count(*) AS n FROM (
                SELECT region, unnest(vec) AS v, generate_subscripts(vec, 1) AS f FROM {g}) GROUP BY ALL) GROUP BY region)""",
            f"""b{step}_ AS MATERIALIZED (SELECT lo, hi FROM (
                SELECT DISTINCT least(p.region, q.region) AS lo, greatest(p.region, q.region) AS hi
                FROM side JOIN {g} p ON p.node = a JOIN {g} q ON q.node = b WHERE p.region <> q.region)
                JOIN c{step}_ u ON u.region = lo JOIN c{step}_ v ON v.region = hi
                ORDER BY round(u.n * v.n / (u.n + v.n)::DOUBLE * pow(list_distance(u.m, v.m), 2), 12), lo, hi LIMIT 1)""",
            f"g{step + 1} AS MATERIALIZED (SELECT node, CASE WHEN region = hi THEN lo ELSE region END AS region, vec FROM {g}, b{step}_)",
        ]
    parts.append(
        f"node_clusters AS MATERIALIZED (SELECT node, CAST(dense_rank() OVER (ORDER BY region) - 1 AS INTEGER) AS cluster FROM g{merges})"
    )
    return parts


def assign_by(key: str, codebook: str, name: str) -> str:
    """As ``assign``, each row on the map of its own group."""
    return f"""{name} AS MATERIALIZED (SELECT {key}, doc_id, node, 1.0 / (1e-4::DOUBLE + sim) - 1.0 AS qe FROM (
        SELECT {key}, doc_id, node, sim, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 12) DESC, node) AS rn
        FROM (SELECT r.{key}, doc_id, node, list_dot_product({UNIT.format('r.vec')}, k.u) AS sim
              FROM x r JOIN (SELECT {key}, node, {UNIT.format('vec')} AS u FROM {codebook}) k ON r.{key} = k.{key})) WHERE rn = 1)"""


def trained_by(key: str, params: SomParams) -> list[str]:
    """k0 .. kn: codebooks (key, node, vec) of one map per value of ``key``, from its first rows in turn."""
    parts = [
        f"x AS MATERIALIZED (SELECT {key}, vec_id AS doc_id, [v::DOUBLE for v in embedding] AS vec FROM embeddings)",
        grid(params),
        f"placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY {key}) AS size FROM x)",
        f"k0 AS MATERIALIZED (SELECT {key}, grid.node, vec FROM placed JOIN grid ON place = grid.node % size)",
    ]
    for it in range(1, params.n_iter + 1):
        parts += [
            assign_by(key, f"k{it - 1}", f"a{it}"),
            f"""s{it} AS MATERIALIZED (SELECT {key}, node, f, sum(v) AS s, count(*) AS n FROM (
                SELECT x.{key}, node, unnest(vec) AS v, generate_subscripts(vec, 1) AS f FROM a{it} JOIN x USING (doc_id)) GROUP BY ALL)""",
            kernel(params, it, f"h{it}"),
            f"""k{it} AS MATERIALIZED (SELECT {key}, node, list(w ORDER BY f) AS vec FROM (
                SELECT o.{key}, o.node, o.f, CASE WHEN w > 0 THEN p / w ELSE old END AS w FROM
                (SELECT {key}, node, unnest(vec) AS old, generate_subscripts(vec, 1) AS f FROM k{it - 1}) o
                JOIN (SELECT {key}, j, f, sum(h * s) AS p, sum(h * n) AS w FROM h{it} JOIN s{it} ON b = node GROUP BY ALL) m
                ON o.{key} = m.{key} AND o.node = m.j AND o.f = m.f) GROUP BY ALL)""",
        ]
    return parts


def ward_by(key: str, codebook: str, params: SomParams, n_clusters: int) -> list[str]:
    """As ``ward``, the cheapest merge of every map in each step."""
    parts = [
        "side AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM grid a, grid b WHERE abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1)",
        f"g0 AS MATERIALIZED (SELECT {key}, node, node AS region, vec FROM {codebook})",
    ]
    merges = params.n_nodes - n_clusters
    for step in range(merges):
        g = f"g{step}"
        parts += [
            f"""c{step}_ AS MATERIALIZED (SELECT {key}, region, max(n) AS n, list(m ORDER BY f) AS m FROM (
                SELECT {key}, region, f, avg(v) AS m, count(*) AS n FROM (
                SELECT {key}, region, unnest(vec) AS v, generate_subscripts(vec, 1) AS f FROM {g}) GROUP BY ALL) GROUP BY ALL)""",
            f"""b{step}_ AS MATERIALIZED (SELECT {key}, lo, hi FROM (SELECT t.{key}, lo, hi, row_number() OVER (PARTITION BY t.{key} ORDER BY
                round(u.n * v.n / (u.n + v.n)::DOUBLE * pow(list_distance(u.m, v.m), 2), 12), lo, hi) AS rn FROM (
                SELECT DISTINCT p.{key}, least(p.region, q.region) AS lo, greatest(p.region, q.region) AS hi
                FROM side JOIN {g} p ON p.node = a JOIN {g} q ON q.node = b AND q.{key} = p.{key} WHERE p.region <> q.region) t
                JOIN c{step}_ u ON u.region = lo AND u.{key} = t.{key} JOIN c{step}_ v ON v.region = hi AND v.{key} = t.{key}) WHERE rn = 1)""",
            f"g{step + 1} AS MATERIALIZED (SELECT {g}.{key}, node, CASE WHEN region = hi THEN lo ELSE region END AS region, vec FROM {g} JOIN b{step}_ ON b{step}_.{key} = {g}.{key})",
        ]
    parts.append(
        f"node_clusters AS MATERIALIZED (SELECT {key}, node, CAST(dense_rank() OVER (PARTITION BY {key} ORDER BY region) - 1 AS INTEGER) AS cluster FROM g{merges})"
    )
    return parts
