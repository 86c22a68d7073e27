"""The same questions in plain SQL, in the most literal form: pairs of points, pairs of
cells, one subquery per center. Numbers are passed as doubles, digit for digit."""

import math

from quillgrid import queries as q
from quillgrid.functions.geometry import cell_side
from quillgrid.operators.kcenter import FAN


def _d(value: float) -> str:
    return f"{value!r}::double"


# -- inputs ---------------------------------------------------------------------

E = "e as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y from embeddings)"
O = """o as (select o_orderkey as id, o_totalprice / 1000::double as x, c_acctbal / 100::double as y
      from orders join customer on o_custkey = c_custkey)"""
L = "l as (select l_quantity as x, l_extendedprice / 1000::double as y from lineitem)"
LINES = """lines as (select doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::integer as line_no,
                 unnest(string_split(text, chr(10))) as text from documents)"""
WORDS = LINES + ",\n words as (select doc_id, line_no, unnest(string_split(text, ' ')) as word from lines)"


def _distance(a: str, b: str) -> str:
    return f"(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def _uniform(salt: str, key: str) -> str:
    return f"('0x' || substr(md5('{salt}' || {key}), 1, 8))::bigint / 4294967296::double"


# -- grid and outliers ------------------------------------------------------------

def _cells(points: str, side: str) -> str:
    return f"""cells as (select floor(x / {side})::bigint as i, floor(y / {side})::bigint as j, count(*) as n
                from {points} group by all)"""


BLOCKS = """blocks as (
    select a.i, a.j, any_value(a.n) as n, sum(b.n)::bigint as n7,
           sum(case when abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 then b.n end)::bigint as n3
    from cells a join cells b on b.i between a.i - 3 and a.i + 3 and b.j between a.j - 3 and a.j + 3
    group by a.i, a.j)"""


def _bounds(m: int) -> str:
    return f"""coalesce(sum(case when n7 <= {m} then n end), 0)::bigint as sure,
               coalesce(sum(case when n3 <= {m} and n7 > {m} then n end), 0)::bigint as uncertain"""


def _approximate(source: str, name: str, distance: float, m: int) -> str:
    return f"with {source}, {_cells(name, _d(cell_side(distance)))}, {BLOCKS} select {_bounds(m)} from blocks"


def _counts(source: str, name: str, distance: float) -> str:
    return f"""{source}, counts as (
        select a.id, a.x, a.y, count(*) as n from {name} a join {name} b
        on {_distance('a', 'b')} <= {_d(distance * distance)} group by a.id, a.x, a.y)"""


def _exact(source, name, distance, neighbours) -> str:
    return f"with {_counts(source, name, distance)} select count(*) as exact from counts where n <= {neighbours}"


def _top(source, name, distance, neighbours) -> str:
    return f"""with {_counts(source, name, distance)} select id, x, y, n from counts where n <= {neighbours}
               order by n, x, y, id limit {q.TOP}"""


def _report(source, name, distance, neighbours) -> str:
    return f"""with {_counts(source, name, distance)}, {_cells(name, _d(cell_side(distance)))}, {BLOCKS}
               select (select count(*) from counts where n <= {neighbours}) as exact, {_bounds(neighbours)}
               from blocks"""


# -- k-center ---------------------------------------------------------------------

def _chain(name: str, prefix: str, k: int, start: str = "id") -> str:
    """One subquery per center: the point farthest from all centers before it."""
    parts = [f"{prefix}0 as materialized (select id, x, y from {name} order by {start} limit 1)"]
    for r in range(1, k):
        before = [f"{prefix}{c}" for c in range(r)]
        near = "least(" + ", ".join(_distance("p", c) for c in before) + ")"
        parts.append(f"""{prefix}{r} as materialized (select p.id, p.x, p.y from {name} p, {', '.join(before)}
                         order by {near} desc, p.id limit 1)""")
    return ",\n".join(parts)


def _centers(prefix: str, k: int) -> str:
    return " union all ".join(f"select {r}::integer as rank, id, x, y from {prefix}{r}" for r in range(k))


def _coreset(name: str, k: int) -> str:
    grouped = f"g as (select *, id % {q.PARTS} as g from {name})"
    parts = [grouped, "g0 as materialized (select g, id, x, y from g qualify row_number() over (partition by g order by id) = 1)"]
    for r in range(1, k):
        before = [f"g{c}" for c in range(r)]
        near = "least(" + ", ".join(_distance("p", c) for c in before) + ")"
        joins = " ".join(f"join {c} on {c}.g = p.g" for c in before)
        parts.append(f"""g{r} as materialized (select p.g, p.id, p.x, p.y from g p {joins}
                         qualify row_number() over (partition by p.g order by {near} desc, p.id) = 1)""")
    union = " union all ".join(f"select g, {r}::integer as rank, id, x, y from g{r}" for r in range(k))
    return ",\n".join(parts) + f",\ncoreset as materialized ({union})"


def _mr(source: str, name: str, k: int) -> str:
    return f"with {source}, {_coreset(name, k)}, {_chain('coreset', 'c', k)}, centers as ({_centers('c', k)})"


def _nearest(name: str) -> str:
    return f"""nearest as (select p.id, min({_distance('p', 'c')}) as d2, arg_min(c.rank, ({_distance('p', 'c')}, c.rank)) as center
                           from {name} p, centers c group by p.id)"""


def _covers(source: str, prefix: str, k: int) -> str:
    """Farthest-first in each node of ``source``, and what the centers stand for, as ``{prefix}_t``."""
    parts = [f"{prefix}0 as materialized (select node, id, x, y from {source} qualify row_number() over (partition by node order by id) = 1)"]
    for r in range(1, k):
        before = [f"{prefix}{c}" for c in range(r)]
        near = "least(" + ", ".join(_distance("p", c) for c in before) + ")"
        joins = " ".join(f"join {c} on {c}.node = p.node" for c in before)
        parts.append(f"""{prefix}{r} as materialized (select p.node, p.id, p.x, p.y from {source} p {joins} where {near} > 0
                         qualify row_number() over (partition by p.node order by {near} desc, p.id) = 1)""")
    union = " union all ".join(f"select node, {r}::integer as rank, id, x, y from {prefix}{r}" for r in range(k))
    return ",\n".join(parts) + f""",
        {prefix}_c as materialized ({union}),
        {prefix}_m as (select p.node, p.id, any_value(p.n) as n, any_value(p.radius) as radius, min({_distance('p', 'c')}) as d2,
                             arg_min(c.rank, ({_distance('p', 'c')}, c.rank)) as rank
                      from {source} p join {prefix}_c c on c.node = p.node group by p.node, p.id),
        {prefix}_t as materialized (select c.node, c.rank, c.id, c.x, c.y, sum(m.n)::bigint as n, max(sqrt(m.d2) + m.radius) as radius
                      from {prefix}_c c join {prefix}_m m on m.node = c.node and m.rank = c.rank group by all)"""


def _tree(levels: int) -> str:
    """Coresets of splits of O, merged ``levels`` times; a single node stays as it is."""
    parts = [O, f"""s0 as (select (id - low) // {q.SPLIT_WIDTH} as node, id, x, y, 1::bigint as n, 0::double as radius
                           from o, (select min(id) as low from o))""", _covers("s0", "a", q.K_ORDERS)]
    for level, (before, prefix) in enumerate(zip("abc", "bcd"[:levels]), 1):
        parts += [f"s{level} as (select node // {FAN} as node, id, x, y, n, radius from {before}_t)", _covers(f"s{level}", prefix, q.K_ORDERS)]
    return f"with {', '.join(parts)} select node, rank, id, x, y, n, radius from {'abcd'[levels]}_t"


def _radius_outliers(source: str, name: str, k: int, m: int) -> str:
    return f"""{_mr(source, name, k)}, {_nearest(name)},
        r as materialized (select sqrt(max(d2)) as radius, sqrt(max(d2)) / (2 * sqrt(2::double)) as side from nearest),
        {_cells(f'{name}, r', 'r.side')}, {BLOCKS}
        select any_value(radius) as radius, {_bounds(m)} from blocks, r"""


# -- frequent items ---------------------------------------------------------------

M = math.ceil(1 / q.PHI)
R = math.log(1 / (q.PHI * q.DELTA)) / q.EPSILON
V = f"""total as (select count(*) as total from events),
 v as (select event_id as arrival, user_id as item from events),
 histogram as (select item, count(*) as n from v group by item),
 truth as (select item, n from histogram, total where n::double / total::double >= {_d(q.PHI)}),
 entered as (select arrival, item, case when arrival < {M} then arrival
                   else floor({_uniform('b', 'arrival')} * {M})::bigint end as slot
             from v where arrival < {M} or {_uniform('a', 'arrival')} <= {M}::double / (arrival + 1)::double),
 reservoir as (select slot, arg_max(item, arrival) as item, max(arrival) as arrival from entered group by slot),
 tracked as (select item, min(arrival) as first from v, total
             where {_uniform('c', 'arrival')} <= {_d(R)} / total::double group by item),
 sticky as (select item, count(*) as n from v join tracked using (item) where arrival >= first group by item),
 guessed as (select item, n from sticky, total where n >= {_d(q.PHI - q.EPSILON)} * total::double)"""


def oracle_sql() -> dict[str, str]:
    e, o = q.EMBEDDING, q.ORDER
    counted = f"with {WORDS} select word, count(*) as n from words group by word"
    line_cells = f"with {L}, {_cells('l', _d(cell_side(q.LINE_DISTANCE)))}"
    salt = "floor(" + _uniform("0:", "concat_ws('|', doc_id, line_no, word)") + f" * {q.SALTS})::bigint"
    embedded = _d(cell_side(e["distance"]))
    flags = f"""with {V} select method, item, item in (select item from truth) as is_true from (
                              select distinct 'reservoir' as method, item from reservoir
                              union all select 'sticky', item from guessed)"""
    sizes = f"""with {V} select
            (select count(*) from histogram) as histogram_items, (select count(*) from truth) as true_items,
            (select count(*) from sticky) as sticky_items, (select count(*) from guessed) as sticky_estimates,
            (select count(*) from reservoir) as reservoir_rows,
            (select count(distinct item) from reservoir) as reservoir_estimates,
            {M}::bigint as m, {_d(R)} as r, {_d(R)} / total::double as rate from total"""
    return {
        "doc_lines": f"with {LINES} select doc_id, line_no, text from lines",
        "count_docs": "select count(*) as documents from documents",
        "load_points": f"with {E} select id, x, y from e",
        "parse_points": f"with {E} select id, x, y from e",
        "spread_points": f"with {E} select id, x, y from e",
        "count_points": f"with {E} select count(*) as points from e",
        "stream_items": "select event_id as arrival, user_id as item from events",
        "stream_text_items": "select row_number() over (order by event_id) - 1 as arrival, user_id as item from events",
        "item_positions": "select row_number() over (order by ts, event_id) - 1 as arrival, user_id as item from events",
        "word_count_per_doc": f"with {WORDS} select doc_id, line_no, word, count(*) as n from words group by all",
        "word_count_per_doc_salted": f"""with {WORDS} select doc_id, line_no, word, count(*) as n, {salt} as salt
                                         from words group by doc_id, line_no, word""",
        "word_count": counted,
        "word_count_salted": counted,
        "word_count_salted_fly": counted,
        "word_count_partition": counted,
        "distinct_words": f"with {WORDS} select count(distinct word) as distinct_words from words",
        "avg_word_length": f"""with {WORDS} select avg(length(word)) as average_word_length
                               from (select distinct word from words)""",
        "point_cells": f"""with {E} select id, floor(x / {embedded})::bigint as i, floor(y / {embedded})::bigint as j
                           from e""",
        "cell_histogram": f"{line_cells} select i, j, n from cells",
        "cell_neighbourhoods": f"{line_cells}, {BLOCKS} select i, j, n, n3, n7 from blocks",
        "approx_outliers": _approximate(E, "e", e["distance"], e["neighbours"]),
        "approx_outliers_lines": _approximate(L, "l", q.LINE_DISTANCE, q.LINE_NEIGHBOURS),
        "smallest_cells": f"{line_cells} select i, j, n from cells order by n, i, j limit {q.TOP}",
        "neighbour_counts": f"with {_counts(E, 'e', e['distance'])} select id, x, y, n from counts",
        "neighbour_counts_orders": f"with {_counts(O, 'o', o['distance'])} select id, x, y, n from counts",
        "exact_outlier_count": _exact(E, "e", **e),
        "exact_outlier_count_orders": _exact(O, "o", **o),
        "top_outliers": _top(E, "e", **e),
        "top_outliers_orders": _top(O, "o", **o),
        "outlier_report": _report(E, "e", **e),
        "outlier_report_orders": _report(O, "o", **o),
        "kcenter_global": f"with {E}, {_chain('e', 'c', q.K)} {_centers('c', q.K)}",
        "kcenter_global_seeded":
            f"with {E}, {_chain('e', 'c', q.K, _uniform(f'{q.SEED}:', 'id') + ', id')} {_centers('c', q.K)}",
        "kcenter_coreset": f"with {E}, {_coreset('e', q.K)} select g, rank, id, x, y from coreset",
        "kcenter_coreset_orders": f"with {O}, {_coreset('o', q.K_ORDERS)} select g, rank, id, x, y from coreset",
        "kcenter_coreset_split": _tree(0),
        "kcenter_mr_split": _tree(3),
        "kcenter_mr": f"{_mr(E, 'e', q.K)} select rank, id, x, y from centers",
        "kcenter_mr_orders": f"{_mr(O, 'o', q.K_ORDERS)} select rank, id, x, y from centers",
        "nearest_center": f"""with {E}, {_chain('e', 'c', q.K)}, centers as ({_centers('c', q.K)}), {_nearest('e')}
                              select id, center, d2 from nearest""",
        "kcenter_radius": f"{_mr(E, 'e', q.K)}, {_nearest('e')} select sqrt(max(d2)) as radius from nearest",
        "kcenter_radius_orders":
            f"{_mr(O, 'o', q.K_ORDERS)}, {_nearest('o')} select sqrt(max(d2)) as radius from nearest",
        "kcenter_outliers": _radius_outliers(O, "o", q.K_ORDERS, q.RADIUS_NEIGHBOURS_ORDERS),
        "kcenter_outliers_embeddings": _radius_outliers(E, "e", q.K, q.RADIUS_NEIGHBOURS),
        "stream_prefix": """select event_id as arrival, user_id as item from events
                            where event_id < (select greatest(1, count(*) // 2) from events)""",
        "item_histogram": f"with {V} select item, n from histogram",
        "stream_histogram": f"with {V} select item, n from histogram",
        "frequent_exact": f"with {V} select item, n from truth order by item",
        "reservoir_sample": f"with {V} select slot, item, arrival from reservoir",
        "reservoir_sample_stream": f"with {V} select slot, item, arrival from reservoir",
        "frequent_reservoir": f"with {V} select distinct item from reservoir order by item",
        "sticky_counts": f"with {V} select item, n from sticky",
        "sticky_counts_stream": f"with {V} select item, n from sticky",
        "frequent_sticky": f"with {V} select item, n from guessed order by item",
        "frequent_flags": flags,
        "frequent_flags_stream": flags,
        "heavy_hitter_report": sizes,
        "heavy_hitter_report_stream": sizes,
    }
