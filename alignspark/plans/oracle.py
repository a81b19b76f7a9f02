"""Alignment recurrences as recursive SQL, an independent check of the kernel.

One recursion step fills one row of every pair's table.  The carry along the
row is a window aggregate: ``max(t + j * ext) - j * ext`` for best paths,
``sum(t * exp(j * ext)) * exp(-j * ext)`` for sums over all paths.  Unreachable
cells hold -1e300 (best) or 0 (sums).
"""

from __future__ import annotations

NEG = "-1e300"


def _match(match: float, mismatch: float) -> str:
    return f"CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN {match} ELSE {mismatch} END"


def best_sql(pairs: str, mode: str, model: str, match: float, mismatch: float, open_a: float, ext_a: float, open_b: float, ext_b: float, band: int | None = None, subst: str | None = None, by_row: dict[str, str] | None = None, guided: bool = False) -> str:
    """A query of (pair_id, score).

    ``pairs`` is a query of pair_id, a, b.  ``band`` keeps columns around the main
    diagonal, or with ``guided`` around the list g of ``pairs`` (affine gaps only).  ``by_row`` gives expressions in i (the row before the filled one)
    for penalties that differ by row: open_a, ext_a, open_b, ext_b.
    """
    score = subst or _match(match, mismatch)
    r = {"open_a": open_a, "ext_a": ext_a, "open_b": open_b, "ext_b": ext_b} | (by_row or {})
    oa, ea, ob, eb = (f"({r[k]})" for k in ("open_a", "ext_a", "open_b", "ext_b"))
    oa, ea = (x.replace("i0", "i") for x in (oa, ea))
    first = {"global": f"CASE WHEN j = 0 THEN 0 ELSE {NEG} END", "glocal": "0", "local": "0"}[mode]
    ends = {"global": "i = m AND j = n", "glocal": "i = m", "local": "TRUE"}[mode]
    inside = "TRUE"
    if band is not None:
        g = lambda row: f"g[{row} + 1]" if guided else f"CASE WHEN m = 0 THEN 0 ELSE CAST(floor({row} * n / CAST(m AS DOUBLE) + 0.5) AS BIGINT) END"
        inside = f"(j >= ({g('(i + 1)')}) - {band} AND (j <= greatest(({g('(i + 1)')}) + {band}, CASE WHEN i + 1 < m THEN ({g('(i + 2)')}) - 1 + {band} ELSE 0 END) OR (i + 1 = m AND '{mode}' = 'global')))"
    w = "OVER (PARTITION BY pair_id ORDER BY j)"
    carry = "OVER (PARTITION BY pair_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND {} )"
    head = f"WITH RECURSIVE pairs AS ({pairs}), cells AS (SELECT pair_id, a, b, length(a) AS m, length(b) AS n, unnest(range(0, length(b) + 1)) AS j FROM pairs)"
    if model == "linear":
        border = {"global": f"-j * ({r['ext_a']})".replace("i", "(-1)") if by_row else f"-j * {ext_a}", "glocal": "0", "local": "0"}[mode]
        top = f"greatest(lag(h) {w} + {score}, h - {eb})"
        cell = f"CASE WHEN j = 0 THEN {'0' if mode == 'local' else f'h - {eb}'} WHEN {inside} THEN {f'greatest({top}, 0)' if mode == 'local' else top} ELSE {NEG} END"
        return f"""{head},
dp AS (
  SELECT pair_id, a, b, m, n, CAST(0 AS BIGINT) AS i, j, CAST({border} AS DOUBLE) AS h FROM cells
  UNION ALL
  SELECT pair_id, a, b, m, n, i + 1, j, CASE WHEN {inside} OR j = 0 THEN max(t + j * {ea}) {carry.format('CURRENT ROW')} - j * {ea} ELSE {NEG} END
  FROM (SELECT *, CAST({cell} AS DOUBLE) AS t FROM dp WHERE i < m)
)
SELECT pair_id, max(h) AS score FROM dp WHERE {ends} GROUP BY pair_id"""
    row0_y = f"CASE WHEN j = 0 THEN {NEG} ELSE -({open_a} + j * {ext_a}) END" if mode == "global" else NEG
    diag = f"greatest(lag(mm) {w}, lag(x) {w}, lag(y) {w}) + {score}"
    col0_m, col0_x = ("0", NEG) if mode == "local" else (NEG, f"CASE WHEN i = 0 THEN -{ob} - {eb} ELSE x - {eb} END")
    more = ", g" if guided else ""
    head = head.replace("length(b) AS n,", f"length(b) AS n{more},")
    return f"""{head},
dp AS (
  SELECT pair_id, a, b, m, n{more}, CAST(0 AS BIGINT) AS i, j, CAST({first} AS DOUBLE) AS mm, CAST({NEG} AS DOUBLE) AS x, CAST({row0_y} AS DOUBLE) AS y FROM cells
  UNION ALL
  SELECT pair_id, a, b, m, n{more}, i + 1, j, nm, nx,
         CASE WHEN j > 0 AND {inside} THEN greatest(coalesce(max(greatest(nm, nx) + j * {ea}) {carry.format('1 PRECEDING')}, {NEG}) - {oa} - j * {ea}, {NEG}) ELSE {NEG} END
  FROM (
    SELECT *, CAST(CASE WHEN j = 0 THEN {col0_m} WHEN {inside} THEN {f'greatest({diag}, 0)' if mode == 'local' else diag} ELSE {NEG} END AS DOUBLE) AS nm,
           CAST(CASE WHEN j = 0 THEN {col0_x} WHEN {inside} THEN greatest(greatest(mm, y) - {ob} - {eb}, x - {eb}) ELSE {NEG} END AS DOUBLE) AS nx
    FROM dp WHERE i < m
  )
)
SELECT pair_id, max(greatest(mm, x, y)) AS score FROM dp WHERE {ends} GROUP BY pair_id"""


def log_z_sql(pairs: str, mode: str, model: str, match: float, mismatch: float, open_a: float, ext_a: float, open_b: float, ext_b: float, temperature: float = 1.0) -> str:
    """A query of (pair_id, log_z), the temperature times the log of the sum over all alignments, rounded to 6 places."""
    t = temperature
    match, mismatch, open_a, ext_a, open_b, ext_b = (x / t for x in (match, mismatch, open_a, ext_a, open_b, ext_b))
    score = f"exp({_match(match, mismatch)})"
    ends = {"global": "i = m AND j = n", "glocal": "i = m", "local": "TRUE"}[mode]
    w = "OVER (PARTITION BY pair_id ORDER BY j)"
    carry = "OVER (PARTITION BY pair_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND {} )"
    head = f"WITH RECURSIVE pairs AS ({pairs}), cells AS (SELECT pair_id, a, b, length(a) AS m, length(b) AS n, unnest(range(0, length(b) + 1)) AS j FROM pairs)"
    if model == "linear":
        first = f"exp(-j * {ext_a})" if mode == "global" else "1"
        plus = " + 1" if mode == "local" else ""
        col0 = "1" if mode == "local" else f"h * exp(-{ext_b})"
        # the start of column 0 reaches the row by gaps like any cell
        return f"""{head},
dp AS (
  SELECT pair_id, a, b, m, n, CAST(0 AS BIGINT) AS i, j, CAST({first} AS DOUBLE) AS h FROM cells
  UNION ALL
  SELECT pair_id, a, b, m, n, i + 1, j, sum(t * exp(j * {ext_a})) {carry.format('CURRENT ROW')} * exp(-j * {ext_a})
  FROM (SELECT *, CAST(CASE WHEN j = 0 THEN {col0} ELSE lag(h) {w} * {score} + h * exp(-{ext_b}){plus} END AS DOUBLE) AS t FROM dp WHERE i < m)
)
SELECT pair_id, round({t} * ln(sum(h)), 6) AS log_z FROM dp WHERE {ends} GROUP BY pair_id"""
    first = "CASE WHEN j = 0 THEN 1 ELSE 0 END" if mode == "global" else "1"
    row0_y = f"CASE WHEN j = 0 THEN 0 ELSE exp(-{open_a} - j * {ext_a}) END" if mode == "global" else "0"
    col0_m, col0_x = ("1", "0") if mode == "local" else ("0", f"CASE WHEN i = 0 THEN exp(-{open_b} - {ext_b}) ELSE x * exp(-{ext_b}) END")
    return f"""{head},
dp AS (
  SELECT pair_id, a, b, m, n, CAST(0 AS BIGINT) AS i, j, CAST({first} AS DOUBLE) AS mm, CAST(0 AS DOUBLE) AS x, CAST({row0_y} AS DOUBLE) AS y FROM cells
  UNION ALL
  SELECT pair_id, a, b, m, n, i + 1, j, nm, nx,
         CASE WHEN j = 0 THEN 0 ELSE coalesce(sum((nm + nx) * exp(j * {ext_a})) {carry.format('1 PRECEDING')}, 0) * exp(-{open_a} - j * {ext_a}) END
  FROM (
    SELECT *, CAST(CASE WHEN j = 0 THEN {col0_m} ELSE (lag(mm) {w} + lag(x) {w} + lag(y) {w}) * {score}{' + 1' if mode == 'local' else ''} END AS DOUBLE) AS nm,
           CAST(CASE WHEN j = 0 THEN {col0_x} ELSE (mm + y) * exp(-{open_b} - {ext_b}) + x * exp(-{ext_b}) END AS DOUBLE) AS nx
    FROM dp WHERE i < m
  )
)
SELECT pair_id, round({t} * ln(sum(mm + x + y)), 6) AS log_z FROM dp WHERE {ends} GROUP BY pair_id"""


def _best(m: str, x: str, y: str, less_m: str = "", less_x: str = "", less_y: str = "") -> str:
    """The best of three cells (structs with a value v) after what is taken off each: M before X before Y."""
    vm, vx, vy = f"({m}.v{less_m})", f"({x}.v{less_x})", f"({y}.v{less_y})"
    with_value = lambda c, v: f"{{'v': {v}, 'p': {c}.p, 'ga': {c}.ga, 'gb': {c}.gb, 'si': {c}.si, 'sj': {c}.sj}}"
    return f"CASE WHEN {vm} >= {vx} AND {vm} >= {vy} THEN {with_value(m, vm)} WHEN {vx} >= {vy} THEN {with_value(x, vx)} ELSE {with_value(y, vy)} END"


def path_sql(pairs: str, mode: str, match: float, mismatch: float, open_a: float, ext_a: float, open_b: float, ext_b: float) -> str:
    """The best path of every pair under affine gaps, ties M before X before Y, the first end in row order.

    Returns pair_id, a, b, score, ops (M both advance, I gap in B, D gap in A), ga and gb (the gapped
    strings), si, sj (where the path starts) and ei, ej (where it ends).  One recursion step fills one
    cell; each cell carries the path that led to it, so it is meant for short sequences.
    """
    oa, ea, ob, eb = (f"{float(x)}" for x in (open_a, ext_a, open_b, ext_b))
    cell = lambda v, p="''", ga="''", gb="''", si="0", sj="0": f"{{'v': CAST({v} AS DOUBLE), 'p': {p}, 'ga': {ga}, 'gb': {gb}, 'si': CAST({si} AS BIGINT), 'sj': CAST({sj} AS BIGINT)}}"
    none = cell(NEG)
    row0 = {
        "global": (f"CASE WHEN c = 0 THEN {cell(0)} ELSE {none} END", f"CASE WHEN c = 0 THEN {none} ELSE {cell(f'-({oa} + c * {ea})', 'repeat({}, c)'.format(chr(39) + 'D' + chr(39)), 'repeat({}, c)'.format(chr(39) + '-' + chr(39)), 'left(b, c)')} END"),
    }.get(mode, (cell(0, sj="c"), none))
    i1 = "(i + 1)"
    col0 = (cell(0, si=i1), none) if mode == "local" else (none, cell(f"-({ob} + {i1} * {eb})", f"repeat('I', {i1})", f"left(a, {i1})", f"repeat('-', {i1})"))
    # column k of a list stands at k + 1; the new cell is (i, j + 1)
    grown = lambda c, op, x, y: f"{{'v': {c}.v, 'p': {c}.p || '{op}', 'ga': {c}.ga || {x}, 'gb': {c}.gb || {y}, 'si': {c}.si, 'sj': {c}.sj}}"
    sub = f"(CASE WHEN substr(a, i, 1) = substr(b, j + 1, 1) THEN {float(match)} ELSE {float(mismatch)} END)"
    value = f"(dm.v + {sub})"
    m_cell = grown(f"{{'v': {value}, 'p': dm.p, 'ga': dm.ga, 'gb': dm.gb, 'si': dm.si, 'sj': dm.sj}}", "M", "substr(a, i, 1)", "substr(b, j + 1, 1)")
    if mode == "local":
        m_cell = f"CASE WHEN {value} <= 0 THEN {cell(0, si='i', sj='j + 1')} ELSE {m_cell} END"
    top = "greatest(nm.v, nx.v, ny.v)"
    state = _best("nm", "nx", "ny")
    found = {
        "global": f"CASE WHEN i = m AND j + 1 = n THEN {state} ELSE best END",
        "glocal": f"CASE WHEN i = m AND {top} > best.v THEN {state} ELSE best END",
        "local": f"CASE WHEN {top} > best.v THEN {state} ELSE best END",
    }[mode]
    better = {"global": "i = m AND j + 1 = n", "glocal": f"i = m AND {top} > best.v", "local": f"{top} > best.v"}[mode]
    edge = "i + 1 = m" if mode != "local" else "FALSE"  # the last row's first cell ends a glocal path (and a global one if b is empty)
    none_yet = cell(0) if mode == "local" else none
    return f"""WITH RECURSIVE pairs AS ({pairs}),
dp AS (
  SELECT pair_id, a, b, CAST(length(a) AS BIGINT) AS m, CAST(length(b) AS BIGINT) AS n, CAST(0 AS BIGINT) AS i, CAST(length(b) AS BIGINT) AS j,
         list_transform(range(0, length(b) + 1), lambda c: {none}) AS pm, list_transform(range(0, length(b) + 1), lambda c: {none}) AS px, list_transform(range(0, length(b) + 1), lambda c: {none}) AS py,
         list_transform(range(0, length(b) + 1), lambda c: {row0[0]}) AS cm, list_transform(range(0, length(b) + 1), lambda c: {none}) AS cx, list_transform(range(0, length(b) + 1), lambda c: {row0[1]}) AS cy,
         {none_yet} AS best, CAST(0 AS BIGINT) AS ei, CAST(0 AS BIGINT) AS ej
  FROM pairs
  UNION ALL
  SELECT pair_id, a, b, m, n, CASE WHEN turn THEN i + 1 ELSE i END, CASE WHEN turn THEN 0 ELSE j + 1 END,
         CASE WHEN turn THEN cm ELSE pm END, CASE WHEN turn THEN cx ELSE px END, CASE WHEN turn THEN cy ELSE py END,
         CASE WHEN turn THEN [{col0[0]}] ELSE list_append(cm, nm) END, CASE WHEN turn THEN [{col0[1]}] ELSE list_append(cx, nx) END, CASE WHEN turn THEN [{none}] ELSE list_append(cy, ny) END,
         CASE WHEN turn THEN CASE WHEN {edge} THEN {col0[1]} ELSE best END ELSE {found} END,
         CASE WHEN turn THEN CASE WHEN {edge} THEN i + 1 ELSE ei END WHEN {better} THEN i ELSE ei END,
         CASE WHEN turn THEN CASE WHEN {edge} THEN 0 ELSE ej END WHEN {better} THEN j + 1 ELSE ej END
  FROM (
    SELECT *, {m_cell} AS nm, {grown('ux', 'I', 'substr(a, i, 1)', "'-'")} AS nx, {grown('ly', 'D', "'-'", 'substr(b, j + 1, 1)')} AS ny
    FROM (
      SELECT *, j = n AS turn, {_best('pm[j + 1]', 'px[j + 1]', 'py[j + 1]')} AS dm,
             {_best('pm[j + 2]', 'px[j + 2]', 'py[j + 2]', f' - {ob} - {eb}', f' - {eb}', f' - {ob} - {eb}')} AS ux,
             {_best('cm[j + 1]', 'cx[j + 1]', 'cy[j + 1]', f' - {oa} - {ea}', f' - {oa} - {ea}', f' - {ea}')} AS ly
      FROM dp WHERE i < m OR j < n
    )
  )
)
SELECT pair_id, a, b, best.v AS score, best.p AS ops, best.ga AS ga, best.gb AS gb,
       CASE WHEN best.p = '' THEN 0 ELSE best.si END AS si, CASE WHEN best.p = '' THEN 0 ELSE best.sj END AS sj, ei, ej
FROM dp WHERE i = m AND j = n"""


def runs_of(ops: str) -> str:
    """The runs of equal letters of a string, as a list in SQL."""
    return f"regexp_extract_all({ops}, 'M+|I+|D+|=+|X+')"


def cigar_of(ops: str) -> str:
    return f"array_to_string(list_transform({runs_of(ops)}, lambda r: CAST(length(r) AS VARCHAR) || substr(r, 1, 1)), '')"


def posterior_sql(pairs: str, mode: str, match: float, mismatch: float, open_a: float, ext_a: float, open_b: float, ext_b: float) -> str:
    """CTEs of the sums over all alignments through each cell, under affine gaps (linear ones cost nothing to open).

    ``f`` sums the ways to reach a cell in each state; ``r`` those of the
    reversed sequences, so at (m - i, n - j) the ways to go on from it; ``z`` all
    alignments.  ``cell`` joins them: fm (a pair of letters was aligned into the
    cell), fx, fy and what follows each: tm, tx, ty.  A gap that goes on has paid
    its opening once: the reversed one's is given back.
    """
    w = "OVER (PARTITION BY pair_id ORDER BY j)"
    before = "OVER (PARTITION BY pair_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    score = f"exp({_match(match, mismatch)})"
    carry = f"coalesce(sum((nm + nx) * exp(j * {ext_a})) {before}, 0) * exp(-{open_a} - j * {ext_a})"
    down = f"(mm + y) * exp(-{open_b} - {ext_b}) + x * exp(-{ext_b})"
    anywhere = 1 if mode == "local" else 0
    inner = f"(lag(mm) {w} + lag(x) {w} + lag(y) {w}) * {score} + {anywhere}"
    ends = {"global": "i = m AND j = n", "glocal": "i = m", "local": "TRUE"}[mode]
    top = {"global": "CASE WHEN j = 0 THEN 1 ELSE 0 END"}.get(mode, "1")

    def table(name: str, source: str, free: bool) -> str:
        """``free``: gaps along the borders as along any row; else only where the mode has them."""
        row0 = f"coalesce(sum(CAST({top} AS DOUBLE) * exp(j * {ext_a})) {before}, 0) * exp(-{open_a} - j * {ext_a})" if free or mode == "global" else "0"
        col0 = down if free or mode != "local" else "0"
        return f"""{name} AS (
  SELECT pair_id, a, b, m, n, CAST(0 AS BIGINT) AS i, j, CAST({top} AS DOUBLE) AS mm, CAST(0 AS DOUBLE) AS x, CAST(CASE WHEN j = 0 THEN 0 ELSE {row0} END AS DOUBLE) AS y FROM {source}
  UNION ALL
  SELECT pair_id, a, b, m, n, i + 1, j, nm, nx, CASE WHEN j = 0 THEN 0 ELSE {carry} END
  FROM (SELECT *, CAST(CASE WHEN j = 0 THEN {anywhere} ELSE {inner} END AS DOUBLE) AS nm, CAST(CASE WHEN j = 0 THEN {col0} ELSE {down} END AS DOUBLE) AS nx FROM {name} WHERE i < m)
)"""

    sized = "length(a) AS m, length(b) AS n, unnest(range(0, length(b) + 1)) AS j FROM pairs"
    return f"""WITH RECURSIVE pairs AS ({pairs}), fc AS (SELECT pair_id, a, b, {sized}), rc AS (SELECT pair_id, reverse(a) AS a, reverse(b) AS b, {sized}),
{table('f', 'fc', False)}, {table('r', 'rc', True)},
z AS (SELECT pair_id, sum(mm + x + y) AS z FROM f WHERE {ends} GROUP BY pair_id),
cell AS MATERIALIZED (
  SELECT f.pair_id, f.a, f.b, f.m, f.n, f.i, f.j, z.z, f.mm AS f0, CASE WHEN f.i > 0 AND f.j > 0 THEN f.mm - {anywhere} ELSE 0 END AS fm, f.x AS fx, f.y AS fy,
         r.mm + r.x + r.y AS tm, r.mm + r.y + r.x * exp({open_b}) AS tx, r.mm + r.x + r.y * exp({open_a}) AS ty, r.mm + r.y AS ends_x, r.mm + r.x AS ends_y
  FROM f JOIN r ON r.pair_id = f.pair_id AND r.i = f.m - f.i AND r.j = f.n - f.j JOIN z ON z.pair_id = f.pair_id
)"""


def soft_counts_sql(pairs: str, symbols: str, mode: str, model: str, *values: float, total: bool = False) -> str:
    """(pair_id, field, value): every entry of the expected counts that is not 0 to five places; gaps count negative.

    With ``total`` the sums over all pairs, (field, value), to three places.
    """
    key, digits = ("", 3) if total else ("pair_id, ", 5)
    match, mismatch, open_a, ext_a, open_b, ext_b = values
    if model == "linear":
        open_a = open_b = 0
    n = len(symbols)
    opens = f"UNION ALL SELECT pair_id, {n * n}, -fy * ends_y / z FROM cell UNION ALL SELECT pair_id, {n * n + 2}, -fx * ends_x / z FROM cell" if model == "affine" else ""
    return f"""{posterior_sql(pairs, mode, match, mismatch, open_a, ext_a, open_b, ext_b)}
SELECT {key}CAST(field AS INTEGER) AS field, round(sum(v), {digits}) AS value FROM (
  SELECT pair_id, (strpos('{symbols}', substr(a, i, 1)) - 1) * {n} + strpos('{symbols}', substr(b, j, 1)) - 1 AS field, fm * tm / z AS v FROM cell WHERE i > 0 AND j > 0
  UNION ALL SELECT pair_id, {n * n + 1}, -fy * ty / z FROM cell UNION ALL SELECT pair_id, {n * n + 3}, -fx * tx / z FROM cell {opens}
) GROUP BY ALL HAVING round(sum(v), {digits}) <> 0"""


def posterior_guide_sql(pairs: str, mode: str, *values: float) -> str:
    """(pair_id, guide): for each row the column that most paths leave it at, the first of equals, never decreasing."""
    return f"""{posterior_sql(pairs, mode, *values)},
leaving AS (SELECT pair_id, i, j, (f0 * tm + fx * tx + fy * ty - coalesce(lead(fy * ty) OVER (PARTITION BY pair_id, i ORDER BY j), 0)) / z AS v FROM cell),
best AS (SELECT pair_id, i, arg_min(j, (-round(v, 10), j)) AS j FROM leaving GROUP BY pair_id, i),
rising AS (SELECT pair_id, i, max(j) OVER (PARTITION BY pair_id ORDER BY i) AS j FROM best)
SELECT pair_id, string_agg(CAST(j AS VARCHAR), ',' ORDER BY i) AS guide FROM rising GROUP BY pair_id"""
