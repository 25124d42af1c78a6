"""DuckDB SQL for the pattern engine's queries."""

from __future__ import annotations

#: Decimal places to which both sides round doubles.
ROUNDING = 9
#: Lines that are no patterns: the line, its n and count of rows (-1: none), what is wrong.
BAD_LINES = (
    ("not json", -1, -1, "n missing"),
    ('{"n":2}', 2, -1, "col_at missing"),
    ('{"n":1,"indptr":[0],"indices":[]}', 1, 0, "col_at length"),
    ('{"n":1,"indptr":[1,1],"indices":[0]}', 1, 1, "col_at start"),
    ('{"n":1,"indptr":[0,2],"indices":[0]}', 1, 1, "col_at end"),
    ('{"n":2,"indptr":[0,2,1],"indices":[1]}', 2, 1, "col_at falls"),
    ('{"n":1,"indptr":[0,1],"indices":[1]}', 1, 1, "row out of range"),
)
MONTH = "SELECT 'month-' || strftime(l_shipdate, '%Y-%m') AS mid, l_suppkey AS l, l_partkey AS r FROM lineitem"
YEAR = "SELECT 'year-' || strftime(l_shipdate, '%Y') AS mid, l_suppkey AS l, l_partkey AS r FROM lineitem"
BRAND = "SELECT 'brand-' || p_brand AS mid, l_suppkey AS l, l_partkey AS r FROM lineitem JOIN part ON p_partkey = l_partkey"
PRIORITY = "SELECT 'priority-' || o_orderpriority AS mid, o_custkey AS l, o_orderkey AS r FROM orders"
ORDERS = "SELECT 'orders' AS mid, o_custkey AS l, o_orderkey AS r FROM orders"


def family(*sources: str) -> str:
    """CTEs: v (mid, kind, key, id), h (mid, a, b once), e (both ways), m (mid, n)."""
    return f"""raw AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(sources)}) WHERE mid IS NOT NULL AND l IS NOT NULL AND r IS NOT NULL),
v AS (SELECT mid, kind, key, row_number() OVER (PARTITION BY mid ORDER BY kind, key) - 1 AS id
  FROM (SELECT DISTINCT mid, 0 AS kind, l AS key FROM raw UNION ALL SELECT DISTINCT mid, 1 AS kind, r AS key FROM raw)),
h AS (SELECT raw.mid, x.id AS a, y.id AS b FROM raw JOIN v x ON x.mid = raw.mid AND x.kind = 0 AND x.key = raw.l JOIN v y ON y.mid = raw.mid AND y.kind = 1 AND y.key = raw.r),
e AS (SELECT mid, a, b FROM h UNION ALL SELECT mid, b, a FROM h),
m AS (SELECT mid, count(*) AS n FROM v GROUP BY mid),
deg AS (SELECT v.mid, v.id AS v, count(e.a) AS degree FROM v LEFT JOIN e ON e.mid = v.mid AND e.a = v.id GROUP BY ALL)"""


ALL = family(MONTH, PRIORITY, ORDERS)
ONE = family(MONTH)
DEGREE = "o AS (SELECT mid, row_number() OVER (PARTITION BY mid ORDER BY degree, v) - 1 AS k, v FROM deg)"
REVERSE = "SELECT mid, row_number() OVER (PARTITION BY mid ORDER BY id DESC) - 1 AS k, id AS v FROM v"


def closure(name: str, edges: str) -> str:
    """CTEs <name>_reach and <name> (mid, j, parent, c): factor columns by the fill-path theorem; edges: a table (mid, a, b) both ways; vertices from v."""
    return f"""{name}_reach(mid, j, v) AS (SELECT mid, a, b FROM {edges} UNION SELECT r.mid, r.j, x.b FROM {name}_reach r JOIN {edges} x ON x.mid = r.mid AND x.a = r.v WHERE r.v < r.j AND x.b <> r.j),
{name} AS (SELECT v.mid, v.id AS j, min(r.v) FILTER (r.v > v.id) AS parent, 1 + count(r.v) FILTER (r.v > v.id) AS c FROM v LEFT JOIN {name}_reach r ON r.mid = v.mid AND r.j = v.id GROUP BY ALL)"""


def scored(name: str, columns: str) -> str:
    return f"{name} AS (SELECT mid, count(*) AS n, CAST(sum(c) AS BIGINT) AS nnz_l, CAST(sum(c * c) AS BIGINT) AS flops FROM {columns} GROUP BY mid)"


MOVED = "d AS (SELECT e.mid, x.k AS a, y.k AS b FROM e JOIN o x ON x.mid = e.mid AND x.v = e.a JOIN o y ON y.mid = e.mid AND y.v = e.b)"
BACKWARDS = "t AS (SELECT e.mid, m.n - 1 - a AS a, m.n - 1 - b AS b FROM e JOIN m USING (mid))"


def both(fam: str) -> str:
    """CTEs natural and degree (mid, n, nnz_l, flops) and ratio."""
    return f"""{fam}, {DEGREE}, {MOVED}, {closure("cn", "e")}, {scored("natural_s", "cn")}, {closure("cd", "d")}, {scored("degree_s", "cd")},
ratio AS (SELECT x.mid, x.n, x.flops, y.flops AS base_flops, CAST(x.flops AS DOUBLE) / y.flops AS flop_ratio, CAST(x.nnz_l AS DOUBLE) / y.nnz_l AS fill_ratio FROM degree_s x JOIN natural_s y USING (mid)),
bucket AS (SELECT * FROM (VALUES (0, 'lt_1k', CAST(0.3 AS DOUBLE)), (1, '1k_10k', CAST(0.3 AS DOUBLE)), (2, 'gt_10k', CAST(0.4 AS DOUBLE))) t(place, bucket, weight)),
means AS (SELECT place, b.bucket, weight, count(mid) AS matrices, exp(avg(ln(flop_ratio))) AS flop_geomean, exp(avg(ln(fill_ratio))) AS fill_geomean
  FROM bucket b LEFT JOIN (SELECT *, CASE WHEN n < 1000 THEN 'lt_1k' WHEN n < 10000 THEN '1k_10k' ELSE 'gt_10k' END AS bucket FROM ratio) r ON r.bucket = b.bucket GROUP BY ALL),
total AS (SELECT coalesce(sum(weight * flop_geomean) / sum(weight) FILTER (flop_geomean IS NOT NULL), CAST('NaN' AS DOUBLE)) AS score,
  coalesce(sum(weight * fill_geomean) / sum(weight) FILTER (fill_geomean IS NOT NULL), CAST('NaN' AS DOUBLE)) AS fill, CAST(sum(matrices) AS BIGINT) AS matrices FROM means)"""


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, {ROUNDING}) AS {n}" for n in names)


NATIONS = """raw AS (SELECT CAST(n_regionkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) + 100 AS b FROM nation UNION SELECT CAST(c_nationkey AS BIGINT) + 100, c_custkey * 2 + 1000 FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) + 100, s_suppkey * 2 + 1001 FROM supplier),
e AS (SELECT a, b FROM raw UNION SELECT b, a FROM raw)"""
SIDES = "s AS (SELECT mid, id AS v, id % 3 = 0 AS side FROM v)"


def mesh(name: str, k: int, axes: int) -> str:
    steps = " UNION ALL ".join(f"SELECT i AS a, i + {k**x} AS b FROM range({k**axes}) t(i) WHERE (i // {k**x}) % {k} < {k - 1}" for x in range(axes))
    return f"WITH RECURSIVE g AS (SELECT '{name}' AS mid, a, b FROM ({steps})), {_GENERATED}"


_GENERATED = f"e AS (SELECT mid, a, b FROM g UNION SELECT mid, b, a FROM g), v AS (SELECT DISTINCT mid, a AS id FROM e), {closure('c', 'e')}, {scored('s', 'c')} SELECT mid, n, nnz_l, flops FROM s"
_TEXTS = "(SELECT 'd' || doc_id AS path, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages)"
_W = "(license|License|idiot|script)"
#: Lines of a column ``text``, beside the columns named.
TEXT_LINES = r"SELECT {}, unnest(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10))) AS content, generate_subscripts(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)), 1) AS line FROM "


def _gates() -> str:
    text = ", ".join(f"({i}, '{name}', {n}, {low}, {high})" for i, name, n, low, high in GATES)
    return f"g(cand_idx, candidate, max_n, min_nnz, max_nnz) AS (VALUES {text})"



#: Sources: path, text, line and kind of the first finding (none: null), the text without comments and with blank strings, the text without comments.
SOURCES = (
    ("f01", 'extern "C" { fn f(); }', 1, "foreign functions", 'extern " " { fn f(); }', 'extern "C" { fn f(); }'),
    ("f02", "// extern in prose\nfn f() {}", None, None, "\nfn f() {}", "\nfn f() {}"),
    ("f03", "/* a /* extern */ extern */ let x = 1;", None, None, " let x = 1;", " let x = 1;"),
    ("f04", 'let s = "extern";', None, None, 'let s = "      ";', 'let s = "extern";'),
    ("f05", 'let s = "/*"; extern "C" {}', 1, "foreign functions", 'let s = "  "; extern " " {}', 'let s = "/*"; extern "C" {}'),
    ("f06", "fn f<'a>(x: &'a str) {} // '\nextern", 2, "foreign functions", "fn f<'a>(x: &'a str) {} \nextern", "fn f<'a>(x: &'a str) {} \nextern"),
    ("f07", "\t#[no_mangle]\nfn f() {}", 1, "no_mangle", "\t#[no_mangle]\nfn f() {}", "\t#[no_mangle]\nfn f() {}"),
    ("f08", "fn no_mangle_helper() {}", None, None, "fn no_mangle_helper() {}", "fn no_mangle_helper() {}"),
    ("f09", "let asm = 5; if asm != 5 {}", None, None, "let asm = 5; if asm != 5 {}", "let asm = 5; if asm != 5 {}"),
    ("f10", "use x;\ncore::arch::asm\n  !\n (nop)", 2, "inline assembly", "use x;\ncore::arch::asm\n  !\n (nop)", "use x;\ncore::arch::asm\n  !\n (nop)"),
    ("f11", 'a;\ninclude!("../x.rs");', 2, "include of a path outside", 'a;\ninclude!("       ");', 'a;\ninclude!("../x.rs");'),
    ("f12", 'include!("x.rs");', None, None, 'include!("    ");', 'include!("x.rs");'),
    ("f13", '\n\t#[link(name = "c")]', 2, "link attribute", '\n\t#[link(name = " ")]', '\n\t#[link(name = "c")]'),
    ("f14", "use proc_macro::TokenStream;", 1, "procedural macros", "use proc_macro::TokenStream;", "use proc_macro::TokenStream;"),
)
#: Manifests and the native build tool that each names first (none: null).
MANIFESTS = (
    ("plain", '[package]\nname = "x"\n[dependencies]\ncc = "1"\n', None),
    ("key", '[build-dependencies]\ncc = "1"\n', "cc"),
    ("tab", '[build-dependencies]\n\tcc\t=\t"1"\n', "cc"),
    ("tabbed-header", '\t[build-dependencies]\t\nnasm = "1"\n', "nasm"),
    ("target", "[target.'cfg(unix)'.build-dependencies.cmake]\nversion = \"1\"\n", "cmake"),
    ("renamed", '[build-dependencies]\nmine = { package = "bindgen" }\n', "bindgen"),
    ("dotted", "[build-dependencies]\ncc.workspace = true\n", "cc"),
    ("under", "[build-dependencies.mine]\n\tpackage\t=\t'gcc'\n", "gcc"),
    ("closed", '[build-dependencies]\nserde = "1"\n\t[features]\ncc = []\n', None),
    ("comment", '[build-dependencies]\n\t# cc = "1"\n', None),
)
#: The candidates' gates: number, name, n below, nnz from, nnz below.
GATES = (
    (1, "amd", "NULL", 0, "NULL"), (2, "amf a5", 250_000, 0, 1_500_000), (3, "amd a5", 60_000, 0, 400_000), (4, "amd a2", 60_000, 0, 400_000), (5, "amf", 60_000, 0, 400_000), (6, "amf a2", 60_000, 0, 400_000),
    (7, "amd a1", 60_000, 0, 150_000), (8, "amd a16", 60_000, 0, 150_000), (9, "amf a1", 300_000, 0, 130_000), (10, "amf a16", 300_000, 0, 130_000), (11, "amf all", 300_000, 0, 130_000), (11, "amf all", 300_000, 400_000, 1_500_000),
    (12, "amd calm", 150_000, 0, 130_000), (13, "amd calm a5", 150_000, 0, 130_000), (14, "amd calm a2", 150_000, 0, 130_000), (15, "amd calm all", 150_000, 0, 130_000), (16, "amd all", 150_000, 0, 130_000),
    (17, "rcm", 150_000, 0, 130_000), (18, "sloan 2 1", 150_000, 0, 130_000), (19, "sloan 1 2", 150_000, 0, 130_000), (20, "nested dissection", 150_000, 0, 130_000), (21, "grown dissection", 150_000, 0, 130_000), (22, "minimum fill", 3_000, 0, 12_000),
    (23, "multilevel 4 4", 130_000, 0, 320_000), (24, "multilevel 16 20", 21_000, 0, 120_000), (25, "multilevel 32 30", 8_000, 0, 40_000), (26, "multilevel 2 8", 12_000, 0, 200_000), (27, "multilevel 10 8", 10_000, 0, 120_000), (28, "multilevel 8 40", 6_000, 0, 50_000),
)


def literal(value) -> str:
    """A Python value as SQL; control characters by number."""
    if value is None:
        return "NULL"
    if not isinstance(value, str):
        return str(value)
    parts = ["'" + run.replace("'", "''") + "'" if run not in ("\n", "\t") else f"chr({ord(run)})" for run in _pieces(value)]
    return " || ".join(parts) or "''"


def _pieces(text: str) -> list[str]:
    out: list[str] = []
    for c in text:
        if c in "\n\t" or not out or out[-1] in ("\n", "\t"):
            out.append(c)
        else:
            out[-1] += c
    return out


def values(rows, *names: str) -> str:
    """A SELECT of literal rows; rows of nulls in a column take the type of the others."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, row)) + ')' for row in rows)}) t({', '.join(names)})"



def kkt(h: int, m: int, seed: int) -> str:
    """The seeded generator, draw by draw: a row of states, two links of each variable from four draws, then each constraint's draws, whose number the first gives."""
    modulus, draws = 1 << 64, 4 * h + 7 * m + 8
    first = (seed * 0x9E3779B97F4A7C15 + 1) % modulus
    return f"""WITH RECURSIVE st(i, s) AS (SELECT 0, CAST('{first}' AS HUGEINT) UNION ALL SELECT i + 1, (s * CAST('6364136223846793005' AS HUGEINT) + CAST('1442695040888963407' AS HUGEINT)) % CAST('{modulus}' AS HUGEINT) FROM st WHERE i < {draws}),
d AS MATERIALIZED (SELECT i, CAST(s // 2048 AS BIGINT) AS x FROM st),
near AS (SELECT v, CASE WHEN y.x % 2 = 0 THEN greatest(v - 1 - r.x % 40, 0) ELSE least(v + 1 + r.x % 40, {h - 1}) END AS w FROM range({h}) t(v), range(2) u(k), d r, d y WHERE r.i = 4 * v + 2 * k + 1 AND y.i = 4 * v + 2 * k + 2),
q(k, place, size) AS (SELECT 0, {4 * h} + 1, (SELECT 3 + x % 4 FROM d WHERE i = {4 * h} + 1) UNION ALL SELECT k + 1, place + 1 + size, 3 + d.x % 4 FROM q, d WHERE d.i = place + 1 + size AND k < {m - 1}),
g AS (SELECT 'kkt-{h}-{m}-{seed}' AS mid, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (SELECT v AS a, v + 1 AS b FROM range({h - 1}) t(v) UNION SELECT v, w FROM near WHERE v <> w UNION SELECT least(k * {h} // {m} + d.x % 80, {h - 1}), {h} + k FROM q, d WHERE d.i > q.place AND d.i <= q.place + q.size)), {_GENERATED}"""


def _report(fam: str) -> str:
    return f"WITH RECURSIVE {fam}, {closure('c', 'e')}, {scored('s', 'c')} SELECT mid, n, flops AS natural_flops, true AS whole, true AS repeats, true AS counts_agree, true AS no_dearer FROM s"


_LARGE = 1 << 32  # more than any vertex number


def sweep(name: str, steps: str, starts: str) -> str:
    """CTE <name> (mid, part, v, level, path): breadth-first from starts (mid, part, v) along steps (mid, v, to, rank). Paths, of rank and number, compare as vertices are discovered."""
    return f"""{name}(mid, part, v, level, path) USING KEY (mid, v) AS (SELECT mid, part, v, 0, CAST([] AS BIGINT[]) FROM {starts}
  UNION SELECT s.mid, w.part, s.to, w.level + 1, min(list_append(w.path, s.rank * {_LARGE} + s.to)) FROM {name} w JOIN {steps} s ON s.mid = w.mid AND s.v = w.v WHERE NOT EXISTS (SELECT 1 FROM recurring.{name} r WHERE r.mid = s.mid AND r.v = s.to) GROUP BY s.mid, w.part, s.to, w.level)"""


def _far(name: str, swept: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT w.mid, w.part, first(w.v ORDER BY level DESC, degree, path) AS v, max(level) AS depth FROM {swept} w JOIN deg ON deg.mid = w.mid AND deg.v = w.v GROUP BY w.mid, w.part)"


def rcm(jumps: int = 5) -> str:
    """CTE rcm (mid, k, v) of the family: components by least vertex, jumps to peripheral starts, a sweep by (degree, number), reversed."""
    out = [
        "comp(mid, v, c) USING KEY (mid, v) AS (SELECT mid, v, v FROM deg UNION SELECT e.mid, e.b, min(w.c) FROM comp w JOIN e ON e.mid = w.mid AND e.a = w.v JOIN recurring.comp r ON r.mid = e.mid AND r.v = e.b WHERE w.c < r.c GROUP BY e.mid, e.b)",
        "plain AS MATERIALIZED (SELECT mid, a AS v, b AS to, CAST(0 AS BIGINT) AS rank FROM e), slim AS MATERIALIZED (SELECT e.mid, a AS v, b AS to, degree AS rank FROM e JOIN deg ON deg.mid = e.mid AND deg.v = e.b)",
        "start0 AS MATERIALIZED (SELECT DISTINCT mid, c AS part, c AS v, 0 AS depth FROM comp)",
    ]
    for j in range(jumps):
        better = f"f.depth > s.depth"
        out += [sweep(f"jump{j}", "plain", f"start{j}"), _far(f"far{j}", f"jump{j}"), f"start{j + 1} AS MATERIALIZED (SELECT mid, part, CASE WHEN {better} THEN f.v ELSE s.v END AS v, greatest(f.depth, s.depth) AS depth FROM start{j} s JOIN far{j} f USING (mid, part))"]
    out += [sweep("last", "slim", f"start{jumps}"), "rcm AS (SELECT mid, n - row_number() OVER (PARTITION BY mid ORDER BY part, level, path) AS k, v FROM last JOIN m USING (mid))"]
    return ",\n".join(out)


def dissection(rounds: int, leaf: int = 200) -> str:
    """CTE nd (mid, k, v) of the family: so many rounds of splitting, each by the middle level of a second sweep; parts that need more are missing. The budget of 64 rounds is not reached."""
    out, blocks = ["p0 AS MATERIALIZED (SELECT mid, v, degree, CAST(0 AS BIGINT) AS part FROM deg)"], []
    for r in range(rounds):
        out += [
            f"z{r} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY mid, part) AS size FROM p{r}), a{r} AS MATERIALIZED (SELECT * FROM z{r} WHERE size > {leaf})",
            f"s{r} AS MATERIALIZED (SELECT e.mid, e.a AS v, e.b AS to, CAST(0 AS BIGINT) AS rank FROM e JOIN a{r} x ON x.mid = e.mid AND x.v = e.a JOIN a{r} y ON y.mid = e.mid AND y.v = e.b WHERE x.part = y.part)",
            f"i{r} AS MATERIALIZED (SELECT mid, part, min(degree * {_LARGE} + v) % {_LARGE} AS v FROM a{r} GROUP BY mid, part)",
            sweep(f"w{r}", f"s{r}", f"i{r}"), _far(f"f{r}", f"w{r}"), sweep(f"x{r}", f"s{r}", f"f{r}"),
            f"c{r} AS MATERIALIZED (SELECT mid, part, level, count(*) AS size, sum(count(*)) OVER (PARTITION BY mid, part ORDER BY level) AS upto, sum(count(*)) OVER (PARTITION BY mid, part) AS reached FROM x{r} GROUP BY mid, part, level)",
            f"h{r} AS MATERIALIZED (SELECT mid, part, min(level) AS median, CAST(first(upto - size ORDER BY level) AS BIGINT) AS below, first(size ORDER BY level) AS within FROM c{r} WHERE upto >= (reached + 1) // 2 GROUP BY mid, part)",
            f"d{r} AS MATERIALIZED (SELECT a.mid, a.part, a.v, degree, size, below, within, CASE WHEN size = within THEN 'filled' WHEN level < median THEN 'left' WHEN level = median THEN 'middle' ELSE 'right' END AS side FROM a{r} a JOIN h{r} h ON h.mid = a.mid AND h.part = a.part LEFT JOIN x{r} x ON x.mid = a.mid AND x.v = a.v)",
            f"p{r + 1} AS MATERIALIZED (SELECT mid, v, degree, part + CASE side WHEN 'right' THEN below ELSE 0 END AS part FROM d{r} WHERE side IN ('left', 'right'))",
        ]
        blocks += [f"SELECT mid, part AS block, degree AS rank, v FROM z{r} WHERE size <= {leaf}", f"SELECT mid, CASE side WHEN 'middle' THEN part + size - within ELSE part END, CASE side WHEN 'middle' THEN 0 ELSE degree END, v FROM d{r} WHERE side IN ('middle', 'filled')"]
    out.append(f"nd AS (SELECT mid, row_number() OVER (PARTITION BY mid ORDER BY block, rank, v) - 1 AS k, v FROM ({' UNION ALL '.join(blocks)}))")
    return ",\n".join(out)


def pivoted(rounds: int, slack: int = 25) -> str:
    """CTE md (mid, k, v) of the family: so many rounds of minimum degree by independent pivots, on each round's whole neighbourhoods; patterns that need more are missing."""
    out, steps = ["a0 AS MATERIALIZED (SELECT DISTINCT mid, id AS v FROM v), l0 AS MATERIALIZED (SELECT DISTINCT mid, a, b FROM e WHERE a <> b), x0 AS MATERIALIZED (SELECT mid, a AS e, b AS v FROM e WHERE false)"], []
    for r in range(rounds):
        out += [
            f"k{r} AS MATERIALIZED (SELECT t.mid, t.v, coalesce(links, 0) AS links, CASE WHEN links IS NULL AND coalesce(lies, 0) <= 1 THEN coalesce(e, t.v) END AS goes FROM a{r} t LEFT JOIN (SELECT mid, a AS v, count(*) AS links FROM l{r} GROUP BY ALL) USING (mid, v) LEFT JOIN (SELECT mid, v, count(*) AS lies, min(e) AS e FROM x{r} GROUP BY ALL) USING (mid, v))",
            f"o{r} AS MATERIALIZED (SELECT x.mid, x.e, x.v, count(*) OVER (PARTITION BY x.mid, x.e) - 1 AS others FROM x{r} x JOIN k{r} k ON k.mid = x.mid AND k.v = x.v WHERE goes IS NULL)",
            f"b{r} AS (SELECT k.mid, k.v, CAST(any_value(links) + coalesce(sum(others), 0) AS BIGINT) AS whole FROM k{r} k LEFT JOIN o{r} o ON o.mid = k.mid AND o.v = k.v WHERE goes IS NULL GROUP BY k.mid, k.v)",
            f"j{r} AS MATERIALIZED (SELECT mid, v, least(whole, rest) AS bound, least(least_, rest) AS least_, rest, (v * 2654435761 + {r * 1640531527 % _LARGE}) % {_LARGE} AS drawn FROM (SELECT *, count(*) OVER (PARTITION BY mid) - 1 AS rest, min(whole) OVER (PARTITION BY mid) AS least_ FROM b{r}))",
            f"t{r} AS MATERIALIZED (SELECT * FROM j{r} WHERE 2 * least_ < rest), q{r} AS MATERIALIZED (SELECT * FROM t{r} WHERE 100 * bound <= {100 + slack} * least_)",
            f"y{r} AS MATERIALIZED (SELECT x.mid, x.e, x.v FROM x{r} x JOIN t{r} t ON t.mid = x.mid AND t.v = x.v)",
            f"n{r} AS MATERIALIZED (SELECT mid, a, b FROM l{r} WHERE mid IN (SELECT mid FROM t{r}) UNION SELECT x.mid, x.v, y.v FROM y{r} x JOIN y{r} y ON y.mid = x.mid AND y.e = x.e WHERE x.v <> y.v)",
            f"g{r} AS MATERIALIZED (SELECT mid, v FROM q{r} EXCEPT SELECT n.mid, n.a FROM n{r} n JOIN q{r} s ON s.mid = n.mid AND s.v = n.a JOIN q{r} u ON u.mid = n.mid AND u.v = n.b WHERE u.bound < s.bound OR u.bound = s.bound AND (u.drawn < s.drawn OR u.drawn = s.drawn AND u.v < s.v))",
            f"f{r} AS MATERIALIZED (SELECT n.mid, n.a AS e, n.b AS v, count(*) OVER (PARTITION BY n.mid, n.a) AS size FROM n{r} n JOIN g{r} g ON g.mid = n.mid AND g.v = n.a)",
            f"x{r + 1} AS MATERIALIZED (SELECT mid, e, v FROM y{r} WHERE (mid, e) NOT IN (SELECT y.mid, y.e FROM y{r} y JOIN g{r} g ON g.mid = y.mid AND g.v = y.v) UNION ALL SELECT mid, e, v FROM f{r} WHERE size > 2)",
            f"l{r + 1} AS MATERIALIZED (SELECT mid, a, b FROM l{r} WHERE mid IN (SELECT mid FROM t{r}) AND (mid, a) NOT IN (SELECT mid, v FROM g{r}) AND (mid, b) NOT IN (SELECT mid, v FROM g{r}) UNION SELECT x.mid, x.v, y.v FROM f{r} x JOIN f{r} y ON y.mid = x.mid AND y.e = x.e WHERE x.size = 2 AND x.v <> y.v EXCEPT SELECT x.mid, x.v, y.v FROM f{r} x JOIN f{r} y ON y.mid = x.mid AND y.e = x.e WHERE x.size > 2)",
            f"a{r + 1} AS MATERIALIZED (SELECT mid, v FROM t{r} EXCEPT SELECT mid, v FROM g{r})",
        ]
        steps += [f"SELECT mid, {3 * r} AS step, goes AS block, CAST(0 AS BIGINT) AS rank, v FROM k{r} WHERE goes IS NOT NULL", f"SELECT mid, {3 * r + 1}, 0, bound, v FROM j{r} WHERE 2 * least_ >= rest", f"SELECT mid, {3 * r + 2}, v, 0, v FROM g{r}"]
    out.append(f"md AS MATERIALIZED (SELECT mid, row_number() OVER (PARTITION BY mid ORDER BY step, block, rank, v) - 1 AS k, v FROM ({' UNION ALL '.join(steps)}))")
    return ",\n".join(out)


ORACLES = {
    "edges_symmetrize": f"WITH {ONE} SELECT mid, a, b FROM e",
    "vertex_index": f"WITH {ALL} SELECT mid, kind, key, id FROM v",
    "csc_build": f"WITH {ONE} SELECT v.mid, v.id AS col, CAST(sum(count(e.b)) OVER (PARTITION BY v.mid ORDER BY v.id) AS BIGINT) AS col_end, coalesce(string_agg(CAST(e.b AS VARCHAR), ',' ORDER BY e.b), '') AS rows FROM v LEFT JOIN e ON e.mid = v.mid AND e.a = v.id GROUP BY v.mid, v.id",
    "csc_roundtrip": f"WITH {ONE} SELECT mid, a, b FROM e",
    "frames_roundtrip": f"WITH {ONE} SELECT mid, a, b FROM e",
    "csc_column": f"WITH {ONE} SELECT e.mid, e.b AS row FROM e JOIN m ON m.mid = e.mid AND e.a = m.n - 1",
    "upper_triangle": f"WITH {ONE} SELECT mid, a, b FROM e WHERE a < b",
    "degree_hist": f"WITH {ALL} SELECT mid, degree, count(*) AS vertices FROM deg GROUP BY ALL",
    "pattern_stats": f"WITH {ALL} SELECT mid, count(*) AS n, CAST(sum(degree) AS BIGINT) AS nnz, CAST(sum(degree) // greatest(count(*), 1) AS BIGINT) AS density, max(degree) AS max_degree FROM deg GROUP BY mid",
    "size_buckets": f"WITH {ALL} SELECT CASE WHEN n < 1000 THEN 'lt_1k' WHEN n < 10000 THEN '1k_10k' ELSE 'gt_10k' END AS bucket, count(*) AS matrices FROM m GROUP BY ALL",
    "edge_checks": f"WITH {ONE}, s AS (SELECT mid, a, b + 1 AS b FROM h) SELECT m.mid, m.n, (SELECT count(*) FROM s WHERE s.mid = m.mid AND b >= m.n) AS out_of_range, (SELECT count(*) FROM s WHERE s.mid = m.mid AND NOT EXISTS (SELECT 1 FROM s r WHERE r.mid = s.mid AND r.a = s.b AND r.b = s.a)) AS one_way FROM m",
    "order_degree": f"WITH {ALL}, {DEGREE} SELECT mid, 'degree' AS candidate, k, v FROM o",
    "order_reverse": f"WITH {ALL} SELECT mid, 'reverse' AS candidate, k, v FROM ({REVERSE})",
    "permute_edges": f"WITH {ONE.replace('v AS (', 'v AS MATERIALIZED (', 1).replace('e AS (', 'e AS MATERIALIZED (', 1)}, {DEGREE.replace(' AS (', ' AS MATERIALIZED (', 1)}, {MOVED} SELECT mid, 'degree' AS candidate, a, b FROM d",
    "bijection_check": f"""WITH {ONE}, {DEGREE}, c AS (SELECT mid, 'degree' AS candidate, v FROM o UNION ALL SELECT mid, 'short', v FROM o WHERE k > 0 UNION ALL SELECT o.mid, 'range', CASE WHEN k = 0 THEN n ELSE v END FROM o JOIN m USING (mid)
      UNION ALL SELECT o.mid, 'repeat', CASE WHEN o.k = 0 THEN p.v ELSE o.v END FROM o JOIN o p ON p.mid = o.mid AND p.k = 1)
      SELECT c.mid, candidate, any_value(n) AS n, CASE WHEN count(*) <> any_value(n) THEN 'length' WHEN min(v) < 0 OR max(v) >= any_value(n) THEN 'range' WHEN count(DISTINCT v) <> count(*) THEN 'repeat' END AS fault FROM c JOIN m ON m.mid = c.mid GROUP BY c.mid, candidate""",
    "determinism_check": f"WITH {ONE}, {DEGREE}, r AS ({REVERSE}) SELECT o.mid, 'reverse' AS run, count(*) AS differences FROM o JOIN r ON r.mid = o.mid AND r.k = o.k WHERE r.v <> o.v GROUP BY o.mid",
    "run_status": f"WITH {ONE}, s AS (SELECT mid, max(degree) AS d FROM deg GROUP BY mid), f AS (SELECT min(mid) AS mid FROM s WHERE d > 30) SELECT CASE WHEN mid IS NULL THEN 'OK' ELSE 'FAIL' END AS status, 'degree too high: ' || mid AS reason FROM f",
    "etree_parent": f"WITH RECURSIVE {ONE}, {closure('c', 'e')} SELECT mid, j, coalesce(parent, -1) AS parent FROM c",
    "column_counts": f"WITH RECURSIVE {ONE}, {closure('c', 'e')} SELECT mid, j, c FROM c",
    "column_counts_relational": f"WITH RECURSIVE {family(PRIORITY)}, {closure('c', 'e')} SELECT mid, j, coalesce(parent, -1) AS parent, c FROM c",
    "score_natural": f"WITH RECURSIVE {ALL}, {closure('c', 'e')}, {scored('s', 'c')} SELECT mid, n, nnz_l, flops FROM s",
    "score_degree": f"WITH RECURSIVE {ALL}, {DEGREE}, {MOVED}, {closure('c', 'd')}, {scored('s', 'c')} SELECT mid, n, nnz_l, flops FROM s",
    "flop_ratio": f"WITH RECURSIVE {both(ALL)} SELECT mid, n, flops, base_flops, {rounded('flop_ratio', 'fill_ratio')} FROM ratio",
    "bucket_geomean": f"WITH RECURSIVE {both(ALL)} SELECT bucket, weight, matrices, {rounded('flop_geomean', 'fill_geomean')} FROM means",
    "weighted_score": f"WITH RECURSIVE {both(ALL)} SELECT {rounded('score', 'fill')}, matrices FROM total",
    "weighted_score_missing_bucket": f"WITH RECURSIVE {both(ONE)} SELECT {rounded('score', 'fill')}, matrices FROM total",
    "bestof_argmin": f"""WITH RECURSIVE {ONE}, {DEGREE}, {MOVED}, {BACKWARDS}, {closure("cn", "e")}, {scored("sn", "cn")}, {closure("cd", "d")}, {scored("sd", "cd")}, {closure("ct", "t")}, {scored("st", "ct")},
      every AS (SELECT mid, 'natural' AS candidate, 1 AS cand_idx, flops FROM sn UNION ALL SELECT mid, 'degree', 2, flops FROM sd UNION ALL SELECT mid, 'reverse', 3, flops FROM st)
      SELECT mid, candidate, CAST(cand_idx AS BIGINT) AS cand_idx, flops FROM (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY flops, cand_idx) AS place FROM every) WHERE place = 1""",
    "gate_admission": f"WITH {ALL}, {_gates()}, s AS (SELECT mid, count(*) AS n, sum(degree) AS nnz FROM deg GROUP BY mid) SELECT DISTINCT mid, CAST(cand_idx AS BIGINT) AS cand_idx, candidate FROM s JOIN g ON (max_n IS NULL OR n < max_n) AND nnz >= min_nnz AND (max_nnz IS NULL OR nnz < max_nnz)",
    "bfs_levels": f"WITH RECURSIVE {NATIONS}, w(v, level) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.b, w.level + 1 FROM w JOIN e ON e.a = w.v WHERE w.level < 12) SELECT 'nations' AS mid, v, min(level) AS level FROM w GROUP BY v",
    "components": f"WITH RECURSIVE {NATIONS}, w(v, c) AS (SELECT DISTINCT a, a FROM e WHERE a < 100 UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.v), u AS (SELECT DISTINCT a AS v FROM e) SELECT 'nations' AS mid, v, min(c) AS component FROM w GROUP BY v",
    "median_level_split": f"""WITH RECURSIVE {ONE}, w(mid, v, level) AS (SELECT mid, CAST(0 AS BIGINT), 0 FROM m UNION SELECT e.mid, e.b, w.level + 1 FROM w JOIN e ON e.mid = w.mid AND e.a = w.v WHERE w.level < 100),
      l AS (SELECT mid, v, min(level) AS level FROM w GROUP BY ALL), c AS (SELECT mid, level, sum(count(*)) OVER (PARTITION BY mid ORDER BY level) AS upto, sum(count(*)) OVER (PARTITION BY mid) AS reached FROM l GROUP BY mid, level)
      SELECT mid, CAST(max(reached) AS BIGINT) AS reached, CAST(min(level) FILTER (upto >= (reached + 1) // 2) AS BIGINT) AS median FROM c GROUP BY mid""",
    "cut_boundary": f"WITH {ONE}, {SIDES} SELECT s.mid, s.v, s.side FROM s WHERE EXISTS (SELECT 1 FROM e JOIN s t ON t.mid = e.mid AND t.v = e.b WHERE e.mid = s.mid AND e.a = s.v AND t.side <> s.side)",
    "subset_gain": f"WITH {ONE}, {SIDES} SELECT s.mid, s.v, CAST(coalesce(sum(CASE WHEN t.side THEN 1 WHEN t.side IS NULL THEN 0 ELSE -1 END), 0) AS BIGINT) AS gain FROM s LEFT JOIN e ON e.mid = s.mid AND e.a = s.v LEFT JOIN s t ON t.mid = e.mid AND t.v = e.b GROUP BY s.mid, s.v",
    "deficiency_first_pivot": f"""WITH {ONE}, p AS (SELECT x.mid, x.a AS v, count(*) FILTER (NOT EXISTS (SELECT 1 FROM e z WHERE z.mid = x.mid AND z.a = x.b AND z.b = y.b)) AS lack FROM e x JOIN e y ON y.mid = x.mid AND y.a = x.a AND x.b < y.b GROUP BY ALL),
      q AS (SELECT deg.mid, deg.v, degree, coalesce(lack, 0) AS lack, row_number() OVER (PARTITION BY deg.mid ORDER BY coalesce(lack, 0), degree, deg.v) AS place FROM deg LEFT JOIN p ON p.mid = deg.mid AND p.v = deg.v) SELECT mid, v, degree, lack FROM q WHERE place = 1""",
    "arrow_score": f"""WITH RECURSIVE q AS (SELECT n, i FROM (VALUES (50), (200)) s(n), range(1, 200) t(i) WHERE i < n), g AS (SELECT 'arrow-' || n AS mid, CAST(0 AS BIGINT) AS a, i AS b FROM q UNION ALL SELECT 'arrow-' || n, i, i + 1 FROM q WHERE i < n - 1),
      e AS (SELECT mid, a, b FROM g UNION SELECT mid, b, a FROM g), v AS (SELECT DISTINCT mid, a AS id FROM e), m AS (SELECT mid, count(*) AS n FROM v GROUP BY mid), l AS (SELECT mid, (a + n - 1) % n AS a, (b + n - 1) % n AS b FROM e JOIN m USING (mid)),
      {closure("c", "e")}, {scored("s", "c")}, {closure("d", "l")}, {scored("t", "d")} SELECT mid, 'natural' AS candidate, n, nnz_l, flops FROM s UNION ALL SELECT mid, 'hub last', n, nnz_l, flops FROM t""",
    "kkt_score": kkt(600, 200, 42),
    "grid2d_score": mesh("grid2d-10", 10, 2),
    "grid3d_score": mesh("grid3d-4", 4, 3),
    "text_forbidden_words": f"WITH l AS ({TEXT_LINES.format("path")}{_TEXTS}) SELECT path, count(*) AS lines, CAST(min(line) AS BIGINT) AS first_line FROM l WHERE regexp_matches(content, '(^|[^A-Za-z0-9_]){_W}([^A-Za-z0-9_]|$)') GROUP BY path",
    "jsonl_scan_rejects": f"WITH {ONE} SELECT mid, CAST(count(*) AS BIGINT) AS n, CAST(sum(degree) AS BIGINT) AS nnz, '' AS fault FROM deg GROUP BY mid UNION ALL SELECT '', n, nnz, fault FROM (VALUES "
    + ", ".join(f"(CAST({n} AS BIGINT), CAST({nnz} AS BIGINT), '{fault}: {line}')" for line, n, nnz, fault in BAD_LINES)
    + ") t(n, nnz, fault)",
    "matrix_table": f"WITH RECURSIVE {both(ALL)} SELECT mid, n, nnz, base_flops AS flops_base, flops AS flops_yours, printf('%.3f', flop_ratio) AS ratio FROM ratio JOIN (SELECT mid, CAST(sum(degree) AS BIGINT) AS nnz FROM deg GROUP BY mid) USING (mid)",
    "score_json": f"""WITH RECURSIVE {both(ONE)}, j AS (SELECT string_agg(printf('"%s": %.2f', bucket, weight), ', ' ORDER BY place) AS weights,
      string_agg(printf('"%s": {{ "count": %d, "geomean_flop_ratio": %s, "geomean_fill_ratio": %s }}', bucket, matrices, coalesce(printf('%.6f', flop_geomean), 'null'), coalesce(printf('%.6f', fill_geomean), 'null')), ', ' ORDER BY place) AS buckets FROM means)
      SELECT printf('{{ "score": %.6f, "metrics": {{ "geomean_flop_ratio": %.6f, "geomean_fill_ratio": %.6f, "matrices": %d, "weights": {{ %s }}, "buckets": {{ %s }} }} }}', score, score, fill, matrices, weights, buckets) AS document FROM total, j""",
    "bestof_full": f"""WITH RECURSIVE {both(ONE)} SELECT mid, n, base_flops AS natural_flops, flops AS degree_flops, true AS at_most_floor, true AS at_most_others, true AS counts_diagonal FROM ratio""",
    "nested_dissection": f"WITH RECURSIVE {family(YEAR)}, {dissection(12)} SELECT mid, 'nested dissection' AS candidate, k, v FROM nd",
    "score_components": f"WITH RECURSIVE {ALL}, {DEGREE}, {MOVED}, {closure('c', 'd')}, {scored('s', 'c')} SELECT mid, n, nnz_l, flops FROM s",
    "columns_dissected": f"WITH RECURSIVE {family(BRAND)}, {dissection(6, 100)}, d AS MATERIALIZED (SELECT e.mid, x.k AS a, y.k AS b FROM e JOIN nd x ON x.mid = e.mid AND x.v = e.a JOIN nd y ON y.mid = e.mid AND y.v = e.b), {closure('c', 'd')} SELECT mid, j, coalesce(parent, -1) AS parent, c FROM c",
    "minimum_degree": f"WITH {family(YEAR)}, {pivoted(12)} SELECT mid, 'independent pivots' AS candidate, k, v FROM md",
    "score_minimum_degree": f"WITH RECURSIVE {family(YEAR)}, {pivoted(12)}, d AS MATERIALIZED (SELECT e.mid, x.k AS a, y.k AS b FROM e JOIN md x ON x.mid = e.mid AND x.v = e.a JOIN md y ON y.mid = e.mid AND y.v = e.b), {closure('c', 'd')}, {scored('s', 'c')} SELECT mid, n, nnz_l, flops FROM s",
    "order_nd": f"WITH RECURSIVE {family(YEAR)}, {dissection(12)} SELECT mid, 'nested dissection' AS candidate, k, v FROM nd",
    "order_rcm": f"WITH RECURSIVE {ONE}, {rcm()} SELECT mid, 'rcm' AS candidate, k, v FROM rcm",
    "order_by_sql": f"WITH RECURSIVE {ONE}, {rcm()} SELECT mid, k, v FROM rcm",
    "cuthill_mckee": f"WITH RECURSIVE {family(YEAR)}, {rcm()} SELECT mid, 'rcm' AS candidate, k, v FROM rcm",
    "own_order": f"WITH RECURSIVE {ONE}, {BACKWARDS}, {closure('c', 't')}, {scored('s', 'c')} SELECT mid, 'backwards' AS candidate, n, nnz_l, flops, 'OK' AS status FROM s",
    **dict.fromkeys(("order_amd", "order_amf", "order_sloan", "order_gggp", "order_minfill", "order_multilevel"), _report(ONE)),
    "bucket_report": f"WITH RECURSIVE {both(ONE)} SELECT bucket, matrices, coalesce(printf('%.4f', flop_geomean), '—') AS flops, coalesce(printf('%.4f', fill_geomean), '—') AS fill FROM means",
    "run_log_row": f"WITH RECURSIVE {both(ONE)} SELECT concat_ws(chr(9), '1700000000', 'OK', printf('%.6f', score), printf('%.6f', fill), 'a b | c d') AS line FROM total",
}
