"""SQL text of the sketch arithmetic, for the oracles.

Each function returns the body of one common table expression; ``chain`` strings them together.
"""

from __future__ import annotations

from tallyweave.functions.hashing import hash_fn, lanes_sql, mix_sql
from tallyweave.spec import SketchSpec

COEF = ("a0", "a1", "a2", "b", "c0", "c1", "c2", "c3")

G_SQL = {
    "cardinality": "(CASE WHEN {0} > 0 THEN 1.0::DOUBLE ELSE 0.0 END)",
    "sum": "(CASE WHEN {0} >= 0 THEN {0}::DOUBLE ELSE 0.0 END)",
    "entropy": "(CASE WHEN {0} > 0 THEN {0}::DOUBLE * log2({0}::DOUBLE) ELSE 0.0 END)",
    "sqr": "(CASE WHEN {0} >= 0 THEN {0}::DOUBLE * {0}::DOUBLE ELSE 0.0 END)",
}


def g_sql(name: str, x: str) -> str:
    return G_SQL[name].format(f"({x})")


def chain(final: str, **ctes: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes.items()) + "\n" + final


def values(seed: int, role: str, rows: int, levels: int = 1) -> str:
    """Hash coefficients as an inline table ``c(level, row, a0, ...)``."""
    lines = ", ".join(
        f"({level}, {row}, " + ", ".join(f"{x}::BIGINT" for x in hash_fn(seed, role, level, row).coefficients()) + ")"
        for level in range(levels) for row in range(rows))
    return f"(VALUES {lines}) AS c(level, row, {', '.join(COEF)})"


def table_hash(key: str, text: bool) -> str:
    return mix_sql(lanes_sql(key, text), [f"c.{x}" for x in COEF])


def one_hash(key: str, seed: int, role: str, text: bool = False, level: int = 0, row: int = 0) -> str:
    return hash_fn(seed, role, level, row).sql(lanes_sql(key, text))


def bucket_sql(key: str, seed: int, width: int, role: str = "bucket", text: bool = False) -> str:
    return f"(({one_hash(key, seed, role, text)} >> 1) % {width})"


def sign_sql(key: str, seed: int, role: str, text: bool = False) -> str:
    return f"(1 - 2 * ({one_hash(key, seed, role, text)} & 1))"


def cells(stream: str, spec: SketchSpec, role: str, signed: bool = True, text: bool = False) -> str:
    """``(row, idx, v)`` of a stream ``(key, weight)``."""
    sign = "(1 - 2 * (h & 1)) * " if signed else ""
    return f"""SELECT row, (h >> 1) % {spec.width} AS idx, sum({sign}weight)::BIGINT AS v
 FROM (SELECT c.row, s.weight, {table_hash('s.key', text)} AS h FROM ({stream}) s
 CROSS JOIN {values(spec.seed, role, spec.rows)}) GROUP BY ALL HAVING v <> 0"""


def probes(keys: str, cell_table: str, spec: SketchSpec, role: str, signed: bool = True, text: bool = False) -> str:
    """``(key, row, x)``: what each key sees in each row."""
    sign = "(1 - 2 * (p.h & 1)) * " if signed else ""
    return f"""SELECT p.key, p.row, {sign}coalesce(t.v, 0) AS x
 FROM (SELECT s.key, c.row, {table_hash('s.key', text)} AS h FROM (SELECT DISTINCT key FROM ({keys})) s
 CROSS JOIN {values(spec.seed, role, spec.rows)}) p
 LEFT JOIN {cell_table} t ON t.row = p.row AND t.idx = (p.h >> 1) % {spec.width}"""


def estimates(keys: str, cell_table: str, spec: SketchSpec, role: str, text: bool = False) -> str:
    """``(key, est)``: medians of the signed probes."""
    return f"SELECT key, median(x)::DOUBLE AS est FROM ({probes(keys, cell_table, spec, role, True, text)}) GROUP BY key"


def depth_sql(key: str, spec: SketchSpec, text: bool = False) -> str:
    h = one_hash(key, spec.seed, "depth", text)
    return f"least(bit_count(xor({h}, {h} + 1)) - 1, {spec.levels - 1})"


def sampled(counts: str, spec: SketchSpec, text: bool = False) -> str:
    """``(level, key, depth, f)``: every key once per level it is sampled into."""
    return f"""SELECT l.level, k.key, k.depth, k.f
 FROM (SELECT key, f, {depth_sql('key', spec, text)} AS depth FROM ({counts})) k
 JOIN (SELECT unnest(range({spec.levels}))::INTEGER AS level) l ON l.level <= k.depth"""


def level_cells(sampled_table: str, spec: SketchSpec, text: bool = False) -> str:
    """``(level, row, idx, v)`` of the universal sketch."""
    return f"""SELECT level, row, (h >> 1) % {spec.width} AS idx, sum((1 - 2 * (h & 1)) * f)::BIGINT AS v
 FROM (SELECT c.level, c.row, s.f, {table_hash('s.key', text)} AS h FROM {sampled_table} s
 JOIN {values(spec.seed, 'univ', spec.rows, spec.levels)} ON c.level = s.level) GROUP BY ALL HAVING v <> 0"""


def level_estimates(pairs: str, cell_table: str, spec: SketchSpec, text: bool = False) -> str:
    """``(level, key, est)`` of ``(level, key)`` pairs."""
    return f"""SELECT p.level, p.key, median((1 - 2 * (p.h & 1)) * coalesce(t.v, 0))::DOUBLE AS est
 FROM (SELECT c.level, s.key, c.row, {table_hash('s.key', text)} AS h FROM (SELECT DISTINCT level, key FROM ({pairs})) s
 JOIN {values(spec.seed, 'univ', spec.rows, spec.levels)} ON c.level = s.level) p
 LEFT JOIN {cell_table} t ON t.level = p.level AND t.row = p.row AND t.idx = (p.h >> 1) % {spec.width}
 GROUP BY p.level, p.key"""


def cut(table: str, spec: SketchSpec, value: str = "f") -> str:
    """``(level, key, v)``: the ``capacity`` largest of each level."""
    return f"""SELECT level, key, {value}::BIGINT AS v FROM {table}
 QUALIFY row_number() OVER (PARTITION BY level ORDER BY {value} DESC, key) <= {spec.capacity}"""


def level_gsum(candidates: str, spec: SketchSpec, g: str, text: bool = False, value: str = "v") -> str:
    """One value: the recursive estimator, level by level in closed form."""
    coef = f"CASE WHEN level = {spec.levels - 1} OR {depth_sql('key', spec, text)} <= level THEN 1 ELSE -1 END"
    return f"SELECT coalesce(sum(pow(2.0, level) * ({coef}) * {g_sql(g, value)}), 0.0)::DOUBLE AS gsum FROM ({candidates})"


# --- ordered replays: one list_reduce per bucket over the arrivals in order ---------------

def set_at(field: str, pos: str, value: str) -> str:
    return f"list_transform(a.{field}, lambda old, i: CASE WHEN i = {pos} THEN {value} ELSE old END)"


def struct(**fields: str) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def replay(stream: str, bucket: str, empty: dict[str, str], arrival: dict[str, str], step: str) -> str:
    """``(bucket, state)``. ``empty`` are the typed fields of a fresh state; every arrival is a
    fresh state whose field ``e`` holds the ``arrival`` columns; ``step`` maps (a, x) to a state."""
    one = struct(**empty, e=struct(**arrival))
    none = struct(**empty, e=struct(**{k: "NULL::BIGINT" for k in arrival}))
    return f"""SELECT bucket, list_reduce(list({one} ORDER BY seq), lambda a, x: {step}, {none}) AS state
 FROM (SELECT *, {bucket} AS bucket FROM ({stream})) GROUP BY bucket"""


GUARD_FULL = {"elastic": "({g}) > 8 * list_min(a.vs)", "frequent": "({g}) > list_min(a.vs)",
              "guardian": "({g}) > list_min(a.vs)"}


def heavy_replay(stream: str, spec: SketchSpec, strategy: str, slots: int | None = None, bucket: str | None = None) -> str:
    """``(bucket, state)`` of an ordered heavy part; state: ks, vs, fl, g, out."""
    slots = slots or spec.slots
    here, low = "list_position(a.ks, x.e.k)", "list_position(a.vs, list_min(a.vs))"
    guard = "a.g + 1"
    if strategy == "guardian":
        flip = f"{one_hash('x.e.s', spec.seed, 'coin')} % floor(pow(1.08, least(list_min(a.vs) - a.g, 280)))::BIGINT = 0"
        guard = f"a.g + CASE WHEN {flip} THEN 1 ELSE 0 END"
    moved = lambda kind, key, f, flag: f"list_append(a.o, {struct(kind=kind, seq='x.e.s', key=key, f=f, flag=flag)})"
    keep = lambda **changed: struct(**{**{k: f"a.{k}" for k in ("ks", "vs", "fl", "g", "o", "e")}, **changed})
    step = f"""CASE WHEN {here} > 0 THEN {keep(vs=set_at('vs', here, 'old + x.e.f'))}
 WHEN len(a.ks) < {slots} THEN {keep(ks='list_append(a.ks, x.e.k)', vs='list_append(a.vs, x.e.f)', fl='list_append(a.fl, false)')}
 WHEN {GUARD_FULL[strategy].format(g=guard)} THEN {keep(
        ks=set_at('ks', low, 'x.e.k'), vs=set_at('vs', low, 'x.e.f'), fl=set_at('fl', low, 'true'), g='0::BIGINT',
        o=moved("'evict'", f'a.ks[{low}]', f'a.vs[{low}]', f'a.fl[{low}]'))}
 ELSE {keep(g=f'({guard})::BIGINT', o=moved("'pass'", 'x.e.k', 'x.e.f', 'false'))} END"""
    empty = {"ks": "[]::BIGINT[]", "vs": "[]::BIGINT[]", "fl": "[]::BOOLEAN[]", "g": "0::BIGINT",
             "o": "[]::STRUCT(kind VARCHAR, seq BIGINT, key BIGINT, f BIGINT, flag BOOLEAN)[]"}
    bucket = bucket or bucket_sql("key", spec.seed, spec.buckets)
    return replay(stream, bucket, empty, {"k": "key", "s": "seq", "f": "weight"}, step)


def replay_heavy(states: str) -> str:
    return (f"SELECT bucket, unnest(state.ks) AS key, unnest(state.vs) AS v, unnest(state.fl) AS flag FROM {states}")


def replay_moved(states: str) -> str:
    return f"SELECT bucket, m.kind, m.seq, m.key, m.f, m.flag FROM (SELECT bucket, unnest(state.o) AS m FROM {states})"
