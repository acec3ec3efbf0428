"""Queries: boundary rules (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftfield.functions.vector import magnitude
from driftfield.operators import rules
from driftfield.plans.fixtures import BOX
from driftfield.plans.q_points import N, U
from driftfield.plans.registry import query

WIDE = "wide_points"
AX = (("x", 0, 9), ("y", 0, 10), ("z", 0, 8))


def _moved(t):
    return t.wide_points().select("id", "x", "y", "z")


def rule(name, make, cols: dict[str, str], status: str | None = None, src: str = WIDE):
    """Register a rule: SQL expression per coordinate, and the SQL of the status (default kept or moved)."""
    changed = " OR ".join(f"({cols[a]}) <> {a}" for a in "xyz")
    st = status or f"CASE WHEN {changed} THEN 'moved' ELSE 'kept' END"
    sql = f"SELECT id, {', '.join(f'({cols[a]}) {a}' for a in 'xyz')}, {st.format(changed=changed)} status FROM {src}"
    query(name, sql, WIDE, "x y z", "id")(lambda t: make(t)(_moved(t)))


PERIODIC = {a: f"{lo}+({a}-{lo})-{hi - lo}*floor(({a}-{lo})/{hi - lo})" for a, lo, hi in AX}
CLAMP = {a: f"least(greatest({a},{lo}),{hi})" for a, lo, hi in AX}
# triangle wave: distance to the nearest even multiple of the width
REFLECT = {a: f"abs(({a})-{2 * hi}*floor(({a})/{2 * hi}+0.5::DOUBLE))" for a, lo, hi in AX}
OUT = " OR ".join(f"{a} < {lo} OR {a} > {hi}" for a, lo, hi in AX)


def _unless(cond: str, cols: dict[str, str]) -> dict[str, str]:
    return {a: f"CASE WHEN NOT ({cond}) THEN {cols[a]} END" for a in "xyz"}


SAME = {a: a for a in "xyz"}
rule("wrap_periodic", lambda t: rules.wrap_periodic(BOX), PERIODIC, "CASE WHEN x < 0 OR x >= 9 OR y < 0 OR y >= 10 OR z < 0 OR z >= 8 THEN 'moved' ELSE 'kept' END")
rule("clamp", lambda t: rules.clamp(BOX), CLAMP)
rule("reflect", lambda t: rules.reflect(BOX), REFLECT, f"CASE WHEN {OUT} THEN 'moved' ELSE 'kept' END")
rule("absorb", lambda t: rules.absorb(BOX), _unless(OUT, SAME), f"CASE WHEN {OUT} THEN 'absorbed' ELSE 'kept' END")
ZOUT = "z < 0 OR z > 8"
rule("mixed", lambda t: rules.mixed(BOX, {"y": "clamp", "z": "absorb"}), _unless(ZOUT, {"x": PERIODIC["x"], "y": CLAMP["y"], "z": "z"}),
     f"CASE WHEN {ZOUT} THEN 'absorbed' WHEN x < 0 OR x >= 9 OR y < 0 OR y > 10 THEN 'moved' ELSE 'kept' END")
NEAR = "sqrt((x-4)*(x-4)+(y-5)*(y-5)+(z-4)*(z-4))-6.5::DOUBLE <= 0"
rule("by_distance", lambda t: rules.by_distance(lambda x, y, z: magnitude(x - 4.0, y - 5.0, z - 4.0) - 6.5, rules.clamp(BOX), rules.absorb(BOX)),
     {a: f"CASE WHEN {NEAR} THEN {CLAMP[a]} WHEN NOT ({OUT}) THEN {a} END" for a in "xyz"},
     f"CASE WHEN NOT ({OUT}) THEN 'kept' WHEN {NEAR} THEN 'moved' ELSE 'absorbed' END")
R = "sqrt((x-4)*(x-4)+(y-5)*(y-5)+(z-4)*(z-4))"
rule("sphere_reflect", lambda t: rules.sphere((4, 5, 4), 4.5), {a: f"CASE WHEN {R} > 4.5 THEN {c}+4.5::DOUBLE*({a}-{c})/{R} ELSE {a} END" for a, c in zip("xyz", (4, 5, 4))},
     f"CASE WHEN {R} > 4.5 THEN 'moved' ELSE 'kept' END")
rule("sphere_absorb", lambda t: rules.sphere((4, 5, 4), 4.5, "absorb"), _unless(f"{R} > 4.5", SAME), f"CASE WHEN {R} > 4.5 THEN 'absorbed' ELSE 'kept' END")
RC = "sqrt((x-4)*(x-4)+(y-5)*(y-5))"
rule("cylinder_clamp", lambda t: rules.cylinder((4, 5, 0), 4.0, "z", 12.0, "clamp"),
     {**{a: f"CASE WHEN {RC} > 4 THEN {c}+4*({a}-{c})/{RC} ELSE {a} END" for a, c in zip("xy", (4, 5))}, "z": "least(greatest(z,-6),6)"},
     f"CASE WHEN {RC} > 4 OR abs(z) > 6 THEN 'moved' ELSE 'kept' END")
rule("cylinder_absorb", lambda t: rules.cylinder((4, 5, 0), 4.0, "z", 12.0, "absorb"), _unless(f"{RC} > 4 OR abs(z) > 6", SAME),
     f"CASE WHEN {RC} > 4 OR abs(z) > 6 THEN 'absorbed' ELSE 'kept' END")


def mirror(a: str, lo: int, hi: int) -> str:
    return f"CASE WHEN {a} < {lo} THEN {2 * lo}-{a} WHEN {a} > {hi} THEN {2 * hi}-{a} ELSE {a} END"


SIDES = {a: mirror(a, lo, hi) for a, lo, hi in AX}
SIDE_OUT = "y < 0 OR y > 10 OR z < 0 OR z > 8"
rule("inlet_outlet", lambda t: rules.inlet_outlet(BOX), _unless("x > 9", {"x": "CASE WHEN x < 0 THEN 9 ELSE x END", "y": SIDES["y"], "z": SIDES["z"]}),
     f"CASE WHEN x > 9 THEN 'absorbed' WHEN x < 0 OR {SIDE_OUT} THEN 'moved' ELSE 'kept' END")


def _entering(name, make, fresh: dict[str, str], back: str):
    cols = {"x": f"CASE WHEN x > 9 THEN 0 WHEN x < 0 THEN {back} ELSE x END", **{a: f"CASE WHEN x > 9 THEN {fresh[a]} ELSE {SIDES[a]} END" for a in "yz"}}
    rule(name, make, cols, f"CASE WHEN x > 9 THEN 're-entered' WHEN x < 0 OR {SIDE_OUT} THEN 'moved' ELSE 'kept' END")


_entering("flow_through", lambda t: rules.flow_through(BOX, seed=21), {a: f"{U(21, a)}*{hi}" for a, _, hi in AX[1:]}, "-x")
_entering("continuous_inlet_uniform", lambda t: rules.continuous_inlet(BOX, seed=22), {a: f"{U(22, a)}*{hi}" for a, _, hi in AX[1:]}, "0.009::DOUBLE")
_entering("continuous_inlet_gaussian", lambda t: rules.continuous_inlet(BOX, distribution="gaussian", seed=23),
          {a: f"least(greatest({hi / 2}::DOUBLE+{N(23, a)}*({hi}/6.0::DOUBLE),0),{hi})" for a, _, hi in AX[1:]}, "0.009::DOUBLE")


def snap(a: str, hi: int, res: int) -> str:
    """Nearest of all grid coordinates by search, the lower one on ties."""
    return f"(SELECT min_by(c, (abs(c-{a}), c)) FROM (SELECT i*{hi}/{res - 1}.0::DOUBLE c FROM range({res}) r(i)))"


def snap_sql(a: str, hi: int, res: int) -> str:
    step = f"({hi}/{res - 1}.0::DOUBLE)"
    low = f"floor({a}/{step})"
    pick = f"(CASE WHEN {a}/{step}-{low} > 0.5 THEN {low}+1 ELSE {low} END)"
    return f"least(greatest({pick},0),{res - 1})*{step}"


_entering("continuous_inlet_grid", lambda t: rules.continuous_inlet(BOX, distribution="grid", counts={"y": 9, "z": 5}), {"y": snap_sql("y", 10, 9), "z": snap_sql("z", 8, 5)}, "0.009::DOUBLE")
query("snap_to_inlet_grid", f"SELECT id, 0.0::DOUBLE x, {snap_sql('y', 10, 9)} y, {snap_sql('z', 8, 5)} z FROM {WIDE}", WIDE, "x y z", "id")(
    lambda t: rules.snap_to_inlet_grid(_moved(t), BOX, "x", {"y": 9, "z": 5}, 0.0)
)
_CH = {a: REFLECT[a] for a in "xyz"}
query("rule_chain", f"SELECT id, {', '.join(f'least(greatest({_CH[a]},1),7) {a}' for a in 'xyz')} FROM {WIDE}", WIDE, "x y z", "id")(
    lambda t: rules.chain(rules.reflect(BOX), rules.clamp(type(BOX)((1.0, 1.0, 1.0), (7.0, 7.0, 7.0))))(_moved(t)).select("id", "x", "y", "z")
)
_V = ", ".join(f"count(*) FILTER ({a} < {lo}-1e-6) {a}_low, count(*) FILTER ({a} > {hi}+1e-6) {a}_high, min({a}) {a}_min, max({a}) {a}_max" for a, lo, hi in AX)
_VOUT = " OR ".join(f"{a} < {lo}-1e-6 OR {a} > {hi}+1e-6" for a, lo, hi in AX)
query(
    "violations", f"SELECT *, n_out/n::DOUBLE share_out FROM (SELECT count(*) n, count(*) FILTER ({_VOUT}) n_out, {_V} FROM {WIDE})", WIDE,
    "share_out " + " ".join(f"{a}_{m}" for a in "xyz" for m in ("min", "max")), "n n_out " + " ".join(f"{a}_{m}" for a in "xyz" for m in ("low", "high")),
)(lambda t: rules.violations(_moved(t), BOX))
query(
    "rule_audit",
    f"SELECT count(*) n, count(*) FILTER (NOT ({OUT})) n_finite, count(*) FILTER ({OUT}) n_missing, 0 n_infinite, count(*) FILTER (NOT ({OUT})) n_kept, 0 n_moved, count(*) FILTER ({OUT}) n_absorbed, 0 n_re_entered FROM {WIDE}",
    WIDE, "", "n n_finite n_missing n_infinite n_kept n_moved n_absorbed n_re_entered",
)(lambda t: rules.rule_audit(rules.absorb(BOX)(_moved(t))))
