"""Barycentric coordinates and element shape functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TOL = 1e-6
_FLAT_TRIANGLE = 1e-15
_FLAT_TETRA = 1e-30


def _sub(a, b):
    return [p - q for p, q in zip(a, b)]


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _det(a, b, c) -> Column:
    """Determinant of three column vectors."""
    return (
        a[0] * (b[1] * c[2] - b[2] * c[1])
        - b[0] * (a[1] * c[2] - a[2] * c[1])
        + c[0] * (a[1] * b[2] - a[2] * b[1])
    )


def bary_triangle(p, a, b, c) -> list[Column]:
    """Three weights of p in triangle abc (least squares in its plane); a degenerate triangle gives 1, 0, 0."""
    e1, e2, ep = _sub(b, a), _sub(c, a), _sub(p, a)
    d11, d12, d22 = _dot(e1, e1), _dot(e1, e2), _dot(e2, e2)
    dp1, dp2 = _dot(ep, e1), _dot(ep, e2)
    den = d11 * d22 - d12 * d12
    ok = F.abs(den) > F.lit(_FLAT_TRIANGLE)
    l1 = F.when(ok, (d22 * dp1 - d12 * dp2) / den).otherwise(F.lit(0.0))
    l2 = F.when(ok, (d11 * dp2 - d12 * dp1) / den).otherwise(F.lit(0.0))
    return [F.lit(1.0) - l1 - l2, l1, l2]


def bary_tetra(p, a, b, c, d) -> list[Column]:
    """Four weights of p in tetrahedron abcd by Cramer's rule; a degenerate tetrahedron gives 0s."""
    e1, e2, e3, ep = _sub(b, a), _sub(c, a), _sub(d, a), _sub(p, a)
    den = _det(e1, e2, e3)
    ok = F.abs(den) > F.lit(_FLAT_TETRA)
    l1, l2, l3 = _det(ep, e2, e3) / den, _det(e1, ep, e3) / den, _det(e1, e2, ep) / den
    zero = F.lit(0.0)
    return [F.when(ok, v).otherwise(zero) for v in (F.lit(1.0) - l1 - l2 - l3, l1, l2, l3)]


def affine_rows(df: DataFrame, corners: str, n: int) -> DataFrame:
    """Add ``rows``: the barycentric weights 1..n-1 of an element as affine functions of the point.

    Row r holds (c0, cx, cy, cz) with weight r = c0 + cx x + cy y + cz z; a triangle gets a last row that is
    the signed distance from its plane. Elements are prepared once, so testing a point is a few products.
    """
    flat = _FLAT_TETRA if n == 4 else _FLAT_TRIANGLE
    cross = lambda p, q: {
        "x": f"{p}y * {q}z - {p}z * {q}y", "y": f"{p}z * {q}x - {p}x * {q}z", "z": f"{p}x * {q}y - {p}y * {q}x",
    }
    dot = lambda p, q: " + ".join(f"{p}{a} * {q}{a}" for a in "xyz")
    out = df.selectExpr(
        "*", *[f"{corners}[0].{a} AS o_{a}" for a in "xyz"],
        *[f"{corners}[{e}].{a} - {corners}[0].{a} AS e{e}_{a}" for e in range(1, n) for a in "xyz"],
    )
    if n == 4:
        normals = {1: ("e2_", "e3_"), 2: ("e3_", "e1_"), 3: ("e1_", "e2_")}
        out = out.selectExpr("*", *[f"{v} AS n{r}_{a}" for r, pq in normals.items() for a, v in cross(*pq).items()])
        out = out.selectExpr("*", f"{dot('e1_', 'n1_')} AS den")
        scale = {1: "den", 2: "den", 3: "den"}
    else:
        # weight r is linear along the in-plane normal of the opposite edge; row 3 is the distance from the plane
        out = out.selectExpr("*", *[f"{v} AS n3_{a}" for a, v in cross("e1_", "e2_").items()])
        normals = {1: ("e2_", "n3_"), 2: ("n3_", "e1_")}
        out = out.selectExpr("*", *[f"{v} AS n{r}_{a}" for r, pq in normals.items() for a, v in cross(*pq).items()])
        out = out.selectExpr("*", f"{dot('n3_', 'n3_')} AS den")
        scale = {1: "den", 2: "den", 3: "sqrt(den)"}
    out = out.selectExpr("*", f"abs(den) <= {flat!r}D AS flat")
    out = out.selectExpr("*", *[f"CASE WHEN flat THEN 0D ELSE n{r}_{a} / {d} END AS r{r}_{a}" for r, d in scale.items() for a in "xyz"])
    rows = ", ".join(f"array(-({dot(f'r{r}_', 'o_')}), r{r}_x, r{r}_y, r{r}_z)" for r in scale)
    return out.selectExpr(*df.columns, f"array({rows}) AS rows", "flat")


def affine_value(rows: Column, r: int, p) -> Column:
    return rows[r][0] + rows[r][1] * p[0] + rows[r][2] * p[1] + rows[r][3] * p[2]


def affine_weights(rows: Column, p, n: int) -> list[Column]:
    rest = [affine_value(rows, r, p) for r in range(n - 1)]
    return [F.lit(1.0) - sum(rest[1:], rest[0]), *rest]


def _corner_edge(lam, edges) -> list[Column]:
    corners = [v * (F.lit(2.0) * v - F.lit(1.0)) for v in lam]
    return corners + [F.lit(4.0) * lam[i] * lam[j] for i, j in edges]


# Corner pairs of the mid-edge nodes, in node order.
TRI6_EDGES = ((0, 1), (1, 2), (2, 0))
TET10_EDGES = ((0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3))


def tri6_shapes(lam) -> list[Column]:
    return _corner_edge(lam, TRI6_EDGES)


def tet10_shapes(lam) -> list[Column]:
    return _corner_edge(lam, TET10_EDGES)


def shapes(kind: str, lam) -> list[Column]:
    """Weights of the element's nodes, in node order."""
    if kind in ("tri3", "tet4"):
        return lam
    if kind == "tri6":
        return tri6_shapes(lam)
    if kind == "tet10":
        return tet10_shapes(lam)
    raise ValueError(f"unknown element kind {kind!r}")


CORNERS = {"tri3": 3, "tri6": 3, "tet4": 4, "tet10": 4}
WIDTH = {"tri3": 3, "tri6": 6, "tet4": 4, "tet10": 10}
