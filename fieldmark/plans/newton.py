"""Maximum-likelihood fits as SQL: Newton's method as a recursive query, for any design.

Derivatives in the three linear predictors are fourth-order differences over a grid, summed with the design
columns; a step solves the equations by elimination written out.  So the SQL shares no formula for derivatives
or solving with the library.
"""

from __future__ import annotations

from collections.abc import Sequence

from fieldmark.plans.base import ll_sql

H = 0.01
#: First derivative: sum of weight * f(offset) / H.
_FIRST = {-2: 1 / 12, -1: -8 / 12, 1: 8 / 12, 2: -1 / 12}
_SECOND = {-2: -1 / 12, -1: 16 / 12, 0: -30 / 12, 1: 16 / 12, 2: -1 / 12}
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_DERIVED = ["w", *[f"g{i}" for i in range(3)], *[f"e{i}{j}" for i, j in _PAIRS]]
CONSTANT = (("1",), ("1",), ("1",))
RATES = ("(1 / (1 + exp(-(b0 + o0))))", "(1 / (1 + exp(-(b1 + o1))))", "exp(b2 + o2)")


def _grid() -> str:
    """Rows (o0, o1, o2, w, g0 ... g2, e00 ... e22): offsets, and the weights of value and derivatives there."""
    rows: dict[tuple[int, ...], dict[str, float]] = {}

    def put(at: dict[int, int], name: str, w: float) -> None:
        rows.setdefault(tuple(at.get(i, 0) for i in range(3)), {})[name] = w

    put({}, "w", 1.0)
    for i in range(3):
        for k, w in _FIRST.items():
            put({i: k}, f"g{i}", w / H)
        for k, w in _SECOND.items():
            put({i: k}, f"e{i}{i}", w / H**2)
    for i, j in _PAIRS:
        if i != j:
            for k, v in _FIRST.items():
                for m, w in _FIRST.items():
                    put({i: k, j: m}, f"e{i}{j}", v * w / H**2)
    values = ", ".join("(" + ", ".join([f"{k * H!r}::DOUBLE" for k in at] + [f"{of.get(n, 0.0)!r}::DOUBLE" for n in _DERIVED]) + ")" for at, of in rows.items())
    return f"(VALUES {values}) grid(o0, o1, o2, {', '.join(_DERIVED)})"


def _layered(source: str, layers: list[list[str]]) -> str:
    """A query with more columns, each layer's from the ones before."""
    for layer in layers:
        if layer:
            source = f"SELECT *, {', '.join(layer)} FROM ({source})"
    return source


def _eliminated(k: int, right: bool = False) -> list[list[str]]:
    """Columns of A = L D L' (q: D, m: L) from A's columns a{i}_{j}, i <= j; with ``right`` f, for which L f = u."""
    out = []
    for j in range(k):
        own = [f"a{j}_{j}" + "".join(f" - m{j}_{c} * m{j}_{c} * q{c}" for c in range(j)) + f" AS q{j}"]
        out.append(own + ([f"u{j}" + "".join(f" - m{j}_{c} * f{c}" for c in range(j)) + f" AS f{j}"] if right else []))
        out.append([f"(a{j}_{i}" + "".join(f" - m{i}_{c} * m{j}_{c} * q{c}" for c in range(j)) + f") / q{j} AS m{i}_{j}" for i in range(j + 1, k)])
    return out


def newton_sql(
    individuals: str = "ind", ridge: float = 0.0, occasions: int = 7, designs: Sequence[Sequence[str]] = CONSTANT, prior: str = "0",
    free: Sequence[int] = (), name: str = "", steps: int = 25,
) -> str:
    """CTEs ending in ``opt`` (t0 ..., ll, growth, n, a0_0 ...): the optimum, its log-likelihood and mean growth rate, minus the objective's Hessian.

    ``individuals`` is a CTE with x, e, l and what the ``designs`` of survival, detection and recruitment read; ``prior`` is
    added to each row's objective, in terms of phi, p, f; ``ridge`` weighs the sum of squared coefficients but those numbered in
    ``free``.  ``name`` ends the CTEs' names.
    """
    of = [(i, c) for i, columns in enumerate(designs) for c in columns]
    k = len(of)
    ridges = [0.0 if a in free else ridge for a in range(k)]
    columns = list(dict.fromkeys(c for _, c in of))
    design = [f"d{columns.index(c)}" for _, c in of]
    made = ", ".join(f"({c})::DOUBLE AS d{i}" for i, c in enumerate(columns))
    theta = ", ".join(f"t{a}" for a in range(k))
    eta = ", ".join("(" + " + ".join(f"t{a} * {design[a]}" for a in range(k) if of[a][0] == i) + f") AS b{i}" for i in range(3))
    ll = ll_sql(*RATES, occasions)
    value = f"({ll}) + ({prior.format(phi=RATES[0], p=RATES[1], f=RATES[2])})"
    derived = ", ".join(f"sum({c} * v) AS {c}" for c in _DERIVED)
    rows = "q.* EXCLUDE (n), q.n, " + eta
    each = f"SELECT r.s, {theta}, {rows} FROM {{of}} r, grp{name} q"
    key = f"s, {theta}, x, e, l, n, {', '.join(f'd{i}' for i in range(len(columns)))}"
    points = f"SELECT {key}, {derived} FROM (SELECT y.*, grid.*, {value} AS v FROM ({each}) y, {_grid()}) GROUP BY {key}"
    sums = [f"sum(n * g{of[a][0]} * {design[a]}) - {2 * ridges[a]!r}::DOUBLE * t{a} AS u{a}" for a in range(k)]
    curve = lambda a, b: f"e{min(of[a][0], of[b][0])}{max(of[a][0], of[b][0])}"
    sums += [f"-sum(n * {curve(a, b)} * {design[a]} * {design[b]})" + (f" + {2 * ridges[a]!r}::DOUBLE" if a == b else "") + f" AS a{a}_{b}" for a in range(k) for b in range(a, k)]
    total = f"SELECT s, {theta}, {', '.join(sums)} FROM ({points}) GROUP BY s, {theta}"
    back = [[f"f{a} / q{a}" + "".join(f" - m{c}_{a} * z{c}" for c in range(a + 1, k)) + f" AS z{a}"] for a in reversed(range(k))]
    step = _layered(total.format(of=f"it{name}"), [*_eliminated(k, True), *back])
    firsts = [of.index((i, designs[i][0])) for i in range(3)]
    start = ", ".join(f"{dict(zip(firsts, (0.5, 0.5, -1.0))).get(a, 0.0)!r}::DOUBLE" for a in range(k))
    plain = lambda r: r.replace(" + o0", "").replace(" + o1", "").replace(" + o2", "")
    fit = f"SELECT sum(n * ({plain(ll)})) AS ll, sum(n * ({plain(RATES[0])} + {plain(RATES[2])})) / sum(n) AS growth, sum(n) AS n FROM ({each.format(of=f'last{name}')})"
    return f"""grp{name} AS (SELECT x, e, l, {', '.join(f'd{i}' for i in range(len(columns)))}, count(*)::DOUBLE AS n FROM (SELECT x, e, l, {made} FROM {individuals}) GROUP BY ALL),
it{name}(s, {theta}) AS (
 SELECT 0, {start}
 UNION ALL SELECT s + 1, {', '.join(f't{a} + greatest(-1, least(1, z{a}))' for a in range(k))} FROM ({step}) WHERE s < {steps}),
last{name} AS (SELECT * FROM it{name} ORDER BY s DESC LIMIT 1),
opt{name} AS (SELECT * FROM ({total.format(of=f'last{name}')}), ({fit}))"""


def inverse_sql(k: int = 3, name: str = "") -> str:
    """CTE ``cov`` (i, j, info, cov): information and its inverse."""
    # columns of L's inverse, w{i}_{j} for i > j
    low = [[f"-m{i}_{j}" + "".join(f" - m{i}_{c} * w{c}_{j}" for c in range(j + 1, i)) + f" AS w{i}_{j}" for j in range(i)] for i in range(1, k)]
    w = lambda i, j: "1" if i == j else f"w{i}_{j}"
    cells = ", ".join(f"{{'i': {i}, 'j': {j}, 'info': a{min(i, j)}_{max(i, j)}, 'cov': {' + '.join(f'{w(c, i)} * {w(c, j)} / q{c}' for c in range(max(i, j), k))}}}" for i in range(k) for j in range(k))
    return f"cov{name} AS (SELECT unnest([{cells}], recursive := true) FROM ({_layered(f'SELECT * FROM opt{name}', [*_eliminated(k), *low])}))"


#: Eigenvalues of the constant model's information by the trigonometric formula, and so its condition number.
CONDITION = """tr AS (SELECT (a0_0 + a1_1 + a2_2) / 3 AS m, a0_1 * a0_1 + a0_2 * a0_2 + a1_2 * a1_2 AS off, a0_0 AS a, a1_1 AS d, a2_2 AS f, a0_1 AS b, a0_2 AS c, a1_2 AS e FROM opt),
pq AS (SELECT *, sqrt(((a - m) * (a - m) + (d - m) * (d - m) + (f - m) * (f - m) + 2 * off) / 6) AS p FROM tr),
an AS (SELECT *, acos(greatest(-1, least(1, ((a - m) * ((d - m) * (f - m) - e * e) - b * (b * (f - m) - e * c) + c * (b * e - (d - m) * c)) / (2 * p * p * p)))) / 3 AS phi FROM pq),
ev AS (SELECT m + 2 * p * cos(phi) AS most, m + 2 * p * cos(phi + 2 * pi() / 3) AS least FROM an)"""
