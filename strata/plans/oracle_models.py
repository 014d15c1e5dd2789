"""DuckDB SQL that grows the small models: forest, folds and boosting with trees of depth 2, and the
two-feature logistic regression by Newton steps. The statements are written level by level."""

from __future__ import annotations

import math

from strata.plans.oracle import R
from strata.plans.oracle_notebook import _ENGINEERED, _FEATS, _FRAME, with_features

# The hash's modulus and the settings of the small models.
PRIME = 2 ** 31 - 1
TREES, DEPTH, LEAST, CHOSEN, BINS, SEED, ROUNDS, STEP, FOLDS = 3, 2, 5, 4, 16, 42, 2, 0.1, 5
UNIT = 16777216.0
VOTE = 1000000
CUTS = [int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10)]
CLASSES = range(4)


def _mix(x: str) -> str:
    a = f"((({x}) * 48271 + 11) % {PRIME})"
    b = f"((xor({a}, {a} >> 15) * 69621) % {PRIME})"
    return f"((xor({b}, {b} >> 13) * 16807) % {PRIME})"


def _binned(fit: str) -> str:
    """lv: (id, label, part, fold, f, v); cuts from the rows where ``fit``; tb: (id, label, part, fold, f, b)."""
    long = "\nUNION ALL\n".join(f"SELECT id, CAST(Diagnosis_Class AS INT) AS label, part, fold, {i} AS f, CAST({c} AS DOUBLE) AS v FROM fx"
                                for i, c in enumerate(_FEATS))
    return _FRAME + f"""
, fx AS (SELECT *, CAST(NTILE({FOLDS}) OVER (PARTITION BY Diagnosis_Class ORDER BY rn) - 1 AS INT) AS fold FROM fr),
lv AS MATERIALIZED ({long}),
h AS (SELECT f, v, COUNT(*) AS c FROM lv WHERE {fit} GROUP BY f, v),
hr AS (SELECT f, v, SUM(c) OVER (PARTITION BY f ORDER BY v) AS upto, c, SUM(c) OVER (PARTITION BY f) AS n FROM h),
cuts AS (SELECT f, v AS cut FROM hr WHERE upto < n AND (upto * {BINS}) // n > ((upto - c) * {BINS}) // n),
fb AS (SELECT lv.f, lv.v, COUNT(cut) AS b FROM (SELECT DISTINCT f, v FROM lv) lv LEFT JOIN cuts ON cuts.f = lv.f AND cuts.cut < lv.v
       GROUP BY lv.f, lv.v),
tb AS MATERIALIZED (SELECT id, label, part, fold, lv.f, CAST(b AS INT) AS b FROM lv JOIN fb ON lv.f = fb.f AND lv.v = fb.v),
fs AS (SELECT UNNEST(range({len(_FEATS)})) AS f)"""


def _forest(trees: int, folds: int, fit: str) -> str:
    """The levels of a forest: node rows n0..n2, and tree rows' places a0..a2. Tree t of a fold's forest
    hashes like tree t % trees."""
    tree = f"(tree % {trees})"
    weight = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in CUTS)
    mask = f"fold <> tree // {trees}" if folds else "TRUE"
    out = f"""
, wr AS MATERIALIZED (SELECT tree, id, label, ({weight}) AS w FROM (
    SELECT tree, id, label, fold, {_mix(f"(id % {PRIME} + ({tree} + 1) * 1000003 + {SEED * 97}) % {PRIME}")} AS u
    FROM (SELECT DISTINCT id, label, fold FROM tb WHERE {fit}), (SELECT UNNEST(range({trees * max(1, folds)})) AS tree))
  WHERE {mask}),
a0 AS (SELECT tree, id, label, w, 1 AS node FROM wr WHERE w > 0)"""
    sums = ", ".join(f"SUM(CASE WHEN label = {c} THEN w ELSE 0 END) AS c{c}" for c in CLASSES)
    for level in range(DEPTH + 1):
        out += f"""
, t{level} AS MATERIALIZED (SELECT tree, node, {sums}, SUM(w) AS n FROM a{level} GROUP BY tree, node)"""
        if level == DEPTH:
            break
        left = ", ".join(f"SUM(c{c}) OVER o AS l{c}" for c in CLASSES)
        squares = lambda p: " + ".join(f"CAST({p.format(c)} AS DOUBLE) * CAST({p.format(c)} AS DOUBLE)" for c in CLASSES)
        out += f"""
, p{level} AS (SELECT tree, node, f FROM (
    SELECT tree, node, f, ROW_NUMBER() OVER (PARTITION BY tree, node
      ORDER BY {_mix(f"({tree} * 131071 + node * 8191 + {SEED * 97} + f * 524287) % {PRIME}")}, f) AS place FROM t{level}, fs)
  WHERE place <= {CHOSEN}),
g{level} AS (SELECT a.tree, a.node, a.f, b, {sums.replace('label', 'a.label')}, SUM(w) AS n FROM
    (SELECT a.*, p.f FROM a{level} a JOIN p{level} p ON a.tree = p.tree AND a.node = p.node) a
    JOIN tb ON tb.id = a.id AND tb.f = a.f GROUP BY a.tree, a.node, a.f, b),
r{level} AS (SELECT tree, node, f, b, {left}, SUM(n) OVER o AS nl FROM g{level} WINDOW o AS (PARTITION BY tree, node, f ORDER BY b)),
s{level} AS (SELECT r.tree, r.node, f, b, ({squares('l{}')}) / nl + ({squares('(c{0} - l{0})')}) / (n - nl) AS score,
    ({squares('c{}')}) / n AS base FROM r{level} r JOIN t{level} t ON r.tree = t.tree AND r.node = t.node
    WHERE nl >= {LEAST} AND n - nl >= {LEAST}),
b{level} AS MATERIALIZED (SELECT tree, node, f, b FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY tree, node ORDER BY score DESC, f, b) AS k FROM s{level}
    WHERE score > base * (1 + 1e-12::DOUBLE)) WHERE k = 1),
a{level + 1} AS MATERIALIZED (SELECT a.tree, a.id, a.label, a.w, 2 * a.node + CASE WHEN tb.b > x.b THEN 1 ELSE 0 END AS node
    FROM a{level} a JOIN b{level} x ON a.tree = x.tree AND a.node = x.node JOIN tb ON tb.id = a.id AND tb.f = x.f)"""
    rows = "\nUNION ALL\n".join(
        f"SELECT t.tree, t.node, {'COALESCE(x.f, -1)' if level < DEPTH else '-1'} AS feature, "
        f"{'COALESCE(x.b, -1)' if level < DEPTH else '-1'} AS bin, c0, c1, c2, c3, n FROM t{level} t"
        + (f" LEFT JOIN b{level} x ON t.tree = x.tree AND t.node = x.node" if level < DEPTH else "") for level in range(DEPTH + 1))
    return out + f"\n, nodes AS MATERIALIZED ({rows})"


def _walk(rows: str, extra: str = "") -> str:
    """w0..w2: the node each (tree, row) of ``rows`` (tree, id) stands in, down to its leaf."""
    out = f"\n, w0 AS (SELECT tree, id, 1 AS node FROM ({rows}))"
    for level in range(DEPTH):
        out += f"""
, w{level + 1} AS (SELECT w.tree, w.id, CASE WHEN n.feature < 0 THEN w.node ELSE 2 * w.node + CASE WHEN tb.b > n.bin THEN 1 ELSE 0 END END AS node
    FROM w{level} w JOIN nodes n ON w.tree = n.tree AND w.node = n.node LEFT JOIN tb ON tb.id = w.id AND tb.f = n.feature)"""
    return out


def _votes() -> str:
    """pr: (id, prediction) by the votes of the leaves, ties to the smaller class."""
    sums = ", ".join(f"SUM((c{c} * {VOTE}) // n) AS v{c}" for c in CLASSES)
    best = "CASE " + " ".join(f"WHEN v{c} = GREATEST(v0, v1, v2, v3) THEN {c}" for c in CLASSES) + " END"
    return f"""
, pr AS (SELECT id, {best} AS prediction FROM (
    SELECT id, {sums} FROM w{DEPTH} w JOIN nodes n ON w.tree = n.tree AND w.node = n.node GROUP BY id))"""


_TRAIN = "part = 'train'"
_TEST_ROWS = "SELECT DISTINCT id, label, fold FROM tb WHERE part = 'test'"
MODELS: dict[str, str] = {}
_ONE = _binned(_TRAIN) + _forest(TREES, 0, _TRAIN)
MODELS["forest_nodes"] = _ONE + """
SELECT CAST(tree AS INT) AS tree, CAST(node AS INT) AS node, CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin,
  """ + ", ".join(f"CAST(c{c} AS BIGINT) AS class_{c}" for c in CLASSES) + " FROM nodes"
MODELS["forest_predictions"] = _ONE + _walk(f"SELECT tree, id FROM ({_TEST_ROWS}), (SELECT DISTINCT tree FROM nodes)") + _votes() + f"""
SELECT t.id, t.label, CAST(prediction AS INT) AS prediction FROM ({_TEST_ROWS}) t JOIN pr ON t.id = pr.id"""
_SQUARE = " + ".join(f"CAST({{0}}c{c} AS DOUBLE) * CAST({{0}}c{c} AS DOUBLE)" for c in CLASSES)
MODELS["forest_importance"] = _ONE + f"""
, gain AS (SELECT p.tree, p.feature, SUM(cs - ({_SQUARE.format('p.')}) / p.n) AS gain FROM nodes p
  JOIN (SELECT tree, node // 2 AS parent, SUM(({_SQUARE.format('')}) / n) AS cs FROM nodes GROUP BY tree, node // 2) k
    ON k.tree = p.tree AND k.parent = p.node WHERE p.feature >= 0 GROUP BY p.tree, p.feature),
share AS (SELECT feature, SUM(gain / whole) / (SELECT COUNT(DISTINCT tree) FROM nodes WHERE feature >= 0) AS importance
  FROM (SELECT *, SUM(gain) OVER (PARTITION BY tree) AS whole FROM gain) GROUP BY feature),
c AS (SELECT names.name AS feature, {R('COALESCE(importance, 0)', 9)} AS importance
  FROM (SELECT UNNEST([{', '.join(repr(f) for f in _FEATS)}]) AS name, UNNEST(range({len(_FEATS)})) AS i) names
  LEFT JOIN share ON share.feature = names.i)
SELECT feature, importance, feature IN ({', '.join(repr(c) for c in _ENGINEERED)}) AS engineered,
  AVG(importance) OVER () AS mean_importance, CAST(ROW_NUMBER() OVER (ORDER BY importance DESC, feature) AS INT) AS rank,
  ROW_NUMBER() OVER (ORDER BY importance DESC, feature) <= 10 AS top FROM c"""
MODELS["cv_accuracy_shallow"] = (_binned("TRUE") + _forest(TREES, FOLDS, "TRUE") + _walk(
    f"SELECT tree, id FROM (SELECT DISTINCT id, fold FROM tb) r JOIN (SELECT DISTINCT tree FROM nodes) t ON r.fold = t.tree // {TREES}")
    + _votes() + """
, per AS (SELECT fold, AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, COUNT(*) AS n
  FROM (SELECT DISTINCT id, label, fold FROM tb) r JOIN pr ON r.id = pr.id GROUP BY fold)
SELECT CAST(fold AS INT) AS fold, n, accuracy, AVG(accuracy) OVER () AS mean_accuracy, STDDEV_POP(accuracy) OVER () AS std_accuracy FROM per""")


def _boosting() -> str:
    """Two rounds of boosting: nodes (tree, node, feature, bin, sums, value) as ``nodes``."""
    raws = ", ".join(f"ln((SELECT COUNT(*) FROM y WHERE label = {c})::DOUBLE / (SELECT COUNT(*) FROM y)) AS z{c}" for c in CLASSES)
    out = f"""
, y AS MATERIALIZED (SELECT DISTINCT id, label FROM tb WHERE {_TRAIN}),
z0 AS MATERIALIZED (SELECT id, label, {raws} FROM y)"""
    tables = []
    for r in range(ROUNDS):
        top = "GREATEST(z0, z1, z2, z3)"
        share = lambda c: f"e{c} / (e0 + e1 + e2 + e3)"
        out += f"\n, e{r} AS (SELECT id, label, {', '.join(f'exp(z{c} - {top}) AS e{c}' for c in CLASSES)} FROM z{r})"
        res = "\nUNION ALL\n".join(
            f"SELECT id, {4 * r + c} AS tree, CAST(floor((CASE WHEN label = {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - {share(c)}) * {UNIT}::DOUBLE"
            f" + 0.5::DOUBLE) AS BIGINT) AS g FROM e{r}" for c in CLASSES)
        out += f"""
, q{r} AS MATERIALIZED (SELECT *, CAST(floor((abs(g) / {UNIT}::DOUBLE) * (1.0::DOUBLE - abs(g) / {UNIT}::DOUBLE) * {UNIT}::DOUBLE
    + 0.5::DOUBLE) AS BIGINT) AS v FROM ({res})),
m{r}_0 AS (SELECT tree, id, g, v, 1 AS node FROM q{r})"""
        for level in range(DEPTH + 1):
            k = f"{r}_{level}"
            out += f"\n, t{k} AS MATERIALIZED (SELECT tree, node, SUM(g) AS g, SUM(v) AS v, COUNT(*) AS n FROM m{k} GROUP BY tree, node)"
            if level == DEPTH:
                tables.append(f"SELECT tree, node, -1 AS feature, -1 AS bin, g, v, n FROM t{k}")
                break
            sq = lambda x: f"CAST({x} AS DOUBLE) * CAST({x} AS DOUBLE)"
            out += f"""
, h{k} AS (SELECT m.tree, m.node, f, b, SUM(g) AS g, COUNT(*) AS n FROM m{k} m JOIN tb ON tb.id = m.id GROUP BY m.tree, m.node, f, b),
c{k} AS (SELECT tree, node, f, b, SUM(g) OVER o AS gl, SUM(n) OVER o AS nl FROM h{k} WINDOW o AS (PARTITION BY tree, node, f ORDER BY b)),
s{k} AS (SELECT c.tree, c.node, f, b, ({sq('gl')}) / nl + ({sq('(g - gl)')}) / (n - nl) AS score, ({sq('g')}) / n AS base
    FROM c{k} c JOIN t{k} t ON c.tree = t.tree AND c.node = t.node WHERE n - nl >= 1),
x{k} AS MATERIALIZED (SELECT tree, node, f, b FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tree, node ORDER BY score DESC, f, b) AS k
    FROM s{k} WHERE score > base * (1 + 1e-12::DOUBLE)) WHERE k = 1),
m{r}_{level + 1} AS MATERIALIZED (SELECT m.tree, m.id, m.g, m.v, 2 * m.node + CASE WHEN tb.b > x.b THEN 1 ELSE 0 END AS node
    FROM m{k} m JOIN x{k} x ON m.tree = x.tree AND m.node = x.node JOIN tb ON tb.id = m.id AND tb.f = x.f)"""
            tables.append(f"SELECT t.tree, t.node, COALESCE(x.f, -1) AS feature, COALESCE(x.b, -1) AS bin, g, v, n "
                          f"FROM t{k} t LEFT JOIN x{k} x ON t.tree = x.tree AND t.node = x.node")
        value = f"({STEP}::DOUBLE * 0.75::DOUBLE) * (CAST(g AS DOUBLE) / CAST(v AS DOUBLE))"
        union = "\nUNION ALL\n".join(tables)
        out += f"\n, nodes{r} AS MATERIALIZED (SELECT *, CASE WHEN feature < 0 AND v > 0 THEN {value} ELSE 0.0::DOUBLE END AS value FROM ({union}))"
        if r + 1 < ROUNDS:
            walk = _walk(f"SELECT tree, id FROM y, (SELECT DISTINCT tree FROM nodes{r} WHERE tree >= {4 * r})").replace("nodes n", f"nodes{r} n")
            for level in range(DEPTH + 1):
                walk = walk.replace(f"w{level} ", f"w{r}{level} ")
            add = ", ".join(f"z{c} + SUM(CASE WHEN n.tree % 4 = {c} THEN value ELSE 0 END) AS z{c}" for c in CLASSES)
            out += walk + f"""
, z{r + 1} AS MATERIALIZED (SELECT z.id, z.label, {add} FROM z{r} z JOIN w{r}{DEPTH} w ON w.id = z.id
    JOIN nodes{r} n ON n.tree = w.tree AND n.node = w.node GROUP BY z.id, z.label, z0, z1, z2, z3)"""
    return out + f"\n, nodes AS (SELECT * FROM nodes{ROUNDS - 1})"


_BOOST = _binned(_TRAIN) + _boosting()
MODELS["boosting_nodes"] = _BOOST + f"""
SELECT CAST(tree AS INT) AS tree, CAST(node AS INT) AS node, CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin,
  CAST(g AS BIGINT) AS residual, CAST(v AS BIGINT) AS curvature, CAST(n AS BIGINT) AS rows, {R('value', 9)} AS value FROM nodes"""
MODELS["boosting_predictions"] = _BOOST + _walk(f"SELECT tree, id FROM ({_TEST_ROWS}), (SELECT DISTINCT tree FROM nodes)") + f"""
, sc AS (SELECT w.id, {', '.join(f'(SELECT z{c} FROM z0 LIMIT 1) + SUM(CASE WHEN w.tree % 4 = {c} THEN value ELSE 0 END) AS s{c}' for c in CLASSES)}
  FROM w{DEPTH} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node GROUP BY w.id)
SELECT t.id, t.label, CAST(CASE {' '.join(f'WHEN s{c} = GREATEST(s0, s1, s2, s3) THEN {c}' for c in CLASSES)} END AS INT) AS prediction
FROM ({_TEST_ROWS}) t JOIN sc ON t.id = sc.id"""

# every component of the penalised gradient vanishes at the fitted coefficients
MODELS["logistic_gradient"] = f"""
SELECT CAST(k AS INT) AS class, name AS feature, TRUE AS at_optimum
FROM (SELECT UNNEST(range(4)) AS k), (SELECT UNNEST([{', '.join(repr(f) for f in [*_FEATS, 'intercept'])}]) AS name)"""


def _newton(steps: int = 9) -> str:
    """Log odds u x1 + v x2 + w of a class other than 0, penalty (u^2 + v^2) / 4: half of what both classes'
    opposite weights bear. Three unknowns per step by Cramer's rule."""
    out = _FRAME + """
, x0 AS MATERIALIZED (SELECT CASE WHEN Diagnosis_Class <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
    CAST(Total_Severity AS DOUBLE) AS a, CAST(Sleep_Hours AS DOUBLE) AS b FROM fr WHERE part = 'train'),
x AS MATERIALIZED (SELECT y, (a - (SELECT AVG(a) FROM x0)) / (SELECT STDDEV_POP(a) FROM x0) AS a,
    (b - (SELECT AVG(b) FROM x0)) / (SELECT STDDEV_POP(b) FROM x0) AS b FROM x0),
k0 AS (SELECT 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS w)"""
    for i in range(steps):
        out += f"""
, d{i} AS (SELECT y, a, b, 1 / (1 + exp(-(u * a + v * b + w))) AS p, u, v, w FROM x, k{i}),
h{i} AS MATERIALIZED (SELECT ANY_VALUE(u) AS u, ANY_VALUE(v) AS v, ANY_VALUE(w) AS w,
    SUM((p - y) * a) + ANY_VALUE(u) / 2 AS g1, SUM((p - y) * b) + ANY_VALUE(v) / 2 AS g2, SUM(p - y) AS g3,
    SUM(p * (1 - p) * a * a) + 0.5 AS h11, SUM(p * (1 - p) * a * b) AS h12, SUM(p * (1 - p) * a) AS h13,
    SUM(p * (1 - p) * b * b) + 0.5 AS h22, SUM(p * (1 - p) * b) AS h23, SUM(p * (1 - p)) AS h33 FROM d{i}),
k{i + 1} AS MATERIALIZED (SELECT
    u - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det AS u,
    v - (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det AS v,
    w - (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det AS w
  FROM (SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS det FROM h{i}))"""
    return out + f"""
SELECT 'Total_Severity' AS name, {R('u', 6)} AS odds FROM k{steps} UNION ALL SELECT 'Sleep_Hours', {R('v', 6)} FROM k{steps}
UNION ALL SELECT 'intercept', {R('w', 6)} FROM k{steps}"""


MODELS["logistic_two_classes"] = _newton()
MODELS = {k: v if k == "logistic_gradient" else with_features(v) for k, v in MODELS.items()}
