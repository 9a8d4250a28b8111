"""SQL for DuckDB that computes the catalogue's results in a different way.

Relational queries are plain SQL. Fits without unit effects are solved by Newton steps in a recursive query; normal and
Tukey tails are integrated numerically. Mixed fits at a given covariance are solved by Newton steps, too: independent effects
are eliminated one by one, joint ones by Gauss-Jordan steps per unit and a Schur complement over the levels. Where the variance
itself is searched for, grids of candidates close in on the best one.
"""

from __future__ import annotations

ADM = """adm AS (
  SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS unit_code, CAST(l_quantity * 2 AS INT) AS saps,
    CAST(l_returnflag = 'R' AS INT) AS death, CAST(year(l_shipdate) AS VARCHAR) AS adm_year,
    CASE WHEN l_linestatus = 'O' THEN 'eSurgery' ELSE 'Medical' END AS adm_type,
    CAST(l_linenumber % 3 AS VARCHAR) AS ecog, CAST(CAST(l_tax >= 0.04 AS INT) AS VARCHAR) AS infection,
    CAST(CAST(l_discount >= 0.05 AS INT) AS VARCHAR) AS mv, CAST(l_shipdate AS DATE) AS adm_date
  FROM lineitem)"""


def phased(gap: str = "pweek > 25") -> str:
    return f"""phased AS (
  SELECT *, CASE WHEN adm_year <> '2001' THEN adm_year WHEN pweek <= 10 THEN 'before'
    WHEN pweek > 10 AND pweek <= 24 THEN 'peak1' WHEN {gap} AND pweek <= 41 THEN 'plateau' ELSE 'peak2' END AS period
  FROM (SELECT *, (dayofyear(adm_date) - 1) // 7 + 1 AS pweek FROM adm WHERE adm_year IN ('2000', '2001')))"""


LEVELS = """lv AS (
  SELECT level, CAST(row_number() OVER (ORDER BY level) AS INT) AS idx
  FROM (SELECT DISTINCT adm_year AS level FROM adm))"""

PERIOD_LEVELS = """lv AS (
  SELECT * FROM (VALUES ('2000', 1, '2000'), ('before', 2, 'Baseline'), ('peak1', 3, 'First Peak'),
    ('plateau', 4, 'Plateau'), ('peak2', 5, 'Second Peak')) t(level, idx, label)
  WHERE level IN (SELECT period FROM phased))"""

CLOSED = f"""{ADM}, {LEVELS},
counts AS (
  SELECT saps, adm_year AS level, CAST(count(*) AS DOUBLE) AS n, CAST(sum(death) AS DOUBLE) AS k FROM adm GROUP BY ALL),
means AS (
  SELECT saps, level, idx, CASE WHEN k > 0 AND k < n THEN ln(k / (n - k)) END AS eta,
    CASE WHEN k > 0 AND k < n THEN 1 / k + 1 / (n - k) END AS v
  FROM counts JOIN lv USING (level))"""

PAIRS = """pairs AS (
  SELECT a.saps, a.level AS level_a, b.level AS level_b, a.level || ' / ' || b.level AS contrast,
    a.eta - b.eta AS log_or, sqrt(a.v + b.v) AS se_log, f.family
  FROM means a JOIN means b ON a.saps = b.saps AND a.idx < b.idx
  JOIN (SELECT saps, count(*) AS family FROM means GROUP BY saps) f ON f.saps = a.saps)"""

CLOSED_PAIRS = f"{CLOSED}, {PAIRS}"


def half(x: str) -> str:
    """Normal distribution function minus one half, by Simpson's rule on 400 intervals."""
    return (
        f"(({x}) / sqrt(2 * pi()) / 1200 * list_sum(list_transform(range(401), lambda i: "
        f"(CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * power(({x}) * i / 400.0, 2)))))"
    )


TUKEY = f"""nodes AS (
  SELECT x, {half('x')} AS h, exp(-x * x / 2) / sqrt(2 * pi()) * 0.2 AS weight
  FROM (SELECT (i - 45) * 0.2 AS x FROM range(91) t(i))),
tukey AS (
  SELECT saps, contrast, CASE WHEN max(z) IS NOT NULL THEN greatest(0.0, least(1.0, 1 - family * sum(
    weight * power(h - {half('x - sqrt(2) * z')}, family - 1)))) END AS p_value
  FROM (SELECT saps, contrast, family, CAST(abs(log_or / se_log) AS DOUBLE) AS z FROM pairs) CROSS JOIN nodes
  GROUP BY saps, contrast, family)"""


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round(({expression}) * (1 + 1e-12), {digits}) + 0.0 AS {name}"


def fixed(source: str, level: str) -> str:
    """Twelve Newton steps per level; ``est`` has estimates and covariance on the original score scale."""
    return f"""pooled AS (
  SELECT {level} AS level, CAST(saps AS DOUBLE) AS saps, (saps - 50) / 30.0 AS s, CAST(count(*) AS DOUBLE) AS n,
    CAST(sum(death) AS DOUBLE) AS k
  FROM {source} GROUP BY ALL),
steps AS (
  SELECT 0 AS i, level, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS c FROM (SELECT DISTINCT level FROM pooled)
  UNION ALL
  SELECT i + 1, level, a + (w2 * r0 - w1 * r1) / (w0 * w2 - w1 * w1), c + (w0 * r1 - w1 * r0) / (w0 * w2 - w1 * w1)
  FROM (
    SELECT i, level, a, c, sum(n * m * (1 - m)) AS w0, sum(n * m * (1 - m) * s) AS w1, sum(n * m * (1 - m) * s * s) AS w2,
      sum(k - n * m) AS r0, sum((k - n * m) * s) AS r1
    FROM (SELECT steps.*, s, n, k, 1 / (1 + exp(-(a + c * s))) AS m FROM steps JOIN pooled USING (level) WHERE i < 12)
    GROUP BY i, level, a, c)),
last AS (SELECT level, a - c * 50 / 30.0 AS a, c / 30.0 AS c FROM steps WHERE i = 12),
est AS (
  SELECT level, a, c, w2 / (w0 * w2 - w1 * w1) AS v_aa, -w1 / (w0 * w2 - w1 * w1) AS v_ac, w0 / (w0 * w2 - w1 * w1) AS v_cc,
    ll
  FROM (
    SELECT level, a, c, sum(n * m * (1 - m)) AS w0, sum(n * m * (1 - m) * saps) AS w1,
      sum(n * m * (1 - m) * saps * saps) AS w2, sum(k * ln(m) + (n - k) * ln(1 - m)) AS ll
    FROM (SELECT last.*, saps, n, k, 1 / (1 + exp(-(a + c * saps))) AS m FROM last JOIN pooled USING (level))
    GROUP BY level, a, c))"""


def at_scores(values: str) -> str:
    return f"""means AS (
  SELECT CAST(saps AS INT) AS saps, level, idx, a + c * saps AS eta, v_aa + 2 * v_ac * saps + v_cc * saps * saps AS v
  FROM est JOIN lv USING (level) CROSS JOIN {values} t(saps))"""


CONTRAST_SCORES = "(SELECT 10 * i FROM range(2, 11) u(i))"
CURVE_SCORES = "(SELECT i FROM range(30, 101) u(i))"
FIXED_YEARS = f"{ADM}, {LEVELS}, {fixed('adm', 'adm_year')}"
FIXED_PERIODS = f"{ADM}, {phased()}, {PERIOD_LEVELS}, {fixed('phased', 'period')}"

Z = 1.959963984540054
MEANS_SQL = f"""SELECT saps, level, {r('1 / (1 + exp(-eta))', 'prob')},
  {r('1 / (1 + exp(-eta)) * (1 - 1 / (1 + exp(-eta))) * sqrt(v)', 'se')},
  {r(f'1 / (1 + exp(-(eta - {Z} * sqrt(v))))', 'lower')}, {r(f'1 / (1 + exp(-(eta + {Z} * sqrt(v))))', 'upper')}
FROM means"""

CURVE_SQL = f"""saps AS x, level AS "group", {r('1 / (1 + exp(-eta))', 'predicted')}, {r('sqrt(v)', 'std_error')},
  {r(f'1 / (1 + exp(-(eta - {Z} * sqrt(v))))', 'conf_low')}, {r(f'1 / (1 + exp(-(eta + {Z} * sqrt(v))))', 'conf_high')}"""


def or_sql(error: str) -> str:
    return f"""SELECT saps, contrast, level_b || ' / ' || level_a AS or_direction, {r('exp(-log_or)', 'odds_ratio')},
  {r(f'exp(-log_or - 1.96 * {error})', 'lower')}, {r(f'exp(-log_or + 1.96 * {error})', 'upper')}, {r('p_value', 'p_value')}
FROM pairs JOIN tukey USING (saps, contrast) WHERE level_b = '2001'"""


def season_sql(compat: bool) -> str:
    # pairs run from the earlier to the later level; the season compares the later with the earlier one
    direction = "level_a || ' / ' || level_b" if compat else "level_b || ' / ' || level_a"
    label = "level_a || '/' || label" if compat else "label || '/' || level_a"
    center = "log_or" if compat else "-log_or"
    error = "exp(-log_or) * se_log" if compat else "se_log"
    return f"""WITH RECURSIVE {FIXED_PERIODS}, {at_scores(CONTRAST_SCORES)}, {PAIRS}, {TUKEY}
SELECT saps, level_b || ' / ' || level_a AS contrast, {direction} AS or_direction, {label} AS label,
  {r(f'exp({center})', 'odds_ratio')}, {r(f'exp({center} - 1.96 * {error})', 'lower')},
  {r(f'exp({center} + 1.96 * {error})', 'upper')}, {r('p_value', 'p_value')}
FROM pairs JOIN tukey USING (saps, contrast) JOIN lv ON lv.level = level_b WHERE level_a = '2000'"""


SUBGROUP_RULES = [
    ("surg", "adm_type = 'eSurgery'"), ("med", "adm_type = 'Medical'"), ("ecog0", "ecog = '0'"), ("ecog1", "ecog = '1'"),
    ("ecog2", "ecog = '2'"), ("infection", "infection = '1'"), ("mv", "mv = '1'"),
]

REPORT_TEXT = "regexp_replace(printf('%.3f', {0}), '\\.?0+$', '')"


def text3(expression: str) -> str:
    text = REPORT_TEXT.format(f"CAST(round_even({expression}, 3) AS DOUBLE)")
    return f"coalesce({text}, 'NA')"


REPORT_SQL = f"""WITH {CLOSED_PAIRS}, {TUKEY}
SELECT CAST(saps AS DOUBLE) AS saps, {text3('exp(-log_or)')} || ' [' || {text3('exp(-log_or - 1.96 * se_log)')} || '-' ||
  {text3('exp(-log_or + 1.96 * se_log)')} || ']' AS odds_ratio2, CAST(round_even(p_value, 3) AS DOUBLE) AS p_value
FROM pairs JOIN tukey USING (saps, contrast) WHERE level_b = '2001'"""

SCORE_SQL = f"""WITH {ADM}
SELECT adm_year AS level, CAST(sum(death) AS BIGINT) AS observed, CAST(sum(death) AS DOUBLE) AS fitted,
  CAST(sum(saps * death) AS DOUBLE) AS observed_saps, CAST(sum(saps * death) AS DOUBLE) AS fitted_saps
FROM adm GROUP BY adm_year"""

# The subgroups in one table, with the model as part of the level; contrasts are formed within a model.
SUBGROUP_ROWS = "sub AS (" + " UNION ALL ".join(
    f"SELECT '{name}|' || adm_year AS own_level, saps, death FROM adm WHERE {rule}" for name, rule in SUBGROUP_RULES
) + ")"
SUBGROUP_SQL = f"""WITH RECURSIVE {ADM}, {LEVELS}, {SUBGROUP_ROWS}, {fixed('sub', 'own_level')},
means AS (
  SELECT split_part(e.level, '|', 1) AS model, CAST(s.saps AS INT) AS score, split_part(e.level, '|', 1) || '|' || s.saps AS saps,
    lv.level, idx, a + c * s.saps AS eta, v_aa + 2 * v_ac * s.saps + v_cc * s.saps * s.saps AS v
  FROM est e JOIN lv ON lv.level = split_part(e.level, '|', 2) CROSS JOIN {CONTRAST_SCORES} s(saps)),
{PAIRS}, {TUKEY}
SELECT split_part(saps, '|', 1) AS model, CAST(split_part(saps, '|', 2) AS INT) AS saps, contrast,
  level_b || ' / ' || level_a AS or_direction, {r('exp(-log_or)', 'odds_ratio')},
  {r('exp(-log_or - 1.96 * se_log)', 'lower')}, {r('exp(-log_or + 1.96 * se_log)', 'upper')}, {r('p_value', 'p_value')}
FROM pairs JOIN tukey USING (saps, contrast) WHERE level_b = '2001'"""

# Common slope: Newton steps with the intercepts eliminated.
ADDITIVE = """pooled AS (
  SELECT adm_year AS level, CAST(saps AS DOUBLE) AS saps, (saps - 50) / 30.0 AS s, CAST(count(*) AS DOUBLE) AS n,
    CAST(sum(death) AS DOUBLE) AS k
  FROM adm GROUP BY ALL),
steps AS (
  SELECT 0 AS i, level, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS c FROM (SELECT DISTINCT level FROM pooled)
  UNION ALL
  SELECT i + 1, level, a + (r0 - w1 * dc) / w0, c + dc
  FROM (
    SELECT *, sum(r1 - w1 * r0 / w0) OVER (PARTITION BY i) / sum(w2 - w1 * w1 / w0) OVER (PARTITION BY i) AS dc
    FROM (
      SELECT i, level, a, c, sum(n * m * (1 - m)) AS w0, sum(n * m * (1 - m) * s) AS w1,
        sum(n * m * (1 - m) * s * s) AS w2, sum(k - n * m) AS r0, sum((k - n * m) * s) AS r1
      FROM (SELECT steps.*, s, n, k, 1 / (1 + exp(-(a + c * s))) AS m FROM steps JOIN pooled USING (level) WHERE i < 12)
      GROUP BY i, level, a, c))),
common AS (
  SELECT level, a, c, sum(n * m * (1 - m)) AS w0, sum(n * m * (1 - m) * s) AS w1, sum(n * m * (1 - m) * s * s) AS w2,
    sum(k * ln(m) + (n - k) * ln(1 - m)) AS ll
  FROM (SELECT steps.*, s, n, k, 1 / (1 + exp(-(a + c * s))) AS m FROM steps JOIN pooled USING (level) WHERE i = 12)
  GROUP BY level, a, c)"""
COMPARE_SQL = f"""WITH RECURSIVE {ADM}, {LEVELS}, {fixed('adm', 'adm_year')},
one AS (SELECT CAST(2 * count(*) AS INT) AS npar, sum(ll) AS ll FROM est),
{ADDITIVE.replace('pooled', 'pooled2').replace('steps', 'steps2')},
two AS (SELECT CAST(count(*) + 1 AS INT) AS npar, sum(ll) AS ll FROM common),
test AS (SELECT 2 * (one.ll - two.ll) AS x, one.npar - two.npar AS df FROM one, two)
SELECT 'additive' AS model, npar, {r('-2 * ll', 'deviance', 4)}, CAST(NULL AS DOUBLE) AS chisq, CAST(NULL AS INT) AS df,
  CAST(NULL AS DOUBLE) AS p_value FROM two
UNION ALL
SELECT 'interaction', npar, {r('-2 * ll', 'deviance', 4)}, {r('x', 'chisq', 4)}, CAST(df AS INT),
  {r('exp(-x / 2) * list_sum([power(x / 2, i) / gamma(i + 1) FOR i IN range(0, df // 2)])', 'p_value', 4)} FROM one, test"""
ADDITIVE_OR_SQL = f"""WITH RECURSIVE {ADM}, {LEVELS}, {ADDITIVE},
pair AS (
  SELECT s.saps, g.level || ' / ' || h.level AS contrast, h.level || ' / ' || g.level AS or_direction, h.a - g.a AS log_or,
    sqrt(1 / g.w0 + 1 / h.w0 + power(g.w1 / g.w0 - h.w1 / h.w0, 2) / (SELECT sum(w2 - w1 * w1 / w0) FROM common)) AS se
  FROM common g JOIN common h ON g.level < h.level AND h.level = '2001' CROSS JOIN {CONTRAST_SCORES} s(saps))
SELECT CAST(saps AS INT) AS saps, contrast, or_direction, {r('exp(log_or)', 'odds_ratio')},
  {r('exp(log_or - 1.96 * se)', 'lower')}, {r('exp(log_or + 1.96 * se)', 'upper')},
  {r(f"2 * (0.5 - {half('least(abs(log_or / se), 12)')})", 'p_value')} FROM pair"""

# Independent unit effects of a given variance: every unit and level has one scalar effect, eliminated from the two equations
# of its level; sixteen Newton steps. Levels of several models may be fitted side by side.


def independent(source: str, level: str, precision: str = "4") -> str:
    """``final`` has effects and sums per unit and level; ``precision`` may depend on the level."""
    return f"""cell AS (
  SELECT unit_code AS unit, {level} AS level, CAST(saps AS DOUBLE) AS saps, (saps - 50) / 30.0 AS s,
    CAST(count(*) AS DOUBLE) AS n, CAST(sum(death) AS DOUBLE) AS k
  FROM {source} GROUP BY ALL),
steps AS (
  SELECT 0 AS i, unit, level, CAST({precision} AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS c,
    CAST(0 AS DOUBLE) AS b
  FROM (SELECT DISTINCT unit, level FROM cell)
  UNION ALL
  SELECT i + 1, unit, level, q, a + d0, c + d1, b + (r0 - q * b - w0 * d0 - w1 * d1) / (w0 + q)
  FROM (
    SELECT *, (a11 * u0 - a01 * u1) / (a00 * a11 - a01 * a01) AS d0, (a00 * u1 - a01 * u0) / (a00 * a11 - a01 * a01) AS d1
    FROM (
      SELECT *, sum(w0 - w0 * w0 / (w0 + q)) OVER l AS a00, sum(w1 - w0 * w1 / (w0 + q)) OVER l AS a01,
        sum(w2 - w1 * w1 / (w0 + q)) OVER l AS a11, sum(r0 - w0 * (r0 - q * b) / (w0 + q)) OVER l AS u0,
        sum(r1 - w1 * (r0 - q * b) / (w0 + q)) OVER l AS u1
      FROM (
        SELECT i, unit, level, q, a, c, b, sum(n * m * (1 - m)) AS w0, sum(n * m * (1 - m) * s) AS w1,
          sum(n * m * (1 - m) * s * s) AS w2, sum(k - n * m) AS r0, sum((k - n * m) * s) AS r1
        FROM (
          SELECT steps.*, s, n, k, 1 / (1 + exp(-(a + b + c * s))) AS m FROM steps JOIN cell USING (unit, level) WHERE i < 16)
        GROUP BY i, unit, level, q, a, c, b)
      WINDOW l AS (PARTITION BY i, level)))),
{final_sums(16)}"""


def final_sums(steps: int) -> str:
    return f"""final AS (
  SELECT unit, level, q, a - c * 50 / 30.0 AS a, c / 30.0 AS c, b, sum(n * m * (1 - m)) AS w0,
    sum(n * m * (1 - m) * saps) AS w1, sum(n * m * (1 - m) * saps * saps) AS w2, sum(k * ln(m) + (n - k) * ln(1 - m)) AS ll
  FROM (
    SELECT steps.*, saps, n, k, 1 / (1 + exp(-(a + b + c * s))) AS m FROM steps JOIN cell USING (unit, level) WHERE i = {steps})
  GROUP BY unit, level, q, a, c, b)"""


# what is left of each level's equations once its units are eliminated
LEVEL_INFO = """info AS (
  SELECT level, a, c, sum(w0 - w0 * w0 / (w0 + q)) AS p, sum(w1 - w0 * w1 / (w0 + q)) AS o, sum(w2 - w1 * w1 / (w0 + q)) AS t
  FROM final GROUP BY level, a, c),
est AS (
  SELECT level, a, c, t / (p * t - o * o) AS v_aa, -o / (p * t - o * o) AS v_ac, p / (p * t - o * o) AS v_cc FROM info)"""
GIVEN = f"{ADM}, {independent('adm', 'adm_year')}"

# The same with one slope for all levels: a border to the levels' equations, in which every level has only its intercept left.
BORDERED = f"""{ADM}, {independent('adm', 'adm_year').split('steps AS (')[0]}steps AS (
  SELECT 0 AS i, unit, level, CAST(4 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS b
  FROM (SELECT DISTINCT unit, level FROM cell)
  UNION ALL
  SELECT i + 1, unit, level, q, a + d0, c + d1, b + (r0 - q * b - w0 * d0 - w1 * d1) / (w0 + q)
  FROM (
    SELECT *, (u0 - a01 * d1) / a00 AS d0
    FROM (
      SELECT *, sum((u1 - a01 * u0 / a00) / units) OVER (PARTITION BY i) / sum((a11 - a01 * a01 / a00) / units) OVER (PARTITION BY i) AS d1
      FROM (
        SELECT *, count(*) OVER l AS units, sum(w0 - w0 * w0 / (w0 + q)) OVER l AS a00,
          sum(w1 - w0 * w1 / (w0 + q)) OVER l AS a01, sum(w2 - w1 * w1 / (w0 + q)) OVER l AS a11,
          sum(r0 - w0 * (r0 - q * b) / (w0 + q)) OVER l AS u0, sum(r1 - w1 * (r0 - q * b) / (w0 + q)) OVER l AS u1
        FROM (
          SELECT i, unit, level, q, a, c, b, sum(n * m * (1 - m)) AS w0, sum(n * m * (1 - m) * s) AS w1,
            sum(n * m * (1 - m) * s * s) AS w2, sum(k - n * m) AS r0, sum((k - n * m) * s) AS r1
          FROM (
            SELECT steps.*, s, n, k, 1 / (1 + exp(-(a + b + c * s))) AS m FROM steps JOIN cell USING (unit, level) WHERE i < 16)
          GROUP BY i, unit, level, q, a, c, b)
        WINDOW l AS (PARTITION BY i, level))))),
{final_sums(16)},
info AS (
  SELECT level, a, c, sum(w0 - w0 * w0 / (w0 + q)) AS p, sum(w1 - w0 * w1 / (w0 + q)) AS o, sum(w2 - w1 * w1 / (w0 + q)) AS t
  FROM final GROUP BY level, a, c),
border AS (SELECT 1 / sum(t - o * o / p) AS v FROM info)"""
BORDERED_SQL = f"""WITH RECURSIVE {BORDERED}
SELECT x.level, y.level AS other, {r('x.a', 'a', 9)}, {r('x.c', 'c', 9)},
  {r('CASE WHEN x.level = y.level THEN 1 / x.p ELSE 0 END + x.o / x.p * y.o / y.p * v', 'v_aa', 9)}, {r('-x.o / x.p * v', 'v_ac', 9)},
  {r('-y.o / y.p * v', 'v_ca', 9)}, {r('v', 'v_cc', 9)}
FROM info x CROSS JOIN info y CROSS JOIN border"""


def gauss_jordan(name: str, rows: str, size: int, by: str = "") -> str:
    """Rows ``p, r``: the first ``size`` entries of r are the matrix, the others are solved for. Matrices are positive
    definite, so pivots are taken as they come."""
    key, part = (f"{by}, ", f"{by}, ") if by else ("", "")
    return f"""{name}_steps AS (
  SELECT 0 AS k, {key}p, r FROM {rows}
  UNION ALL
  SELECT k + 1, {key}p, CASE WHEN p = k + 1 THEN [x / lead_row[k + 1] FOR x IN r]
    ELSE [x[1] - x[2] * r[k + 1] / lead_row[k + 1] FOR x IN list_zip(r, lead_row)] END
  FROM (
    SELECT k, {key}p, r, max(CASE WHEN p = k + 1 THEN r END) OVER (PARTITION BY {part}k) AS lead_row FROM {name}_steps
    WHERE k < {size})),
{name} AS MATERIALIZED (SELECT {key}p, r[{size + 1}:] AS r FROM {name}_steps WHERE k = {size})"""


def joint(source: str, level: str, levels: list[str], precision: list[list[float]], steps: int = 10) -> str:
    """Newton steps with joint unit effects of a given precision: one per level, or a single one that all levels share.

    Ends in ``last`` (g, a, c), ``effect`` (unit, p, u), ``solved`` (p, r: rows of the inverse over intercepts and slopes) and
    ``fit`` (sums per unit and level), all with the score as (saps - 50) / 30.
    """
    g, q = len(levels), len(precision)
    own = "e.p = c.g" if q > 1 else "e.p = 1"
    values = ", ".join(f"('{name}', {i})" for i, name in enumerate(levels, 1))
    matrix = ", ".join(f"({i}, {j}, CAST({x!r} AS DOUBLE))" for i, row in enumerate(precision, 1) for j, x in enumerate(row, 1))
    parts = [f"""names AS (SELECT * FROM (VALUES {values}) t(level, g)),
prec AS (SELECT * FROM (VALUES {matrix}) t(p, j, x)),
cell AS MATERIALIZED (
  SELECT unit_code AS unit, g, (saps - 50) / 30.0 AS s, CAST(count(*) AS DOUBLE) AS n, CAST(sum(death) AS DOUBLE) AS k
  FROM {source} JOIN names ON names.level = {level} GROUP BY ALL),
units AS MATERIALIZED (SELECT DISTINCT unit FROM cell),
beta0 AS (SELECT g, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS c FROM names),
effect0 AS (SELECT unit, p, CAST(0 AS DOUBLE) AS u FROM units CROSS JOIN (SELECT DISTINCT p FROM prec))"""]
    sums = """sums{t} AS MATERIALIZED (
  SELECT unit, g, sum(w) AS w0, sum(w * s) AS w1, sum(w * s * s) AS w2, sum(k - n * m) AS r0, sum((k - n * m) * s) AS r1,
    sum(k * ln(m) + (n - k) * ln(1 - m)) AS ll
  FROM (SELECT *, n * m * (1 - m) AS w FROM (
    SELECT c.unit, c.g, s, n, k, 1 / (1 + exp(-(a + e.u + b.c * s))) AS m
    FROM cell c JOIN beta{t} b ON b.g = c.g JOIN effect{t} e ON e.unit = c.unit AND {own}))
  GROUP BY unit, g)"""
    # per unit and effect: its row of the matrix, the couplings to intercepts and slopes, the right-hand side
    full = """full{t} AS MATERIALIZED (
  SELECT u.unit, names.g, coalesce(w0, 0) AS w0, coalesce(w1, 0) AS w1, coalesce(r0, 0) AS r0
  FROM units u CROSS JOIN names LEFT JOIN sums{t} s ON s.unit = u.unit AND s.g = names.g)"""
    pull = "(SELECT e.unit, prec.p, sum(x * u) AS pull FROM effect{t} e JOIN prec ON prec.j = e.p GROUP BY e.unit, prec.p)"
    if q > 1:
        rows = """rows{t} AS MATERIALIZED (
  SELECT f.unit, f.g AS p,
    [CASE WHEN j = f.g THEN w0 ELSE 0 END + m.xs[j] FOR j IN range(1, {q} + 1)]
    || [CASE WHEN j = f.g THEN w0 ELSE 0 END FOR j IN range(1, {g} + 1)]
    || [CASE WHEN j = f.g THEN w1 ELSE 0 END FOR j IN range(1, {g} + 1)] || [r0 - pull] AS r
  FROM full{t} f JOIN (SELECT p, list(x ORDER BY j) AS xs FROM prec GROUP BY p) m ON m.p = f.g JOIN """ + pull + """ l
    ON l.unit = f.unit AND l.p = f.g)"""
    else:
        rows = """rows{t} AS MATERIALIZED (
  SELECT f.unit, 1 AS p, [sum(w0) + any_value(x)] || list(w0 ORDER BY g) || list(w1 ORDER BY g) || [sum(r0) - any_value(pull)] AS r
  FROM full{t} f JOIN """ + pull + """ l ON l.unit = f.unit CROSS JOIN prec GROUP BY f.unit)"""
    # the equations of the fixed part with the units eliminated, and beside them the right-hand side and a unit matrix
    schur = """taken{t} AS MATERIALIZED (
  SELECT p, list(v ORDER BY b) AS vs FROM (
    SELECT p, b, sum(c * v) AS v FROM (
      SELECT p, c, unnest(vs) AS v, unnest(range(1, len(vs) + 1)) AS b FROM (
        SELECT unnest(range(1, 2 * {g} + 1)) AS p, unnest(rows{t}.r[{q} + 1 : {q} + 2 * {g}]) AS c, s.r AS vs
        FROM rows{t} JOIN unit{t} s ON s.unit = rows{t}.unit AND s.p = rows{t}.p))
    GROUP BY p, b) GROUP BY p),
fixed{t} AS MATERIALIZED (
  SELECT t.p, [CASE WHEN (b - 1) % {g} + 1 = l.g THEN CASE (t.p - 1) // {g} + (b - 1) // {g} WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END
      ELSE 0 END - vs[b] FOR b IN range(1, 2 * {g} + 1)]
    || [CASE WHEN t.p <= {g} THEN r0 ELSE r1 END - vs[2 * {g} + 1]]
    || [CASE WHEN b = t.p THEN 1.0 ELSE 0.0 END FOR b IN range(1, 2 * {g} + 1)] AS r
  FROM taken{t} t JOIN (SELECT g, sum(w0) AS w0, sum(w1) AS w1, sum(w2) AS w2, sum(r0) AS r0, sum(r1) AS r1 FROM sums{t} GROUP BY g) l
    ON l.g = (t.p - 1) % {g} + 1)"""
    step = """beta{u} AS MATERIALIZED (
  SELECT b.g, a + x.r[1] AS a, c + y.r[1] AS c FROM beta{t} b JOIN move{t} x ON x.p = b.g JOIN move{t} y ON y.p = b.g + {g}),
effect{u} AS MATERIALIZED (
  SELECT e.unit, e.p, e.u + s.r[2 * {g} + 1] - list_sum([z[1] * z[2] FOR z IN list_zip(s.r[: 2 * {g}], d.ds)]) AS u
  FROM effect{t} e JOIN unit{t} s ON s.unit = e.unit AND s.p = e.p CROSS JOIN (SELECT list(r[1] ORDER BY p) AS ds FROM move{t}) d)"""
    for t in range(steps):
        names = {"t": t, "u": t + 1, "g": g, "q": q, "own": own}
        parts += [text.format(**names) for text in (sums, full, rows)]
        parts.append(gauss_jordan(f"unit{t}", f"rows{t}", q, "unit"))
        parts.append(schur.format(**names))
        parts.append(gauss_jordan(f"move{t}", f"fixed{t}", 2 * g))
        parts.append(step.format(**names))
    parts.append(sums.format(t=steps, own=own))
    parts.append(f"""last AS (SELECT * FROM beta{steps}),
effect AS (SELECT * FROM effect{steps}),
solved AS (SELECT p, r[2:] AS r FROM move{steps - 1}),
fit AS (SELECT * FROM sums{steps})""")
    return ",\n".join(parts)


def joint_levels_sql(prefix: str, g: int) -> str:
    """Estimates and covariances of all level pairs on the original score scale."""
    return f"""WITH RECURSIVE {prefix}
SELECT x.level, y.level AS other, {r('e.a - e.c * 50 / 30.0', 'a', 9)}, {r('e.c / 30.0', 'c', 9)},
  {r(f'i.r[y.g] - 50 / 30.0 * (i.r[y.g + {g}] + s.r[y.g]) + 2500 / 900.0 * s.r[y.g + {g}]', 'v_aa', 9)},
  {r(f'(i.r[y.g + {g}] - 50 / 30.0 * s.r[y.g + {g}]) / 30', 'v_ac', 9)}, {r(f'(s.r[y.g] - 50 / 30.0 * s.r[y.g + {g}]) / 30', 'v_ca', 9)},
  {r(f's.r[y.g + {g}] / 900', 'v_cc', 9)}
FROM names x CROSS JOIN names y JOIN last e ON e.g = x.g JOIN solved i ON i.p = x.g JOIN solved s ON s.p = x.g + {g}"""


YEARS = [str(year) for year in range(1995, 2002)]
VARIED = ADM.replace("CAST(l_returnflag = 'R' AS INT)", "CAST(l_returnflag = 'R' OR l_linenumber > 2 + l_suppkey % 5 AS INT)")

# Covariance of the effects of three years, and its inverse from the adjugate.
GIVEN_COVARIANCE = [[0.30, 0.12, 0.05], [0.12, 0.40, 0.10], [0.05, 0.10, 0.25]]


def inverse3(m: list[list[float]]) -> list[list[float]]:
    minor = lambda i, j: (
        m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    )
    size = sum(m[0][j] * minor(0, j) for j in range(3))
    return [[minor(j, i) / size for j in range(3)] for i in range(3)]


THREE_YEARS = f"{VARIED}, {joint('adm', 'adm_year', ['1999', '2000', '2001'], inverse3(GIVEN_COVARIANCE))}"

# Information of the covariance's entries: half the trace of E P E' P per unit, P the inverse of covariance plus 1 / weights.
COVARIANCE_ROWS = ", ".join(f"({i}, {j}, CAST({x} AS DOUBLE))" for i, row in enumerate(GIVEN_COVARIANCE, 1) for j, x in enumerate(row, 1))
VARCOMP_SQL = f"""WITH RECURSIVE {THREE_YEARS},
sigma AS (SELECT * FROM (VALUES {COVARIANCE_ROWS}) t(p, j, x)),
weights AS (SELECT u.unit, names.g, coalesce(w0, 0) AS w FROM units u CROSS JOIN names LEFT JOIN fit ON fit.unit = u.unit AND fit.g = names.g),
plain AS (
  SELECT unit, g AS p, [CASE WHEN j = g THEN 1 ELSE 0 END + w * xs[j] FOR j IN range(1, 4)] || [CASE WHEN j = g THEN w ELSE 0 END FOR j IN range(1, 4)] AS r
  FROM weights JOIN (SELECT p, list(x ORDER BY j) AS xs FROM sigma GROUP BY p) s ON s.p = g),
{gauss_jordan('prec_of', 'plain', 3, 'unit')},
entry AS MATERIALIZED (SELECT unit, p AS i, unnest(range(1, 4)) AS j, unnest(r) AS x FROM prec_of),
low AS (SELECT * FROM (VALUES (1, 1, 1), (2, 2, 1), (3, 2, 2), (4, 3, 1), (5, 3, 2), (6, 3, 3)) t(place, i, j)),
fisher AS (
  SELECT a.place AS p, b.place AS b, sum(0.5 * power(2, (a.i <> a.j)::INT + (b.i <> b.j)::INT - 1) * (w.x * y.x + z.x * v.x)) AS x
  FROM low a CROSS JOIN low b JOIN entry w ON w.i = a.j AND w.j = b.i JOIN entry y ON y.unit = w.unit AND y.i = a.i AND y.j = b.j
  JOIN entry z ON z.unit = w.unit AND z.i = a.j AND z.j = b.j JOIN entry v ON v.unit = w.unit AND v.i = a.i AND v.j = b.i
  GROUP BY a.place, b.place),
informed AS (SELECT p, list(x ORDER BY b) || [CASE WHEN b = p THEN 1.0 ELSE 0.0 END FOR b IN range(1, 7)] AS r FROM fisher GROUP BY p),
{gauss_jordan('spread_of', 'informed', 6)},
spread AS MATERIALIZED (SELECT p, unnest(range(1, 7)) AS b, unnest(r) AS x FROM spread_of),
change AS (SELECT * FROM (VALUES (1, 1, 1), (2, 1, -1), (2, 2, 1), (3, 1, -1), (3, 3, 1)) t(i, j, x)),
-- changed entry (i, j) as a combination of the entries (k, l) and so of the lower triangle
parts AS (
  SELECT n.place, n.i, n.j, low.place AS p, sum(a.x * b.x) AS x
  FROM low n JOIN change a ON a.i = n.i JOIN change b ON b.i = n.j JOIN low ON low.i = greatest(a.j, b.j) AND low.j = least(a.j, b.j)
  GROUP BY ALL),
changed AS (
  SELECT n.i, n.j, any_value(m.v) AS v, sqrt(sum(n.x * s.x * o.x)) AS e
  FROM parts n JOIN spread s ON s.p = n.p JOIN parts o ON o.place = n.place AND o.p = s.b
  JOIN (SELECT place, sum(parts.x * sigma.x) AS v FROM parts JOIN low USING (place) JOIN low k ON k.place = parts.p
    JOIN sigma ON sigma.p = k.i AND sigma.j = k.j GROUP BY place) m ON m.place = n.place
  GROUP BY n.i, n.j),
terms AS (SELECT g, CASE WHEN g = 1 THEN '(Intercept)' ELSE 'adm_year' || level END AS term FROM names)
SELECT b.term AS var1, CASE WHEN i <> j THEN a.term END AS var2, {r('x.v', 'vcov')},
  {r('CASE WHEN i = j THEN sqrt(x.v) ELSE x.v / sqrt(d.v * f.v) END', 'sdcor')}, {r('x.e', 'std_error')}
FROM changed x JOIN terms a ON a.g = x.i JOIN terms b ON b.g = x.j
JOIN (SELECT i AS di, v FROM changed WHERE i = j) d ON d.di = x.i JOIN (SELECT i AS fi, v FROM changed WHERE i = j) f ON f.fi = x.j"""


def chi_square(x: str, df: str) -> str:
    """Upper tail for even or odd df, by finite sums; a point at zero without degrees of freedom."""
    tail = f"(2 * (0.5 - {half(f'least(sqrt({x}), 12)')}))"
    odd = (
        f"{tail} + sqrt(2 / pi()) * exp(-({x}) / 2) * coalesce(list_sum([power({x}, i - 0.5) * power(2, i) * gamma(i + 1) "
        f"/ gamma(2 * i + 1) FOR i IN range(1, ({df} - 1) // 2 + 1)]), 0)"
    )
    even = f"exp(-({x}) / 2) * list_sum([power(({x}) / 2, i) / gamma(i + 1) FOR i IN range(0, {df} // 2)])"
    return f"CASE WHEN {df} = 0 THEN ({x} <= 0)::INT WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"


# One effect per unit at 0.0001 against one per unit and level at 0.001.
GIVEN_COMPARE_SQL = f"""WITH RECURSIVE {VARIED}, {joint('adm', 'adm_year', YEARS, [[1 / 1e-4]])},
small AS (
  SELECT (SELECT sum(ll) FROM fit) - 0.5 * sum(u * u / 1e-4) - 0.5 * sum(ln(1 + 1e-4 * w)) AS ll
  FROM effect JOIN (SELECT unit, sum(w0) AS w FROM fit GROUP BY unit) USING (unit)),
{independent('adm', 'adm_year', '1000').replace('cell', 'cell2').replace('steps', 'steps2').replace('final', 'final2')},
large AS (SELECT sum(ll) - 0.5 * sum(1000 * b * b) - 0.5 * sum(ln(1 + 0.001 * w0)) AS ll FROM final2),
test AS (SELECT 2 * (large.ll - small.ll) AS x, small.ll AS s, large.ll AS l FROM small, large),
mixed AS (
  SELECT sum(CAST(gamma(7) / gamma(j + 1) / gamma(7 - j) AS DOUBLE) / 64 * ({chi_square('x', '(21 + j)')})) AS p
  FROM test CROSS JOIN range(7) r(j))
SELECT 'm1' AS model, CAST(15 AS INT) AS npar, {r('-2 * s', 'deviance', 4)}, CAST(NULL AS DOUBLE) AS chisq, CAST(NULL AS INT) AS df,
  CAST(NULL AS DOUBLE) AS p_value, CAST(NULL AS DOUBLE) AS p_boundary FROM test
UNION ALL
SELECT 'm3', 42, {r('-2 * l', 'deviance', 4)}, {r('x', 'chisq', 4)}, 27, CASE WHEN x >= 0 THEN {r(chi_square('x', '27'), 'p', 4).removesuffix(' AS p')} END,
  CASE WHEN x >= 0 THEN {r('p', 'p', 4).removesuffix(' AS p')} END FROM test, mixed"""


def one_level(stages: int = 8, shrink: float = 3.5) -> str:
    """Grids of nine variances, each around the best of the one before, then the top of the parabola through three points;
    every candidate has its own Newton steps, with one scalar effect per unit eliminated from two equations."""
    stage = """tried{t} AS MATERIALIZED ({grid}),
steps{t} AS (
  SELECT 0 AS i, v, unit, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS b FROM tried{t}, (SELECT DISTINCT unit FROM cell)
  UNION ALL
  SELECT i + 1, v, unit, a + d0, c + d1, b + (r0 - b / v - w0 * d0 - w1 * d1) / (w0 + 1 / v)
  FROM (
    SELECT *, (a11 * u0 - a01 * u1) / (a00 * a11 - a01 * a01) AS d0, (a00 * u1 - a01 * u0) / (a00 * a11 - a01 * a01) AS d1
    FROM (
      SELECT *, sum(w0 - w0 * w0 / (w0 + 1 / v)) OVER l AS a00, sum(w1 - w0 * w1 / (w0 + 1 / v)) OVER l AS a01,
        sum(w2 - w1 * w1 / (w0 + 1 / v)) OVER l AS a11, sum(r0 - w0 * (r0 - b / v) / (w0 + 1 / v)) OVER l AS u0,
        sum(r1 - w1 * (r0 - b / v) / (w0 + 1 / v)) OVER l AS u1
      FROM (
        SELECT i, v, unit, a, c, b, sum(n * m * (1 - m)) AS w0, sum(n * m * (1 - m) * s) AS w1,
          sum(n * m * (1 - m) * s * s) AS w2, sum(k - n * m) AS r0, sum((k - n * m) * s) AS r1
        FROM (SELECT steps{t}.*, s, n, k, 1 / (1 + exp(-(a + b + c * s))) AS m FROM steps{t} JOIN cell USING (unit) WHERE i < 12)
        GROUP BY i, v, unit, a, c, b)
      WINDOW l AS (PARTITION BY i, v)))),
height{t} AS MATERIALIZED (
  SELECT v, any_value(a) AS a, any_value(c) AS c, sum(ll) - 0.5 * sum(b * b) / v - 0.5 * sum(ln(1 + v * w0)) AS ll
  FROM (
    SELECT v, unit, a, c, b, sum(n * m * (1 - m)) AS w0, sum(k * ln(m) + (n - k) * ln(1 - m)) AS ll
    FROM (SELECT steps{t}.*, n, k, 1 / (1 + exp(-(a + b + c * s))) AS m FROM steps{t} JOIN cell USING (unit) WHERE i = 12)
    GROUP BY v, unit, a, c, b)
  GROUP BY v)"""
    width, parts = 1.3, []
    for t in range(stages):
        middle = "SELECT ln(0.2)" if not t else f"SELECT ln(arg_max(v, ll)) FROM height{t - 1}"
        parts.append(stage.format(t=t, grid=f"SELECT exp(({middle}) + {width!r} * (i - 4)) AS v FROM range(9) g(i)"))
        width /= shrink
    top = f"""SELECT exp(x + {width * shrink!r} * 0.5 * (before - after) / (before - 2 * ll + after)) AS v FROM (
  SELECT ln(v) AS x, ll, lag(ll) OVER (ORDER BY v) AS before, lead(ll) OVER (ORDER BY v) AS after FROM height{stages - 1})
  WHERE before IS NOT NULL AND after IS NOT NULL ORDER BY ll DESC LIMIT 1"""
    parts.append(stage.format(t=stages, grid=top))
    return f"""WITH RECURSIVE {VARIED}, cell AS MATERIALIZED (
  SELECT unit_code AS unit, CAST(saps AS DOUBLE) AS saps, (saps - 50) / 30.0 AS s, CAST(count(*) AS DOUBLE) AS n, CAST(sum(death) AS DOUBLE) AS k
  FROM adm GROUP BY ALL),
{", ".join(parts)}
SELECT method, (SELECT count(*) FROM adm) AS n_obs, (SELECT count(DISTINCT unit) FROM cell) AS n_units, {r('v', 'variance', 4)},
  {r('a - c * 50 / 30.0', 'a', 5)}, {r('c / 30.0', 'c', 6)}, {r('ll', 'log_lik', 4)}
FROM height{stages} CROSS JOIN (VALUES ('search'), ('profile')) t(method)"""


SUBGROUP_PRECISIONS = {"surg": 0.1, "med": 0.25, "ecog0": 0.5, "ecog1": 0.05, "ecog2": 0.2, "infection": 0.4, "mv": 0.8}
PRECISION_OF = "CASE split_part(level, '|', 1) " + " ".join(
    f"WHEN '{name}' THEN 1 / {v}" for name, v in SUBGROUP_PRECISIONS.items()
) + " END"
SUBGROUP_ROWS_OF_UNITS = SUBGROUP_ROWS.replace("AS own_level, ", "AS own_level, unit_code, ")
GIVEN_SUBGROUP_SQL = SUBGROUP_SQL.replace(SUBGROUP_ROWS, SUBGROUP_ROWS_OF_UNITS).replace(
    fixed("sub", "own_level"), f"{independent('sub', 'own_level', PRECISION_OF)}, {LEVEL_INFO}"
)
GIVEN_SEASON_SQL = season_sql(compat=False).replace(
    fixed("phased", "period"), f"{independent('phased', 'period')}, {LEVEL_INFO}"
)

# Records with the residual of the fit, and combinations of level parameters in baseline coding.
RESIDUAL_SQL = f"""WITH RECURSIVE {FIXED_YEARS},
residuals AS (
  SELECT CASE WHEN death = 1 THEN exp(-(a + c * saps) / 2) ELSE -exp((a + c * saps) / 2) END AS x
  FROM adm JOIN last ON last.level = adm.adm_year)
SELECT CAST(p AS DOUBLE) AS probability, {r('CASE p WHEN 0 THEN (SELECT min(x) FROM residuals) WHEN 1 THEN (SELECT max(x) FROM residuals) ELSE qs[CAST(4 * p AS INT)] END', 'quantile')}
FROM (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS qs FROM residuals) CROSS JOIN (VALUES (0), (0.25), (0.5), (0.75), (1)) t(p)"""
CORRELATION_SQL = f"""WITH RECURSIVE {FIXED_YEARS}, size AS (SELECT CAST(max(idx) AS INT) AS g FROM lv),
terms AS (
  SELECT 1 AS idx, '(Intercept)' AS term, level, 1 AS x, 0 AS y FROM lv WHERE idx = 1
  UNION ALL SELECT 2, 'saps', level, 0, 1 FROM lv WHERE idx = 1
  UNION ALL SELECT t.idx + 1, 'adm_year' || t.level, lv.level, CASE WHEN lv.idx = 1 THEN -1 ELSE 1 END, 0
    FROM lv t JOIN lv ON lv.idx IN (1, t.idx) WHERE t.idx > 1
  UNION ALL SELECT t.idx + g, 'saps:adm_year' || t.level, lv.level, 0, CASE WHEN lv.idx = 1 THEN -1 ELSE 1 END
    FROM lv t JOIN lv ON lv.idx IN (1, t.idx) CROSS JOIN size WHERE t.idx > 1),
cov AS (
  SELECT s.idx AS i, s.term AS si, t.idx AS j, t.term AS sj,
    sum(CASE WHEN s.level = t.level THEN s.x * t.x * v_aa + (s.x * t.y + s.y * t.x) * v_ac + s.y * t.y * v_cc ELSE 0 END) AS v
  FROM terms s CROSS JOIN terms t JOIN est ON est.level = s.level GROUP BY ALL)
SELECT CAST(c.i AS INT) AS idx, c.si AS term, CAST(c.j AS INT) AS with_idx, c.sj AS with_term, {r('c.v / sqrt(a.v * b.v)', 'correlation')}
FROM cov c JOIN cov a ON a.i = c.i AND a.j = c.i JOIN cov b ON b.i = c.j AND b.j = c.j WHERE c.j < c.i"""

COUNTS = "count(*) AS n, CAST(sum(death) AS BIGINT) AS k"

BIND_SQL = """SELECT a.o_orderkey, a.o_totalprice, b.d AS adm_date
FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders) a
JOIN (SELECT CAST(o_orderdate AS DATE) AS d, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS pos
  FROM orders) b USING (pos)"""

ORACLES = {
    "read_admissions": f"WITH {ADM} SELECT * FROM adm",
    "csv_admissions": f"WITH {ADM} SELECT * EXCLUDE (l_orderkey, adm_date) FROM adm",
    "cells": f"WITH {ADM} SELECT unit_code AS unit, adm_year AS level, saps, {COUNTS} FROM adm GROUP BY 1, 2, 3",
    "subgroup_cells": f"WITH {ADM} " + " UNION ALL ".join(
        f"SELECT '{name}' AS subgroup, unit_code AS unit, adm_year AS level, saps, {COUNTS} FROM adm WHERE {rule} "
        "GROUP BY 2, 3, 4" for name, rule in SUBGROUP_RULES
    ),
    "freq_adm_type": f"""WITH {ADM} SELECT l.level, count(adm.adm_type) AS n
FROM (VALUES ('eSurgery'), ('Medical'), ('uSurgery')) l(level) LEFT JOIN adm ON adm.adm_type = l.level GROUP BY 1""",
    "used_levels": f"""WITH {ADM} SELECT DISTINCT adm_year AS level,
  CAST(dense_rank() OVER (ORDER BY adm_year) AS INT) AS idx FROM adm""",
    "used_units": f"""WITH {ADM} SELECT unit_code AS level, CAST(row_number() OVER (ORDER BY unit_code) AS INT) AS idx
FROM (SELECT DISTINCT unit_code FROM adm)""",
    "dropped_levels": f"""WITH {ADM}, {phased()}, {PERIOD_LEVELS}
SELECT level, CAST(row_number() OVER (ORDER BY idx) AS INT) AS idx FROM lv""",
    "factor_levels": f"""WITH {ADM} SELECT CASE WHEN adm_year IN ('2000', '2001') THEN adm_year END AS adm_year,
  count(*) AS n FROM adm GROUP BY 1""",
    "attach_dates": f"""WITH {ADM} SELECT CAST(year(o_orderdate) AS INT) AS order_year, adm_year, {COUNTS}
FROM adm LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "bind_position": BIND_SQL,
    "bind_file_position": BIND_SQL,
    "extract": f"""WITH {ADM} SELECT adm_year, {COUNTS}, min(adm_date) AS first_date, max(adm_date) AS last_date,
  CAST(sum(saps) AS BIGINT) AS saps_total FROM adm GROUP BY adm_year""",
    "week_blocks": f"""WITH {ADM} SELECT adm_date, CAST((dayofyear(adm_date) - 1) // 7 + 1 AS INT) AS week, count(*) AS n
FROM adm GROUP BY adm_date""",
    "period": f"WITH {ADM}, {phased()} SELECT period, {COUNTS} FROM phased GROUP BY period",
    "period_gap_closed": f"WITH {ADM}, {phased('pweek >= 25')} SELECT period, {COUNTS} FROM phased GROUP BY period",
    "season_chain": f"""WITH {ADM.replace('l_shipdate AS DATE', 'o_orderdate AS DATE').replace(
        'FROM lineitem', 'FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey')}, {phased()}
SELECT period, {COUNTS} FROM phased GROUP BY period""",
    "period_cells": f"""WITH {ADM}, {phased()} SELECT unit_code AS unit, period, saps, {COUNTS}
FROM phased WHERE period IS NOT NULL GROUP BY 1, 2, 3""",
    "reference_grid": f"""WITH {ADM}, {LEVELS} SELECT level, idx, CAST(s AS INT) AS saps
FROM lv CROSS JOIN {CONTRAST_SCORES} t(s)""",
    "pairs": f"WITH {CLOSED_PAIRS} SELECT saps, level_a, level_b FROM pairs",
    "closed_means": f"WITH {CLOSED} {MEANS_SQL}",
    "closed_contrasts": f"""WITH {CLOSED_PAIRS} SELECT saps, contrast, {r('log_or', 'log_or')}, {r('se_log', 'se_log')},
  {r('exp(log_or)', 'odds_ratio')}, {r('exp(log_or) * se_log', 'se')}, {r('log_or / se_log', 'z_ratio')} FROM pairs""",
    "closed_contrasts_reversed": f"""WITH {CLOSED_PAIRS} SELECT saps, level_b || ' / ' || level_a AS contrast,
  {r('-log_or', 'log_or')}, {r('exp(-log_or)', 'odds_ratio')}, {r('exp(-log_or) * se_log', 'se')} FROM pairs""",
    "bonferroni": f"""WITH {CLOSED_PAIRS} SELECT saps, contrast, {r('log_or / se_log', 'z_ratio')},
  CASE WHEN log_or IS NOT NULL THEN
    {r(f"least(1.0, 2 * (0.5 - {half('abs(log_or / se_log)')}) * family * (family - 1) / 2)", 'x').removesuffix(' AS x')}
  END AS p_value FROM pairs""",
    "tukey": f"""WITH {CLOSED_PAIRS}, {TUKEY} SELECT saps, contrast, {r('log_or / se_log', 'z_ratio')},
  {r('p_value', 'p_value')} FROM pairs JOIN tukey USING (saps, contrast)""",
    "vs_reference": f"""WITH {CLOSED_PAIRS} SELECT saps, contrast, {r('exp(log_or)', 'odds_ratio')}
FROM pairs WHERE level_b = '2001'""",
    "vs_reference_either": f"""WITH {CLOSED_PAIRS} SELECT saps, contrast, {r('exp(log_or)', 'odds_ratio')}
FROM pairs WHERE level_a = '2000' OR level_b = '2000'""",
    "or_table": f"WITH {CLOSED_PAIRS}, {TUKEY} {or_sql('se_log')}",
    "or_table_compat": f"WITH {CLOSED_PAIRS}, {TUKEY} {or_sql('exp(log_or) * se_log')}",
    "or_report": REPORT_SQL,
    "or_report_file": REPORT_SQL,
    "relabel": f"""WITH {CLOSED_PAIRS} SELECT saps, 'Year ' || level_a AS label, {r('exp(log_or)', 'odds_ratio')}
FROM pairs WHERE level_b = '2001'""",
    "fit_fixed_score": SCORE_SQL,
    "fit_mixed_score": SCORE_SQL,
    "given_cov_levels": f"""WITH RECURSIVE {GIVEN}, {LEVEL_INFO}
SELECT level, {r('a', 'a')}, {r('c', 'c')}, {r('v_aa', 'v_aa')}, {r('v_ac', 'v_ac')}, {r('v_cc', 'v_cc')} FROM est""",
    "given_intercept_levels": joint_levels_sql(f"{ADM}, {joint('adm', 'adm_year', YEARS, [[4.0]])}", len(YEARS)),
    "given_additive_levels": BORDERED_SQL,
    "given_cov_subgroup_or": GIVEN_SUBGROUP_SQL,
    "given_cov_season_or": GIVEN_SEASON_SQL,
    "given_varcomp": VARCOMP_SQL,
    "given_covariance_levels": joint_levels_sql(THREE_YEARS, 3),
    "given_compare": GIVEN_COMPARE_SQL,
    "one_level_mixed": one_level(),
    "fit_residuals": RESIDUAL_SQL,
    "fixed_effect_correlation": CORRELATION_SQL,
    "given_cov_unit_effects": f"""WITH RECURSIVE {GIVEN} SELECT unit, level, {r('a + b + 60 * c', 'log_odds')} FROM final""",
    "given_cov_stats": f"""WITH RECURSIVE {GIVEN}
SELECT (SELECT count(*) FROM adm) AS n_obs, count(DISTINCT unit) AS n_units,
  {r('sum(ll) - 0.5 * sum(4 * b * b) - 0.5 * sum(ln(1 + 0.25 * w0))', 'log_lik', 4)} FROM final""",
    "fixed_levels": f"""WITH RECURSIVE {FIXED_YEARS}
SELECT level, {r('a', 'a')}, {r('c', 'c')}, {r('v_aa', 'v_aa')}, {r('v_ac', 'v_ac')}, {r('v_cc', 'v_cc')} FROM est""",
    "fixed_coef": f"""WITH RECURSIVE {FIXED_YEARS}, base AS (SELECT est.* FROM est JOIN lv USING (level) WHERE idx = 1),
size AS (SELECT CAST(max(idx) AS INT) AS g FROM lv),
terms AS (
  SELECT 1 AS idx, '(Intercept)' AS term, a AS estimate, sqrt(v_aa) AS std_error FROM base
  UNION ALL SELECT 2, 'saps', c, sqrt(v_cc) FROM base
  UNION ALL SELECT lv.idx + 1, 'adm_year' || level, e.a - b.a, sqrt(e.v_aa + b.v_aa)
    FROM est e JOIN lv USING (level) CROSS JOIN base b WHERE lv.idx > 1
  UNION ALL SELECT lv.idx + g, 'saps:adm_year' || level, e.c - b.c, sqrt(e.v_cc + b.v_cc)
    FROM est e JOIN lv USING (level) CROSS JOIN base b CROSS JOIN size WHERE lv.idx > 1)
SELECT CAST(idx AS INT) AS idx, term, {r('estimate', 'estimate', 5)}, {r('std_error', 'std_error', 5)},
  {r('estimate / std_error', 'z_value', 5)},
  {r(f"2 * (0.5 - {half('least(abs(estimate / std_error), 12)')})", 'p_value', 5)} FROM terms""",
    "fixed_additive": f"""WITH RECURSIVE {ADM}, {ADDITIVE}
SELECT level, {r('a - c * 50 / 30.0', 'a')}, {r('c / 30.0', 'c')} FROM steps WHERE i = 12""",
    "fixed_stats": f"""WITH RECURSIVE {FIXED_YEARS},
one AS (
  SELECT CAST(2 * count(*) AS INT) AS npar, (SELECT count(*) FROM adm) AS n_obs,
    (SELECT count(DISTINCT unit_code) FROM adm) AS n_units, sum(ll) AS ll FROM est)
SELECT npar, n_obs, n_units, {r('ll', 'log_lik', 3)}, {r('-2 * ll', 'deviance', 3)}, {r('-2 * ll + 2 * npar', 'aic', 3)},
  {r('-2 * ll + ln(n_obs) * npar', 'bic', 3)} FROM one""",
    "fixed_predict_grid": f"""WITH RECURSIVE {FIXED_YEARS}, {at_scores(CURVE_SCORES)}
SELECT {CURVE_SQL}, printf('%.0f%%', 100 / (1 + exp(-eta))) AS predicted_percent FROM means""",
    "fixed_figure_grid": f"""WITH RECURSIVE {FIXED_YEARS}, {at_scores(CURVE_SCORES)}
SELECT {CURVE_SQL} FROM means WHERE level IN ('1995', '1999', '2000', '2001')""",
    "fixed_marginal_means": f"WITH RECURSIVE {FIXED_YEARS}, {at_scores(CONTRAST_SCORES)} {MEANS_SQL}",
    "fixed_year_or": f"""WITH RECURSIVE {FIXED_YEARS}, {at_scores(CONTRAST_SCORES)}, {PAIRS}, {TUKEY}
{or_sql('se_log')}""",
    "fixed_subgroup_or": SUBGROUP_SQL,
    "fixed_compare": COMPARE_SQL,
    "fixed_additive_or": ADDITIVE_OR_SQL,
    "fixed_season_or": season_sql(compat=False),
    "fixed_season_or_compat": season_sql(compat=True),
}
