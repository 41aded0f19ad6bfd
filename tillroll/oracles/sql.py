"""The same analyses as plain SQL, to check the Spark results against.

Amounts are integer cents (``_c``) until the last step, as on the Spark side, and
ratios use the same half-up integer rule.
"""

from __future__ import annotations

_TABLES = """
WITH line AS (
  SELECT *, (price_c * (40 + product_id % 31) + 50) // 100 AS cost_c,
         (price_c * discount_pct + 50) // 100 AS discount_c,
         (price_c * tax_pct + 50) // 100 AS shipping_c
  FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id,
               l_orderkey || '-' || l_linenumber AS item_id,
               CAST(l_quantity AS INTEGER) AS quantity,
               CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS price_c,
               CAST(ROUND(l_discount * 100) AS BIGINT) AS discount_pct,
               CAST(ROUND(l_tax * 100) AS BIGINT) AS tax_pct
        FROM lineitem)),
ord AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
         CAST(o_orderdate AS DATE) AS day,
         CAST(EXTRACT(year FROM o_orderdate) * 12 + EXTRACT(month FROM o_orderdate) - 1
              AS INTEGER) AS mon,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Returned'
              ELSE 'Cancelled' END AS status,
         o_orderpriority AS payment_method, subtotal_c, discount_c, shipping_c, cost_c,
         n_lines, subtotal_c - discount_c + shipping_c AS total_c,
         subtotal_c - discount_c - cost_c AS profit_c,
         CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
              AS INTEGER) AS seq
  FROM orders
  JOIN (SELECT order_id, CAST(SUM(price_c) AS BIGINT) AS subtotal_c,
               CAST(SUM(discount_c) AS BIGINT) AS discount_c,
               CAST(SUM(shipping_c) AS BIGINT) AS shipping_c,
               CAST(SUM(cost_c) AS BIGINT) AS cost_c, COUNT(*) AS n_lines
        FROM line GROUP BY order_id) s ON s.order_id = o_orderkey),
done AS (SELECT * FROM ord WHERE status = 'Completed'),
cust AS (
  SELECT c_custkey AS customer_id, c_name AS first_name, CAST(NULL AS VARCHAR) AS email,
         first_day AS signup_date, r_name AS region, c_mktsegment AS acquisition_channel
  FROM customer JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN (SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS first_day
             FROM orders GROUP BY o_custkey) f ON o_custkey = c_custkey),
prod AS (
  SELECT *, (unit_price_c * (40 + product_id % 31) + 50) // 100 AS unit_cost_c
  FROM (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
               CAST(ROUND(p_retailprice * 100) AS BIGINT) AS unit_price_c
        FROM part))"""


def _rat(num: str, den: str, scale: int, dp: int) -> str:
    """round(num / den * scale / 10^dp, dp), half-up, NULL where den is 0."""
    n, d = f"CAST(ABS({num}) AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    units = f"(({n} * {2 * scale} + {d}) // ({d} * 2))"
    return (
        f"CASE WHEN {den} <> 0 THEN CAST(CASE WHEN {num} < 0 THEN -{units} "
        f"ELSE {units} END AS DOUBLE) / {10 ** dp}.0 END"
    )


def _pct(num: str, den: str, dp: int) -> str:
    return _rat(num, den, 100 * 10**dp, dp)


def _avg_money(cents: str, n: str) -> str:
    return _rat(cents, n, 1, 2)


def _avg(total: str, n: str, dp: int) -> str:
    return _rat(total, n, 10**dp, dp)


def _money(cents: str) -> str:
    return f"CAST({cents} AS DOUBLE) / 100.0"


def _month(mon: str) -> str:
    return f"STRFTIME(MAKE_DATE({mon} // 12, {mon} % 12 + 1, 1), '%Y-%m')"


def _q(ctes: str, body: str) -> str:
    return _TABLES + (",\n" + ctes.strip() if ctes.strip() else "") + "\n" + body.strip()


def _monthly(columns: str) -> str:
    return _q(
        """m AS (SELECT mon, COUNT(*) AS n, COUNT(DISTINCT customer_id) AS buyers,
              SUM(total_c) AS total, SUM(discount_c) AS disc, SUM(profit_c) AS profit
           FROM done GROUP BY mon)""",
        f"SELECT {columns} FROM m",
    )


_COHORT = """
act AS (SELECT DISTINCT d.customer_id, c.cohort, d.mon - c.cohort AS off
        FROM done d JOIN (SELECT customer_id, MIN(mon) AS cohort FROM done
                          GROUP BY customer_id) c USING (customer_id)),
size AS (SELECT cohort, COUNT(DISTINCT customer_id) AS size FROM act GROUP BY cohort),
ret AS (SELECT cohort, size, off, COUNT(*) AS active
        FROM act JOIN size USING (cohort) GROUP BY cohort, size, off)"""

_RFM = """
raw AS (
  SELECT customer_id, first_name, region, acquisition_channel,
         CAST((SELECT MAX(day) FROM done) - MAX(day) AS BIGINT) AS days,
         COUNT(*) AS orders, SUM(total_c) AS spend, SUM(profit_c) AS profit
  FROM done JOIN cust USING (customer_id)
  GROUP BY customer_id, first_name, region, acquisition_channel),
scored AS (
  SELECT *, CAST(NTILE(5) OVER (ORDER BY days DESC, customer_id) AS INTEGER) AS r,
         CAST(NTILE(5) OVER (ORDER BY orders, customer_id) AS INTEGER) AS f,
         CAST(NTILE(5) OVER (ORDER BY spend, customer_id) AS INTEGER) AS m
  FROM raw)"""


def _ladder(new: str, five: bool = False) -> str:
    middle = "" if five else "WHEN r >= 3 AND f <= 3 AND m >= 3 THEN 'Potential Loyalists'"
    dormant = "" if five else "WHEN r <= 2 AND f <= 2 AND m >= 3 THEN 'High-Value Dormant'"
    return f"""CASE WHEN LEAST(r, f, m) >= 4 THEN 'Champions'
        WHEN LEAST(r, f) >= 3 THEN 'Loyal Customers'
        WHEN r >= 4 AND f <= 2 THEN '{new}' {middle}
        WHEN r <= 2 AND f >= 3 THEN 'At Risk Customers' {dormant}
        ELSE 'Lost / Hibernating' END"""


def _segments(new: str, columns: str, five: bool = False) -> str:
    return _q(
        _RFM
        + f""",
seg AS (SELECT {_ladder(new, five)} AS segment, COUNT(*) AS n, SUM(spend) AS spend,
               SUM(orders) AS orders, SUM(days) AS days
        FROM scored GROUP BY 1)""",
        f"SELECT {columns} FROM seg",
    )


_RUNNING = f"""
SELECT order_id, customer_id, day AS order_date_only, seq AS order_sequence,
       {_money("total_c")} AS total_amount, {_money("run_c")} AS running_cumulative_spend,
       prev AS prev_order_date, CAST(day - prev AS INTEGER) AS days_since_prior_order
FROM (SELECT *, SUM(total_c) OVER w AS run_c, LAG(day) OVER w AS prev FROM done
      WINDOW w AS (PARTITION BY customer_id ORDER BY day, order_id))"""

_FUNNEL = """
top AS (SELECT customer_id, MAX(seq) AS reached FROM done GROUP BY customer_id),
fun AS (SELECT k, COUNT(customer_id) AS n
        FROM UNNEST([1, 2, 3, 4, 5, 6]) AS s(k) LEFT JOIN top ON reached >= k GROUP BY k),
prv AS (SELECT k, n, LAG(n) OVER (ORDER BY k) AS before FROM fun)"""

_GAPS = """
gap AS (SELECT seq, CAST(day - LAG(day) OVER (PARTITION BY customer_id
                                              ORDER BY day, order_id) AS INTEGER) AS days
        FROM done)"""


def _baskets(lines: str) -> str:
    return f"""
item AS (SELECT DISTINCT l.order_id, l.product_id FROM ({lines}) l
         JOIN done USING (order_id)),
single AS (SELECT product_id, COUNT(*) AS n FROM item GROUP BY product_id),
pair AS (SELECT x.product_id AS a, y.product_id AS b, COUNT(*) AS n
         FROM item x JOIN item y ON x.order_id = y.order_id AND x.product_id < y.product_id
         GROUP BY 1, 2),
total AS (SELECT COUNT(*) AS n FROM done)"""


def _basket_pairs(lines: str, products: str, least: int) -> str:
    return _q(
        _baskets(lines)
        + f""",
item_name AS ({products})""",
        f"""
SELECT p.a AS product_a_id, na.product_name AS product_a_name, na.category AS category_a,
       p.b AS product_b_id, nb.product_name AS product_b_name, nb.category AS category_b,
       p.n AS times_bought_together, sa.n AS orders_with_product_a,
       sb.n AS orders_with_product_b, {_pct("p.n", "total.n", 2)} AS basket_support_pct,
       {_pct("p.n", "sa.n", 1)} AS confidence_a_to_b_pct,
       {_pct("p.n", "sb.n", 1)} AS confidence_b_to_a_pct
FROM (SELECT pair.* FROM pair JOIN item_name x ON x.product_id = a JOIN item_name y ON y.product_id = b
      WHERE n >= {least} ORDER BY n DESC, a, b LIMIT 20) p
JOIN single sa ON sa.product_id = p.a JOIN single sb ON sb.product_id = p.b
JOIN item_name na ON na.product_id = p.a JOIN item_name nb ON nb.product_id = p.b, total""",
    )


def _mann_whitney(sample: str) -> str:
    """CTE ``mw`` with u1 from average ranks over ``sample(x, first)``."""
    return f"""
smp AS ({sample}),
rnk AS (SELECT x, first, RANK() OVER (ORDER BY x)
               + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM smp),
mw AS (SELECT COUNT(*) FILTER (first) AS n1, COUNT(*) FILTER (NOT first) AS n2,
              SUM(r) FILTER (first)
              - COUNT(*) FILTER (first) * (COUNT(*) FILTER (first) + 1) / 2.0 AS u1
       FROM rnk)"""


_STEPS = 4000


def _integral(density: str, upper: str) -> str:
    """Simpson's rule for ``density`` (of ``u``) from 0 to ``upper``."""
    return (
        f"(SELECT SUM(({density}) * CASE WHEN i = 0 OR i = {_STEPS} THEN 1 "
        f"WHEN i % 2 = 1 THEN 4 ELSE 2 END) * MAX(h) / 3 "
        f"FROM (SELECT i, {upper} / {_STEPS}.0 AS h, i * ({upper}) / {_STEPS}.0 AS u "
        f"FROM RANGE({_STEPS + 1}) r(i)))"
    )


def _normal_tail(z: str) -> str:
    """P(Z > z)."""
    below = _integral("EXP(-u * u / 2) / SQRT(2 * PI())", f"ABS({z})")
    return f"(CASE WHEN {z} < 0 THEN 0.5 + {below} ELSE 0.5 - {below} END)"


def _z(two_sided: bool) -> str:
    """z of CTE ``mw`` over ``smp``, with tie and continuity correction."""
    u = "GREATEST(u1, n1 * n2 - u1)" if two_sided else "u1"
    return f"""(SELECT ({u} - n1 * n2 / 2.0 - 0.5) / SQRT(n1 * n2 / 12.0 * (n1 + n2 + 1
        - (SELECT SUM(CAST(c AS DOUBLE) * c * c - c)
           FROM (SELECT COUNT(*) AS c FROM smp GROUP BY x))
          / ((n1 + n2) * (n1 + n2 - 1.0)))) FROM mw)"""


def _h1_tables() -> str:
    """CTEs ``stat`` (group sums, Welch t and df) and ``mw``."""

    def half(cond, tag):
        return f"""
        COUNT(*) FILTER ({cond}) AS n{tag}, SUM(total_c) FILTER ({cond}) AS c{tag},
        SUM(profit_c) FILTER ({cond}) AS p{tag},
        CAST(SUM(CAST(total_c AS HUGEINT) * total_c) FILTER ({cond}) AS DOUBLE) / 10000 AS q{tag}"""

    mean = lambda k: f"(CAST(c{k} AS DOUBLE) / 100 / n{k})"
    total = lambda k: f"(CAST(c{k} AS DOUBLE) / 100)"
    err = lambda k: (
        f"((q{k} - {total(k)} * {total(k)} / n{k}) / NULLIF(n{k} - 1, 0) / n{k})"
    )
    return (
        f"""grp AS (SELECT {half("discount_c > 0", 1)}, {half("discount_c <= 0", 2)}
        FROM done),
stat AS (
  SELECT *, (m1 - m2) / SQRT(e1 + e2) AS t,
         (e1 + e2) * (e1 + e2) / (e1 * e1 / NULLIF(n1 - 1, 0)
                                  + e2 * e2 / NULLIF(n2 - 1, 0)) AS df
  FROM (SELECT *, {mean(1)} AS m1, {mean(2)} AS m2, {err(1)} AS e1, {err(2)} AS e2
        FROM grp)), """
        + _mann_whitney("SELECT total_c AS x, discount_c > 0 AS first FROM done")
    )


def _h1() -> str:
    return _q(
        _h1_tables(),
        f"""
SELECT stat.n1 AS discounted_orders, stat.n2 AS full_price_orders,
       {_avg_money("c1", "stat.n1")} AS discounted_aov,
       {_avg_money("c2", "stat.n2")} AS full_price_aov,
       {_pct("p1", "c1", 1)} AS discounted_margin_pct,
       {_pct("p2", "c2", 1)} AS full_price_margin_pct,
       ROUND((m1 - m2) / m2 * 100, 2) AS aov_lift_pct, ROUND(t, 4) AS t_statistic,
       ROUND(df, 4) AS df, u1 AS u_statistic
FROM stat, mw""",
    )


_CONTINGENCY = f"""
tab AS (
  SELECT acquisition_channel AS ch, COUNT(*) FILTER (COALESCE(n, 0) <= 1) AS s,
         COUNT(*) FILTER (n > 1) AS r, COUNT(*) AS t
  FROM cust LEFT JOIN (SELECT customer_id, COUNT(*) AS n FROM done GROUP BY customer_id) x
       USING (customer_id)
  GROUP BY 1),
rate AS (SELECT *, {_pct("r", "t", 2)} AS rr FROM tab)"""


def _h2_tables() -> str:
    expected = lambda c: f"(t * (SUM({c}) OVER ()) / CAST(SUM(t) OVER () AS DOUBLE))"
    cell = lambda c: f"POW({c} - {expected(c)}, 2) / {expected(c)}"
    return (
        _CONTINGENCY
        + f""",
chi AS (SELECT SUM(part) AS chi2, CAST(COUNT(*) - 1 AS INTEGER) AS dof,
               CAST(SUM(t) AS BIGINT) AS n
        FROM (SELECT t, {cell("s")} + {cell("r")} AS part FROM tab))"""
    )


def _h2() -> str:
    return _q(
        _h2_tables(),
        """
SELECT ROUND(chi2, 4) AS chi2, dof, n, ROUND(SQRT(chi2 / n), 4) AS cramers_v,
       ROUND(SQRT(chi2 / (n * (LEAST(dof + 1, 4) - 1))), 4) AS cramers_v_as_published,
       (SELECT ch FROM rate ORDER BY rr DESC, ch LIMIT 1) AS best_channel,
       (SELECT MAX(rr) FROM rate) AS best_rate_pct,
       (SELECT ch FROM rate ORDER BY rr, ch LIMIT 1) AS worst_channel,
       (SELECT MIN(rr) FROM rate) AS worst_rate_pct
FROM chi""",
    )


def _h3_tables() -> str:
    return (
        _mann_whitney(
            """SELECT spend AS x, n_lines > 1 AS first
        FROM done JOIN (SELECT customer_id, SUM(total_c) AS spend FROM done
                        GROUP BY customer_id) s USING (customer_id)
        WHERE seq = 1"""
        )
        + """,
grp AS (SELECT SUM(x) FILTER (first) AS c1, SUM(x) FILTER (NOT first) AS c2 FROM smp)"""
    )


def _h3() -> str:
    return _q(
        _h3_tables(),
        f"""
SELECT n1 AS multi_customers, n2 AS single_customers,
       {_avg_money("c1", "n1")} AS multi_mean_ltv, {_avg_money("c2", "n2")} AS single_mean_ltv,
       ROUND((CAST(c1 AS DOUBLE) / 100 / n1 - CAST(c2 AS DOUBLE) / 100 / n2)
             / (CAST(c2 AS DOUBLE) / 100 / n2) * 100, 2) AS ltv_lift_pct,
       ROUND(u1, 2) AS u_statistic
FROM mw, grp""",
    )


#: Small samples without ties, of n1 and n2 values.
_SMALL = "ties = 0 AND LEAST(n1, n2) BETWEEN 1 AND 8 AND n1 * n2 <= 200000"

#: Subsets of c of the first i ranks with sum s, as far as the small samples in ``test`` go.
_WAYS = """
ways AS (
  SELECT 0 AS i, 0 AS c, 0 AS s, CAST(1 AS HUGEINT) AS w
  UNION ALL
  SELECT i + 1, c + d, s + d * (i + 1), CAST(SUM(w) AS HUGEINT) FROM ways, (VALUES (0), (1)) t(d)
  WHERE i < (SELECT MAX(n1 + n2) FROM test WHERE exact) AND c + d <= 8 GROUP BY ALL)"""

_EXACT_P = """(SELECT CAST(SUM(w) FILTER (s - c * (c + 1) // 2 >= u1) AS DOUBLE) / CAST(SUM(w) AS DOUBLE)
            FROM ways WHERE i = n1 + n2 AND c = LEAST(n1, n2))"""


def _h3_log_p() -> str:
    """ln of the third test's p, from counting all orders if a sample is small."""
    return _q(
        _h3_tables()
        + f""",
test AS (SELECT *, {_z(False)} AS z, {_SMALL} AS exact FROM mw,
         (SELECT SUM(c * c * c - c) AS ties FROM (SELECT COUNT(*) AS c FROM smp GROUP BY x))),
{_WAYS}""",
        f"SELECT CASE WHEN exact THEN LN({_EXACT_P}) ELSE {_log_normal('z')} END AS ln_p FROM test",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


def _h3_by_group() -> str:
    """U by average ranks within each group; p from counting all orders of a small sample,
    else from the normal tail."""
    return _q(
        f"""
smp AS (SELECT region, acquisition_channel, spend AS x, n_lines > 1 AS first
        FROM done JOIN cust USING (customer_id)
        JOIN (SELECT customer_id, SUM(total_c) AS spend FROM done GROUP BY customer_id) s USING (customer_id)
        WHERE seq = 1),
rnk AS (SELECT *, RANK() OVER (PARTITION BY region, acquisition_channel ORDER BY x)
               + (COUNT(*) OVER (PARTITION BY region, acquisition_channel, x) - 1) / 2.0 AS r FROM smp),
tie AS (SELECT region, acquisition_channel, SUM(CAST(c AS DOUBLE) * c * c - c) AS ties
        FROM (SELECT region, acquisition_channel, x, COUNT(*) AS c FROM smp GROUP BY ALL) GROUP BY ALL),
mw AS (
  SELECT region, acquisition_channel, COUNT(*) FILTER (first) AS n1, COUNT(*) FILTER (NOT first) AS n2,
         COALESCE(SUM(r) FILTER (first), 0) - COUNT(*) FILTER (first) * (COUNT(*) FILTER (first) + 1) / 2.0 AS u1
  FROM rnk GROUP BY ALL),
test AS (
  SELECT *, {_SMALL} AS exact,
         (u1 - n1 * n2 / 2.0 - 0.5) / NULLIF(SQRT(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / NULLIF((n1 + n2) * (n1 + n2 - 1.0), 0))), 0) AS z
  FROM mw JOIN tie USING (region, acquisition_channel)),
{_WAYS}""",
        f"""
SELECT region, acquisition_channel, n1 AS multi_customers, n2 AS single_customers,
       CAST(u1 AS DOUBLE) AS u_statistic, exact,
       ROUND(CASE WHEN exact THEN
           {_EXACT_P}
         ELSE {_normal_tail("z")} END, 9) AS p_value
FROM test""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


def _p_values() -> str:
    t_density = """EXP(LGAMMA((df + 1) / 2) - LGAMMA(df / 2)) / SQRT(df * PI())
        * POW(1 + u * u / df, -(df + 1) / 2)"""
    chi_density = "POW(u, dof / 2.0 - 1) * EXP(-u / 2) / (POW(2, dof / 2.0) * GAMMA(dof / 2.0))"
    parts = [
        f"""SELECT 'H1 Welch t' AS test, 1 - 2 * {_integral(t_density, "ABS(t)")} AS p
        FROM ({_q(_h1_tables(), "SELECT t, df FROM stat")})""",
        f"""SELECT 'H1 Mann-Whitney U', LEAST(2 * {_normal_tail("z")}, 1)
        FROM ({_q(_h1_tables(), f"SELECT {_z(True)} AS z")})""",
        f"""SELECT 'H2 chi-square', 1 - {_integral(chi_density, "chi2")}
        FROM ({_q(_h2_tables(), "SELECT chi2, dof FROM chi")})""",
        f"""SELECT 'H3 Mann-Whitney U, greater', {_normal_tail("z")}
        FROM ({_q(_h3_tables(), f"SELECT {_z(False)} AS z")})""",
    ]
    return (
        "SELECT test, ROUND(CASE WHEN ABS(p) < 1e-9 THEN 0.0 ELSE p END, 6) AS p_value\nFROM ("
        + "\nUNION ALL ".join(parts)
        + ")"
    )


_FINE, _REACH = 20_000, 60


def _log_tail(log_density: str, shape: str, scale: str) -> str:
    """ln of a tail: the log density at its start, and Simpson's rule for what is left of
    the density further out, relative to its start. ``shape`` is the log of that ratio at
    ``v`` beyond the start; ``scale`` is about the distance over which it falls."""
    weights = f"CASE WHEN i = 0 OR i = {_FINE} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (
        f"({log_density} + LN((SELECT SUM(EXP({shape}) * {weights}) * MAX(h) / 3 "
        f"FROM (SELECT i, ({scale}) * {_REACH}.0 / {_FINE} AS h, ({scale}) * i * {_REACH}.0 / {_FINE} AS v "
        f"FROM RANGE({_FINE + 1}) r(i)))))"
    )


def _log_normal(z: str) -> str:
    far = _log_tail(f"(-ABS({z}) * ABS({z}) / 2 - LN(SQRT(2 * PI())))", f"-ABS({z}) * v - v * v / 2", f"1 / GREATEST(ABS({z}), 1.0)")
    return f"(CASE WHEN {z} < 0 THEN LN(1 - EXP({far})) ELSE {far} END)"


def _log_student() -> str:
    density = "(LGAMMA((df + 1) / 2) - LGAMMA(df / 2) - LN(SQRT(df * PI())) - (df + 1) / 2 * LN(1 + t * t / df))"
    shape = "-(df + 1) / 2 * LN((1 + POW(ABS(t) + v, 2) / df) / (1 + t * t / df))"
    return f"(LN(2) + {_log_tail(density, shape, '(df + t * t) / ((df + 1) * GREATEST(ABS(t), 1.0))')})"


def _log_chi2() -> str:
    density = "((dof / 2.0 - 1) * LN(chi2) - chi2 / 2 - dof / 2.0 * LN(2) - LGAMMA(dof / 2.0))"
    return _log_tail(density, "(dof / 2.0 - 1) * LN(1 + v / chi2) - v / 2", "2.0")


def _log_ps() -> dict[str, str]:
    """A query with the column ln_p for each of the four tests."""
    return {
        "H1 Welch t": f"SELECT {_log_student()} AS ln_p FROM ({_q(_h1_tables(), 'SELECT t, df FROM stat')})",
        "H1 Mann-Whitney U": f"SELECT LEAST(LN(2) + {_log_normal('z')}, 0) AS ln_p "
        f"FROM ({_q(_h1_tables(), f'SELECT {_z(True)} AS z')})",
        "H2 chi-square": f"SELECT {_log_chi2()} AS ln_p FROM ({_q(_h2_tables(), 'SELECT chi2, dof FROM chi')})",
        "H3 Mann-Whitney U, greater": f"SELECT {_log_normal('z')} AS ln_p "
        f"FROM ({_q(_h3_tables(), f'SELECT {_z(False)} AS z')})",
    }


def _log10_ps() -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{test}' AS test, ROUND(ln_p / LN(10), 8) AS log10_p FROM ({query})"
        for test, query in _log_ps().items()
    )


#: Significant digits of the p values in the registered report.
P_DIGITS = 8


def _report(reports: dict[str, str]) -> str:
    """The three tests as the printed table."""

    def row(hypothesis, test_type, statistic, test, takeaway, query):
        p = f"CAST(printf('%.{P_DIGITS - 1}e', EXP(ln_p)) AS DOUBLE)"
        return f"""
SELECT '{hypothesis}' AS hypothesis, '{test_type}' AS test_type, {statistic} AS statistic, {p} AS p_value,
       CASE WHEN EXP(ln_p) < 0.05 THEN 'Statistically Significant (p < 0.05)'
            ELSE 'Not Statistically Significant (p >= 0.05)' END AS verdict,
       {takeaway} AS business_takeaway
FROM ({query}), ({test})"""

    tests = _log_ps()
    lift = _q(
        _h3_tables(),
        """SELECT (CAST(c1 AS DOUBLE) / 100 / n1 - CAST(c2 AS DOUBLE) / 100 / n2)
               / (CAST(c2 AS DOUBLE) / 100 / n2) * 100 AS lift FROM mw, grp""",
    )
    return "\nUNION ALL ".join(
        [
            row(
                "H1: Promotional Discounts lift AOV", "Welch''s Two-Sample t-test", "t_statistic", tests["H1 Welch t"],
                "printf('Discounted orders average $%.2f vs $%.2f (margin changes from %.1f%% to %.1f%%).', "
                "discounted_aov, full_price_aov, full_price_margin_pct, discounted_margin_pct)",
                reports["h1_discount_effect"],
            ),
            row(
                "H2: Channel affects Repeat Rate", "Chi-Square Test of Independence", "chi2", tests["H2 chi-square"],
                "'Highest repeat rate is ' || best_channel || ' (' || best_rate_pct::VARCHAR || '%), lowest is ' "
                "|| worst_channel || ' (' || worst_rate_pct::VARCHAR || '%).'",
                reports["h2_chi_square"],
            ),
            row(
                "H3: Multi-Item First Order boosts LTV", "Mann-Whitney U Test (One-Tailed)", "u_statistic",
                _h3_log_p(),
                "printf('Customers starting with 2+ items generate $%.2f LTV vs $%.2f (%+.1f%% lift).', "
                "multi_mean_ltv, single_mean_ltv, lift)",
                f"SELECT * FROM ({reports['h3_first_basket_ltv']}), ({lift})",
            ),
        ]
    )


_ORDER_COLUMNS = f"""order_date, day AS order_date_only,
       status AS order_status, payment_method, {_money("subtotal_c")} AS subtotal,
       {_money("o.discount_c")} AS discount_amount, {_money("o.shipping_c")} AS shipping_fee,
       {_money("total_c")} AS total_amount, {_money("o.cost_c")} AS total_cost,
       {_money("profit_c")} AS gross_profit, seq AS order_sequence"""

_ROLLUP = f"SELECT order_id, customer_id, {_ORDER_COLUMNS} FROM ord o"

_PRODUCTS = f"""
SELECT product_id, product_name, category, {_money("unit_price_c")} AS unit_price,
       {_money("unit_cost_c")} AS unit_cost,
       {_pct("unit_price_c - unit_cost_c", "unit_price_c", 2)} AS margin_percentage
FROM prod"""

_PER_CUSTOMER = """
per AS (SELECT customer_id, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(*) AS orders,
               SUM(total_c) AS ltv FROM ord GROUP BY customer_id)"""


def _dq() -> str:
    def check(kind, table, column, count):
        return (
            f"SELECT '{kind}' AS check_type, '{table}' AS table_name, "
            f"'{column}' AS column_name, CAST({count} AS BIGINT) AS violations"
        )

    def dup(src, key):
        return (
            f"(SELECT COUNT(*) FROM (SELECT {key} FROM {src} GROUP BY {key} "
            "HAVING COUNT(*) > 1))"
        )

    def orphan(src, key, parent):
        return (
            f"(SELECT COUNT(*) FROM {src} WHERE {key} IS NOT NULL "
            f"AND {key} NOT IN (SELECT {key} FROM {parent}))"
        )

    src = {"customers": "cust", "products": "prod", "orders": "ord", "order_items": "line"}
    required = {
        "customers": {"customer_id": "customer_id", "signup_date": "signup_date"},
        "products": {
            "product_id": "product_id",
            "product_name": "product_name",
            "category": "category",
            "unit_price": "unit_price_c",
            "unit_cost": "unit_cost_c",
        },
        "orders": {
            "order_id": "order_id",
            "customer_id": "customer_id",
            "order_date": "order_date",
            "order_date_only": "day",
            "order_status": "status",
            "subtotal": "subtotal_c",
            "total_amount": "total_c",
            "total_cost": "cost_c",
            "gross_profit": "profit_c",
        },
        "order_items": {
            "item_id": "item_id",
            "order_id": "order_id",
            "product_id": "product_id",
            "quantity": "quantity",
            "unit_price": "price_c // quantity",
            "unit_cost": "cost_c // quantity",
            "line_subtotal": "price_c",
            "line_cost": "cost_c",
        },
    }
    keys = [
        ("customers", "customer_id"),
        ("products", "product_id"),
        ("orders", "order_id"),
        ("order_items", "item_id"),
    ]
    parts = [check("primary_key", t, k, dup(src[t], k)) for t, k in keys]
    parts += [
        check("foreign_key", t, k, orphan(src[t], k, src[p]))
        for t, k, p in (
            ("orders", "customer_id", "customers"),
            ("order_items", "order_id", "orders"),
            ("order_items", "product_id", "products"),
        )
    ]
    parts += [
        check("not_null", t, name, f"(SELECT COUNT(*) FROM {src[t]} WHERE {expr} IS NULL)")
        for t, columns in required.items()
        for name, expr in columns.items()
    ]
    return _q("", "\nUNION ALL ".join(parts))


def oracle_sql() -> dict[str, str]:
    out = _reports()
    sections = [
        ("kpis", "executive_kpis", "total_orders"),
        ("repeat_rate", "repeat_customer_rate", "repeat_customers"),
        ("monthly_trend", "monthly_trend", "orders"),
        ("category_performance", "category_performance", "units_sold"),
        ("cohort_matrix", "cohort_matrix_dashboard", "active_users"),
        ("rfm_segments", "rfm_dashboard", "customer_count"),
        ("market_basket", "top_pairs_dashboard", "co_orders"),
        ("channels", "channel_distribution", "orders"),
    ]
    out["dashboard_sections"] = "\nUNION ALL ".join(
        f"SELECT '{name}' AS section, CAST(COUNT(*) AS INTEGER) AS n_rows, "
        f"CAST(SUM({measure}) AS BIGINT) AS total FROM ({out[query]})"
        for name, query, measure in sections
    )
    out["test_results_table"] = _report(out)
    out["dashboard_payload"] = _document(out)
    out["dashboard_cells"] = "\nUNION ALL ".join(
        _cells(section, out[query], *how) for section, (query, *how) in _CELLS.items()
    )
    return out


#: section: query, order of its rows, texts, integers, numbers.
_CELLS = {
    "kpis": (
        "executive_kpis", "1", [], ["total_orders", "total_customers"],
        ["total_gmv", "avg_order_value", "total_gross_profit", "gross_margin_pct"],
    ),
    "repeat_rate": (
        "repeat_customer_rate", "1", [], ["repeat_customers", "total_customers"], ["repeat_rate_pct"],
    ),
    "monthly_trend": (
        "monthly_trend", "month", ["month"], ["orders", "active_customers"], ["revenue", "profit", "aov"],
    ),
    "category_performance": (
        "category_performance", "total_sales DESC, category", ["category"],
        ["units_sold", "order_appearances"], ["total_sales", "category_profit"],
    ),
    "cohort_matrix": (
        "cohort_matrix_dashboard", "cohort_month, cohort_index", ["cohort_month"],
        ["cohort_size", "cohort_index", "active_users"], ["retention_pct"],
    ),
    "rfm_segments": (
        "rfm_dashboard", "total_revenue DESC, segment", ["segment"], ["customer_count"],
        ["total_revenue", "avg_spend", "avg_orders", "avg_recency_days"],
    ),
    "market_basket": (
        "top_pairs_dashboard", "co_orders DESC, p1_name, p2_name, p1_cat, p2_cat",
        ["p1_name", "p1_cat", "p2_name", "p2_cat"], ["co_orders"], ["support_pct"],
    ),
    "channels": (
        "channel_distribution", "revenue DESC, acquisition_channel", ["acquisition_channel"],
        ["customers", "orders"], ["revenue", "aov"],
    ),
}


def _cells(section: str, query: str, order: str, texts: list, integers: list, numbers: list) -> str:
    def cell(field, kind):
        number = "CAST(NULL AS DOUBLE)" if kind == "text" else f"CAST({field} AS DOUBLE)"
        text = field if kind == "text" else "CAST(NULL AS VARCHAR)"
        return (
            f"SELECT '{section}' AS section, row_no, '{field}' AS field, '{kind}' AS kind, "
            f"{number} AS number, {text} AS text FROM placed"
        )

    fields = [(f, "text") for f in texts] + [(f, "number") for f in integers + numbers]
    return (
        f"SELECT * FROM (WITH placed AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY {order}) AS INTEGER) AS row_no "
        f"FROM ({query})) " + " UNION ALL ".join(cell(f, k) for f, k in fields) + ")"
    )


#: The fields of a section as they are printed: t text, i integer, m amount, d double.
_PRINTED = {
    "kpis": "total_gmv:m total_orders:i total_customers:i avg_order_value:d total_gross_profit:m gross_margin_pct:d",
    "repeat_rate": "repeat_customers:i total_customers:i repeat_rate_pct:d",
    "monthly_trend": "month:t revenue:m profit:m orders:i active_customers:i aov:d",
    "category_performance": "category:t total_sales:m category_profit:m units_sold:i order_appearances:i",
    "cohort_matrix": "cohort_month:t cohort_size:i cohort_index:i active_users:i retention_pct:d",
    "rfm_segments": "segment:t customer_count:i total_revenue:m avg_spend:d avg_orders:d avg_recency_days:d",
    "market_basket": "p1_name:t p1_cat:t p2_name:t p2_cat:t co_orders:i support_pct:d",
    "channels": "acquisition_channel:t customers:i orders:i revenue:m aov:d",
}


def _document(reports: dict[str, str]) -> str:
    """The indented JSON text of all sections."""
    # From ten million on a double is printed with an exponent.
    digits, whole = "RTRIM(REPLACE({0}::VARCHAR, '.', ''), '0')", "STRPOS({0}::VARCHAR, '.') - 2"
    large = f"SUBSTR({digits}, 1, 1) || '.' || COALESCE(NULLIF(SUBSTR({digits}, 2), ''), '0') || 'E' || ({whole})"
    shown = {
        "t": "to_json({0})::VARCHAR",
        "i": "{0}::VARCHAR",
        "d": f"CASE WHEN {{0}} >= 1e7 THEN {large} ELSE {{0}}::VARCHAR END",
        "m": "printf('%.2f', {0})",
    }
    parts = []
    for section, fields in _PRINTED.items():
        query, order = _CELLS[section][:2]
        pairs = [f.split(":") for f in fields.split()]
        values = " || ',\n' || ".join(
            f"""'    "{name}" : ' || COALESCE({shown[kind].format(name)}, 'null')""" for name, kind in pairs
        )
        row = f"'{{\n' || {values} || '\n  }}'"
        rows = f"SELECT string_agg(entry, ', ' ORDER BY place) FROM (SELECT {row} AS entry, ROW_NUMBER() OVER (ORDER BY {order}) AS place FROM ({reports[query]}))"
        if section in ("kpis", "repeat_rate"):
            parts.append(f"""'  "{section}" : ' || ({rows})""")
        else:
            parts.append(f"""'  "{section}" : [ ' || COALESCE(({rows}) || ' ', '') || ']'""")
    return "SELECT '{\n' || " + " || ',\n' || ".join(parts) + " || '\n}' AS document"


def _reports() -> dict[str, str]:
    churn = _pct("before - n", "before", 2)
    return {
        "customer_order_summary": _q(
            "",
            f"""
SELECT customer_id, region, acquisition_channel, signup_date, MIN(day) AS first_order_date,
       MAX(day) AS last_order_date, COUNT(*) AS total_orders,
       {_money("SUM(total_c)")} AS lifetime_spend,
       {_avg_money("SUM(total_c)", "COUNT(*)")} AS avg_order_value,
       {_money("SUM(profit_c)")} AS lifetime_gross_profit
FROM done JOIN cust USING (customer_id)
GROUP BY customer_id, region, acquisition_channel, signup_date""",
        ),
        "monthly_sales_summary": _monthly(
            f"""{_month("mon")} AS sales_month, n AS total_orders, buyers AS active_customers,
            {_money("total")} AS gross_revenue, {_money("disc")} AS total_discounts,
            {_money("profit")} AS total_gross_profit,
            {_pct("profit", "total", 2)} AS gross_margin_pct,
            {_avg_money("total", "n")} AS avg_order_value"""
        ),
        "monthly_trend": _monthly(
            f"""{_month("mon")} AS month, {_money("total")} AS revenue,
            {_money("profit")} AS profit, n AS orders, buyers AS active_customers,
            {_avg_money("total", "n")} AS aov"""
        ),
        "cohort_retention": _q(
            _COHORT,
            f"""SELECT {_month("cohort")} AS cohort_month, size AS initial_customers,
            off AS month_offset, active AS active_customers,
            {_pct("active", "size", 2)} AS retention_rate_pct FROM ret""",
        ),
        "cohort_matrix_dashboard": _q(
            _COHORT,
            f"""SELECT {_month("cohort")} AS cohort_month, size AS cohort_size,
            off AS cohort_index, active AS active_users,
            {_pct("active", "size", 1)} AS retention_pct FROM ret WHERE off <= 12""",
        ),
        "cohort_retention_pivot": _q(
            _COHORT,
            f"SELECT {_month('cohort')} AS cohort_month, size AS cohort_size, "
            + ", ".join(
                _pct(f"COALESCE(SUM(active) FILTER (off = {k}), 0)", "size", 1)
                + f" AS m{k}_retention_pct"
                for k in range(7)
            )
            + " FROM ret GROUP BY cohort, size",
        ),
        "avg_month1_retention": _q(
            _COHORT,
            f"""SELECT COUNT(*) AS cohorts,
            {_avg("SUM(hundredths)", "COUNT(*) * 100", 2)} AS avg_retention_pct,
            {_pct("SUM(active)", "SUM(size)", 2)} AS pooled_retention_pct
            FROM (SELECT *, CAST(ROUND({_pct("active", "size", 2)} * 100) AS BIGINT)
                  AS hundredths FROM ret WHERE off = 1)""",
        ),
        "rfm_scores": _q(
            _RFM,
            f"""SELECT customer_id, first_name, region, acquisition_channel,
            CAST(days AS DOUBLE) AS recency_days, orders AS frequency_orders,
            {_money("spend")} AS monetary_spend, {_money("profit")} AS total_profit,
            r AS r_score, f AS f_score, m AS m_score,
            CAST(r * 100 + f * 10 + m AS VARCHAR) AS rfm_cell,
            {_ladder("Promising New Customers")} AS customer_segment FROM scored""",
        ),
        "rfm_segment_summary": _segments(
            "Promising New Customers",
            f"""segment AS customer_segment, n AS total_customers,
            {_pct("n", "(SELECT SUM(n) FROM seg)", 2)} AS customer_share_pct,
            {_money("spend")} AS segment_revenue,
            {_pct("spend", "(SELECT SUM(spend) FROM seg)", 2)} AS revenue_share_pct,
            {_avg_money("spend", "n")} AS avg_customer_spend,
            {_avg("orders", "n", 1)} AS avg_order_frequency,
            {_avg("days", "n", 1)} AS avg_recency_days""",
        ),
        "rfm_dashboard": _segments(
            "Promising New",
            f"""segment, n AS customer_count, {_money("spend")} AS total_revenue,
            {_avg_money("spend", "n")} AS avg_spend, {_avg("orders", "n", 1)} AS avg_orders,
            {_avg("days", "n", 0)} AS avg_recency_days""",
        ),
        "rfm_five_segments": _segments(
            "Promising New",
            f"""segment, n AS total_customers, {_money("spend")} AS total_revenue,
            {_avg_money("spend", "n")} AS avg_spend""",
            five=True,
        ),
        "running_spend": _q("", _RUNNING),
        "running_spend_first_rows": _q(
            "", _RUNNING + " ORDER BY customer_id, day, order_id LIMIT 25"
        ),
        "repurchase_funnel": _q(
            _FUNNEL,
            f"""SELECT CAST(k AS INTEGER) AS order_sequence_milestone,
            n AS customers_reached_order,
            {_pct("n", "(SELECT MAX(n) FROM fun)", 2)} AS survival_rate_pct,
            CASE WHEN k = 1 AND n > 0 THEN 0.0 ELSE {churn} END AS marginal_churn_rate_pct
            FROM prv""",
        ),
        "conditional_survival": _q(
            _FUNNEL,
            f"""SELECT CAST(k AS INTEGER) AS order_sequence_milestone,
            n AS customers_reached_order, {_pct("n", "before", 2)} AS conditional_survival_pct
            FROM prv""",
        ),
        "interpurchase_by_transition": _q(
            _GAPS,
            f"""SELECT seq AS order_transition_to, COUNT(*) AS total_transitions,
            {_avg("SUM(days)", "COUNT(*)", 1)} AS avg_days_to_repurchase,
            CAST(MIN(days) AS DOUBLE) AS min_days, CAST(MAX(days) AS DOUBLE) AS max_days
            FROM gap WHERE days IS NOT NULL AND seq <= 5 GROUP BY seq""",
        ),
        "repurchase_median": _q(
            _GAPS,
            """SELECT COUNT(*) AS transitions, CAST(MEDIAN(days) AS DOUBLE) AS median_days
            FROM gap WHERE days IS NOT NULL AND seq = 2""",
        ),
        "repeat_customer_rate": _q(
            "c AS (SELECT customer_id, COUNT(*) AS n FROM done GROUP BY customer_id)",
            f"""SELECT COUNT(*) FILTER (n > 1) AS repeat_customers,
            COUNT(*) AS total_customers,
            {_pct("COUNT(*) FILTER (n > 1)", "COUNT(*)", 1)} AS repeat_rate_pct FROM c""",
        ),
        "market_basket_pairs": _basket_pairs(
            "SELECT order_id, product_id FROM line",
            "SELECT product_id, product_name, category FROM prod",
            2,
        ),
        "market_basket_brand_pairs": _basket_pairs(
            "SELECT l_orderkey AS order_id, p_brand AS product_id "
            "FROM lineitem JOIN part ON p_partkey = l_partkey",
            "SELECT DISTINCT p_brand AS product_id, p_brand AS product_name, "
            "'Brand' AS category FROM part",
            10,
        ),
        "top_pairs_dashboard": _q(
            _baskets("SELECT order_id, product_id FROM line"),
            f"""SELECT x.product_name AS p1_name, x.category AS p1_cat,
            y.product_name AS p2_name, y.category AS p2_cat, p.n AS co_orders,
            {_pct("p.n", "total.n", 2)} AS support_pct
            FROM (SELECT pair.* FROM pair JOIN prod x ON x.product_id = a
                  JOIN prod y ON y.product_id = b ORDER BY n DESC, a, b LIMIT 10) p
            JOIN prod x ON x.product_id = a JOIN prod y ON y.product_id = b, total""",
        ),
        "executive_kpis": _q(
            "",
            f"""SELECT {_money("SUM(total_c)")} AS total_gmv, COUNT(*) AS total_orders,
            COUNT(DISTINCT customer_id) AS total_customers,
            {_avg_money("SUM(total_c)", "COUNT(*)")} AS avg_order_value,
            {_money("SUM(profit_c)")} AS total_gross_profit,
            {_pct("SUM(profit_c)", "SUM(total_c)", 1)} AS gross_margin_pct FROM done""",
        ),
        "category_performance": _q(
            "",
            f"""SELECT category, {_money("SUM(l.price_c)")} AS total_sales,
            {_money("SUM(l.price_c - l.cost_c)")} AS category_profit,
            CAST(SUM(quantity) AS BIGINT) AS units_sold,
            COUNT(DISTINCT order_id) AS order_appearances
            FROM line l JOIN done USING (order_id) JOIN prod USING (product_id)
            GROUP BY category""",
        ),
        "channel_distribution": _q(
            "",
            f"""SELECT acquisition_channel, COUNT(DISTINCT customer_id) AS customers,
            COUNT(*) AS orders, {_money("SUM(total_c)")} AS revenue,
            {_avg_money("SUM(total_c)", "COUNT(*)")} AS aov
            FROM done JOIN cust USING (customer_id) GROUP BY acquisition_channel""",
        ),
        "h1_discount_effect": _h1(),
        "h2_channel_contingency": _q(
            _CONTINGENCY,
            """SELECT ch AS acquisition_channel, s AS single_order, r AS repeat_buyer,
            t AS total, rr AS repeat_rate_pct FROM rate""",
        ),
        "h2_chi_square": _h2(),
        "h3_first_basket_ltv": _h3(),
        "h3_by_customer_group": _h3_by_group(),
        "hypothesis_p_values": _p_values(),
        "hypothesis_log10_p": _log10_ps(),
        "analytics_master": _q(
            "",
            f"""SELECT l.item_id, l.order_id, l.product_id, l.quantity,
            {_money("((l.price_c * 2 + l.quantity) // (l.quantity * 2))")} AS unit_price_x,
            {_money("((l.cost_c * 2 + l.quantity) // (l.quantity * 2))")} AS unit_cost_x,
            {_money("l.price_c")} AS line_subtotal, {_money("l.cost_c")} AS line_cost,
            o.customer_id, {_ORDER_COLUMNS}, first_name, email, signup_date, region,
            acquisition_channel, product_name, category,
            {_money("unit_price_c")} AS unit_price_y, {_money("unit_cost_c")} AS unit_cost_y,
            {_pct("(unit_price_c - unit_cost_c)", "unit_price_c", 2)} AS margin_percentage
            FROM line l JOIN ord o USING (order_id)
            JOIN cust c ON c.customer_id = o.customer_id
            JOIN prod p ON p.product_id = l.product_id""",
        ),
        "order_rollup": _q("", _ROLLUP),
        "order_rollup_by_rate": _q(
            "r AS (SELECT *, (subtotal_c * 5 * (order_id % 4) + 50) // 100 AS cut_c FROM ord)",
            f"""SELECT order_id, {_money("subtotal_c")} AS subtotal, {_money("cut_c")} AS discount_amount,
            {_money("(subtotal_c - cut_c + shipping_c)")} AS total_amount, {_money("cost_c")} AS total_cost,
            {_money("(subtotal_c - cut_c - cost_c)")} AS gross_profit FROM r""",
        ),
        "orders_through_parquet": _q("", _ROLLUP),
        "product_margin": _q("", _PRODUCTS),
        "products_through_csv": _q(
            "", _PRODUCTS.replace("product_id,", "CAST(product_id AS INTEGER) AS product_id,")
        ),
        "category_count": _q(
            "",
            """SELECT COUNT(*) AS products, COUNT(DISTINCT category) AS categories
            FROM prod""",
        ),
        "bi_core_measures": _q(
            "k AS (SELECT SUM(total_c) AS t, SUM(profit_c) AS p, "
            "COUNT(*) FILTER (status = 'Completed') AS n FROM ord)",
            f"""SELECT {_money("t")} AS total_sales, {_money("p")} AS total_gross_profit,
            {_money("p")} / ({_money("t")}) AS gross_margin, n AS total_completed_orders,
            {_money("t")} / n AS average_order_value FROM k""",
        ),
        "bi_core_measures_by_region": _q(
            "k AS (SELECT region, status, SUM(total_c) AS t, SUM(profit_c) AS p, "
            "COUNT(*) FILTER (status = 'Completed') AS n FROM ord JOIN cust USING (customer_id) "
            "GROUP BY ALL)",
            f"""SELECT region, status AS order_status, {_money("t")} AS total_sales,
            {_money("p")} AS total_gross_profit,
            {_money("p")} / ({_money("t")}) AS gross_margin, n AS total_completed_orders,
            CASE WHEN n = 0 THEN 0.0 ELSE {_money("t")} / n END AS average_order_value FROM k""",
        ),
        "bi_prior_year_daily": _q(
            "d AS (SELECT day, SUM(total_c) AS c FROM ord GROUP BY day)",
            f"""SELECT x.day AS date, {_money("x.c")} AS total_sales,
            {_money("y.c")} AS sales_prior_year
            FROM d x LEFT JOIN d y ON y.day = CAST(x.day - INTERVAL 1 YEAR AS DATE)""",
        ),
        "bi_yoy_growth": _q(
            "m AS (SELECT mon, SUM(total_c) AS c FROM ord GROUP BY mon)",
            f"""SELECT {_month("m.mon")} AS month, {_money("m.c")} AS total_sales,
            {_money("y.c")} AS sales_prior_year,
            COALESCE({_money("(m.c - y.c)")} / ({_money("y.c")}), 0.0) AS yoy_sales_growth
            FROM m LEFT JOIN m y ON y.mon = m.mon - 12""",
        ),
        "bi_rolling_30d": _q(
            """d AS (SELECT day, SUM(total_c) AS c FROM ord GROUP BY day),
cal AS (SELECT CAST(UNNEST(GENERATE_SERIES((SELECT MIN(day) FROM d), (SELECT MAX(day) FROM d),
               INTERVAL 1 DAY)) AS DATE) AS date)""",
            f"""SELECT date, {_money("COALESCE(MAX(d.c) FILTER (d.day = date), 0)")}
              AS total_sales, {_money("COALESCE(SUM(d.c), 0)")} AS rolling_sales
            FROM cal LEFT JOIN d ON d.day BETWEEN date - 29 AND date GROUP BY date""",
        ),
        "date_dimension": _q(
            "",
            """SELECT CAST(UNNEST(GENERATE_SERIES((SELECT MIN(day) FROM ord),
            (SELECT MAX(day) FROM ord), INTERVAL 1 DAY)) AS DATE) AS date""",
        ),
        "bi_cohort_measures": _q(
            _PER_CUSTOMER,
            """SELECT order_id, customer_id, day AS order_date_only,
            first_day AS first_order_date,
            CAST(DATE_TRUNC('month', first_day) AS DATE) AS cohort_month,
            CAST(DATEDIFF('month', first_day, day) AS INTEGER) AS cohort_index
            FROM ord JOIN per USING (customer_id)""",
        ),
        "bi_repeat_rate": _q(
            _PER_CUSTOMER,
            """SELECT COUNT(*) FILTER (orders > 1) AS repeat_customers,
            COUNT(*) AS total_customers,
            CAST(COUNT(*) FILTER (orders > 1) AS DOUBLE) / COUNT(*) AS repeat_customer_rate
            FROM per""",
        ),
        "lod_customer_fields": _q(
            _PER_CUSTOMER,
            f"""SELECT order_id, customer_id, day AS order_date_only,
            {_money("total_c")} AS total_amount,
            CAST(DATE_TRUNC('month', first_day) AS DATE) AS cohort_month,
            CAST(DATEDIFF('month', first_day, day) AS INTEGER) AS cohort_index,
            {_money("ltv")} AS customer_ltv, orders AS order_frequency,
            CAST((SELECT MAX(day) FROM ord) - last_day AS INTEGER) AS recency_days
            FROM ord JOIN per USING (customer_id)""",
        ),
        "rfm_threshold_segments": _q(
            _PER_CUSTOMER
            + """,
d AS (SELECT *, CAST((SELECT MAX(day) FROM ord) - last_day AS INTEGER) AS days FROM per)""",
            f"""SELECT customer_id, days AS recency_days, orders AS order_frequency,
            {_money("ltv")} AS customer_ltv,
            CASE WHEN days <= 90 AND orders >= 4 AND ltv >= 50000 THEN 'Champions'
                 WHEN days <= 180 AND orders >= 3 THEN 'Loyal Customers'
                 WHEN days <= 60 AND orders <= 2 THEN 'Promising New'
                 WHEN days > 180 AND orders >= 3 THEN 'At Risk Customers'
                 ELSE 'Lost / Hibernating' END AS rfm_segment
            FROM d""",
        ),
        "dq_keys": _dq(),
        "bi_yoy_growth_by_region": _q(
            "m AS (SELECT region, mon, SUM(total_c) AS c FROM ord JOIN cust USING (customer_id) GROUP BY ALL)",
            f"""SELECT m.region, {_month("m.mon")} AS month, {_money("m.c")} AS total_sales,
            {_money("y.c")} AS sales_prior_year,
            COALESCE({_money("(m.c - y.c)")} / ({_money("y.c")}), 0.0) AS yoy_sales_growth
            FROM m LEFT JOIN m y ON y.mon = m.mon - 12 AND y.region = m.region""",
        ),
        "bi_rolling_30d_by_status": _q(
            """d AS (SELECT region, status, day, SUM(total_c) AS c
                  FROM ord JOIN cust USING (customer_id) GROUP BY ALL),
cal AS (SELECT region, status, CAST(UNNEST(GENERATE_SERIES((SELECT MIN(day) FROM d), (SELECT MAX(day) FROM d),
               INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT region, status FROM d))""",
            f"""SELECT cal.region, cal.status AS order_status, date,
              {_money("COALESCE(MAX(d.c) FILTER (d.day = date), 0)")} AS total_sales,
              {_money("COALESCE(SUM(d.c), 0)")} AS rolling_sales
            FROM cal LEFT JOIN d ON d.region = cal.region AND d.status = cal.status
              AND d.day BETWEEN date - 29 AND date GROUP BY ALL""",
        ),
        "bi_repeat_rate_by_slice": _q(
            "c AS (SELECT acquisition_channel, status, customer_id, COUNT(*) AS n "
            "FROM ord JOIN cust USING (customer_id) GROUP BY ALL)",
            """SELECT acquisition_channel, status AS order_status, COUNT(*) FILTER (n > 1) AS repeat_customers,
            COUNT(*) AS total_customers,
            CAST(COUNT(*) FILTER (n > 1) AS DOUBLE) / COUNT(*) AS repeat_customer_rate FROM c GROUP BY ALL""",
        ),
        "avg_month1_retention_all": _q(
            _COHORT,
            f"""SELECT COUNT(*) AS cohorts, {_avg("SUM(hundredths)", "COUNT(*) * 100", 2)} AS avg_retention_pct,
            {_pct("SUM(back)", "SUM(size)", 2)} AS pooled_retention_pct
            FROM (SELECT *, CAST(ROUND({_pct("back", "size", 2)} * 100) AS BIGINT) AS hundredths
                  FROM (SELECT cohort, size, COALESCE(SUM(active) FILTER (off = 1), 0) AS back FROM ret
                        WHERE cohort < (SELECT MAX(mon) FROM done) GROUP BY ALL))""",
        ),
        "active_customers_rollup": _q(
            "a AS (SELECT region, mon // 12 AS y, mon % 12 + 1 AS m, customer_id "
            "FROM done JOIN cust USING (customer_id))",
            """SELECT CASE GROUPING(region, y, m) WHEN 0 THEN 'region month' WHEN 1 THEN 'region year'
              WHEN 3 THEN 'region' WHEN 4 THEN 'month' WHEN 5 THEN 'year' ELSE 'total' END AS level,
            region, y AS sales_year, CAST(m AS INTEGER) AS sales_month,
            COUNT(DISTINCT customer_id) AS active_customers, COUNT(*) AS orders
            FROM a GROUP BY GROUPING SETS ((region, y, m), (region, y), (region), (y, m), (y), ())""",
        ),
    }
