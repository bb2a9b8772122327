"""Registered queries of the tax family: stays, residency, estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tax as T
from .adapters import read
from .registry import Registry

R = Registry()

#: Parameters of a tax year, as amounts (the values are examples; a real table has a row for each year).
VALUES = {
    "residency_days": 183, "nr_threshold": 44250.0, "nr_rate_low": 0.06, "nr_rate": 0.18, "foreign_employer_rate": 0.18, "talent_threshold": 3000000.0, "salary_deduction": 218000.0,
    "exemption": 97000.0, "exemption_minor": 97000.0, "exemption_70": 145500.0, "standard_single": 131000.0, "standard_married": 262000.0, "basic_living": 210000.0, "rent_cap": 180000.0,
    "overseas_threshold": 1000000.0, "amt_exemption": 7500000.0, "amt_rate": 0.2,
}
BRACKETS = [(590000.0, 0.05, 0.0), (1330000.0, 0.12, 29500.0), (2660000.0, 0.2, 118300.0), (4980000.0, 0.3, 384300.0), (None, 0.4, 1080300.0)]
YEARS = (1999, 2000)


def params(spark):
    row = ", ".join(f"cast({v} as {'int' if isinstance(v, int) else 'double'}) AS {k}" for k, v in VALUES.items())
    b = F.array(*[F.struct(F.lit(u).cast("double").alias("up_to"), F.lit(r).alias("rate"), F.lit(x).alias("base")) for u, r, x in BRACKETS])
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("year"))
    return rows.selectExpr("year", *row.split(", ")).withColumn("brackets", b)


PEOPLE = """SELECT c_custkey AS person, cast(1999 + c_custkey % 2 as int) AS year, cast((c_custkey * 37) % 400 as int) AS days, cast((c_custkey * 7919) % 6000000 as double) AS salary, cast(c_custkey % 14 as int) AS months,
  CASE WHEN c_custkey % 3 = 0 THEN cast((c_custkey * 131) % 900000 as double) END AS foreign_pay, CASE WHEN c_custkey % 5 = 0 THEN cast((c_custkey * 57) % 300000 as double) END AS other_income, c_custkey % 2 = 0 AS married,
  cast(c_custkey % 4 as int) AS dependents, cast(c_custkey % 3 as int) AS minors, cast(c_custkey % 7 % 2 as int) AS elderly, CASE WHEN c_custkey % 2 = 1 THEN cast((c_custkey * 211) % 250000 as double) END AS rent,
  cast((c_custkey * 97) % 400000 as double) AS itemized, c_custkey % 11 = 0 AS special_talent, CASE WHEN c_custkey % 4 = 0 THEN cast((c_custkey * 104729) % 20000000 as double) END AS overseas_income, c_custkey % 9 = 0 AS leaving FROM {customer}"""

STAYS = """SELECT o_custkey AS person, cast(o_orderdate as date) AS arrive, CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE cast(o_orderdate as date) + cast(o_orderkey % 97 - 2 as int) END AS depart FROM {orders}"""


def people(spark, sf):
    return spark.sql(PEOPLE, customer=read(spark, sf, "customer"))


def stays(spark, sf):
    return spark.sql(STAYS, orders=read(spark, sf, "orders"))


STAY_CTE = f"""st AS ({STAYS.format(orders='orders')}), sp AS (SELECT *, coalesce(depart, DATE '2000-12-31') AS e FROM st), yr AS (SELECT person, arrive, e, unnest(range(year(arrive), greatest(year(e), year(arrive)) + 1)) AS year FROM sp),
ds AS (SELECT person, year::INT AS year, sum(greatest(0, datediff('day', greatest(arrive + 1, make_date(year, 1, 1)), least(e, make_date(year, 12, 31), DATE '2000-06-30')) + 1))::BIGINT AS counted,
  sum(greatest(0, datediff('day', greatest(arrive + 1, make_date(year, 1, 1)), least(e, make_date(year, 12, 31))) + 1))::BIGINT AS projected FROM yr GROUP BY 1, 2)"""


@R.add("j6_a8_days_present", f"WITH {STAY_CTE} SELECT person, year, counted, projected FROM ds")
def j6(spark, sf):
    return T.days_present(stays(spark, sf), "2000-06-30")


LEAP = "CASE WHEN year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0) THEN 366 ELSE 365 END"


@R.add("x1_residency", f"WITH {STAY_CTE}, d AS (SELECT person, year, least({LEAP}, counted)::INT AS days FROM ds) SELECT person, year, days, days >= 183 AS resident, CASE WHEN days <= 90 THEN 'le90' WHEN days >= 183 THEN 'resident' ELSE 'mid' END AS band, greatest(0, 183 - days)::INT AS to_resident FROM d")
def x1(spark, sf):
    rows = T.days_present(stays(spark, sf), "2000-06-30").withColumnRenamed("counted", "days").withColumn("residency_days", F.lit(183))
    return T.residency(rows).select("person", "year", "days", "resident", "band", "to_resident")


def _prog(net):
    low, out = 0.0, []
    for up, rate, base in BRACKETS:
        out.append(f"WHEN {f'{net} <= {up}' if up else 'true'} THEN {{}}".format(f"greatest(0.0::DOUBLE, {base}::DOUBLE + ({net} - {low}::DOUBLE) * {rate}::DOUBLE)"))
        low = up
    return "CASE " + " ".join(out) + " END"


def _rate(net):
    return "CASE " + " ".join(f"WHEN {f'{net} <= {up}' if up else 'true'} THEN {rate}::DOUBLE" for up, rate, _ in BRACKETS) + " END"


@R.add("x2_progressive", f"SELECT o_orderkey AS k, {_prog('(o_totalprice * 12)')} AS tax, {_rate('(o_totalprice * 12)')} AS rate FROM orders")
def x2(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 12).alias("net"), F.lit(1999).alias("year"))
    rows = rows.join(F.broadcast(params(spark).select("year", "brackets")), "year")
    return rows.withColumn("p", T.progressive(F.col("net"), F.col("brackets"))).select("k", "p.tax", "p.rate")


V = {k: f"{v}::DOUBLE" for k, v in VALUES.items()}
EST_CTE = f"""pe AS ({PEOPLE.format(customer='customer')}),
a AS (SELECT person, year, least({LEAP}, days) AS days, coalesce(salary, 0) AS salary, coalesce(foreign_pay, 0) AS foreign_pay, coalesce(other_income, 0) AS other_income, married, dependents, least(minors, dependents) AS minors, elderly, coalesce(rent, 0) AS rent, itemized, special_talent,
  coalesce(overseas_income, 0) AS overseas, leaving, CASE WHEN months = 0 THEN 12 ELSE least(12, months) END AS months, {LEAP} AS yd FROM pe),
b AS (SELECT *, days >= 183 AS resident, CASE WHEN days <= 90 THEN 'le90' WHEN days >= 183 THEN 'resident' ELSE 'mid' END AS band, salary / months <= {V['nr_threshold']} AS nr_low, CASE WHEN leaving THEN least(1.0::DOUBLE, days::DOUBLE / yd) ELSE 1.0::DOUBLE END AS f, salary + foreign_pay AS gs, 1 + married::INT AS adults FROM a),
c AS (SELECT *, CASE WHEN nr_low THEN 0.06::DOUBLE ELSE 0.18::DOUBLE END AS nr_rate, CASE WHEN band = 'le90' THEN 0 ELSE foreign_pay * 0.18::DOUBLE END AS nr_f, CASE WHEN special_talent AND gs > {V['talent_threshold']} THEN (gs - {V['talent_threshold']}) * 0.5::DOUBLE ELSE 0 END AS excluded, adults + dependents + elderly AS persons FROM b),
d AS (SELECT *, least(gs - excluded, {V['salary_deduction']}) AS salary_ded, (gs - excluded) - least(gs - excluded, {V['salary_deduction']}) + other_income AS income, f * ((adults + dependents - minors) * {V['exemption']} + minors * {V['exemption_minor']} + elderly * {V['exemption_70']}) AS ex,
  f * CASE WHEN married THEN {V['standard_married']} ELSE {V['standard_single']} END AS standard, f * persons * {V['basic_living']} AS ble, least(rent, {V['rent_cap']}) AS rw, CASE WHEN special_talent OR overseas < {V['overseas_threshold']} THEN 0 ELSE overseas END AS oc FROM c),
e AS (SELECT *, greatest(standard, itemized) AS general FROM d),
g AS (SELECT *, greatest(0, ble - (ex + general + rw)) AS d1, greatest(0, ble - (ex + general + 0)) AS d0 FROM e),
h AS (SELECT *, greatest(0, income - ex - general - rw - d1) AS n1, greatest(0, income - ex - general - 0 - d0) AS n0 FROM g),
i AS (SELECT *, CASE WHEN rw <= 0 THEN NULL WHEN {_rate('n1')} >= 0.2 THEN 'rate' WHEN n1 + oc > {V['amt_exemption']} THEN 'basic income' END AS lost FROM h),
j AS (SELECT *, CASE WHEN lost IS NULL THEN n1 ELSE n0 END AS net, CASE WHEN lost IS NULL THEN rw ELSE 0 END AS rent_ded, CASE WHEN lost IS NULL THEN d1 ELSE d0 END AS bl_diff FROM i),
k AS (SELECT *, {_prog('net')} AS reg, {_rate('net')} AS rate FROM j),
l AS (SELECT *, CASE WHEN oc > 0 AND net + oc > {V['amt_exemption']} THEN greatest(0, (net + oc - {V['amt_exemption']}) * {V['amt_rate']} - reg) ELSE 0 END AS amt FROM k),
m AS (SELECT *, CASE WHEN resident THEN floor(reg + amt + 0.5)::DOUBLE ELSE salary * nr_rate + nr_f END AS total, CASE WHEN resident THEN gs + other_income + overseas ELSE gs END AS gross FROM l)"""


@R.add("x3_nonresident_withholding", f"WITH {EST_CTE} SELECT person, band, nr_rate AS rate, round(total, 4) AS total FROM m WHERE NOT resident")
def x3(spark, sf):
    return T.estimate(people(spark, sf), params(spark)).filter("not resident").select("person", "band", F.col("nr_rate_used").alias("rate"), F.round("total", 4).alias("total"))


@R.add("x4_x5_resident_tax", f"WITH {EST_CTE} SELECT person, round(ex, 4) AS exemptions, round(general, 4) AS general, rent_ded, lost AS rent_lost, round(bl_diff, 4) AS bl_diff, round(net, 4) AS net, round(reg, 2) AS tax FROM m WHERE resident")
def x4(spark, sf):
    rows = T.estimate(people(spark, sf), params(spark)).filter("resident")
    return rows.select("person", F.round("exemptions", 4).alias("exemptions"), F.round("general", 4).alias("general"), "rent_ded", "rent_lost", F.round("bl_diff", 4).alias("bl_diff"), F.round("net", 4).alias("net"), F.round("reg_tax", 2).alias("tax"))


@R.add("x6_c4_totals", f"WITH {EST_CTE} SELECT person, year, CASE WHEN resident THEN 'progressive' ELSE 'withholding' END AS regime, round(amt, 2) AS amt, round(total, 2) AS total, CASE WHEN resident THEN rate ELSE nr_rate END AS marginal_rate, round(CASE WHEN gross > 0 THEN total / gross ELSE 0 END, 9) AS effective_rate, resident OR (band = 'mid' AND foreign_pay > 0) AS must_file FROM m")
def x6(spark, sf):
    rows = T.estimate(people(spark, sf), params(spark))
    return rows.select("person", "year", "regime", F.round("amt", 2).alias("amt"), F.round("total", 2).alias("total"), "marginal_rate", F.round("effective_rate", 9).alias("effective_rate"), "must_file")


@R.add("x7_line_items", f"""WITH {EST_CTE}, li AS (SELECT person, 'salary' AS label, floor(salary + 0.5)::BIGINT AS amount, 'income' AS kind, NULL AS fact FROM m UNION ALL SELECT person, 'exemptions', floor(0 - ex + 0.5)::BIGINT, 'deduction', 'exemption' FROM m WHERE resident
  UNION ALL SELECT person, 'income tax', floor(reg + 0.5)::BIGINT, 'tax', 'brackets' FROM m WHERE resident UNION ALL SELECT person, 'rent', floor(0 - rent_ded + 0.5)::BIGINT, 'deduction', 'rent_cap' FROM m WHERE resident AND rent_ded > 0
  UNION ALL SELECT person, 'withheld', floor(salary * nr_rate + 0.5)::BIGINT, 'tax', CASE WHEN nr_low THEN 'nr_salary_rate_low' ELSE 'nr_salary_rate' END FROM m WHERE NOT resident
  UNION ALL SELECT person, 'minimum tax', floor(amt + 0.5)::BIGINT, 'tax', 'amt_rate' FROM m WHERE resident AND oc > 0 UNION ALL SELECT person, 'total', floor(total + 0.5)::BIGINT, 'total', NULL FROM m) SELECT * FROM li""")  # fmt: skip
def x7(spark, sf):
    rows = T.lines(T.estimate(people(spark, sf), params(spark)))
    return rows.filter(F.col("label").isin("salary", "exemptions", "income tax", "rent", "withheld", "minimum tax", "total")).select("person", "label", "amount", "kind", "fact")


def _items_sql():
    """Every line item in order, as DuckDB rows of (nth, label, amount, kind, fact)."""
    items = [
        ("true", "salary", "salary", "income", None), ("NOT resident", "withheld", "salary * nr_rate", "tax", "CASE WHEN nr_low THEN 'nr_salary_rate_low' ELSE 'nr_salary_rate' END"), ("foreign_pay > 0", "overseas employer", "foreign_pay", "income", None),
        ("NOT resident AND foreign_pay > 0", "overseas employer's pay taxed", "nr_f", "tax", "CASE WHEN band = 'le90' THEN 'foreign_employer_90' ELSE 'foreign_employer_over_90_rate' END"), ("resident AND excluded > 0", "incentive", "0 - excluded", "deduction", "'special_talent_rule'"),
        ("resident", "salary deduction", "0 - salary_ded", "deduction", "'salary_deduction'"), ("resident AND other_income > 0", "other income", "other_income", "income", None), ("resident", "exemptions", "0 - ex", "deduction", "'exemption'"),
        ("resident", "general deduction", "0 - general", "deduction", "CASE WHEN itemized > standard THEN NULL WHEN married THEN 'standard_married' ELSE 'standard_single' END"), ("resident AND rent_ded > 0", "rent", "0 - rent_ded", "deduction", "'rent_cap'"),
        ("resident AND bl_diff > 0", "basic living difference", "0 - bl_diff", "deduction", "'basic_living'"), ("resident", "net income", "net", "subtotal", None), ("resident", "income tax", "reg", "tax", "'brackets'"), ("resident AND oc > 0", "minimum tax", "amt", "tax", "'amt_rate'"), ("true", "total", "total", "total", None),
    ]
    quote = lambda x: x.replace("'", "''")
    return " UNION ALL ".join(f"SELECT person, year, {i} AS i, '{quote(label)}' AS label, floor({x} + 0.5)::BIGINT AS amount, '{kind}' AS kind, {fact or 'NULL'} AS name FROM m WHERE {when}" for i, (when, label, x, kind, fact) in enumerate(items))


#: Parameters that stand for facts of other names, by year; the last two names that items have are facts themselves.
KEYS = ["exemption", "salary_deduction", "rent_cap", "brackets", "amt_rate", "nr_salary_rate", "standard_single", "basic_living"]


@R.add("x7_line_figures", f"""WITH {EST_CTE}, li AS ({_items_sql()}), ky(n, name) AS (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(KEYS))}),
lf AS (SELECT li.*, coalesce(CASE WHEN year = 2000 OR n % 2 = 0 THEN 'f' || n END, name) AS id FROM li LEFT JOIN ky USING (name))
SELECT person, year, (row_number() OVER (PARTITION BY person ORDER BY lf.i) - 1)::INT AS nth, label, amount, kind, CASE WHEN n_name IS NOT NULL OR id = 'special_talent_rule' THEN id END AS fact, coalesce(n_name, CASE WHEN id = 'special_talent_rule' THEN 'half' END) AS figure,
  CASE WHEN n_name IS NOT NULL THEN CASE WHEN n_nationkey % 3 = 0 THEN 'drifted' ELSE 'verified' END WHEN id = 'special_talent_rule' THEN 'unchecked' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN 'https://s.example/' || n_nationkey END AS source FROM lf LEFT JOIN nation ON id = 'f' || n_nationkey AND n_nationkey < 7""")  # fmt: skip
def x7_figures(spark, sf):
    """Every line item with the fact behind it: a parameter of the year, or a fact named as such."""
    nations = read(spark, sf, "nation")
    known = nations.filter("n_nationkey < 7").selectExpr("concat('f', n_nationkey) AS id", "n_name AS display", "CASE WHEN n_nationkey % 3 = 0 THEN 'drifted' ELSE 'verified' END AS status", "CASE WHEN n_nationkey % 2 = 0 THEN array(concat('https://s.example/', n_nationkey), 'other') ELSE array() END AS sources")
    known = known.unionByName(nations.filter("n_nationkey = 0").selectExpr("'special_talent_rule' AS id", "'half' AS display", "'unchecked' AS status", "cast(NULL as array<string>) AS sources"))
    keys = F.posexplode(F.array(*[F.lit(k) for k in KEYS])).alias("i", "key")
    of_year = spark.createDataFrame([(y,) for y in YEARS], "year int").select("year", keys).filter("year = 2000 or i % 2 = 0").selectExpr("year", "key", "concat('f', i) AS fact")
    items = T.lines(T.estimate(people(spark, sf), params(spark)))
    return T.line_figures(items, of_year, known).select("person", "year", "nth", "label", "amount", "kind", "fact", "figure", "status", "source")


@R.add("x8_effects", f"""WITH {EST_CTE} SELECT person, 'rent' AS input, CASE WHEN NOT resident THEN 'residents only' WHEN lost = 'rate' THEN 'rate of 20% or more' ELSE 'basic income too high' END AS reason FROM m WHERE NOT resident OR lost IS NOT NULL
  UNION ALL SELECT person, 'overseas_income', CASE WHEN NOT resident THEN 'residents only' WHEN special_talent THEN 'left out in incentive years' WHEN oc <= 0 THEN 'under the threshold' ELSE 'less than the regular tax' END FROM m WHERE NOT resident OR (overseas > 0 AND (special_talent OR oc <= 0 OR amt <= 0))
  UNION ALL SELECT person, 'special_talent', CASE WHEN NOT resident THEN 'residents only' ELSE 'salary under the threshold' END FROM m WHERE NOT resident OR (special_talent AND gs <= {V['talent_threshold']})
  UNION ALL SELECT person, 'leaving', CASE WHEN NOT resident THEN 'residents only' ELSE 'a full year' END FROM m WHERE NOT resident OR (leaving AND f >= 1)""")  # fmt: skip
def x8(spark, sf):
    return T.effects(T.estimate(people(spark, sf), params(spark))).select("person", "input", "reason")


@R.add("x9_outlook", f"WITH {STAY_CTE}, d AS (SELECT person, year, least({LEAP}, counted)::INT AS days FROM ds), o AS (SELECT *, greatest(0, 183 - days) AS need, datediff('day', DATE '2000-06-30', make_date(year, 12, 31)) AS free, CASE WHEN days >= 183 THEN 'resident' WHEN year < 2000 THEN 'past' WHEN year > 2000 THEN 'arrive_by' WHEN greatest(0, 183 - days) <= greatest(0, datediff('day', DATE '2000-06-30', make_date(year, 12, 31))) THEN 'reachable' ELSE 'too_late' END AS kind FROM d) SELECT person, year, kind, CASE kind WHEN 'arrive_by' THEN (make_date(year, 12, 31) - 183)::VARCHAR WHEN 'reachable' THEN (DATE '2000-06-30' + need::INT)::VARCHAR END AS \"by\" FROM o")
def x9(spark, sf):
    rows = T.days_present(stays(spark, sf), "2000-06-30").withColumnRenamed("counted", "days").withColumn("residency_days", F.lit(183)).withColumn("ahead", F.lit(0))
    return T.outlook(rows, "2000-06-30").select("person", "year", "kind", F.col("by").cast("string").alias("by"))


@R.add("j8_resolve_params", "WITH p AS (SELECT n_nationkey % 3 AS y, n_name AS key, 'f' || n_nationkey AS fact FROM nation WHERE n_nationkey < 20), y AS (SELECT DISTINCT 1998 + y AS year FROM p WHERE y > 0), w AS (SELECT year, key, fact FROM p, y WHERE p.y = 0 UNION ALL SELECT 1998 + y, key, fact FROM p WHERE y > 0) SELECT year::INT AS year, key, w.fact, c_name AS value FROM w JOIN customer ON w.fact = 'f' || c_custkey")
def j8(spark, sf):
    nations = read(spark, sf, "nation").filter("n_nationkey < 20")
    rows = nations.selectExpr("cast(CASE WHEN n_nationkey % 3 > 0 THEN 1998 + n_nationkey % 3 END as int) AS year", "n_name AS key", "concat('f', n_nationkey) AS fact")
    facts = read(spark, sf, "customer").selectExpr("concat('f', c_custkey) AS id", "c_name AS value")
    return T.resolve_params(rows, facts, 1999)[0]


@R.add("j8_dangling_params", "SELECT CASE WHEN c_custkey % 3 > 0 THEN (1998 + c_custkey % 3)::INT END AS year, c_name AS key, 'f' || c_custkey AS fact FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def j8_dangling(spark, sf):
    rows = read(spark, sf, "customer").selectExpr("cast(CASE WHEN c_custkey % 3 > 0 THEN 1998 + c_custkey % 3 END as int) AS year", "c_name AS key", "concat('f', c_custkey) AS fact")
    facts = read(spark, sf, "supplier").selectExpr("concat('f', s_suppkey) AS id", "s_name AS value")
    return T.resolve_params(rows, facts, 1999)[1]
