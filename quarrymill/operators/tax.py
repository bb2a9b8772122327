"""Days, residency and income tax for a population. All amounts come from a parameter row per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import first_of
from .joins import skewed_join, written

BRACKETS = "array<struct<up_to:double,rate:double,base:double>>"


def days_present(stays: DataFrame, as_of: str | None = None) -> DataFrame:
    """(person, year, counted, projected) of stays (person, arrive, depart): days of (arrive, depart] in each year.

    A stay is exploded over its years, so the join on the year is an equi-join. An open stay runs to the end of the year of
    ``as_of`` at the latest, counted up to ``as_of``. Overlapping stays add up; spans that end before they begin are empty.
    """
    limit = F.to_date(F.lit(as_of)) if as_of else F.lit("9999-12-31").cast("date")
    end = F.coalesce("depart", F.make_date(F.year(limit) if as_of else F.year("arrive"), F.lit(12), F.lit(31)))
    rows = stays.filter("arrive is not null").withColumn("_end", end)
    rows = rows.withColumn("year", F.explode(F.sequence(F.year("arrive"), F.greatest(F.year("_end"), F.year("arrive")))))
    first, last = F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))
    low = F.greatest(F.date_add("arrive", 1), first)
    span = lambda high: F.greatest(F.datediff(high, low) + 1, F.lit(0))
    projected = span(F.least("_end", last))
    counted = span(F.least(F.least("_end", last), limit))
    return rows.groupBy("person", "year").agg(F.sum(counted).alias("counted"), F.sum(projected).alias("projected"))


def year_days(year: Column) -> Column:
    return F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))


def residency(rows: DataFrame, days: str = "days") -> DataFrame:
    """``rows`` (days, year, residency_days) with days in the year, resident, band, to_resident."""
    d = F.least(year_days(F.col("year")), F.greatest(F.lit(0), F.floor(F.coalesce(days, F.lit(0))).cast("int")))
    rows = rows.withColumn("days", d).withColumn("resident", F.col("days") >= F.col("residency_days"))
    band = F.when(F.col("days") <= 90, "le90").when(F.col("resident"), "resident").otherwise("mid")
    return rows.withColumn("band", band).withColumn("to_resident", F.greatest(F.lit(0), F.col("residency_days") - F.col("days")))


def progressive(net: Column, brackets: Column) -> Column:
    """struct(tax, rate): the first bracket that holds the net income; its base and the rate on what is above the one before."""
    fits = F.filter(F.transform(brackets, lambda b, i: F.struct(b["up_to"].alias("up_to"), b["rate"].alias("rate"), b["base"].alias("base"), F.coalesce(F.get(brackets, i - 1)["up_to"], F.lit(0.0)).alias("low"))), lambda b: b["up_to"].isNull() | (net <= b["up_to"]))
    b = F.get(fits, F.lit(0))
    return F.struct(F.coalesce(F.greatest(F.lit(0.0), b["base"] + (net - b["low"]) * b["rate"]), F.lit(0.0)).alias("tax"), F.coalesce(b["rate"], F.lit(0.0)).alias("rate"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def _amount(c: str) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))


def _count(c: str) -> Column:
    return F.greatest(F.lit(0), F.floor(F.coalesce(F.col(c), F.lit(0))).cast("int"))


AMOUNTS = ["salary", "foreign_pay", "other_income", "rent", "itemized", "overseas_income"]
COUNTS = ["dependents", "minors", "elderly"]
FLAGS = ["married", "special_talent", "leaving"]


def estimate(people: DataFrame, params: DataFrame) -> DataFrame:
    """``people`` (person, year, days, months and the fields of AMOUNTS, COUNTS, FLAGS, all optional) with the estimate.

    ``params`` has a row a year and is joined by broadcast: it has as many rows as tax years. Columns are staged step by step
    so that generated code stays small.
    """
    for c in [*AMOUNTS, *COUNTS, *FLAGS, "months"]:
        if c not in people.columns:
            people = people.withColumn(c, F.lit(None))
    rows = residency(people.join(F.broadcast(params), "year"))
    rows = rows.select("*").withColumns({c: _amount(c) for c in AMOUNTS} | {c: _count(c) for c in COUNTS} | {c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in FLAGS})
    rows = rows.withColumn("minors", F.least("minors", "dependents")).withColumn("gross_salary", F.col("salary") + F.col("foreign_pay"))
    # non-residents: withheld by the average month; overseas pay by the days
    months = F.when(_count("months") == 0, 12).otherwise(F.least(F.lit(12), _count("months")))
    rows = rows.withColumn("nr_low", F.col("salary") / months <= F.col("nr_threshold"))
    rows = rows.withColumn("nr_rate_used", F.when(F.col("nr_low"), F.col("nr_rate_low")).otherwise(F.col("nr_rate")))
    rows = rows.withColumn("nr_foreign_tax", F.when(F.col("band") == "le90", 0.0).otherwise(F.col("foreign_pay") * F.col("foreign_employer_rate")))
    rows = rows.withColumn("nr_total", F.col("salary") * F.col("nr_rate_used") + F.col("nr_foreign_tax"))
    # residents: incentive, salary deduction, exemptions, general deduction, basic living
    rows = rows.withColumn("f", F.when(F.col("leaving"), F.least(F.lit(1.0), F.col("days") / year_days(F.col("year")))).otherwise(1.0))
    excluded = F.when(F.col("special_talent") & (F.col("gross_salary") > F.col("talent_threshold")), (F.col("gross_salary") - F.col("talent_threshold")) * 0.5).otherwise(0.0)
    rows = rows.withColumn("excluded", excluded).withColumn("taxable_salary", F.col("gross_salary") - F.col("excluded"))
    rows = rows.withColumn("salary_ded", F.least("taxable_salary", "salary_deduction"))
    rows = rows.withColumn("income", F.col("taxable_salary") - F.col("salary_ded") + F.col("other_income"))
    adults = 1 + F.col("married").cast("int")
    rows = rows.withColumn("persons", adults + F.col("dependents") + F.col("elderly"))
    rows = rows.withColumn("exemptions", F.col("f") * ((adults + F.col("dependents") - F.col("minors")) * F.col("exemption") + F.col("minors") * F.col("exemption_minor") + F.col("elderly") * F.col("exemption_70")))
    rows = rows.withColumn("standard", F.col("f") * F.when(F.col("married"), F.col("standard_married")).otherwise(F.col("standard_single")))
    rows = rows.withColumn("general", F.greatest("standard", "itemized")).withColumn("ble", F.col("f") * F.col("persons") * F.col("basic_living"))
    rows = rows.withColumn("rent_wanted", F.least("rent", "rent_cap"))
    counted = F.when(F.col("special_talent") | (F.col("overseas_income") < F.col("overseas_threshold")), 0.0).otherwise(F.col("overseas_income"))
    rows = rows.withColumn("overseas_counted", counted)
    for name, rent in (("with_rent", F.col("rent_wanted")), ("without", F.lit(0.0))):  # the rent rule needs both
        diff = F.greatest(F.lit(0.0), F.col("ble") - (F.col("exemptions") + F.col("general") + rent))
        rows = rows.withColumn(f"diff_{name}", diff)
        rows = rows.withColumn(f"net_{name}", F.greatest(F.lit(0.0), F.col("income") - F.col("exemptions") - F.col("general") - rent - F.col(f"diff_{name}")))
        rows = rows.withColumn(f"p_{name}", progressive(F.col(f"net_{name}"), F.col("brackets")))
    lost = F.when(F.col("rent_wanted") <= 0, F.lit(None).cast("string")).when(F.col("p_with_rent.rate") >= 0.2, F.lit("rate")).when(F.col("net_with_rent") + F.col("overseas_counted") > F.col("amt_exemption"), F.lit("basic income"))
    rows = rows.withColumn("rent_lost", lost)
    use = lambda a, b: F.when(F.col("rent_lost").isNull(), F.col(a)).otherwise(F.col(b))
    rows = rows.withColumns({"rent_ded": F.when(F.col("rent_lost").isNull(), F.col("rent_wanted")).otherwise(0.0), "bl_diff": use("diff_with_rent", "diff_without"), "net": use("net_with_rent", "net_without"), "reg_tax": use("p_with_rent.tax", "p_without.tax"), "top_rate": use("p_with_rent.rate", "p_without.rate")})
    basic = F.when((F.col("overseas_counted") > 0) & (F.col("net") + F.col("overseas_counted") > F.col("amt_exemption")), F.greatest(F.lit(0.0), (F.col("net") + F.col("overseas_counted") - F.col("amt_exemption")) * F.col("amt_rate") - F.col("reg_tax"))).otherwise(0.0)
    rows = rows.withColumn("amt", basic)
    total = F.when(F.col("resident"), half_up(F.col("reg_tax") + F.col("amt")).cast("double")).otherwise(F.col("nr_total"))
    gross = F.when(F.col("resident"), F.col("gross_salary") + F.col("other_income") + F.col("overseas_income")).otherwise(F.col("gross_salary"))
    rows = rows.withColumn("total", total).withColumn("gross", gross)
    return rows.withColumns({
        "regime": F.when(F.col("resident"), "progressive").otherwise("withholding"), "marginal_rate": F.when(F.col("resident"), F.col("top_rate")).otherwise(F.col("nr_rate_used")),
        "effective_rate": F.when(F.col("gross") > 0, F.col("total") / F.col("gross")).otherwise(0.0), "must_file": F.col("resident") | ((F.col("band") == "mid") & (F.col("foreign_pay") > 0)),
    })


def effects(est: DataFrame) -> DataFrame:
    """(person, year, input, reason): inputs that change nothing, and why."""
    r, res = F.col, F.col("resident")
    reasons = [
        ("rent", F.when(~res, "residents only").when(r("rent_lost") == "rate", "rate of 20% or more").when(r("rent_lost") == "basic income", "basic income too high")),
        ("overseas_income", F.when(~res, "residents only").when(r("overseas_income") <= 0, F.lit(None)).when(r("special_talent"), "left out in incentive years").when(r("overseas_counted") <= 0, "under the threshold").when(r("amt") <= 0, "less than the regular tax")),
        ("special_talent", F.when(~res, "residents only").when(r("special_talent") & (r("gross_salary") <= r("talent_threshold")), "salary under the threshold")),
        ("leaving", F.when(~res, "residents only").when(r("leaving") & (r("f") >= 1), "a full year")),
    ]
    pairs = F.array_compact(F.array(*[F.when(w.isNotNull(), F.struct(F.lit(n).alias("input"), w.cast("string").alias("reason"))) for n, w in reasons]))
    return est.select("person", "year", F.inline(pairs))


def lines(est: DataFrame) -> DataFrame:
    """(person, year, nth, label, amount, kind, fact): the line items of residents and non-residents, rounded half up."""
    line = lambda when, label, x, kind, fact=None: F.when(when, F.struct(F.lit(label).alias("label"), half_up(x).alias("amount"), F.lit(kind).alias("kind"), (fact if isinstance(fact, Column) else F.lit(fact).cast("string")).alias("fact")))
    r, n, c = F.col("resident"), ~F.col("resident"), F.col
    zero = F.lit(0.0)
    items = [
        line(F.lit(True), "salary", c("salary"), "income"), line(n, "withheld", c("salary") * c("nr_rate_used"), "tax", F.when(c("nr_low"), "nr_salary_rate_low").otherwise("nr_salary_rate")),
        line(c("foreign_pay") > 0, "overseas employer", c("foreign_pay"), "income"),
        line(n & (c("foreign_pay") > 0), "overseas employer's pay taxed", c("nr_foreign_tax"), "tax", F.when(c("band") == "le90", "foreign_employer_90").otherwise("foreign_employer_over_90_rate")),
        line(r & (c("excluded") > 0), "incentive", zero - c("excluded"), "deduction", "special_talent_rule"), line(r, "salary deduction", zero - c("salary_ded"), "deduction", "salary_deduction"),
        line(r & (c("other_income") > 0), "other income", c("other_income"), "income"), line(r, "exemptions", zero - c("exemptions"), "deduction", "exemption"),
        line(r, "general deduction", zero - c("general"), "deduction", F.when(c("itemized") > c("standard"), F.lit(None).cast("string")).when(c("married"), "standard_married").otherwise("standard_single")),
        line(r & (c("rent_ded") > 0), "rent", zero - c("rent_ded"), "deduction", "rent_cap"), line(r & (c("bl_diff") > 0), "basic living difference", zero - c("bl_diff"), "deduction", "basic_living"),
        line(r, "net income", c("net"), "subtotal"), line(r, "income tax", c("reg_tax"), "tax", "brackets"), line(r & (c("overseas_counted") > 0), "minimum tax", c("amt"), "tax", "amt_rate"),
        line(F.lit(True), "total", c("total"), "total"),
    ]
    return est.select("person", "year", F.posexplode(F.array_compact(F.array(*items))).alias("nth", "l")).select("person", "year", "nth", "l.*")


def line_figures(items: DataFrame, resolved: DataFrame, facts: DataFrame) -> DataFrame:
    """``items`` (of ``lines``) with the fact behind each: fact (its id), figure, status and source, null where an item has none.

    An item names a parameter, which stands for the fact that ``resolved`` (year, key, fact) has for the year; a name that is no
    parameter of the year is a fact's id itself. ``facts`` has id, display, status and sources (in order), of which the first is shown.
    """
    own = resolved.select("year", F.col("key").alias("_name"), F.col("fact").alias("_fact"))
    rows = skewed_join(written(items, "items").withColumnRenamed("fact", "_name"), own, ["year", "_name"], "left").withColumn("_id", F.coalesce("_fact", "_name"))
    known = facts.select(F.col("id").alias("_id"), F.col("id").alias("fact"), F.col("display").alias("figure"), "status", F.get("sources", F.lit(0)).alias("source"))
    return skewed_join(rows, known, "_id", "left").drop("_name", "_fact", "_id")


def outlook(rows: DataFrame, today: str) -> DataFrame:
    """``rows`` (year, days, residency_days, ahead) with kind and by: whether the days for residency can still be had."""
    t = F.to_date(F.lit(today))
    rows = residency(rows)
    free = F.greatest(F.lit(0), F.datediff(F.make_date("year", F.lit(12), F.lit(31)), t) - F.coalesce("ahead", F.lit(0)))
    kind = first_of([(F.col("resident"), F.lit("resident")), (F.col("year") < F.year(t), F.lit("past")), (F.col("year") > F.year(t), F.lit("arrive_by")), (F.col("to_resident") <= free, F.lit("reachable"))], F.lit("too_late"))
    by = F.when(F.col("kind") == "arrive_by", F.date_sub(F.make_date("year", F.lit(12), F.lit(31)), F.col("residency_days").cast("int"))).when(F.col("kind") == "reachable", F.date_add(t, F.col("to_resident").cast("int")))
    return rows.withColumn("kind", kind).withColumn("by", by)


def resolve_params(params: DataFrame, facts: DataFrame, default_year: int) -> tuple[DataFrame, DataFrame]:
    """(year, key, fact, value) of parameter rows (year or null for all years, key, fact) and the rows whose fact isn't there."""
    missing = params.join(facts.select(F.col("id").alias("fact")), "fact", "left_anti")
    years = params.filter("year is not null").select("year").distinct()
    whole = params.filter("year is null").drop("year").join(F.broadcast(years)).unionByName(params.filter("year is not null"))  # years are few
    return whole.join(facts.select(F.col("id").alias("fact"), "value"), "fact").select("year", "key", "fact", "value"), missing
