"""As-filed facts, free cash flow, discounted cash flows and flow reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions.columns import bisect, dcf_value
from almanac.operators.asof import latest

#: Valuation methods by business type, in order, and those that are built on free cash flow.
METHODS = {
    "general": ("dcf", "reverse_dcf"),
    "high_growth": ("reverse_dcf", "dcf"),
    "bank": ("residual_income",),
    "insurance": ("embedded_value",),
    "reit": ("affo_nav",),
    "commodity": ("normalized_cycle",),
}
FCFF_METHODS = ("dcf", "reverse_dcf")
#: The concepts that free cash flow needs, and the tags that carry them in filings.
REQUIRED = ("operating_income", "pretax_income", "income_tax", "depreciation_amortization", "capex")
TAGS = {
    "operating_income": "OperatingIncomeLoss",
    "pretax_income": "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
    "income_tax": "IncomeTaxExpenseBenefit",
    "depreciation_amortization": "DepreciationAmortizationAndAccretionNet",
    "capex": "PaymentsToAcquirePropertyPlantAndEquipment",
    "accounts_receivable_change": "IncreaseDecreaseInAccountsReceivable",
    "inventory_change": "IncreaseDecreaseInInventories",
}
#: Concepts that have no meaning for a business type; a type that is not named has all.
UNSUPPORTED = {
    "bank": ("operating_income", "depreciation_amortization", "capex", "accounts_receivable_change", "inventory_change"),
    "insurance": ("operating_income", "depreciation_amortization", "capex", "accounts_receivable_change", "inventory_change"),
    "reit": ("depreciation_amortization", "inventory_change"),
}
#: Tags of the balance sheet on either side of net debt.
LIQUID_TAGS = {
    "cash_and_equivalents": "CashAndCashEquivalentsAtCarryingValue",
    "short_term_investments": "ShortTermInvestments",
    "marketable_securities_current": "MarketableSecuritiesCurrent",
    "available_for_sale_securities": "AvailableForSaleSecurities",
    "long_term_investments": "LongTermInvestments",
}
DEBT_TAGS = {"long_term_debt": "LongTermDebtNoncurrent", "debt_current": "LongTermDebtCurrent"}


def concept_tags(spark: SparkSession) -> DataFrame:
    """(business_type, tag, concept) of the tags that a business type supports."""
    rows = [(kind, tag, concept) for kind in METHODS for concept, tag in TAGS.items() if concept not in UNSUPPORTED.get(kind, ())]
    return spark.createDataFrame(rows, "business_type string, tag string, concept string")


def balance_tags(spark: SparkSession) -> DataFrame:
    """(tag, concept, side) of the balance sheet; side is 1 for debt and -1 for liquid assets."""
    rows = [(tag, concept, -1) for concept, tag in LIQUID_TAGS.items()] + [(tag, concept, 1) for concept, tag in DEBT_TAGS.items()]
    return spark.createDataFrame(rows, "tag string, concept string, side int")


def known_type(kind: Column) -> Column:
    """A business type with tags of its own, or the general one."""
    return F.when(kind.isin(*METHODS), kind).otherwise("general")


def mapped_facts(facts: DataFrame, companies: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Facts (company_id, metric: a tag, ...) under the concept that the tag stands for in the company's kind of business; other tags go, but those of ``kept`` stay under their own names. A kind that is not known has the tags of a general one."""
    typed = facts.withColumnRenamed("metric", "tag").join(companies.select("company_id", known_type(F.col("business_type")).alias("business_type")), "company_id")
    tags = concept_tags(facts.sparkSession)
    if kept:
        tags = tags.unionByName(facts.sparkSession.createDataFrame([(kind, tag, tag) for kind in METHODS for tag in kept], tags.schema))
    return typed.join(F.broadcast(tags), ["business_type", "tag"]).withColumnRenamed("concept", "metric").drop("tag")  # a fixed table


def pit_facts(filings: DataFrame, cutoff: str) -> DataFrame:
    """Per company, metric, unit and period (with its start, if filings have it) the latest filing at the cutoff that is not before the period's end."""
    known = filings.where((F.col("filed") <= F.lit(cutoff).cast("date")) & (F.col("filed") >= F.col("period_end")))
    start = ["period_start"] if "period_start" in filings.columns else []
    w = Window.partitionBy("company_id", "unit", "metric", *start, "period_end").orderBy(F.col("filed").desc(), F.col("ordinal").asc())
    return known.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fact_violations(facts: DataFrame) -> DataFrame:
    """(rule, company_id, metric, period_end) of facts (company_id, metric, period_end, available_date): ids that are missing or have no namespace, and facts known before their period ends."""
    rules = {
        "company_id": ~F.coalesce(F.col("company_id").contains(":"), F.lit(False)),
        "metric": F.coalesce(F.trim("metric"), F.lit("")) == "",
        "date_missing": F.col("period_end").isNull() | F.col("available_date").isNull(),
        "available_before_period_end": F.col("available_date") < F.col("period_end"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in rules.items()]))
    return facts.select(F.explode(broken).alias("rule"), "company_id", "metric", "period_end")


#: Days of a year and of a quarter, from first to last.
YEAR_DAYS, QUARTER_DAYS = (350, 380), (75, 105)
#: Days before the end of a trailing year's last quarter within which its other quarters end.
TRAILING_DAYS = 290


def in_one_unit(facts: DataFrame) -> DataFrame:
    """Facts by concept (company_id, metric, unit, ...) in one unit per company: that with most required concepts, then most facts; dollars first among equals."""
    required = F.size(F.collect_set(F.when(F.col("metric").isin(*REQUIRED), F.col("metric"))).over(Window.partitionBy("company_id", "unit")))  # of five concepts
    rows = facts.withColumn("_n", required).withColumn("_m", F.count("*").over(Window.partitionBy("company_id", "unit")))
    best = F.max(F.struct("_n", "_m", (F.col("unit") == "USD").alias("dollars"), "unit")).over(Window.partitionBy("company_id"))
    return rows.withColumn("_best", best["unit"]).where(F.col("unit").eqNullSafe(F.col("_best"))).drop("_n", "_m", "_best")


def full_years(facts: DataFrame) -> DataFrame:
    """Facts (company_id, metric, unit, period_start, period_end, available_date, value) of whole years: as filed, or as the sum of four quarters.

    Figures that add up from one start, as of six and nine months, give quarters by their differences; a quarter filed by itself comes first. Four
    quarters within a range of days before a period's end make a trailing year, known when the last of them is. A fact without a start
    is taken for what it says. Interim figures that make no year are left out.
    """
    key = ["company_id", "metric", "unit"]
    facts = facts.repartition("company_id")  # which serves every step by company and more
    days = F.datediff("period_end", "period_start") + 1
    whole = facts.where(F.col("period_start").isNull() | days.between(*YEAR_DAYS)).withColumn("rank", F.lit(0))
    dated = facts.where("period_start is not null")
    w = Window.partitionBy(*key, "period_start").orderBy("period_end")
    before = F.lag(F.struct("value", "period_end", "available_date")).over(w)
    steps = dated.withColumn("_was", before)
    length = F.datediff("period_end", F.coalesce("_was.period_end", F.date_sub("period_start", 1)))
    quarters = steps.withColumn("own", F.col("_was").isNull()).where(length.between(*QUARTER_DAYS))
    quarters = quarters.select(*key, "period_end", F.greatest("available_date", "_was.available_date").alias("available_date"), (F.col("value") - F.coalesce("_was.value", F.lit(0.0))).alias("value"), "own")
    one = quarters.groupBy(*key, "period_end").agg(F.max_by(F.struct("value", "available_date"), F.struct("own", "available_date")).alias("q")).select(*key, "period_end", "q.value", "q.available_date")
    year = Window.partitionBy(*key).orderBy(F.unix_date("period_end")).rangeBetween(-TRAILING_DAYS, 0)
    sums = one.select(*key, "period_end", F.sum("value").over(year).alias("value"), F.max("available_date").over(year).alias("available_date"), F.count("*").over(year).alias("n"))
    trailing = sums.where("n = 4").select(*key, F.lit(None).cast("date").alias("period_start"), "period_end", "available_date", "value", F.lit(1).alias("rank"))
    both = whole.select(*trailing.columns).unionByName(trailing).repartition("company_id")
    kept = both.groupBy(*key, "period_end").agg(F.min_by(F.struct("value", "available_date"), F.struct("rank", F.unix_date("available_date") * -1)).alias("f"))
    return kept.select(*key, "period_end", "f.available_date", "f.value")


def fcff_parts(facts: DataFrame) -> DataFrame:
    """A row per company and period from facts by concept (company_id, metric, period_end, available_date, value): a column per concept.

    The period is known when its last part is; the build-up of receivables and inventory, where reported, is the change of working capital.
    """
    names = [*REQUIRED, "accounts_receivable_change", "inventory_change"]
    wide = facts.groupBy("company_id", "period_end").agg(F.max("available_date").alias("available_date"), *[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    change = F.coalesce("accounts_receivable_change", F.lit(0.0)) + F.coalesce("inventory_change", F.lit(0.0))
    return wide.withColumn("working_capital_change", change).drop("accounts_receivable_change", "inventory_change")


def fcff(wide: DataFrame) -> DataFrame:
    """Tax rate, NOPAT and free cash flow to the firm of rows as of ``fcff_parts``; ``reason`` says why a row has none."""
    dated = {"available_date", "period_end"} <= set(wide.columns)
    early = F.col("available_date") < F.col("period_end") if dated else F.lit(False)
    lacking = F.greatest(*[F.col(c).isNull() for c in REQUIRED])
    reason = F.when(lacking, "missing_metric").when(F.coalesce(early, F.lit(False)), "available_before_period_end").when(F.col("pretax_income") == 0, "no_pretax_income")
    out = wide.withColumn("reason", reason).withColumn("tax_rate", F.when(reason.isNull(), F.try_divide("income_tax", "pretax_income")))
    build = F.coalesce("working_capital_change", F.lit(0.0)) if "working_capital_change" in wide.columns else F.lit(0.0)
    out = out.withColumn("nopat", F.col("operating_income") * (1 - F.col("tax_rate")))
    return out.withColumn("fcff", F.col("nopat") + F.col("depreciation_amortization") - F.col("capex") - build)


def dcf_reason() -> Column:
    """Why inputs (shares, discount, terminal) have no value."""
    return F.when(~F.coalesce(F.col("shares") > 0, F.lit(False)), "shares_not_positive").when(F.col("discount") <= F.col("terminal"), "discount_not_above_growth").when(F.col("discount") <= -1, "discount_too_low")


def dcf(df: DataFrame) -> DataFrame:
    """Value per share of (fcf, growth_rates array, discount, terminal, net_debt, shares), with a ``reason`` where there is none."""
    worth = dcf_value(F.col("fcf"), F.col("growth_rates"), F.col("discount"), F.col("terminal"))
    return df.withColumn("reason", dcf_reason()).withColumn("value_per_share", F.when(F.col("reason").isNull(), (worth - F.col("net_debt")) / F.col("shares")))


def reverse_dcf(df: DataFrame, years: int = 5, low: float = -0.5, high: float = 1.0) -> DataFrame:
    """The constant growth of ``years`` years that a price implies, with a ``reason`` where there is none: bad inputs, a price below zero or outside what the bounds allow."""
    if years <= 0 or low >= high:
        raise ValueError("years must be positive and the bounds in order")

    def per_share(g: Column) -> Column:
        worth = dcf_value(F.col("fcf"), F.array_repeat(g, years), F.col("discount"), F.col("terminal"))
        return (worth - F.col("net_debt")) / F.col("shares")

    bad = dcf_reason()
    price = F.col("price")
    inside = F.when(bad.isNull(), (per_share(F.lit(low)) <= price) & (per_share(F.lit(high)) >= price))
    reason = F.coalesce(bad, F.when(price.isNull() | (price < 0), "bad_price"), F.when(~F.coalesce(inside, F.lit(False)), "price_out_of_range"))
    root = bisect(lambda g: per_share(g) - price, low, high, 60)
    return df.withColumn("reason", reason).withColumn("implied_growth", F.when(F.col("reason").isNull(), root))


def valuation_band(df: DataFrame) -> DataFrame:
    """Whether low, base and high are in order and not negative, and confidence, where there, within [0, 1]; and the margin of safety to the price."""
    ok = (F.col("low") >= 0) & (F.col("low") <= F.col("base")) & (F.col("base") <= F.col("high"))
    if "confidence" in df.columns:
        ok = ok & F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    return df.withColumn("valid", ok).withColumn("margin", F.when(F.col("price") > 0, F.col("base") / F.col("price") - 1))


def method_routing(companies: DataFrame) -> DataFrame:
    """(company_id, place, method) by business type, in order; a company of an unknown type has one row without a method."""
    table = companies.sparkSession.createDataFrame([(k, i, m) for k, v in METHODS.items() for i, m in enumerate(v)], "business_type string, place int, method string")
    return companies.join(F.broadcast(table), "business_type", "left").select("company_id", "place", "method")


def fcff_support(facts: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """(company_id, missing): required concepts that a company lacks, or that its kind of business does not have."""
    have = facts.groupBy("company_id").agg(F.collect_set("metric").alias("have"))  # a company's own concepts
    required = F.array(*map(F.lit, REQUIRED))
    if companies is None:
        return have.select("company_id", F.array_sort(F.array_except(required, "have")).alias("missing"))
    never = F.create_map(*[x for k, v in UNSUPPORTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("business_type")]
    none = F.array().cast("array<string>")
    usable = F.array_except(F.coalesce("have", none), F.coalesce(never, none))
    return companies.join(have, "company_id", "left").select("company_id", F.array_sort(F.array_except(required, usable)).alias("missing"))


def net_debt(facts: DataFrame) -> DataFrame:
    """(company_id, debt, liquid, net_debt, missing) from the balance-sheet tags of facts (company_id, metric: a tag, period_end, available_date, value).

    Each tag counts with its latest version of the company's latest balance date; ``missing`` names the concepts that the filer did not report.
    """
    rows = facts.withColumnRenamed("metric", "tag").join(F.broadcast(balance_tags(facts.sparkSession)), "tag")  # a fixed table
    newest = rows.groupBy("company_id").agg(F.max("period_end").alias("period_end"))
    now = latest(rows.join(newest, ["company_id", "period_end"]), ["company_id", "concept"], "available_date")
    names = F.array(*[F.lit(c) for c in (*LIQUID_TAGS, *DEBT_TAGS)])
    by = now.groupBy("company_id").agg(
        F.coalesce(F.sum(F.when(F.col("side") > 0, F.col("value"))), F.lit(0.0)).alias("debt"),
        F.coalesce(F.sum(F.when(F.col("side") < 0, F.col("value"))), F.lit(0.0)).alias("liquid"),
        F.array_except(names, F.collect_set("concept")).alias("missing"),
    )
    return by.select("company_id", "debt", "liquid", (F.col("debt") - F.col("liquid")).alias("net_debt"), "missing")


def value_companies(filings: DataFrame, companies: DataFrame, cutoff: str, growth: float = 0.03, discount: float = 0.1, terminal: float = 0.02, years: int = 5, spread: float = 0.01) -> DataFrame:
    """One row per company at a date: free cash flow of its last full period, net debt, value per share with a band, implied growth, margin, and why there is none.

    ``filings``: company_id, metric (a tag), unit, period_start (optional), period_end, filed, value, ordinal; ``companies``: company_id, business_type, shares,
    price. Each company is valued in one unit, and cash flows are of whole years, filed or summed from quarters. The band takes the growth ``spread``
    lower and higher.
    """
    from almanac.sources.shared import written

    rows = filings if "period_start" in filings.columns else filings.withColumn("period_start", F.lit(None).cast("date"))
    # Concepts of cash flow, and tags of the balance sheet under their own names. Other tags go before the one shuffle, by company, that all steps by
    # company, unit and concept share, and so is the order in which the last filings are taken.
    sheet = (*LIQUID_TAGS.values(), *DEBT_TAGS.values())
    columns = ["company_id", "metric", "unit", "period_start", "period_end", "filed", "value", "ordinal"]
    near = rows.where(F.col("metric").isin(*TAGS.values(), *sheet)).select(*columns).repartition("company_id")
    known = pit_facts(mapped_facts(near, companies, sheet), cutoff).withColumnRenamed("filed", "available_date").drop("business_type", "ordinal")
    # All that follows reads facts in the unit of the company from one table.
    facts = written(in_one_unit(known), "facts")
    flows = facts.where(F.col("metric").isin(*REQUIRED, "accounts_receivable_change", "inventory_change"))
    parts = fcff(fcff_parts(full_years(flows)))
    last = latest(parts.where("reason is null or reason <> 'missing_metric'"), ["company_id"], "period_end").select("company_id", "period_end", "fcff", F.col("reason").alias("cash_reason"))
    support = fcff_support(flows.select("company_id", "metric"), companies.select("company_id", "business_type"))
    rows = companies.join(last, "company_id", "left").join(net_debt(facts).select("company_id", "net_debt"), "company_id", "left").join(support, "company_id", "left")
    rows = rows.withColumn("net_debt", F.coalesce("net_debt", F.lit(0.0))).withColumn("fcf", F.col("fcff")).withColumn("discount", F.lit(discount)).withColumn("terminal", F.lit(terminal))
    fine = F.col("fcff").isNotNull() & F.col("cash_reason").isNull() & dcf_reason().isNull()

    def per_share(rate: float) -> Column:
        worth = dcf_value(F.col("fcf"), F.array_repeat(F.lit(rate), years), F.col("discount"), F.col("terminal"))
        return F.when(fine, (worth - F.col("net_debt")) / F.col("shares"))

    rows = rows.withColumn("low", per_share(growth - spread)).withColumn("base", per_share(growth)).withColumn("high", per_share(growth + spread))
    rows = reverse_dcf(rows, years).drop("reason")
    unsupported = F.size("missing") > 0
    reason = F.coalesce(F.when(unsupported, F.concat(F.lit("unsupported: "), F.array_join("missing", ","))), F.when(F.col("fcff").isNull(), F.coalesce("cash_reason", F.lit("no_full_period"))), dcf_reason())
    out = valuation_band(rows).withColumn("reason", reason)
    return out.select("company_id", "period_end", "fcff", "net_debt", "low", "base", "high", "valid", "margin", F.when(fine, F.col("implied_growth")).alias("implied_growth"), "reason")


def tidy_facts(facts: DataFrame) -> DataFrame:
    """Facts with the place of each in its company's and metric's history, the newest first."""
    return facts.withColumn("place", F.row_number().over(Window.partitionBy("company_id", "metric").orderBy(F.desc("period_end"), F.desc("available_date"))))


def stock_flow(stocks: DataFrame) -> DataFrame:
    """Flow = change of stock - valuation - other, per holder and date, and what the identity leaves over."""
    w = Window.partitionBy("holder").orderBy("date")
    before = F.lag("stock").over(w)
    out = stocks.withColumn("flow", F.col("stock") - before - F.col("valuation") - F.col("other"))
    return out.withColumn("residual", F.col("stock") - (before + F.col("flow") + F.col("valuation") + F.col("other"))).where("flow is not null")


def aum_flow(aum: DataFrame) -> DataFrame:
    """Flow = assets - previous assets grown by the return; rows with negative assets have none."""
    w = Window.partitionBy("holder").orderBy("date")
    before = F.lag("aum").over(w)
    return aum.withColumn("flow", F.when((F.col("aum") >= 0) & (before >= 0), F.col("aum") - before * (1 + F.col("ret")))).where("flow is not null")


#: How a flow is known.
EVIDENCE = ("observed", "inferred")


def edge_violations(edges: DataFrame) -> DataFrame:
    """(rule, src, dst) of flow edges (src, dst, amount, currency, evidence, confidence, source)."""
    rules = {
        "node_missing": F.col("src").isNull() | F.col("dst").isNull(),
        "same_node": F.col("src") == F.col("dst"),
        "currency_missing": F.coalesce("currency", F.lit("")) == "",
        "source_missing": F.coalesce("source", F.lit("")) == "",
        "evidence": ~F.coalesce(F.col("evidence").isin(*EVIDENCE), F.lit(False)),
        "confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in rules.items()]))
    return edges.select(F.explode(broken).alias("rule"), "src", "dst")


def flow_network(edges: DataFrame) -> DataFrame:
    """(node, inflow, outflow, net) of edges (src, dst, amount) between different nodes; per date, currency and evidence where edges have them."""
    keys = [c for c in ("date", "currency", "evidence") if c in edges.columns]
    good = edges.where("src is not null and dst is not null and src <> dst")
    sides = good.select(*keys, F.explode(F.array(F.struct(F.col("dst").alias("node"), F.col("amount").alias("inflow"), F.lit(0.0).alias("outflow")), F.struct(F.col("src").alias("node"), F.lit(0.0).alias("inflow"), F.col("amount").alias("outflow")))).alias("e"))
    by = sides.select(*keys, "e.*").groupBy("node", *keys).agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    return by.withColumn("net", F.col("inflow") - F.col("outflow"))


def component_violations(components: DataFrame) -> DataFrame:
    """(rule, entity, component) of signal components (entity, component, score, weight, confidence)."""
    score = F.col("score")
    rules = {
        "name_missing": F.coalesce("component", F.lit("")) == "",
        "score": score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")),
        "weight": ~F.coalesce(F.col("weight") >= 0, F.lit(False)),
        "confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in rules.items()]))
    return components.select(F.explode(broken).alias("rule"), "entity", "component")


def combine_signals(components: DataFrame, least: int = 1) -> DataFrame:
    """Mean of scores by weight times confidence over the usable components, per entity; null with fewer than ``least``."""
    w = F.col("weight") * F.col("confidence")
    good = components.where("weight > 0 and confidence > 0 and confidence <= 1 and score is not null and not isnan(score)")
    return good.groupBy("entity").agg(F.when(F.count("*") >= least, F.try_divide(F.sum(F.col("score") * w), F.sum(w))).alias("score"), F.count("*").alias("n"))


def company_violations(companies: DataFrame) -> DataFrame:
    """(rule, id) of companies (company_id, name)."""
    found = F.array_compact(F.array(F.when(~F.coalesce(F.col("company_id").contains(":"), F.lit(False)), F.lit("company_id")), F.when(F.coalesce("name", F.lit("")) == "", F.lit("name"))))
    return companies.select(F.explode(found).alias("rule"), F.col("company_id").alias("id"))


def security_violations(securities: DataFrame) -> DataFrame:
    """(rule, id) of securities (security_id, ticker, exchange, currency)."""
    blank = F.greatest(*[F.coalesce(F.trim(c), F.lit("")) == "" for c in ("ticker", "exchange", "currency")])
    found = F.array_compact(F.array(F.when(~F.coalesce(F.col("security_id").contains(":"), F.lit(False)), F.lit("security_id")), F.when(blank, F.lit("attributes"))))
    return securities.select(F.explode(found).alias("rule"), F.col("security_id").alias("id"))


def entity_join(companies: DataFrame, securities: DataFrame) -> DataFrame:
    """Companies with their securities; companies without one stay."""
    return companies.join(securities, "company_id", "left")
