"""Ratio-set queries: supplier measures in the roles of balance-sheet items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import ratios as R
from tessella.operators.quality import coverage, range_violations
from tessella.plans.base import SUPPLIER_MONTHS, query, r, rounded, supplier_months

# Which supplier measure plays which balance-sheet item.
ROLES = {
    R.ASSETS: "price",
    R.CASH: "tax",
    R.LOANS: "CASE WHEN quantity > 300 THEN price - tax END",
    R.PROVISIONS_LEGAL: "returned",
    R.PROVISIONS_PERSONS: "discount",
    R.DEPOSITS: "price - discount",
    R.LIABILITIES: "price + tax",
    R.EQUITY: "discount",
    R.AUTHORIZED: "quantity",
    R.PROFIT: "tax - discount",
    R.INCOME: "price + discount",
    R.EXPENSES: "discount + tax",
    R.INTEREST_INCOME: "tax",
    R.INTEREST_EXPENSE: "discount",
    R.COMMISSION_INCOME: "returned",
    R.COMMISSION_EXPENSE: "tax",
    R.OPERATING_EXPENSE: "quantity",
    R.FX_GAP: "tax - returned",
}


def statements(spark, d):
    m = supplier_months(spark, d)
    return m.select("entity", "period", *[F.expr(e).alias(c) for c, e in ROLES.items()])


STATEMENTS = f"""{SUPPLIER_MONTHS},
statements AS (SELECT entity, period, {", ".join(f"{e} AS {c}" for c, e in ROLES.items())} FROM supplier_months)"""

CORE_SQL = f"""round({R.EQUITY} / nullif({R.ASSETS}, 0), 6) AS "Capital_Ratio",
  round((coalesce({R.PROVISIONS_LEGAL}, 0) + coalesce({R.PROVISIONS_PERSONS}, 0)) / nullif({R.LOANS}, 0), 6) AS "NPL_Ratio",
  round({R.EXPENSES} / nullif({R.INCOME}, 0), 6) AS "Cost_Income_Ratio", round({R.PROFIT} / nullif({R.ASSETS}, 0), 6) AS "ROA",
  round({R.PROFIT} / nullif({R.EQUITY}, 0), 6) AS "ROE", round({R.CASH} / nullif({R.ASSETS}, 0), 6) AS "Liquid_Assets_Ratio",
  round({R.LOANS} / nullif({R.DEPOSITS}, 0), 6) AS "Loan_Deposit_Ratio", round({R.FX_GAP} / nullif({R.EQUITY}, 0), 6) AS "Net_Open_FX_Ratio" """


def core(spark, d):
    return R.apply_ratios(statements(spark, d), R.CORE_RATIOS).select(
        "entity", "period", *[x.name for x in R.CORE_RATIOS]
    )


@query("core_ratios", f"WITH {STATEMENTS} SELECT entity, period, {CORE_SQL} FROM statements")
def core_ratios(spark, d):
    """B19."""
    return rounded(core(spark, d))


def _q(num: str, den: str, name: str) -> str:
    return f'round(({num}) / nullif({den}, 0), 6) AS "{name}"'


EXTENDED_SQL = ",\n  ".join(
    [
        _q(f"{R.INTEREST_INCOME} - {R.INTEREST_EXPENSE}", R.ASSETS, "Net_Interest_Income_Ratio"),
        _q(R.INTEREST_INCOME, R.ASSETS, "Interest_Income_Ratio"),
        _q(f"{R.INTEREST_INCOME} - {R.INTEREST_EXPENSE}", R.ASSETS, "Net_Interest_Margin"),
        _q(f"{R.COMMISSION_INCOME} - {R.COMMISSION_EXPENSE}", R.ASSETS, "Net_Commission_Income_Ratio"),
        _q(R.COMMISSION_INCOME, R.ASSETS, "Commission_Income_Ratio"),
        _q(R.INCOME, R.ASSETS, "Asset_Turnover"),
        _q(f"{R.INCOME} - {R.INTEREST_INCOME}", R.INCOME, "Income_Diversity_Ratio"),
        _q(R.PROFIT, R.INCOME, "Profit_Margin"),
        _q(R.EQUITY, R.ASSETS, "Total_Equity_Ratio"),
        _q(R.AUTHORIZED, R.ASSETS, "Common_Equity_Ratio"),
        _q(R.ASSETS, R.EQUITY, "Equity_Multiplier"),
        _q(f"coalesce({R.PROVISIONS_LEGAL}, 0) + coalesce({R.PROVISIONS_PERSONS}, 0)", R.ASSETS, "Provisions_Ratio"),
        _q(R.PROVISIONS_LEGAL, R.LOANS, "Loan_Loss_Provision_Ratio"),
        _q(R.LOANS, R.ASSETS, "Loan_Asset_Ratio"),
        _q(R.LOANS, R.DEPOSITS, "Loan_Deposit_Efficiency_Ratio"),
        _q(R.INTEREST_EXPENSE, R.ASSETS, "Interest_Expense_Ratio"),
        _q(R.CASH, R.ASSETS, "Cash_Ratio"),
        _q(R.DEPOSITS, R.LIABILITIES, "Deposit_Ratio"),
        _q(R.CASH, R.DEPOSITS, "Cash_Deposit_Ratio"),
        _q(R.INTEREST_EXPENSE, R.LIABILITIES, "Cost_of_Deposits"),
        _q(R.DEPOSITS, R.ASSETS, "Deposits_Assets_Ratio"),
        _q(f"{R.LIABILITIES} - {R.DEPOSITS}", R.LIABILITIES, "Wholesale_Funding_Ratio"),
        _q(R.OPERATING_EXPENSE, R.ASSETS, "Operating_Expense_Ratio"),
        _q(R.COMMISSION_EXPENSE, R.ASSETS, "Commission_Expense_Ratio"),
        _q(f"{R.INTEREST_EXPENSE} - {R.INTEREST_INCOME}", R.LIABILITIES, "Net_Interest_Expense_Ratio"),
    ]
)


@query("extended_ratios", f"WITH {STATEMENTS} SELECT entity, period, {EXTENDED_SQL} FROM statements")
def extended_ratios(spark, d):
    """B20."""
    out = R.apply_ratios(statements(spark, d), R.EXTENDED_RATIOS)
    return rounded(out.select("entity", "period", *[x.name for x in R.EXTENDED_RATIOS]))


@query(
    "existing_ratio_kept",
    f"""WITH {STATEMENTS} SELECT entity, period, round(quantity_share, 6) AS "ROA" FROM (
  SELECT entity, period, {R.AUTHORIZED} / nullif({R.ASSETS}, 0) AS quantity_share FROM statements)""",
)
def existing_ratio_kept(spark, d):
    """A ratio column that already exists wins over the computed one."""
    s = statements(spark, d).withColumn("ROA", F.try_divide(R.AUTHORIZED, R.ASSETS))
    return rounded(R.apply_ratios(s, R.CORE_RATIOS).select("entity", "period", "ROA"))


@query(
    "ratio_coverage",
    f"""WITH {STATEMENTS}, c AS (SELECT {CORE_SQL} FROM statements)
SELECT 'NPL_Ratio' AS column_name, round(count("NPL_Ratio") / count(*), 6) AS coverage, count("NPL_Ratio") / count(*) >= 0.75 AS sufficient FROM c
UNION ALL SELECT 'ROA', round(count("ROA") / count(*), 6), count("ROA") / count(*) >= 0.75 FROM c""",
)
def ratio_coverage(spark, d):
    """E20."""
    return rounded(coverage(core(spark, d), ["NPL_Ratio", "ROA"]))


@query(
    "ratio_range_violations",
    f"""WITH {STATEMENTS}, c AS (SELECT {R.EQUITY} / nullif({R.ASSETS}, 0) AS cap, {R.PROFIT} / nullif({R.EQUITY}, 0) AS roe FROM statements)
SELECT 'Capital_Ratio' AS column_name, count(*) FILTER (WHERE cap < 0.045) AS below, count(*) FILTER (WHERE cap > 0.055) AS above FROM c
UNION ALL SELECT 'ROE', count(*) FILTER (WHERE roe < -0.5), count(*) FILTER (WHERE roe > 0.2) FROM c""",
)
def ratio_range_violations(spark, d):
    """E19."""
    return range_violations(core(spark, d), {"Capital_Ratio": (0.045, 0.055), "ROE": (-0.5, 0.2)})
