"""Supervisory ratios from a mapping of numerators and denominators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.numeric import safe_ratio, sum_skip_null
from tessella.operators.series import quoted


@dataclass(frozen=True)
class Ratio:
    """``(sum of plus - sum of minus) / over``.

    ``skip_null`` sums the numerator with nulls as zero; ``existing`` names a
    column that already holds the ratio and wins where the frame has it.
    """

    name: str
    plus: tuple[str, ...]
    over: str
    minus: tuple[str, ...] = ()
    skip_null: bool = False
    existing: str | None = None

    def inputs(self) -> set[str]:
        return {*self.plus, *self.minus, self.over}

    def expr(self) -> Column:
        if self.skip_null:
            num = sum_skip_null([quoted(c) for c in self.plus])
        else:
            num = quoted(self.plus[0])
            for c in self.plus[1:]:
                num = num + quoted(c)
        for c in self.minus:
            num = num - quoted(c)
        return safe_ratio(num, quoted(self.over))


# Measure names used by the ratio catalogue.
ASSETS = "assets_total_assets"
CASH = "assets_cash_and_cash_equivalents"
LOANS = "assets_loans_and_receivables_from_customers"
PROVISIONS_LEGAL = (
    "assets_including_provision_for_impairment_of_loans_and_receivables_from_legal_entities"
)
PROVISIONS_PERSONS = (
    "assets_including_provision_for_impairment_of_loans_and_receivables_from_individuals"
)
DEPOSITS = "liabilities_amounts_due_to_customers"
LIABILITIES = "liabilities_total_liabilities"
EQUITY = "equity_total_equity_capital"
AUTHORIZED = "equity_authorized_capital"
PROFIT = "financial_results_profit_loss_after_tax"
INCOME = "financial_results_total_income"
EXPENSES = "financial_results_total_expenses"
INTEREST_INCOME = "financial_results_interest_income"
INTEREST_EXPENSE = "financial_results_interest_expenses"
COMMISSION_INCOME = "financial_results_commission_income"
COMMISSION_EXPENSE = "financial_results_commission_expenses"
OPERATING_EXPENSE = "financial_results_operating_expenses"
FX_GAP = "FX_Gap"

CORE_RATIOS = [
    Ratio("Capital_Ratio", (EQUITY,), ASSETS),
    Ratio("NPL_Ratio", (PROVISIONS_LEGAL, PROVISIONS_PERSONS), LOANS, skip_null=True),
    Ratio("Cost_Income_Ratio", (EXPENSES,), INCOME),
    Ratio("ROA", (PROFIT,), ASSETS, existing="ROA"),
    Ratio("ROE", (PROFIT,), EQUITY),
    Ratio("Liquid_Assets_Ratio", (CASH,), ASSETS),
    Ratio("Loan_Deposit_Ratio", (LOANS,), DEPOSITS),
    Ratio("Net_Open_FX_Ratio", (FX_GAP,), EQUITY),
]

EXTENDED_RATIOS = [
    Ratio("Net_Interest_Income_Ratio", (INTEREST_INCOME,), ASSETS, (INTEREST_EXPENSE,)),
    Ratio("Interest_Income_Ratio", (INTEREST_INCOME,), ASSETS),
    Ratio("Net_Interest_Margin", (INTEREST_INCOME,), ASSETS, (INTEREST_EXPENSE,)),
    Ratio("Net_Commission_Income_Ratio", (COMMISSION_INCOME,), ASSETS, (COMMISSION_EXPENSE,)),
    Ratio("Commission_Income_Ratio", (COMMISSION_INCOME,), ASSETS),
    Ratio("Asset_Turnover", (INCOME,), ASSETS),
    Ratio("Income_Diversity_Ratio", (INCOME,), INCOME, (INTEREST_INCOME,)),
    Ratio("Profit_Margin", (PROFIT,), INCOME),
    Ratio("Total_Equity_Ratio", (EQUITY,), ASSETS),
    Ratio("Common_Equity_Ratio", (AUTHORIZED,), ASSETS),
    Ratio("Equity_Multiplier", (ASSETS,), EQUITY),
    Ratio("Provisions_Ratio", (PROVISIONS_LEGAL, PROVISIONS_PERSONS), ASSETS, skip_null=True),
    Ratio("Loan_Loss_Provision_Ratio", (PROVISIONS_LEGAL,), LOANS),
    Ratio("Loan_Asset_Ratio", (LOANS,), ASSETS),
    Ratio("Loan_Deposit_Efficiency_Ratio", (LOANS,), DEPOSITS),
    Ratio("Interest_Expense_Ratio", (INTEREST_EXPENSE,), ASSETS),
    Ratio("Cash_Ratio", (CASH,), ASSETS),
    Ratio("Deposit_Ratio", (DEPOSITS,), LIABILITIES),
    Ratio("Cash_Deposit_Ratio", (CASH,), DEPOSITS),
    Ratio("Cost_of_Deposits", (INTEREST_EXPENSE,), LIABILITIES),
    Ratio("Deposits_Assets_Ratio", (DEPOSITS,), ASSETS),
    Ratio("Wholesale_Funding_Ratio", (LIABILITIES,), LIABILITIES, (DEPOSITS,)),
    Ratio("Operating_Expense_Ratio", (OPERATING_EXPENSE,), ASSETS),
    Ratio("Commission_Expense_Ratio", (COMMISSION_EXPENSE,), ASSETS),
    Ratio("Net_Interest_Expense_Ratio", (INTEREST_EXPENSE,), LIABILITIES, (INTEREST_INCOME,)),
]


def apply_ratios(df: DataFrame, ratios: list[Ratio]) -> DataFrame:
    """Add every ratio whose inputs exist, in one projection."""
    have = set(df.columns)
    exprs = {
        r.name: r.expr()
        for r in ratios
        if r.inputs() <= have and not (r.existing and r.existing in have)
    }
    return df.withColumns(exprs)


def interact(df: DataFrame, flag: str, cols: list[str]) -> DataFrame:
    """Products of a flag with each column, named ``flag_x_column``."""
    return df.withColumns({f"{flag}_x_{c}": F.col(flag) * quoted(c) for c in cols})
