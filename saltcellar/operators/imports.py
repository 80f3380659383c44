"""CSV exports, read as text, to warehouse rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cell texts that mean "no value", and the item report's smallest reorder level.
NO_VALUE = ("", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "#N/A", "<NA>")
LEAST_REORDER_LEVEL, REORDER_SHARE = 10.0, 0.1


def _cell(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    cell = F.col(f"`{name}`")
    return F.when(~F.trim(cell).isin(*NO_VALUE), cell)


def _number(df: DataFrame, name: str) -> Column:
    return F.coalesce(_cell(df, name).try_cast("double"), F.lit(0.0))


def _readable(df: DataFrame, *names: str) -> Column:
    """False for a row with a cell that should be a number and is not; such rows are skipped."""
    fine = F.lit(True)
    for name in names:
        cell = _cell(df, name)
        fine = fine & (cell.isNull() | cell.try_cast("double").isNotNull())
    return fine


def import_orders(export: DataFrame) -> DataFrame:
    """Order and check exports."""
    amounts = {
        "total_amount": "Total", "subtotal": "Amount", "tax_amount": "Tax", "tip_amount": "Tip",
        "discount_amount": "Discount Amount",
    }
    guid = _cell(export, "Order Id")
    return export.filter(guid.isNotNull() & _readable(export, *amounts.values())).select(
        guid.alias("order_id"),
        "location_id",
        "business_date",
        guid.alias("order_guid"),
        _cell(export, "Opened").alias("order_time"),
        F.coalesce(_cell(export, "Dining Options"), F.lit("UNKNOWN")).alias("order_type"),
        *[_number(export, header).alias(name) for name, header in amounts.items()],
    )


def import_payments(export: DataFrame) -> DataFrame:
    guid = _cell(export, "order_guid")
    return export.filter(guid.isNotNull() & _readable(export, "amount")).select(
        guid.alias("order_guid"),
        F.coalesce(_cell(export, "payment_method"), F.lit("UNKNOWN")).alias("payment_method"),
        _number(export, "amount").alias("amount"),
        F.coalesce(_cell(export, "payment_date"), F.col("business_date")).alias("payment_date"),
        "location_id",
        "business_date",
    )


def import_items(export: DataFrame) -> DataFrame:
    guid = _cell(export, "Order Id")
    return export.filter(guid.isNotNull() & _readable(export, "Qty", "Gross Price", "Net Price")).select(
        guid.alias("order_guid"),
        F.coalesce(_cell(export, "Menu Item"), F.lit("")).alias("item_name"),
        F.coalesce(_cell(export, "Sales Category"), F.lit("")).alias("category"),
        F.coalesce(_cell(export, "Qty").try_cast("double"), F.lit(1.0)).cast("long").alias("quantity"),
        _number(export, "Gross Price").alias("prediscount_total"),
        _number(export, "Net Price").alias("total_price"),
        "location_id",
        "business_date",
    )


def import_inventory(export: DataFrame) -> DataFrame:
    """Item reports: the reorder level is a tenth of the quantity, at least ten."""
    name, quantity = _cell(export, "Menu Item"), _number(export, "Item Qty")
    return export.filter(name.isNotNull() & _readable(export, "Item Qty", "Avg Price")).select(
        "location_id",
        name.alias("item_name"),
        F.coalesce(_cell(export, "Menu Group"), F.lit("")).alias("category"),
        quantity.alias("current_stock"),
        F.greatest(F.lit(LEAST_REORDER_LEVEL), quantity * REORDER_SHARE).alias("reorder_level"),
        _number(export, "Avg Price").alias("unit_cost"),
        F.col("business_date").alias("snapshot_date"),
        F.lit("good").alias("status"),
    )


def import_time_entries(export: DataFrame) -> DataFrame:
    numbers = {
        "total_hours": "Total Hours", "payable_hours": "Payable Hours", "regular_hours": "Regular Hours",
        "overtime_hours": "Overtime Hours", "cash_tips": "Cash Tips Declared", "non_cash_tips": "Non Cash Tips",
        "total_gratuity": "Total Gratuity", "total_tips": "Total Tips", "wage": "Wage",
    }
    employee = F.nullif(F.trim(_cell(export, "Employee")), F.lit(""))
    return export.filter(employee.isNotNull() & _readable(export, *numbers.values())).select(
        "location_id",
        "business_date",
        employee.alias("employee_name"),
        F.coalesce(_cell(export, "Job Title"), F.lit("")).alias("job_title"),
        _cell(export, "In Date").alias("clock_in_time"),
        _cell(export, "Out Date").alias("clock_out_time"),
        *[_number(export, header).alias(name) for name, header in numbers.items()],
        (_number(export, "Total Hours") * 60).cast("long").alias("duration_minutes"),
    )
