"""Column names of the public liquor-sales transactions table, and the names used here."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# Source column name -> name after cleaning.
COLUMN_NAMES = {
    "Invoice/Item Number": "invoice_item",
    "Date": "sale_date",
    "Store Number": "store_number",
    "Store Name": "store_name",
    "Address": "address",
    "City": "city",
    "Zip Code": "zip_code",
    "Store Location": "store_location",
    "County Number": "county_number",
    "County": "county",
    "Category": "category",
    "Category Name": "category_name",
    "Vendor Number": "vendor_number",
    "Vendor Name": "vendor_name",
    "Item Number": "item_number",
    "Item Description": "item_description",
    "Pack": "pack",
    "Bottle Volume (ml)": "bottle_volume_ml",
    "State Bottle Cost": "state_bottle_cost",
    "State Bottle Retail": "state_bottle_retail",
    "Bottles Sold": "bottles_sold",
    "Sale (Dollars)": "sale_dollars",
    "Volume Sold (Liters)": "volume_liters",
    "Volume Sold (Gallons)": "volume_gallons",
}

# Columns the analysis has no use for.
UNUSED_COLUMNS = (
    "Address",
    "Vendor Number",
    "Item Number",
    "Pack",
    "Bottle Volume (ml)",
    "State Bottle Cost",
    "State Bottle Retail",
)

# Column -> type after cleaning.
NUMERIC_TYPES = {
    "Bottles Sold": "smallint",
    "Sale (Dollars)": "double",
    "Volume Sold (Liters)": "double",
    "Volume Sold (Gallons)": "double",
}

# Columns read as text even where they look like numbers.
TEXT_COLUMNS = (
    "Store Name",
    "City",
    "Zip Code",
    "County",
    "Category",
    "Category Name",
    "Vendor Name",
    "Item Description",
)

_RAW_NUMBERS = {
    "Bottles Sold": IntegerType(),
    "Sale (Dollars)": DoubleType(),
    "Volume Sold (Liters)": DoubleType(),
    "Volume Sold (Gallons)": DoubleType(),
}

# The transactions file as written: what ``read_csv(schema=...)`` takes to parse numbers while scanning.
TRANSACTIONS = StructType([StructField(name, _RAW_NUMBERS.get(name, StringType())) for name in COLUMN_NAMES])
