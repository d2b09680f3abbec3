"""Table schemas, keys and feed layouts of the point-of-sale model."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

# Fixed precision: a bare DECIMAL is decimal(10,0) in Spark and would drop cents.
MONEY = T.DecimalType(18, 2)
QUANTITY = T.DecimalType(18, 2)

_INT = T.IntegerType()
_ID = T.LongType()  # wide enough for any number of orders and lines
_TEXT = T.StringType()
_TIME = T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Parents come before children, so this is also the load order.
SCHEMAS: dict[str, T.StructType] = {
    "menu": _table(
        menuID=_ID, menuName=_TEXT, category=_TEXT, price=MONEY, menuImage=_INT,
        menuDescription=_TEXT, seasonalStart=_TIME, seasonalEnd=_TIME,
    ),
    "employee": _table(
        employeeID=_ID, employeeName=_TEXT, employeePosition=_TEXT, employeePasscode=_TEXT,
    ),
    "ordertest": _table(
        orderID=_ID, employeeID=_ID, orderLocation=_TEXT, orderDate=_TIME, orderTotal=MONEY,
    ),
    "orderItem": _table(
        orderItemID=_ID, menuID=_ID, priceAtPurchase=MONEY, quantityPurchased=QUANTITY,
        orderID=_ID, orderSize=_INT,
    ),
    "inventory": _table(
        inventoryID=_ID, inventoryName=_TEXT, quantityAvailable=QUANTITY, restockPrice=MONEY,
        addOnPrice=MONEY, restockOrdered=_INT, unit=_TEXT, allergy=_TEXT, restockMin=_INT,
    ),
    "locationTable": _table(
        locationID=_ID, locationName=_TEXT, locationAddress=_TEXT, locationPhoneNum=_TEXT,
    ),
    "modification": _table(
        modificationID=_ID, inventoryID=_ID, orderItemID=_ID, modificationQuantity=QUANTITY,
        cost=MONEY,
    ),
    "menuInfo": _table(
        menuInfoID=_ID, inventoryID=_ID, menuID=_ID, menuInfoQuantity=QUANTITY,
    ),
}

LOAD_ORDER: tuple[str, ...] = tuple(SCHEMAS)

PRIMARY_KEYS: dict[str, str] = {
    "menu": "menuID",
    "employee": "employeeID",
    "ordertest": "orderID",
    "orderItem": "orderItemID",
    "inventory": "inventoryID",
    "locationTable": "locationID",
    "modification": "modificationID",
    "menuInfo": "menuInfoID",
}


class ForeignKey(NamedTuple):
    child: str
    column: str
    parent: str


FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("ordertest", "employeeID", "employee"),
    ForeignKey("orderItem", "menuID", "menu"),
    ForeignKey("orderItem", "orderID", "ordertest"),
    ForeignKey("modification", "inventoryID", "inventory"),
    ForeignKey("modification", "orderItemID", "orderItem"),
    ForeignKey("menuInfo", "inventoryID", "inventory"),
    ForeignKey("menuInfo", "menuID", "menu"),
)

# CSV header of every feed. Columns bind by position, not by header.
FEED_HEADERS: dict[str, tuple[str, ...]] = {
    "menu": ("MenuID", "Name", "Category", "Price", "Image", "Description",
             "SeasonalStart", "SeasonalEnd"),
    "employee": ("EmployeeID", "Name", "Position", "Passcode"),
    "ordertest": ("OrderID", "EmployeeID", "Location", "Date", "OrderTotal"),
    "orderItem": ("OrderItemID", "MenuID", "Price", "QuantityPurchased", "OrderID", "Size"),
    "inventory": ("InventoryID", "Name", "Quantity Available", "Restock Price", "AddOnPrice",
                  "Restock Ordered", "Unit", "Allegery", "Restock Min"),
    "locationTable": ("LocationID", "Name", "Address", "PhoneNum"),
    "modification": ("ModificationID", "InventoryID", "OrderItemID", "Quantity", "Cost"),
    "menuInfo": ("MenuInfoID", "InventoryID", "MenuID", "Quantity"),
}

# File name of every feed.
FEED_FILES: dict[str, str] = {
    "menu": "menu.csv",
    "employee": "employee.csv",
    "ordertest": "order.csv",
    "orderItem": "orderItem.csv",
    "inventory": "inventory.csv",
    "locationTable": "location.csv",
    "modification": "modifications.csv",
    "menuInfo": "menuInfo.csv",
}
