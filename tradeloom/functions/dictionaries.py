"""Dictionaries that drive classification and extraction, and their checks.

A dictionary is a plain mapping or a YAML file; it stays on the driver and becomes Column expressions or a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Document types in order of precedence for ties, with strong and supporting clues.
CLUES: dict[str, tuple[list[str], list[str]]] = {
    "COMMERCIAL_INVOICE": (["COMMERCIAL INVOICE", "商业发票", "HÓA ĐƠN THƯƠNG MẠI"], ["INVOICE NO", "INVOICE NUMBER", "UNIT PRICE", "TOTAL AMOUNT"]),
    "PACKING_LIST": (["PACKING LIST", "装箱单", "PHIẾU ĐÓNG GÓI", "BẢNG KÊ ĐÓNG GÓI"], ["GROSS WEIGHT", "NET WEIGHT", "PACKAGE", "CARTON"]),
    "BILL_OF_LADING": (["BILL OF LADING", "提单", "B/L", "B.L."], ["VESSEL", "PORT OF LOADING", "PORT OF DISCHARGE", "SHIPPER", "CONSIGNEE"]),
    "AIR_WAYBILL": (["AIR WAYBILL", "航空运单", "AWB"], ["FLIGHT", "AIRPORT OF DEPARTURE", "AIRPORT OF DESTINATION"]),
    "CUSTOMS_DECLARATION": (["CUSTOMS DECLARATION", "TỜ KHAI HẢI QUAN", "报关单", "海关申报"], ["DECLARATION NO", "CUSTOMS OFFICE", "HS CODE"]),
    "CONTRACT": (["SALES CONTRACT", "PURCHASE CONTRACT", "HỢP ĐỒNG", "合同"], ["PARTY A", "PARTY B"]),
    "PURCHASE_ORDER": (["PURCHASE ORDER", "采购订单", "ĐƠN ĐẶT HÀNG"], ["PO NO"]),
    "CERTIFICATE_OF_ORIGIN": (["CERTIFICATE OF ORIGIN", "GIẤY CHỨNG NHẬN XUẤT XỨ", "原产地证"], ["C/O", "FORM E", "FORM D"]),
    "CATALOGUE": (["CATALOGUE", "PRODUCT CATALOG", "DANH MỤC SẢN PHẨM", "产品目录"], []),
    "SPECIFICATION": (["TECHNICAL SPECIFICATION", "THÔNG SỐ KỸ THUẬT", "技术规格"], ["SPECIFICATION"]),
}
#: Weights, decision threshold, margin over the second type.
STRONG, SUPPORTING, THRESHOLD, MARGIN = 0.6, 0.2, 0.5, 0.15

#: Exact labels that end an item table, and those that only begin a footer.
SUMMARY_MARKERS = ["TOTAL", "TOTAL PRICE", "SUBTOTAL", "SUB TOTAL", "GRAND TOTAL", "TỔNG", "TỔNG CỘNG", "CỘNG", "小计", "合计", "总计", "总金额"]
FOOTER_MARKERS = ["NOTE", "NOTES", "REMARK", "REMARKS", "PAYMENT TERMS", "BANK DETAILS", "BANK ACCOUNT", "THANK YOU", "GHI CHÚ", "备注"]

#: Those of the summary markers that end a part of a table only.
SUBTOTAL_MARKERS = ["SUBTOTAL", "SUB TOTAL", "小计"]

#: Default labels of header fields and item columns; any dictionary of the same shape can take their place.
HEADER_ALIASES: dict[str, list[str]] = {
    "invoice_number": ["INVOICE NO", "INVOICE NUMBER"],
    "invoice_date": ["INVOICE DATE", "DATE"],
    "seller.name": ["SELLER"],
    "buyer.name": ["BUYER"],
    "ship_to.name": ["SHIP TO"],
    "currency": ["CURRENCY"],
    "total_amount": ["TOTAL AMOUNT"],
    "freight": ["FREIGHT"],
}
ITEM_ALIASES: dict[str, list[str]] = {
    "item_code": ["ITEM CODE", "PRODUCT CODE"],
    "description": ["DESCRIPTION", "DESCRIPTION OF GOODS"],
    "quantity": ["QUANTITY", "QTY"],
    "unit": ["UNIT", "UOM"],
    "unit_price": ["UNIT PRICE"],
    "amount": ["AMOUNT"],
    "gross_weight": ["GROSS WEIGHT"],
    "net_weight": ["NET WEIGHT"],
    "package_number": ["PACKAGE NO."],
}
#: Labels that also name other things; what they label is less sure.
GENERIC_ALIASES = {"DATE", "UNIT", "AMOUNT"}
IDENTITY_COLUMNS = ["description", "item_code"]
NUMERIC_COLUMNS = ["quantity", "unit_price", "amount", "gross_weight", "net_weight"]


def alias(text: str) -> str:
    """Upper case with single blanks: how labels are compared."""
    return " ".join(text.upper().split())


def checked(aliases: dict[str, list[str]], paths: set[str] | None = None) -> dict[str, list[str]]:
    """The dictionary itself, or ValueError: missing or unknown paths, blank, repeated or conflicting labels."""
    if paths is not None and set(aliases) != paths:
        raise ValueError(f"paths differ: {sorted(set(aliases) ^ paths)}")
    seen: dict[str, str] = {}
    for path, labels in aliases.items():
        for label in labels:
            key = alias(label)
            if not key or key in seen:
                raise ValueError(f"label {label!r} of {path} is blank or already stands for {seen.get(key)}")
            seen[key] = path
    return aliases


def load_yaml(path: str) -> dict:
    """A YAML dictionary in which no key occurs twice and no merge key is used."""
    import yaml

    class Unique(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=deep) for k, _ in node.value]
        if len(set(keys)) < len(keys) or any(k.tag == "tag:yaml.org,2002:merge" for k, _ in node.value):
            raise ValueError(f"repeated or merge key at line {node.start_mark.line + 1}")
        return dict(zip(keys, (loader.construct_object(v, deep=deep) for _, v in node.value), strict=True))

    Unique.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    with open(path, encoding="utf-8") as f:
        return yaml.load(f, Unique)


def table(spark: SparkSession, aliases: dict[str, list[str]]) -> DataFrame:
    """(path, label): one row per normalized label."""
    return spark.createDataFrame([(p, alias(x)) for p, labels in aliases.items() for x in labels], "path string, label string")
