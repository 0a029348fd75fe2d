"""Fixed values and configuration of the table builds."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: the texts below must equal the source system's. ---------------

#: Classes in scope, as normalised text (lower case, trimmed), in the order of the original purchase query.
CLASS_SCOPE = (
    "6905 | bolts & nuts 8.8 metric",
    "6910 | bolts & nuts 10.9 metric",
    "6935 | bolts & nuts stainless steel",
    "6965 | washers",
    "6952 | threaded rods 8.8 - 10.9",
    "6900 | bolts & nuts 4.6 metric",
    "6915 | bolts & nuts 12.9 metric",
    "6920 | bolts & nuts metric fine",
    "6945 | bolts & nuts other",
    "6970 | washers stainless steel",
    "6944 | metal screws",
    "6925 | bolts & nuts unc / unf",
    "6954 | threaded rods stainless steel",
    "6985 | wood screws",
    "7008 | shims",
    "6930 | bolts & nuts hotdip galvanized",
    "6950 | threaded rods 4.6",
    "6981 | wall fixings stainless steel",
    "6956 | threaded rods trapizoidal",
    "6984 | wall fixings other",
)

#: Keys of the aggregated purchase table.
PURCHASE_KEYS = (
    "year_authorization",
    "product_number",
    "product_description",
    "crm_main_vendor",
    "crm_main_group_vendor",
    "class2",
    "class3",
    "class4",
    "brand_name",
    "brand_type",
    "country_of_origin",
    "purchase_stop_ind",
)

#: Product id prefixes; the empty one stands for ids without prefix.
ID_PREFIXES = ("ticGoldenItem-", "ticArticle-", "ticItem-", "")

#: Prefix of the ids that carry product attributes.
ATTRIBUTE_ID_PREFIX = "ticGoldenItem"

#: Detail names in report order, with their attribute id and output column.
PRODUCT_DETAILS = (
    ("Unit", "attUnit", "unit"),
    ("Head shape", "attHeadShape", "head_shape"),
    ("Thread type", "attThreadType", "thread_type"),
    ("Head height", "attHeadHeight", "head_height"),
    ("Head outside diameter (width)", "attHeadOutsideDiameter", "head_outside_diameter_width"),
    ("Quality", "attQuality", "quality"),
    ("Surface treatment", "attSurfaceTreatment", "surface_treatment"),
    ("Material", "attMaterial", "material"),
    ("DIN Standard", "attDINStandard", "din_standard"),
    ("Weight per 100 pcs", "attWeightPer100Pcs", "weight_per_100_pcs"),
    ("Content in sales unit", "attContentInSalesUnit", "content_in_sales_unit"),
    ("Thread diameter", "attThreadDiameter", "thread_diameter"),
    ("Length", "attLength", "length"),
    ("Height", "attHeight", "height"),
    ("Total height", "attTotalHeight", "total_height"),
    ("Width", "attWidth", "width"),
    ("ISO Standard", "attISOStandard", "iso_standard"),
    ("Inside diameter", "attInsideDiameter", "inside_diameter"),
    ("Outside diameter", "attOutsideDiameter", "outside_diameter"),
    ("Thickness", "attThickness", "thickness"),
    ("Designed for thread", "attDesignedForThread", "designed_for_thread"),
    ("Total length", "attTotalLength", "total_length"),
    ("Head type", "attHeadType", "head_type"),
    ("Thread length", "attThreadLength", "thread_length"),
)

#: Localised attributes merged into the enriched purchases, in the order of the original enrichment query.
LOCAL_ATTRIBUTE_IDS = (
    "taConnectionType_6",
    "taForStrapBolt",
    "taHeadShape",
    "taHeadType",
    "taLabelColourCode",
    "taMaterial",
    "taMaterial_2",
    "taMaterial_40",
    "taMaterial_46",
    "taMaterial_47",
    "taMaterial_7",
    "taMaterial_9",
    "taMeasurementsType",
    "taSurfaceThreatment",
    "taSurfaceThreatment_11",
    "taSurfaceTreatment_13",
    "taSurfaceTreatment_17",
    "taSurfaceTreatment_4",
    "taSurfaceTreatment_5",
    "taThreadDirection_",
    "taThreadType_",
    "taThreadType_10",
    "taThreadType_4",
    "taThreadType_9",
    "taType_22",
)

#: Brand types of the sales table and of the brand table, by group.
SALES_BRAND_GROUPS = {
    "Global": ("Global A", "Global B"),
    "Local": ("Local A", "Local B"),
    "OE": ("OE",),
    "Private label": ("Private label A", "Private label B", "Private label C"),
    "Other": ("Non sensitive", "Non branded", "Other"),
}
ITEM_BRAND_GROUPS = {
    "Global": ("(GLOBAL_A) Global A", "(GLOBAL_B) Global B"),
    "Local": ("(LOCAL_A) Local A", "(LOCAL_B) Local B"),
    "OE": ("OE",),
    "Private label": ("(PRIVATE_LABEL_A) Private label A", "(PRIVATE-LABEL-B) Private label B"),
    "Other": ("(NON_SENSITIVE) Non sensitive", "(NON_BRANDED) Non branded", "(OTHER) Other"),
}

#: Spend columns tried in order when none is named.
SPEND_CANDIDATES = (
    "Purchase Amount Eur",
    "purchase_amount_eur",
    "PurchaseAmountEUR",
    "purchase_amount",
    "amount_eur",
    "AmountEUR",
    "amount",
    "total_spend",
    "TotalSpend",
    "Total Spend",
)

#: Class columns tried in order.
CLASS_CANDIDATES = (
    "Class3",
    "class3",
    "Class 3",
    "Class2",
    "class2",
    "Class 2",
    "Category",
    "category",
)

# --- Configuration ----------------------------------------------------------------


@dataclass(frozen=True)
class TierScheme:
    """Labels and cumulative-share cut-offs of a tiering."""

    labels: tuple[str, ...] = ("A", "B", "C", "D", "E")
    thresholds: tuple[str | float, ...] = ("0.8", "0.95", "0.99", "0.999")
    min_products: int = 5
    out_of_range: str = "nan"

    def __post_init__(self) -> None:
        if len(self.labels) != len(self.thresholds) + 1:
            raise ValueError("thresholds must have one element fewer than labels")


ABCDE = TierScheme()
ABC = TierScheme(labels=("A", "B", "C"), thresholds=("0.8", "0.95"), min_products=0)


@dataclass(frozen=True)
class PurchaseScope:
    """Filters of the purchase build."""

    brand: str
    company_prefix: str
    class2_code: str = "54"
    after_year: int = 2020
    classes: tuple[str, ...] = tuple(c for c in CLASS_SCOPE if c != "7008 | shims")
    exclude_product: str | None = "P001$"


@dataclass(frozen=True)
class OrderScope:
    """Filters of the order build; an empty `class2` keeps every class."""

    company_prefix: str
    class2: tuple[str, ...] = ("54 - Fasteners",)
    after_year: int = 2020
    dimension_attribute: str = "taLengthMm_5"
    dimension_class3: str = "Bolts & Nuts"
    dimension_word: str = "nut"


@dataclass(frozen=True)
class AttributeRule:
    """One output column, fed by attributes of a given name or id."""

    output: str
    names: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()


PRODUCT_NUMBER_RULE = AttributeRule("product_number", ids=("attItemNumber",))
PRODUCT_RULES = (
    PRODUCT_NUMBER_RULE,
    *(AttributeRule(out, (name.lower(),), (att,)) for name, att, out in PRODUCT_DETAILS),
)
PRODUCT_RULES_MIN = (
    PRODUCT_NUMBER_RULE,
    AttributeRule("material", ("material",)),
    AttributeRule("length", ("length",)),
    AttributeRule("thread_diameter", ("thread diameter",)),
)
DETAIL_NAMES = tuple(name for name, _, _ in PRODUCT_DETAILS)


@dataclass(frozen=True)
class EnrichmentScope:
    """Which localised attributes become columns, and which columns are merged."""

    attribute_ids: tuple[str, ...] = LOCAL_ATTRIBUTE_IDS
    language: str = "ENG"
    #: attribute key -> output column
    outputs: dict[str, str] = field(
        default_factory=lambda: {
            "ConnectionType": "connection_type",
            "ForStrapBolt": "for_strap_bolt",
            "HeadShape": "head_shape",
            "HeadType": "head_type",
            "LabelColourCode": "label_colour_code",
            "Material": "material",
            "MeasurementsType": "measurements_type",
            "SurfaceTreatment": "surface_treatment",
            "ThreadDirection": "thread_direction",
            "ThreadType": "thread_type",
            "Type": "type",
        }
    )
    #: key whose values are merged into another key's column (old misspelling)
    merged: dict[str, str] = field(default_factory=lambda: {"SurfaceThreatment": "SurfaceTreatment"})
