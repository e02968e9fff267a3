"""Parameters of the two workflows. Every value can be replaced."""

from __future__ import annotations

from dataclasses import dataclass

from launchlens.operators import ImputeRule

# Seasons, merchant classes, districts and patterns of the analysis.
SEASON_CODES = ("F17", "F18", "F19", "M17", "M18", "M19", "S17", "S18", "S19", "W17", "W18", "W19")
SHARED_CLASSES = (
    "Crossbodies", "Backpacks", "Travel Bags", "Totes", "IDs/Keychains", "Wristlets",
    "Cosmetics", "Travel/Packing Accessories", "Textiles", "Wallets", "Lunch Bags",
    "Satchels", "Rolling Luggage", "Laptop/Tablet Accessories",
)
DISTRICTS = ("Mid Atlantic", "Midwest", "Northeast", "West")


@dataclass(frozen=True)
class TwoChannelSettings:
    # Every default is one of the analysis.
    entry_method: int = 21
    excluded_stores: tuple[int, ...] = (179,)
    store_type: str = "Full Line"
    excluded_classes: tuple[str, ...] = ("Marketing",)
    excluded_styles: tuple[str, ...] = ("E-Gift Card",)
    seasons: tuple[str, ...] = (*SEASON_CODES, "S20")
    launched_from: str = "2017-02-01"
    launched_to: str = "2019-07-07"
    n_patterns: int = 150
    classes: tuple[str, ...] = (*SHARED_CLASSES, "Other Handbag Accessories")
    impute: tuple[ImputeRule, ...] = (
        ImputeRule("2017-05-02", "launched_3m", "existing_3m_avg_price"),
        ImputeRule("2017-04-02", "launched_2m", "existing_2m_avg_price"),
        ImputeRule("2017-03-02", "launched_1m", "existing_1m_avg_price"),
    )
    burst_limit: float = 1000
    clusters: int = 3
    starts: int = 20
    elbow_starts: int = 20
    elbow_ks: tuple[int, ...] = tuple(range(1, 16))
    max_iter: int = 100
    log_offset: float = 0.001
    train_share: float = 0.7
    seed: int = 1234
    folds: int = 5
    forest_trees: int = 500
    product_cols: tuple[str, ...] = (
        "style", "pattern", "release_season", "retirement_date", "department",
        "merchant_class", "primary_color", "secondary_color", "color_family",
    )


@dataclass(frozen=True)
class StoreSettings:
    # Every default is one of the analysis.
    excluded_stores: tuple[int, ...] = (179,)
    store_type: str = "Full Line"
    excluded_departments: tuple[str, ...] = ("Marketing",)
    excluded_districts: tuple[str, ...] = ("Model Store",)
    districts: tuple[str, ...] = DISTRICTS
    seasons: tuple[str, ...] = SEASON_CODES
    launched_from: str = "2017-02-01"
    cluster_launched_to: str = "2019-07-07"
    classes: tuple[str, ...] = (*SHARED_CLASSES, "Baby Bags", "Necklaces")
    cluster_excluded: tuple[str, ...] = ("Black", "Classic Black")
    model_excluded: tuple[str, ...] = ("Classic Black", "Black", "Charcoal")
    clusters: int = 4
    starts: int = 50
    elbow_starts: int = 100
    elbow_ks: tuple[int, ...] = tuple(range(1, 16))
    max_iter: int = 100
    log_offset: float = 1.0
    tails: tuple[float, float] = (0.01, 0.99)
    train_share: float = 0.7
    seed: int = 333
    folds: int = 10
    lasso_fractions: tuple[float, ...] = (1.0, 0.1, 0.01, 0.001)
    product_cols: tuple[str, ...] = (
        "style_id", "style", "pattern", "release_season", "retirement_season",
        "retirement_date", "department", "fabrication", "color_family", "color_season",
    )
    store_cols: tuple[str, ...] = (
        "district_id", "district", "latitude", "longitude", "active", "square_footage",
    )
    # Columns the two channels are appended on.
    append_cols: tuple[str, ...] = (
        "channel", "sku", "store", "district_id", "district", "latitude", "longitude", "active",
        "square_footage", "launch_date", "discount_flag", "group_tag", "totalsales", "trans",
        "units", "margins", "price", "style_id", "style", "pattern", "release_season",
        "retirement_season", "retirement_date", "department",
    )
