"""Fixed schemas of the raw and filtered relations, and which columns fill which role of a document."""

from __future__ import annotations

from dataclasses import dataclass

# File formats.
REVIEW_RAW = (
    "rating double, title string, text string, images array<struct<hi_res:string,large:string,thumb:string>>, asin string, parent_asin string, "
    "user_id string, timestamp long, helpful_vote int, verified_purchase boolean"
)
META_RAW = (
    "parent_asin string, main_category string, title string, subtitle string, author struct<name:string>, average_rating double, rating_number int, "
    "price string, features array<string>, description array<string>, categories array<string>, store string, details map<string,string>, "
    "images array<struct<large:string>>, videos array<struct<url:string>>"
)
SPINE_CSV = "user_id string, parent_asin string, rating float, timestamp long"

# Roles, their weights, and the columns that fill them, first choice first.
ROLES = ("title", "creator", "taxonomy", "blurb", "reviews")
ENTITY_ROLES = ("creator", "taxonomy")
TEXT_ROLES = ("title", "blurb")
DEFAULT_WEIGHTS = {"title": 1.0, "creator": 1.0, "taxonomy": 0.5, "blurb": 1.0, "reviews": 0.5}
FIELD_MAPS = {
    "books": {"title": ["title"], "creator": ["author_name", "store"], "taxonomy": ["categories"], "blurb": ["features"], "reviews": ["description"]},
    "movies": {"title": ["title"], "creator": ["store"], "taxonomy": ["categories"], "blurb": ["description"], "reviews": []},
}


@dataclass(frozen=True)
class SplitParams:
    """Parameters of the cold-start split; refused where reveal and test could overlap."""

    min_interactions: int = 25
    cold_fraction: float = 0.10
    val_fraction: float = 0.10
    n_reveal: int = 20
    test_size: int = 5
    min_rating: float = 4.0
    min_warm: int = 5
    min_loo: int = 3
    seed: int = 42

    def __post_init__(self) -> None:
        if self.min_interactions - self.test_size < self.n_reveal:
            raise ValueError("the reveal pool would overlap the reserved test rows: raise min_interactions or lower n_reveal or test_size")
