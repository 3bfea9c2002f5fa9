"""Parameters and fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Distances in metres; shares between 0 and 1."""

    radius: float = 450.0
    doorstep: float = 150.0
    landmark_radius: float = 800.0
    min_confidence: float = 0.6
    utm_zone: int = 18
    pad_degrees: float = 0.02
    max_listings: int | None = 10_000
    usually_present: float = 0.6
    top_deviations: int = 5
    typical: float = 0.15
    numeric_share: float = 0.5
    learners_needed: int = 3
    batch_size: int = 3_000
    max_tokens: int = 400
    price_in: float = 0.075e-6
    price_out: float = 0.30e-6
    full_size: int = 4_687
    city: str = "New York"
    city_short: str = "NYC"


DEFAULT = Params()

# Column names that a scrape may use for each target, the first present wins.
ALIASES = {
    "price": ("price",),
    "ratings": ("ratings", "review_scores_rating"),
    "lat": ("lat", "latitude"),
    "long": ("long", "longitude"),
    "guests": ("guests", "accommodates"),
    "bedrooms": ("bedrooms",),
    "bathrooms": ("bathrooms",),
    "room_type": ("room_type",),
    "details": ("details", "bathrooms_text"),
    "host_rating": ("host_rating",),
    "property_number_of_reviews": ("property_number_of_reviews", "number_of_reviews"),
    "is_superhost": ("is_supperhost", "is_superhost", "host_is_superhost"),
}
NUMBERS = ("ratings", "lat", "long", "guests", "bedrooms", "bathrooms", "host_rating", "property_number_of_reviews")
FLAGS = ("is_superhost",)
LEAKS = ("id", "name", "host_id", "host_name", "license", "last_review")

# How a details text tells room counts.
BEDROOMS_TOLD = r"(?i)\b(\d+\.?\d*)\s+bedrooms?\b"
BATHS_TOLD = r"(?i)\b(\d+\.?\d*)\s+bath(?:s|rooms?)?\b"

# Category groups that are kept, and single categories of other groups.
KEPT_GROUPS = ("eat_and_drink", "retail", "arts_and_entertainment", "attractions_and_activities", "active_life", "accommodation")
TRANSIT = (
    "transportation", "public_transportation", "train_station", "metro_station", "subway_station", "bus_station",
    "bus_stop", "light_rail_station", "ferry_terminal", "tram_station", "airport",
)
GROCERY = (
    "grocery_store", "asian_grocery_store", "indian_grocery_store", "international_grocery_store", "japanese_grocery_store",
    "korean_grocery_store", "kosher_grocery_store", "mexican_grocery_store", "organic_grocery_store", "russian_grocery_store",
    "specialty_grocery_store", "ethical_grocery", "supermarket", "convenience_store", "delicatessen", "farmers_market",
    "public_market", "health_market", "seafood_market", "butcher", "greengrocer", "health_food_store", "bodega",
)
PARKS = ("park", "botanical_garden", "beach", "plaza", "trail", "national_park", "state_park", "memorial_park")
CULTURE = ("museum", "art_gallery", "cultural_center")

# Display labels; other buckets show their name with spaces.
LABELS = {
    "dining": "dining",
    "cafe": "cafes",
    "nightlife": "bars & nightlife",
    "grocery": "grocery stores",
    "shopping": "shops",
    "fitness_sport": "gyms & sports",
    "park_green": "parks & green space",
    "culture": "museums & galleries",
    "landmark": "attractions",
    "entertainment": "entertainment venues",
    "lodging": "hotels",
    "transit": "subway & transit",
}

# Phrases. Each list is tried from the top.
AT_LEAST = ((0.95, "far more than most blocks"), (0.80, "well above average"), (0.65, "above average"))
AT_MOST = ((0.05, "almost none"), (0.20, "well below average"), (0.35, "below average"))
ABSENT = "none nearby"
PROXIMITY = ((50, "on the doorstep"), (150, "steps away"), (None, "a short walk"))
LANDMARK_BANDS = ((100, "right by"), (250, "a couple minutes from"), (500, "a short walk from"), (None, "about 10 minutes from"))
SHARES = ((0.30, "mostly"), (0.18, "lots of"), (0.10, "plenty of"), (0.05, "some"), (0.02, "a little"))
NO_LANDMARKS = "There are no well-known landmarks nearby."
LANDMARK_HEADER = "Well-known places nearby (copy names exactly, do not add any):"
# Headers of a text's sections ({city} is a parameter), and the line of one that has nothing to tell.
HEADERS = {
    "deviation": "How this block compares with a typical {city} block (only the ways it stands out are listed):",
    "deviation_exact": "How this block ranks among all {city} blocks (citywide percentile; only standouts listed):",
    "deviation_short": "How this block compares with a typical {city} block:",
    "proximity": "How close each kind of place is:",
    "composition": "The mix of places nearby (share of everything around):",
    "composition_short": "The mix of places nearby:",
}
EMPTY = {
    "deviation": "- (unremarkable — typical across the board)",
    "deviation_short": "- (typical across the board)",
    "proximity": "- (nothing nearby)",
    "composition": "- (little of anything)",
}
BANDS = ("none", "almost none", "well below", "below", "typical", "above", "well above", "far more")
BAND_AT_LEAST = ((0.95, "far more"), (0.80, "well above"), (0.65, "above"))
BAND_AT_MOST = ((0.05, "almost none"), (0.20, "well below"), (0.35, "below"))
PROXIMITY_BANDS = ((50, "doorstep"), (150, "steps"), (None, "short walk"))
VIEWS = ("deviation", "deviation_exact", "proximity", "composition", "landmarks", "combined")
