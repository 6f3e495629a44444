"""Parameters and fixed values of the gauges."""

from __future__ import annotations

from dataclasses import dataclass, replace

VENUE_A, VENUE_B = "polymarket", "kalshi"
BACKFILL_START = "2024-01-01"


# The defaults.
@dataclass(frozen=True)
class Params:
    clip_lo: float = 0.01
    clip_hi: float = 0.99
    pin_lo: float = 0.01
    pin_hi: float = 0.99
    ewma_halflife: float = 10.0
    ewma_min_periods: int = 5
    seed_days: int = 90
    resolution_exclusion_days: int = 3
    pm_min_total_volume: float = 50_000.0
    ka_min_rolling_notional: float = 5_000.0
    rolling_window_days: int = 7

    def with_(self, **changes) -> Params:
        return replace(self, **changes)


# The taxonomy. Sports first, then categories in this order, by substring of the small-letter title.
SPORTS = (
    "nfl", "nba", "mlb", "nhl", "soccer", "football", "basketball", "baseball", "hockey", "tennis", "golf", "ufc",
    "boxing", "olympic", "world cup", "super bowl", "march madness", "f1 ", "grand prix", "premier league",
    "champions league", "playoff", "heisman", "world series", "stanley cup", "wimbledon", "masters tournament",
)
SPORTS_VENUE = ("sports", "sport")
CATEGORIES = {
    "WAR": ("war", "ceasefire", "military", "strike on", "airstrike", "invasion", "invade", "missile", "nuclear", "sanction", "nato", "troops", "gaza", "ukraine", "russia", "iran", "taiwan", "hostage", "hezbollah", "houthis"),
    "ELECTIONS": ("election", "primary", "presidential race", "senate seat", "senate race", "house seat", "governor", "midterm", "nominee", "ballot", "electoral", "wins the presidency", "popular vote"),
    "POLITICS": ("shutdown", "impeach", "supreme court", "scotus", "congress", "bill", "executive order", "cabinet", "resign", "speaker of the house", "confirm", "veto", "pardon", "debt ceiling"),
    "ECON_FED": ("fed ", "fomc", "rate cut", "rate hike", "interest rate", "cpi", "inflation", "recession", "gdp", "unemployment", "jobs report", "payroll", "treasury", "tariff"),
    "CRYPTO": ("bitcoin", "btc", "ethereum", "eth ", "solana", "crypto", "stablecoin", "coinbase", "binance"),
    "TECH_AI": ("openai", "gpt", "claude", "anthropic", "gemini", "ai model", "artificial intelligence", "agi", "nvidia", "apple", "tesla", "spacex", "chatgpt", "deepmind"),
    "CLIMATE": ("temperature", "hottest", "hurricane", "wildfire", "climate", "emissions", "carbon", "heat record", "named storm", "el nino", "la nina"),
}
# Which category a venue's own one stands for.
VENUE_CATEGORIES = {"politics": "POLITICS", "us-current-affairs": "POLITICS", "world": "WAR", "geopolitics": "WAR", "economics": "ECON_FED", "financials": "ECON_FED", "economy": "ECON_FED", "crypto": "CRYPTO", "science and technology": "TECH_AI", "tech": "TECH_AI", "climate and weather": "CLIMATE", "climate": "CLIMATE"}
# Which categories feed each index.
UNIVERSES = {"GLOBAL": tuple(CATEGORIES)} | {c: (c,) for c in CATEGORIES}
# Windows in which known events have to show, and the parameter grid of the robustness runs.
EVENTS = (
    ("US election week", "2024-11-04", "2024-11-08", ("GLOBAL", "ELECTIONS")),
    ("Liberation Day tariffs", "2025-04-02", "2025-04-09", ("GLOBAL", "ECON_FED")),
    ("Israel-Iran war / US strikes", "2025-06-13", "2025-06-23", ("GLOBAL", "WAR")),
)
GRID = {"ewma_halflife": (8, 10, 12), "resolution_exclusion_days": (2, 3, 4), "pm_min_total_volume": (40_000, 50_000, 60_000), "ka_min_rolling_notional": (4_000, 5_000, 6_000)}
