"""Settings, read from the environment (prefix ``PLACEFORGE_``) once per process."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache
from urllib.parse import quote_plus

PREFIX = "PLACEFORGE_"


@dataclass(frozen=True)
class Settings:
    jdbc_host: str = "127.0.0.1"
    jdbc_port: int = 3306
    jdbc_user: str = "placeforge"
    jdbc_password: str = ""
    jdbc_database: str = "reference"
    cache_ttl_seconds: int = 30 * 24 * 3600
    cache_ttl_negative_seconds: int = 7 * 24 * 3600
    #: Separates near-equal candidates only; never overrides a stated country.
    country_bias: str = "AUS"
    country_bias_weight: float = 0.05
    fuzzy_locality_min: int = 88
    fuzzy_street_min: int = 85
    fuzzy_city_min: int = 90
    batch_limit: int = 1000

    def __post_init__(self) -> None:
        for name in ("fuzzy_locality_min", "fuzzy_street_min", "fuzzy_city_min"):
            if not 0 <= getattr(self, name) <= 100:
                raise ValueError(f"{name} must lie between 0 and 100")

    @property
    def jdbc_url(self) -> str:
        return f"jdbc:mysql://{self.jdbc_host}:{self.jdbc_port}/{quote_plus(self.jdbc_database)}?characterEncoding=utf8"


@lru_cache
def get_settings() -> Settings:
    given = {f.name: type(f.default)(os.environ[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in os.environ}
    return Settings(**given)
