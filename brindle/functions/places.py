"""Places: keys, distance, area. All are Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Centre of the area, its states, abbreviations, pattern of a state at the end of a text.
CENTRE = (42.3601, -71.0589)
NEAR_STATES = ["MA", "NH", "RI", "CT", "ME", "VT"]
STREET_WORDS = {"street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "lane": "ln", "parkway": "pkwy", "place": "pl", "court": "ct"}
ADDRESS = r"\d+\s+[\w\s]+(?:st|ave|blvd|rd|dr|ln|way|ct|pl|pkwy|drive|street|avenue)\b"
STATE = (
    r"(?:^|[,\s])(A[KLRZ]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY])"
    r"(?:\s+\d{5}(?:-\d{4})?)?(?:,?\s*(?:US|USA|U\.S\.A?\.?|United States))?\s*$"
)
MAX_KM, SAME_PLACE_KM, KM_PER_DEGREE = 50.0, 0.3, 111.0


def distance_km(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column, mean: bool = False) -> Column:
    """Flat distance by the cosine of the first latitude, or of the mean."""
    at = (lat_a + lat_b) / 2 if mean else lat_a
    dlat, dlng = lat_a - lat_b, (lng_a - lng_b) * F.cos(F.radians(at))
    return F.sqrt(dlat * dlat + dlng * dlng) * KM_PER_DEGREE


def state_of(location: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(location), STATE, 1), F.lit(""))


def is_out_of_area(lat: Column, lng: Column, location: Column) -> Column:
    """Too far from the centre; without coordinates, a text that ends in a state elsewhere."""
    far = distance_km(lat, lng, F.lit(CENTRE[0]), F.lit(CENTRE[1])) > MAX_KM
    return F.when(lat.isNull() | lng.isNull(), F.coalesce(~state_of(location).isin(NEAR_STATES), F.lit(False))).otherwise(far)


def location_key(location: Column) -> Column:
    """The street address with short street words, else the first line, lower case without marks. Words have letters of any script."""
    low = F.lower(location)

    def squeeze(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))

    address = squeeze(F.nullif(F.regexp_extract(low, f"(?U){ADDRESS}", 0), F.lit("")))
    for full, short in STREET_WORDS.items():
        address = F.regexp_replace(address, rf"(?U)\b{full}\b", short)
    return F.coalesce(address, squeeze(F.regexp_extract(low, r"^\s*([^\n]*)", 1)))


def place_text(location: Column) -> Column:
    return F.lower(F.trim(location))
