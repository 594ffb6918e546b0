"""Column types of the canonical tables."""

GENERATION = "ts timestamp_ntz, plant string, mwh double"
LOCATION = ("plant string, energy_source string, address string, source_file string, "
            "lat double, lon double, station bigint, station_name string")
STATIONS = "station bigint, station_name string, lat double, lon double"
WEATHER = ("station bigint, station_name string, ts timestamp_ntz, temperature double, "
           "rain double, sunshine double, radiation double")
TRAINING = ("ts timestamp_ntz, plant string, station_name string, station bigint, mwh double, "
            "temperature double, rain double, sunshine double, radiation double")
ALIAS = "plant string, canonical string"
GEOCODE = "address string, lat double, lon double"
REGISTRY = "generator string, region string, subregion string, capacity string"
BOUNDARIES = "name string"
REJECTS = "path string, reason string"
