"""Fixed values of the domain: categories, pollutants, factors, weights, labels, limits."""

# They must equal those that published results were made with.
CATEGORIES = ("car", "motorcycle", "bus", "truck")
POLLUTANTS = ("tsp", "nox", "so2", "hc", "co", "co2", "ch4", "n2o")

# Grams per vehicle kilometre, in the order of POLLUTANTS.
DISTANCE_FACTORS = {
    "car": (0.01, 2.0, 0.026, 4.0, 40.0, 3180.0, 0.07, 0.005),
    "motorcycle": (0.24, 0.29, 0.008, 5.9, 14.0, 3180.0, 0.26, 0.002),
    "bus": (1.4, 11.9, 0.93, 1.3, 11.0, 3172.0, 0.06, 0.031),
    "truck": (1.4, 17.7, 0.82, 1.8, 9.4, 3172.0, 0.01, 0.031),
}
# Grams of fuel per kilometre, and grams per kilogram of fuel in the order of POLLUTANTS.
FUEL_GRAMS = {"motorcycle": 35.0, "car": 70.0, "bus": 240.0, "truck": 240.0}
FUEL_FACTORS = {
    "motorcycle": (2.2, 6.64, 0.04, 131.4, 497.7, 3180.0, 2.0, 0.02),
    "car": (0.03, 8.73, 0.05, 10.05, 85.0, 3180.0, 0.8, 0.02),
    "bus": (0.94, 33.37, 0.12, 1.92, 7.58, 3200.0, 0.3, 0.04),
    "truck": (0.94, 33.37, 0.12, 1.92, 7.58, 3200.0, 0.3, 0.04),
}
# Quintile labels, first for the first fifth of the ranking.
QUINTILES = ("Sangat Tinggi", "Tinggi", "Sedang", "Rendah", "Sangat Rendah")
# Weights of points of interest by category, 0.8 for all others.
POI_WEIGHTS = {"Pendidikan": 1.25, "Kesehatan": 1.25, "Pariwisata": 1.15, "Perdagangan": 1.2, "Kuliner": 1.0, "Perkantoran": 1.0, "Pemerintahan": 1.0, "Peribadatan": 0.7, "Transportasi": 1.1}
POI_DEFAULT = 0.8
# Limits of requests.
MAX_DAYS, MAX_BUCKETS, MAX_EXPORT, MAX_DELETE, MAX_PAGE = 31, 2000, 100_000, 100_000, 200
EARTH_M = 6_371_000.0
# Seconds after which data are aging, the length of an observation window, units of a record.
AGING_SECONDS, WINDOW_SECONDS = 90, 60
UNITS = {"emissions": "kg/hour", "volume_per_hour": "vehicles/hour", "vkt_km_h": "km/hour"}
