"""Fixed values of the surveillance domain, stated once.

They are inputs to the results, so they must not be derived or tuned.
"""

from datetime import date

# --- fixed values -----------------------------------------------------------
LOCAL_ZONE = "America/Puerto_Rico"

FIRST_DAY = date(2021, 12, 15)
FIRST_YEAR = 2020
DASHBOARD_FIRST_DAY = date(2020, 3, 12)

IMPUTATION_DELAY_DAYS = 2
WINDOW_ROWS = 7
WEEK_DAYS = 7
EPISODE_GAP_DAYS = 90
PAIR_WINDOW_DAYS = 7
SAMPLE_ENTITIES = 50
CONFIDENCE = 0.95

MISSING_TEXT = "N/A"
UNREPORTED = "No reportada"
REGION_SPELLING = {"Bayamon": "Bayamón", "Mayaguez": "Mayagüez"}
REGION_POPULATION = {
    "Metro": 682054,
    "Bayamón": 537123,
    "Arecibo": 394774,
    "Ponce": 474603,
    "Caguas": 529505,
    "Fajardo": 116148,
    "Mayagüez": 459487,
}

AGE_STARTS = [0, 10, 15, 20, 30, 40, 65, 75]
MINOR_AGE_BINS = ["0 to 9", "10 to 14", "15 to 19"]
# 26 labels: "0 to 4", "5 to 9", ... "125 to 129"
FIVE_YEAR_LABELS = [f"{lo} to {lo + 4}" for lo in range(0, 126, 5)]

LAB = "Molecular"
HOME = "AntigensSelfTest"
CHANNELS = [LAB, HOME]
COMBINED_TYPE = "Molecular+Antigens"
COMBINED_MEMBERS = ["Molecular", "Antigens"]
TEST_TYPE_ALIASES = {"Antigeno": "Antigens"}

POSITIVE, NEGATIVE, OTHER = "positive", "negative", "other"

WEEKDAYS = [
    "Sunday",
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
]

PERIODS = [
    ("December-February", date(2021, 12, 1), date(2022, 3, 1)),
    ("March-April", date(2022, 3, 1), date(2022, 5, 1)),
    ("May-June", date(2022, 5, 1), date(2022, 7, 1)),
]

OUTLIER_DAYS = [date(2022, 3, 9), date(2022, 3, 10), date(2022, 3, 12), date(2022, 6, 22)]
# ----------------------------------------------------------------------------
