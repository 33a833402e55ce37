"""Names shared by every module.

The panel's grain is one row per (entity, month).  The three key columns are
fixed by the data model; everything else arrives through a contract.
"""

ENTITY = "county_fips"
NAME = "county_name"
PERIOD = "reference_month"
KEY = [ENTITY, PERIOD]

# Label classes in reporting order; also the index order of every probability
# vector and confusion matrix.
CLASSES = ("cooling", "stable", "heating")

# Columns that travel with the feature matrix and are never model inputs.
CONTEXT = (
    NAME,
    "prediction_as_of",
    "volume_tier",
    "is_included",
    "has_target",
    "growth_yoy",
    "target_dg",
    "target_label",
)

TRAIN, VALIDATION, TEST = "train", "validation", "test"
SPLITS = (TRAIN, VALIDATION, TEST)
EMBARGO, INELIGIBLE = "embargo", "ineligible"
