"""Fixed values of the marketplace domain.

Everything here must equal the published definitions for the results to be
right: status spellings, placeholder labels, tier labels and the default tier
thresholds, the state -> macro-region map, and the calendar name formats.
"""

# --- Fixed values -------------------------------------------------------------------

# order statuses used by the rules
STATUS_DELIVERED = "delivered"
STATUS_CANCELED = "canceled"
# all statuses of an order, as published
ORDER_STATUSES = ("delivered", "shipped", "canceled", "unavailable", "invoiced", "processing",
                  "created", "approved")
# statuses the supplier SLA leaves out, spelled as published ('cancelled' with
# two l's, which the data does not use)
SLA_EXCLUDED_STATUSES = ("cancelled", "unavailable")

# placeholder labels
UNKNOWN_CATEGORY = "unknown"
UNKNOWN_REGION = "Unknown"
NO_FULFILLED_ORDERS = "No Fulfilled Orders"

# supplier segments and their default thresholds
GOLD_PARTNER = "Gold Partner"
REGULAR_OPERATION = "Regular Operation"
OPERATIONAL_RISK = "Operational Risk"
GOLD_MIN_SCORE = 4.5
GOLD_MIN_ON_TIME = 0.90
GOLD_MIN_ORDERS = 10
REGULAR_MIN_SCORE = 3.5
REGULAR_MIN_ON_TIME = 0.70

# logistics risk tiers and their default thresholds
EFFICIENT_REGION = "Efficient Region"
MODERATE_DELAY_REGION = "Moderate Delay Region"
HIGH_RISK_REGION = "High Risk Region"
EFFICIENT_MAX_DELAYED = 0.08
EFFICIENT_MAX_LEAD_DAYS = 12
MODERATE_MAX_DELAYED = 0.20
MODERATE_MAX_LEAD_DAYS = 20

# financial health tiers and their default thresholds
HIGH_FINANCIAL_RISK = "High Financial Risk"
MODERATE_FINANCIAL_RISK = "Moderate Financial Risk"
FINANCIALLY_HEALTHY = "Financially Healthy"
HIGH_RISK_MIN_SHARE = 0.15
MODERATE_RISK_MIN_SHARE = 0.07

# Brazilian macro-region of each state code (27 codes)
REGION_STATES = {
    "Norte": ["AC", "AP", "AM", "PA", "RO", "RR", "TO"],
    "Nordeste": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "Centro-Oeste": ["DF", "GO", "MT", "MS"],
    "Sudeste": ["ES", "MG", "RJ", "SP"],
    "Sul": ["PR", "RS", "SC"],
}

# calendar: full month and weekday names (Spark datetime patterns)
MONTH_NAME_PATTERN = "MMMM"
DAY_NAME_PATTERN = "EEEE"

# --- end of fixed values
