"""Category orders, bin edges, stage names and defaults that results depend on."""

INF = float("inf")

# Funding rounds in order.
ROUND_ORDER = [
    "Pre-Seed", "Seed", "Series A", "Series B", "Series C",
    "Series D", "Series E", "Series F", "Series G",
]
# Rounds that count as early, late and first.
EARLY_ROUNDS = ["Seed", "Series A", "Series B"]
LATE_ROUNDS = ["Series C", "Series D", "Series E", "Series F", "Series G"]
FIRST_ROUNDS = ["Pre-Seed", "Seed", "Series A", "Series B", "Series C"]

# Stage of a round.
STAGES = {
    "Pre-Seed": "Seed",
    "Seed": "Seed",
    "Series A": "Early",
    "Series B": "Early",
    "Series C": "Late",
    "Series D": "Late",
    "Series E": "Late",
    "Series F": "Late",
    "Series G": "Late",
}
# Stage of a round, in the plural.
STAGES_PLURAL = {
    "Pre-Seed": "Seeds",
    "Seed": "Seeds",
    "Series A": "Early",
    "Series B": "Early",
    "Series C": "Late",
    "Series D": "Late",
    "Series E": "Late",
    "Series F": "Late",
    "Series G": "Late",
}
# Stage of a round, long names.
STAGES_LONG = {
    "Pre-Seed": "Seed",
    "Seed": "Seed",
    "Series A": "Early Stage",
    "Series B": "Early Stage",
    "Series C": "Later Stage",
    "Series D": "Later Stage",
    "Series E": "Later Stage",
    "Series F": "Later Stage",
    "Series G": "Later Stage",
}
# Stage of a round in age tables.
STAGES_AGE = {
    "Pre-Seed": "Seed",
    "Seed": "Seed",
    "Series A": "Early Stage",
    "Series B": "Early Stage",
    "Series C": "Late Stage",
    "Series D": "Late Stage",
    "Series E": "Late Stage",
    "Series F": "Late Stage",
    "Series G": "Late Stage",
}
# Stage of a round with growth capital.
STAGES_GROWTH = {
    "Pre-Seed": "Seed",
    "Seed": "Seed",
    "Series A": "Early Stage",
    "Series B": "Early Stage",
    "Series C": "Later Stage",
    "Series D": "Later Stage",
    "Series E": "Later Stage",
    "Series F": "Later Stage",
    "Series G": "Later Stage",
    "Growth": "Growth",
    "Private Equity": "Growth",
}

# Deal size bins in dollars.
DEAL_SIZE_EDGES = [0.0, 1e5, 5e5, 1e6, 5e6, 1e7, 5e7, 1e8, INF]
DEAL_SIZE_LABELS = [
    "<100K", "100K-500K", "500K-1M", "1M-5M", "5M-10M", "10M-50M", "50M-100M", "100M+",
]
# Deal size bins in millions of dollars.
DEAL_MILLION_EDGES = [-INF, 5.0, 15.0, 40.0, 100.0, 250.0, INF]
DEAL_MILLION_LABELS = ["$0-5M", "$5-15M", "$15-40M", "$40-100M", "$100-250M", "$250M+"]
# Company age bins in years.
AGE_EDGES = [float(y) for y in range(11)] + [INF]
AGE_LABELS = [f"{y}-{y + 1}" for y in range(10)] + ["10+"]
# Time-of-day bins over the hour; hour 0 lies outside and reads "nan".
DAYTIME_EDGES = [0.0, 6.0, 12.0, 18.0, 24.0]
DAYTIME_LABELS = ["night", "morning", "afternoon", "evening"]

# Weekdays in order, home regions, labels and mobile devices.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
HOME_REGIONS = {"Canada": "Canada", "USA": "USA"}
REGION_OTHER = "Other International"
UNKNOWN = "Unknown"
ARROW = " → "
MOBILE_DEVICES = ["iOS", "Android"]

# The 30 columns an event export keeps.
EVENT_COLUMNS = [
    "$insert_id", "amplitude_id", "app", "city", "client_event_time", "client_upload_time",
    "country", "data", "data_type", "device_family", "device_id", "device_type", "dma",
    "event_id", "event_properties", "event_time", "event_type", "language", "library",
    "os_name", "os_version", "platform", "processed_time", "region", "server_received_time",
    "server_upload_time", "session_id", "user_id", "user_properties", "uuid",
]
