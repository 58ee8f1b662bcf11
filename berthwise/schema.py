"""Column names, schemas and fixed domain values.

The values under "FIXED VALUES" must equal the source system's for results to
match (raw column headers of the call log, fallbacks, thresholds, the berth
range table, vessel profiles).  They are data, listed plainly in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ============================================================================
# FIXED VALUES — raw call-log column headers (French, as exported by the port)
# ============================================================================
RAW_COLUMNS = [
    "Navire",
    "Type Navire",
    "Jauge Brute",
    "Tirant Eau Entree Avant",
    "Tirant Eau Entree Arriere",
    "Longueur",
    "Tirant Eau",
    "Date Entrée au Port",
    "Heure Entrée au Port",
    "Date Entree Mouillage",
    "Heure Entree Mouillage",
    "Date Sortie Mouillage",
    "Heure Sortie Mouillage",
    "Date Accostage",
    "Heure Accostage",
    "Date App Quai",
    "Heure App Quai",
    "Poste Accostage",
    "Date Appareillage Port",
    "Heure Appareillage Port",
    "Sejour Mouillage (Jours)",
    "Sejour Quai (Jours)",
    "Sejour Port (Jours)",
    "Marchandise DAP Import",
    "Marchandise DAP Export",
    "Tonnage DAP Import",
    "Tonnage DAP Export",
    "Nbr Remorque Accostage",
    "Nbr Remorque Appareillage",
    "Provenances",
]

VESSEL_NAME = "Navire"
VESSEL_TYPE = "Type Navire"
GROSS_TONNAGE = "Jauge Brute"
LENGTH = "Longueur"
DRAFT = "Tirant Eau"
DATE_ARRIVAL = "Date Entrée au Port"
TIME_ARRIVAL = "Heure Entrée au Port"
DATE_ANCHORAGE_IN = "Date Entree Mouillage"
DATE_BERTHING = "Date Accostage"
TIME_BERTHING = "Heure Accostage"
DATE_UNBERTHING = "Date App Quai"
TIME_UNBERTHING = "Heure App Quai"
BERTH_ID = "Poste Accostage"
STAY_QUAY_DAYS = "Sejour Quai (Jours)"
CARGO_IMPORT = "Marchandise DAP Import"
CARGO_EXPORT = "Marchandise DAP Export"
TONNAGE_IMPORT = "Tonnage DAP Import"
TONNAGE_EXPORT = "Tonnage DAP Export"
TUGS_BERTHING = "Nbr Remorque Accostage"

# Derived column names added by cleaning
ARRIVAL_DT = "arrival_datetime"
BERTHING_DT = "berthing_datetime"
UNBERTHING_DT = "unberthing_datetime"
WAITING_HOURS = "waiting_time_hours"
SERVICE_HOURS = "service_time_hours"
ANCHORAGE_FLAG = "anchored_before_berthing"
ARRIVAL_MONTH = "arrival_month"
ARRIVAL_DOW = "arrival_day_of_week"

# ============================================================================
# FIXED VALUES — thresholds and defaults
# ============================================================================
MIN_SERVICE_HOURS = 0.5
MAX_SERVICE_HOURS = 720.0          # 30 days
TRAIN_RATIO = 0.80
RANDOM_SEED = 42
PORT_MIN_DRAFT_M = 7.0
PORT_MAX_DRAFT_M = 14.0
LATE_ARRIVAL_HOURS = 2.0           # replan when delay is strictly greater
CONGESTION_ALERT_VESSELS = 10
DIRECT_BERTHING_HOURS = 0.1        # wait strictly below counts as direct
ON_TIME_WINDOW_HOURS = 1.0         # |planned - actual| <= 1 h is accurate
UTILIZATION_HORIZON_HOURS = 24.0
DEFAULT_SERVICE_HOURS = 12.0
MIN_PREDICTED_SERVICE_HOURS = 0.5
NEXT_SLOT_GAP_SECONDS = 60         # reservations starting within 1 min are chained
CLOSURE_HOURS = 24
CLOSURE_RELEASE_MINUTES = 10
LATE_SCENARIO_DELAY_HOURS = 6
MAINTENANCE_BERTHS = ["72", "30"]
OFFLINE_MARK = "__OFFLINE__"
EXTRA_SUFFIX = "_EXTRA"

# Call fallbacks used when a field is null or not numeric
FALLBACK_TYPE = "CARGO_GENERAL"
FALLBACK_LENGTH_M = 150.0
FALLBACK_DRAFT_M = 8.0
FALLBACK_CARGO_IMPORT = "General Cargo"
FALLBACK_CARGO_EXPORT = ""
FALLBACK_TONNAGE = 0.0
FALLBACK_TUGS = 1
FALLBACK_GROSS = 0

# Texts that mean "no cargo"
NO_CARGO_TEXTS = ["", "nan", "NaN"]

# ============================================================================
# FIXED VALUES — berth range keys of the port document: key, member ids,
# fallback quay length m, fallback depth m, fallback terminal name
# ============================================================================
BERTH_RANGES = [
    ("30_to_36", ["30", "31", "32", "33", "34", "35", "36"], 1500.0, 9.0,
     "Main General Cargo Terminal"),
    ("40_to_44", ["40", "41", "42", "43", "44"], 400.0, 8.0,
     "Ro-Ro & Passenger Terminal"),
    ("A2_to_A5", ["A2", "A3", "A4", "A5"], 300.0, 8.0,
     "Ro-Ro & Passenger Terminal"),
    ("50_to_54", ["50", "51", "52", "53", "54"], 700.0, 9.2,
     "Container Terminal (SOMAPORT)"),
    ("70_to_74", ["70", "71", "72", "73", "74"], 600.0, 12.0,
     "East Container Terminal (Marsa Maroc)"),
    ("80_to_83", ["80", "81", "82", "83"], 600.0, 12.0,
     "East Container Terminal (Marsa Maroc)"),
]

# FIXED VALUES — individual berth fallback specs: id, quay length m, depth m
BERTH_FALLBACK_SPECS = [
    ("20", 300.0, 10.5),
    ("21", 300.0, 10.5),
    ("60", 300.0, 10.5),
    ("61", 300.0, 10.5),
]

# FIXED VALUES — vessel type code -> display label
VESSEL_TYPE_LABELS = [
    ("PORTE_CONTENEUR", "Container Ship"),
    ("VRAQUIER", "Bulk Carrier"),
    ("CARGO_GENERAL", "General Cargo"),
    ("ROULIER", "Ro-Ro"),
]

# FIXED VALUES — vessel profiles: type, import cargo, export cargo,
# length range m, draft range m, gross tonnage range, tug range
VESSEL_PROFILES = [
    ("PORTE_CONTENEUR", "Containers", "Containers", (150.0, 300.0), (9.5, 13.0), (15000, 80000), (2, 4)),
    ("VRAQUIER", "Grains", "", (150.0, 220.0), (8.5, 12.0), (20000, 60000), (2, 3)),
    ("VRAQUIER", "Coal", "", (140.0, 200.0), (8.0, 11.0), (15000, 45000), (2, 3)),
    ("VRAQUIER", "", "Phosphates", (170.0, 240.0), (9.0, 12.5), (25000, 55000), (2, 4)),
    ("CARGO_GENERAL", "General Cargo", "", (100.0, 180.0), (7.0, 10.0), (5000, 25000), (1, 2)),
    ("ROULIER", "Ro-Ro", "Ro-Ro", (140.0, 200.0), (6.5, 9.0), (10000, 30000), (1, 2)),
]

# ============================================================================
# Schemas
# ============================================================================
RAW_CALLS_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

# Terminal specifications are free-form; a map keeps "{}" (no specs) apart
# from "specs without length/depth" (numbers and arrays arrive as JSON text).
_SPECS = T.MapType(T.StringType(), T.StringType())
_TERMINAL = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("operator", T.StringType()),
    T.StructField("specifications", _SPECS),
    T.StructField("berths", T.ArrayType(T.StringType())),
])
_BERTH_DETAIL = T.StructType([
    T.StructField("cargo_types", T.ArrayType(T.StringType())),
    T.StructField("vessel_types", T.ArrayType(T.StringType())),
    T.StructField("notes", T.StringType()),
])
PORT_BODY_SCHEMA = T.StructType([
    T.StructField("terminals", T.ArrayType(_TERMINAL)),
    T.StructField("berths_details", T.MapType(T.StringType(), _BERTH_DETAIL)),
])

CALL_SCHEMA = T.StructType([
    T.StructField("port_id", T.StringType()),
    T.StructField("call_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("vessel_type", T.StringType()),
    T.StructField("gross_tonnage", T.IntegerType()),
    T.StructField("length_m", T.DoubleType()),
    T.StructField("draft_m", T.DoubleType()),
    T.StructField("cargo_import", T.StringType()),
    T.StructField("cargo_export", T.StringType()),
    T.StructField("tonnage_import", T.DoubleType()),
    T.StructField("tonnage_export", T.DoubleType()),
    T.StructField("tugs_at_berthing", T.IntegerType()),
    T.StructField("arrival_month", T.IntegerType()),
    T.StructField("arrival_dow", T.IntegerType()),
    T.StructField("eta", T.TimestampNTZType()),
    T.StructField("is_priority", T.BooleanType()),
])

BERTH_SCHEMA = T.StructType([
    T.StructField("port_id", T.StringType()),
    T.StructField("berth_id", T.StringType()),
    T.StructField("terminal_name", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("quay_length_m", T.DoubleType()),
    T.StructField("depth_m", T.DoubleType()),
    T.StructField("allowed_cargos", T.ArrayType(T.StringType())),
    T.StructField("allowed_types", T.ArrayType(T.StringType())),
    T.StructField("operator", T.StringType()),
])
