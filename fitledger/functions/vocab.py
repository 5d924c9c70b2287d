"""Fixed values. Everything in this file must equal the published behaviour for
results to agree; it is kept as plain text and in natural order."""

# Approval states, in report order.
STATES = ["discovered", "matching", "needs_review", "complete", "failed", "superseded"]

# Categories a record may carry, and the order reports show them in.
CATEGORIES = ["intake", "boost", "cat", "engine", "exhaust", "ignition", "tune", "other"]
CATEGORY_DISPLAY_ORDER = ["intake", "boost", "exhaust", "cat", "engine", "ignition", "tune", "other"]

# Induction vocabulary of a record, and of an imported catalog.
INDUCTIONS = ["NA", "TURBO", "SC"]
CATALOG_INDUCTION = {"na": "NA", "carb": "NA", "turbo": "TURBO", "supercharged": "SC"}
INDUCTION_LABELS = {"NA": "N/A", "TURBO": "Turbo", "SC": "Supercharged"}

# Tiers, best first.
TIERS = ["exact", "high", "medium", "generic"]
TIER_LABELS = {
    "exact": "Exact match",
    "high": "High confidence",
    "medium": "Medium confidence",
    "generic": "Generic fit",
}
DISPLACEMENT_TOLERANCE = 0.15

# Thresholds and prices.
CONFIDENCE_FLOOR = 0.75
DIVERGENCE_CEILING = 0.4
QA_RATE = 0.05
MAX_ATTEMPTS = 3
HEAL_LIMIT = 3
TRANSIENT_CAP = 25
CORRUPT_CAP = 10
LEASE_SECONDS = 600
PRICE_IN_PER_MTOK = 0.75
PRICE_OUT_PER_MTOK = 3.75
CORPUS_DOCUMENTS = 6055

# Patterns that clean a vehicle model name, applied in this order.
MODEL_TRAILING_PARENS = r"\s*\(.*?\)\s*$"
MODEL_WEIGHT_SPEC = r"(?i)\s+(?:GVWR|PAYLOAD|BASE\s+PAYLOAD)\b.*$"
MODEL_DISPLACEMENT_SPEC = r"(?i)\s+\d+\.\d+L\b.*$"
MODEL_TRAILING_DIGITS = r"\s+\d{1,2}\s*$"
MODEL_SUFFIX_WORDS = [
    "2WD", "4WD", "AWD", "FWD", "RWD", "4x4",
    "Pickup", "Van", "Wagon", r"Cab(?:\s+Chassis)?", "Chassis",
    "Convertible", "Coupe", "Sedan", "Cabriolet", "Roadster", "Hatchback",
    "FFV", "Hybrid", r"Plug-in(?:\s+Hybrid)?", "EV", "Electric", "CNG", "Bifuel",
    "TrailBoss", "SFE", "M6",
    "1500", "2500", "3500", "HD", "15", "25", "35",
]
MODEL_SUFFIX = r"(?i)\s+\b(?:" + "|".join(MODEL_SUFFIX_WORDS) + r")\b(?:\s+.*)?$"
# Model words that lost their hyphen or have a combined name.
MODEL_WORDS = {
    "F150": "F-150", "F250": "F-250", "F350": "F-350", "F450": "F-450", "F550": "F-550",
    "E150": "E-150", "E250": "E-250", "E350": "E-350", "E450": "E-450",
    "C1500": "C/K 1500", "K1500": "C/K 1500",
    "C2500": "C/K 2500", "K2500": "C/K 2500",
    "C3500": "C/K 3500", "K3500": "C/K 3500",
}

# Cubic inches with a customary litre figure; others are computed.
CID_LITRES = {
    283: 4.64, 302: 4.95, 305: 5.0, 307: 5.03, 327: 5.36, 350: 5.74, 360: 5.9,
    390: 6.39, 400: 6.55, 427: 6.99, 454: 7.44, 460: 7.54, 496: 8.13, 502: 8.23,
}
LITRES_PER_CID = 0.016387

# Displacement and cylinder patterns (on lower-cased text where noted).
DISPLACEMENT_OPEN = r"\bup\s+to\b|\ball\b|\bany\b"
DISPLACEMENT_LITRES = r"(\d+\.?\d*)\s*-?\s*(?:l(?:iter)?s?)\b"
DISPLACEMENT_CID_PARENS = r"\((\d+)\s*cid\)"
DISPLACEMENT_CID = r"\b(\d{3,4})\s*-?\s*cid\b"
CYLINDERS_COUNT = r"(?i)\b(\d+)\s*-?\s*cyl(?:inder)?s?\b"
CYLINDERS_LAYOUT = r"\b[VvIi]-?(\d+)\b"

# Induction phrases, first hit wins.
INDUCTION_PHRASES = [
    ("naturally aspirated", "na"),
    ("non-turbo", "na"),
    ("supercharged", "supercharged"),
    ("super charged", "supercharged"),
    ("turbocharged", "turbo"),
    ("turbo charged", "turbo"),
    ("turbo", "turbo"),
    ("fuel injected", "fi"),
    ("fuel-injected", "fi"),
    ("carburetted", "carb"),
    ("carbureted", "carb"),
    ("carburetor", "carb"),
]

# Category rules, first hit wins, otherwise "other".
CATEGORY_RULES = [
    ("intake", ["air intake", "intake kit", "intake system", "cold air", "short ram",
                "filtercharger", "air filter"]),
    ("boost", ["supercharger", "turbocharger", "turbo kit", "intercooler", "boost controller"]),
    ("cat", ["catalytic converter", "cat conv", "catalytic"]),
    ("exhaust", ["exhaust header", "header kit", "muffler", "exhaust system", "exhaust pipe",
                 "down pipe", "cat-back", "shorty header", "shorty headers"]),
    ("tune", ["programmer", "power programmer", "map kit", "calibration", " ecu ", "tune kit"]),
    ("engine", ["cylinder head", "rocker arm", "camshaft", "cubic inch", "fuel injector",
                "injector", "throttle body", "carburetor", "carb kit", "fuel system",
                "intake manifold"]),
    ("ignition", ["ignition", "spark plug", "coil", "distributor", "ignitor"]),
]

# Makes outside the passenger-car catalog that are still real.
POWERSPORTS_MAKES = [
    "harley-davidson", "polaris", "can-am", "yamaha", "kawasaki", "suzuki", "ducati", "triumph",
    "aprilia", "victory", "indian", "ktm", "husqvarna", "arctic cat", "sea-doo", "ski-doo",
    "moto guzzi", "royal enfield",
]
# Other spellings of known makes.
MAKE_ALIASES = {
    "vw": "volkswagen", "chevy": "chevrolet", "mercedes": "mercedes-benz",
    "mercedes benz": "mercedes-benz", "gm": "chevrolet", "landrover": "land rover",
    "mini cooper": "mini", "infinity": "infiniti", "roush": "ford",
    "daimlerchrysler": "chrysler", "harley": "harley-davidson", "cummins": "dodge",
}

# Approval key format, version suffix, part-number limits, gate limits.
KEY_FORMAT = r"^[A-Z0-9]{1,3}(-[A-Z0-9]{1,6}){1,3}$"
VERSION_SUFFIX = r"_v(\d+)$"
PART_NUMBER_LENGTH = (2, 48)
PART_NUMBER_JUNK = "<>_{}"
YEAR_RANGE = (1900, 2035)
DISPLACEMENT_RANGE = (0.04, 120.0)

# Failure text markers.
CORRUPT_MARKERS = ["data format error", "pdfium", "failed to load document"]
PERMANENT_PREFIXES = ["400 "]
TOKEN_CAP_MARKERS = ["1048576", "1,048,576"]
TRANSIENT_PREFIXES = ["429 ", "500 ", "503 "]
TRANSIENT_MARKERS = ["RESOURCE_EXHAUSTED", "DEADLINE_EXCEEDED", "UNAVAILABLE"]

# Hints shown beside a failure.
HINT_RATE_LIMIT = "(rate-limit during bulk processing — safe to retry)"
HINT_TOO_LARGE = "(document exceeds the model's input limit)"

# Method tags of a match and source of a batch ingest outcome.
METHOD_DETERMINISTIC = "deterministic"
METHOD_RESOLVED = "gemini_resolved"
INGEST_OUTCOMES = ["complete", "needs_review", "bounced", "skipped", "retry", "failed"]
