"""Fixed values that results depend on.

Everything here is data, stated once and plainly; changing any of it changes
query results.
"""

# --- Fixed values: physics -------------------------------------------------
EARTH_RADIUS_KM = 6371.0088
Z_95 = 1.959963984540054  # standard normal quantile at 0.975
ROBUST_SPAN = 2.5631031310892007  # normal q90 - q10, unit-variance scaling

# --- Fixed values: event schema --------------------------------------------

# Column order of a harmonised catalogue row and its Spark type.
EVENT_FIELDS = (
    ("event_id", "string"),
    ("source_event_id", "string"),
    ("source", "string"),
    ("origin_time_utc", "timestamp"),
    ("latitude", "double"),
    ("longitude", "double"),
    ("depth_km", "double"),
    ("magnitude_value", "double"),
    ("magnitude_type", "string"),
    ("magnitude_original_value", "double"),
    ("magnitude_original_type", "string"),
    ("magnitude_comparable", "double"),
    ("magnitude_homogenization_method", "string"),
    ("magnitude_conversion_equation", "string"),
    ("magnitude_conversion_uncertainty", "double"),
    ("magnitude_homogenization_status", "string"),
    ("intensity_max", "string"),
    ("location_text", "string"),
    ("felt", "boolean"),
    ("location_uncertainty_km", "double"),
    ("magnitude_uncertainty", "double"),
    ("tectonic_domain", "string"),
    ("domain_confidence", "double"),
    ("historical_quality", "string"),
    ("quality_score", "double"),
    ("record_status", "string"),
    ("source_url", "string"),
    ("source_file", "string"),
    ("duplicate_group_id", "string"),
    ("is_preferred_record", "boolean"),
    ("cluster_id", "string"),
    ("cluster_role", "string"),
    ("is_background_event", "boolean"),
    ("declustering_method", "string"),
    ("declustering_eligible", "boolean"),
    ("declustering_exclusion_reason", "string"),
    ("ingested_at_utc", "timestamp"),
)

# Inclusive physical bounds; anything outside becomes NULL.
PLAUSIBLE_RANGE = {
    "latitude": (-90.0, 90.0),
    "longitude": (-180.0, 180.0),
    "depth_km": (-10.0, 800.0),
    "magnitude_value": (-3.0, 10.5),
    "magnitude_comparable": (-3.0, 10.5),
    "magnitude_original_value": (-3.0, 10.5),
    "magnitude_conversion_uncertainty": (0.0, 10.0),
    "location_uncertainty_km": (0.0, 5000.0),
    "magnitude_uncertainty": (0.0, 10.0),
    "domain_confidence": (0.0, 1.0),
    "quality_score": (0.0, 1.0),
}

EVENT_ID_PREFIX = "MEM-"

# --- Fixed values: text tokens ---------------------------------------------
TRUE_TOKENS = ("true", "1", "yes", "sim", "s", "felt")
FALSE_TOKENS = ("false", "0", "no", "não", "nao", "n")

# --- Fixed values: magnitudes ----------------------------------------------
MOMENT_MAGNITUDE_TYPES = ("MW", "MWW", "MWC", "MWR", "MWB", "MWP")
VALIDATED_STATUSES = ("reviewed_identity", "reviewed_conversion", "approved_conversion")
FALLBACK_STATUSES = ("review_required", "unknown_scale")
IDENTITY_EQUATION = "Mcomp = Mw"
FALLBACK_EQUATION = "Mcomp ≈ Moriginal (conversão não validada)"
NO_EQUATION = "—"

# --- Fixed values: de-duplication preference -------------------------------
SOURCE_PRIORITY = {"IPMA": 5, "IPMA_HISTORICAL": 4, "ISC": 4, "AHEAD": 3, "DEMO": 1}
STATUS_PRIORITY = {"reviewed": 3, "historical": 2, "preliminary": 1, "demo": 0}

# --- Fixed values: observation epochs (key, label, first year, last year, floor)
EPOCHS = (
    ("historical_pre_instrumental", "Histórica pré-instrumental", 1000, 1899, 5.0),
    ("early_instrumental", "Instrumental inicial", 1900, 1963, 4.0),
    ("modern_network", "Rede instrumental moderna", 1964, 2007, 3.0),
    ("contemporary_network", "Período instrumental contemporâneo", 2008, None, 1.5),
)

# --- Fixed values: pilot regions (lon, lat) --------------------------------
REGIONS = (
    (
        "Margem Sudoeste Ibérica",
        (
            (-14.8, 34.0), (-7.0, 34.0), (-7.0, 38.4),
            (-9.1, 39.0), (-11.8, 39.3), (-14.8, 38.3),
        ),
    ),
    (
        "Vale Inferior do Tejo",
        (
            (-9.65, 38.35), (-8.55, 38.35), (-8.3, 39.45),
            (-9.1, 39.7), (-9.7, 39.1),
        ),
    ),
)
OUTSIDE_REGION = "Fora dos domínios piloto"
UNCLASSIFIED_REGION = "Não classificado"
NEAR_REGION_DEGREES = 0.25
REGION_CONFIDENCE = {"single": 0.9, "overlap": 0.85, "near": 0.45, "outside": 0.2, "missing": 0.0}

# --- Fixed values: declustering --------------------------------------------
DECLUSTER_METHOD = "pilot_adaptive_space_time_v2"

# --- Fixed values: fingerprint features and weights ------------------------
FEATURE_WEIGHTS = {
    "comparable_event_count": 1.00,
    "comparable_event_rate_per_30d": 1.10,
    "maximum_magnitude": 1.15,
    "mean_magnitude": 0.85,
    "median_depth_km": 0.70,
    "depth_std_km": 0.60,
    "spatial_dispersion_km": 0.85,
    "log10_total_energy_j": 1.00,
    "days_since_previous_m3": 0.70,
    "catalogue_completeness_mc": 0.70,
    "data_quality_score": 0.55,
}
SOURCE_SHARE_COLUMNS = (
    "source_share_ipma", "source_share_isc", "source_share_ahead", "source_share_other",
)
COVERAGE_COLUMNS = (
    "magnitude_coverage_ratio", "depth_coverage_ratio", "location_coverage_ratio",
)
# component: (weight, default when the value is missing, decay scale)
COMPATIBILITY = {
    "quality": (0.20, 0.60, 0.18),
    "completeness": (0.20, 0.55, 0.65),
    "threshold": (0.15, 0.50, 0.50),
    "coverage": (0.20, 0.65, None),
    "source_profile": (0.25, 0.50, None),
}
REGIME_FEATURES = (
    "comparable_event_rate_per_30d", "maximum_magnitude",
    "log10_total_energy_j", "spatial_dispersion_km",
)

# --- Fixed values: validation ----------------------------------------------
# label, probability column, Brier column
MODELS = (
    ("Famílias — score bruto", "analogue_probability", "brier_analogue"),
    ("Famílias — calibrado", "analogue_calibrated_probability", "brier_analogue_calibrated"),
    ("Frequência empírica", "historical_rate_probability", "brier_historical"),
    ("Poisson", "poisson_probability", "brier_poisson"),
)
DECISION_THRESHOLDS = (0.005, 0.01, 0.02, 0.05, 0.10)
GRID_THRESHOLDS = (3.5, 4.0, 4.5, 5.0)
GRID_HORIZONS = (7, 30, 90)

# --- Fixed values: activity states (label, level) --------------------------
STATE_MISSING = ("Inconclusivo — referência insuficiente", "watch")
STATE_SMALL = ("Inconclusivo — amostra efetiva reduzida", "watch")
STATE_EXCEPTIONAL = ("Elevação excecional robusta", "high")
STATE_ELEVATED = ("Atividade elevada com suporte estatístico", "high")
STATE_BASELINE = ("Sem evidência robusta de elevação", "normal")
STATE_CROSSING = ("Inconclusivo — intervalo atravessa o limiar", "watch")
LABEL_NONE = ("Sem referência", "neutral")
LABEL_HIGH = ("Atividade elevada", "high")
LABEL_WATCH = ("Em observação", "watch")
LABEL_NORMAL = ("Dentro da linha de base", "normal")

# --- Fixed values: display --------------------------------------------------
DASH = "—"
NO_DATE = "Data indisponível"
NO_LOCATION = "Localização não indicada"
NO_SOURCE = "Fonte não indicada"
SOURCE_DISPLAY = {
    "IPMA": "IPMA",
    "AHEAD": "AHEAD / EPICA",
    "ISC": "ISC",
    "IPMA_HISTORICAL": "IPMA histórico",
    "DEMO": "Demonstração",
}

# --- Fixed values: raw field aliases ---------------------------------------
FDSN_ALIASES = {
    "eventid": "event_id", "id": "event_id",
    "time": "time", "origintime": "time",
    "latitude": "latitude", "lat": "latitude",
    "longitude": "longitude", "lon": "longitude",
    "depthkm": "depth_km", "depth": "depth_km",
    "author": "author", "catalog": "catalog", "contributor": "contributor",
    "contributorid": "contributor_id",
    "magtype": "magnitude_type", "magnitudetype": "magnitude_type",
    "magnitude": "magnitude", "mag": "magnitude", "magauthor": "magnitude_author",
    "eventlocationname": "location", "region": "location",
    "place": "location", "location": "location",
}
FDSN_NULLS = ("", "NULL", "null", "NaN", "nan")
IPMA_ALIASES = {
    "id": ("id", "eventId", "event_id", "eventID", "shakeMapId"),
    "time": ("time", "datetime", "dateTime", "originTime", "obsTime"),
    "date": ("date", "data"),
    "hour": ("hour", "hora"),
    "latitude": ("latitude", "lat", "Lat"),
    "longitude": ("longitude", "lon", "lng", "Lon"),
    "magnitude": ("magnitud", "magnitude", "mag", "Magnitude", "Mw", "ML"),
    "magnitude_type": ("magType", "magnitudeType", "typeMagnitude"),
    "depth": ("depth", "depthKm", "profundidade", "H"),
    "intensity": ("degree", "intensity", "maxIntensity", "Io"),
    "location": ("local", "location", "region", "obsRegion", "description", "epicentralArea"),
    "felt": ("sensed", "felt", "sentido"),
}
AHEAD_ALIASES = {
    "id": ("EqID", "eqid", "id"),
    "latitude": ("Lat", "lat", "latitude"),
    "longitude": ("Lon", "lon", "longitude"),
    "year": ("Year", "year"),
    "month": ("Mo", "month"),
    "day": ("Da", "day"),
    "hour": ("Ho", "hour"),
    "minute": ("Mi", "minute"),
    "magnitude": ("Mw", "mw", "CMw", "MMw"),
    "depth": ("H", "depth"),
    "intensity": ("Ix", "Io", "CIo"),
    "location": ("Ax", "area", "Reg"),
    "latitude_uncertainty": ("LatUnc",),
    "longitude_uncertainty": ("LonUnc",),
    "magnitude_uncertainty": ("MwUnc", "CMwUnc", "MMwUnc"),
}
