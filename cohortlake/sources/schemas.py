"""Explicit schemas of the study's input files."""

# Fixed values (must equal the source files' headers and codings).
SMARTWATCH = "user_key INT, date SMALLINT, time STRING, activity_type FLOAT, intensity FLOAT, steps FLOAT, hr FLOAT"
WEEKLY = (
    "user_key INT, date INT, weekly_night_symp INT, weekly_day_symp INT, weekly_limit_activity INT, "
    "weekly_short_breath INT, weekly_wheeze INT, weekly_relief_inhaler INT, weekly_doc STRING, "
    "weekly_hospital STRING, weekly_er STRING, weekly_oral INT"
)
DAILY = (
    "user_key INT, date INT, daily_night_symp STRING, daily_day_symp STRING, daily_limit_activity STRING, "
    "daily_prev_inhaler INT, daily_relief_inhaler INT, daily_triggers STRING"
)
INHALER = "user_key INT, date INT, hour INT, name STRING"
PEAKFLOW = "user_key INT, date INT, hour INT, pef_max DOUBLE, morning BOOLEAN"
ENVIRONMENT_NUMERIC = [
    "temperature", "temperature_min", "temperature_max", "pressure", "humidity", "wind_speed", "wind_deg", "aqi",
    "co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3",
]
POLLEN_COLUMNS = ["grass_pollen", "tree_pollen", "weed_pollen"]
ENVIRONMENT = (
    "user_key INT, date INT, "
    + ", ".join(f"{c} DOUBLE" for c in ENVIRONMENT_NUMERIC)
    + ", "
    + ", ".join(f"{c} STRING" for c in POLLEN_COLUMNS)
)
PATIENT_CATEGORICAL = [
    "sex", "age_range", "bmi_range", "age_diagnosed_range", "smoker", "race", "severity", "region", "nation",
]
PATIENT_NUMERIC = [
    "max_pef_expected", "pef_best", "n_inhalers", "pack_years", "phase2_start", "daily_start_date",
    "weekly_start_date", "miband_start_date", "pef_start_date", "inhaler_start_date", "daily_end_date",
    "weekly_end_date", "miband_end_date", "pef_end_date", "inhaler_end_date", "phase2_end",
]
SYMPTOM_COLUMNS = [
    "weekly_night_symp", "weekly_day_symp", "weekly_limit_activity", "weekly_short_breath", "weekly_wheeze",
    "weekly_relief_inhaler",
]
DIRECT_EVENT_FIELDS = ["weekly_doc", "weekly_hospital", "weekly_er"]
LABEL_STRATEGY = "questionnaire_event_episode_labeling"
SPLIT_MANIFEST = (
    "seed BIGINT, val_frac DOUBLE, test_frac DOUBLE, train_users ARRAY<BIGINT>, val_users ARRAY<BIGINT>, "
    "test_users ARRAY<BIGINT>"
)

