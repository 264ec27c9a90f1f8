"""Fixed values that results depend on, in one place."""

# Scoring parameters of a job and the value used when one is missing.
SCORING_DEFAULTS = {
    "base_score": 51.0,
    "score_boost": 0.0,
    "project_priority": 25.0,
    "enable_wfp": 1.0,
    "enable_fifo": 0.0,
    "enable_backfill": 0.0,
    "wfp_factor": 100000.0,
    "fifo_factor": 1800.0,
    "backfill_factor": 84600.0,
    "backfill_max": 50.0,
    "queue_priority": 0.0,
}

# Machine size: all nodes, and the accounting denominator.
TOTAL_NODES = 10624
PRODUCTION_NODES = 9600

# Size tiers: name, min nodes, max nodes, walltime cap (h), base priority, ageing rate.
SIZE_TIERS = [
    ("capacity", 1, 128, 168.0, 5.0, 0.5),
    ("small", 129, 512, 72.0, 20.0, 2.0),
    ("medium", 513, 2048, 48.0, 40.0, 5.0),
    ("large", 2049, 10624, 24.0, 80.0, 10.0),
]

# Allocation type in the raw trace -> program label.
PROGRAM_MAP = {"INCITE": "INCITE", "ALCC": "ALCC", "Discretionary": "DD"}

# Queues named R, M or S plus a number belong to reservations.
RESERVATION_QUEUE = r"^[RMS]\d+$"

# Queue limits when the definition names none.
QUEUE_DEFAULTS = {"min_nodes": 1, "max_nodes": 10624, "max_walltime_h": 24.0, "queue_priority": 0.0}

YEAR_H = 8760.0
WAIT_QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}

# Synthetic program scenarios: node mix, walltime mix (value, weight), runtime ratio mean and spread.
SCENARIOS = {
    "ai_default": (
        [(1, 0.70), (2, 0.12), (4, 0.08), (8, 0.05), (16, 0.03), (64, 0.015), (256, 0.005)],
        [(168.0, 0.55), (96.0, 0.20), (48.0, 0.12), (24.0, 0.08), (6.0, 0.05)], 0.85, 0.12),
    "incite_like": (
        [(256, 0.30), (512, 0.30), (1024, 0.25), (2048, 0.15)],
        [(6.0, 0.20), (12.0, 0.35), (18.0, 0.25), (24.0, 0.20)], 0.90, 0.08),
    "bursty_campaign": (
        [(64, 0.20), (128, 0.25), (256, 0.30), (512, 0.20), (1024, 0.05)],
        [(6.0, 0.30), (12.0, 0.30), (24.0, 0.25), (48.0, 0.10), (96.0, 0.05)], 0.80, 0.15),
}
