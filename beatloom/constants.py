"""Fixed values of the data model (stated plainly; results depend on them)."""

# Signal geometry.
SAMPLING_HZ = 500
NUM_LEADS = 12
LEAD_II = 1
MIN_PEAKS = 4
PAD_LENGTH = 800
MAX_SIGNAL = 20000

# Segment order and the landmark pair that bounds each segment.
SEGMENTS = ["P", "PQ", "QRS", "ST", "T", "TP"]
MODEL_SEGMENTS = ["P", "PQ", "QRS", "ST", "T"]
SEGMENT_LENGTHS = {"P": 88, "PQ": 88, "QRS": 176, "ST": 128, "T": 120}

# Token vocabulary and sentence shape.
PAD, SEP, MASK, FIRST_TOKEN = 0, 1, 2, 3
SENTENCE_BEATS = [1, 2, 6, 8]
MAX_BEATS = 8
SENTENCE_WIDTH = MAX_BEATS * len(MODEL_SEGMENTS) + 1
CODEBOOK_SIZE = 48

# Drop reasons in order of precedence.
DROP_REASONS = [
    "failed_read",
    "empty",
    "missing_12_leads",
    "failed_cleaning",
    "ecg_peaks_error",
    "too_few_r_peaks",
    "ecg_delineate_error",
    "no_beat_cycles",
]

SEED = 42
