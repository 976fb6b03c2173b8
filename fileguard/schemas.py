"""Table schemas and the fixed feature order."""

from __future__ import annotations

from pyspark.sql import types as T

FILE_EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.DoubleType(), False),
        T.StructField("drive_id", T.LongType(), False),
        T.StructField("stable_id", T.LongType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("local_title", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("old_local_title", T.StringType()),
        T.StructField("full_path", T.StringType()),
    ]
)

# The twelve features in model order; training files spell three of them with a hyphen or capitals.
TRAINING_COLUMNS = [
    "File_Delete_archived",
    "File_created",
    "process-related",
    "network-related",
    "file-related",
    "suspicious_path",
    "system_executable",
    "path_length",
    "directory_depth",
    "process_name_length",
    "extension_similarity",
    "file_name_entropy",
]
FEATURES = [name.lower().replace("-", "_") for name in TRAINING_COLUMNS]
LABEL_COLUMN = "Ware Type"

_REAL_FEATURES = {"extension_similarity", "file_name_entropy"}
TRAINING_RAW = T.StructType(
    [T.StructField(LABEL_COLUMN, T.StringType())]
    + [
        T.StructField(name, T.DoubleType() if name in _REAL_FEATURES else T.IntegerType())
        for name in TRAINING_COLUMNS
    ]
)

_TRIGGER = T.StructType([f for f in FILE_EVENTS.fields if f.name != "drive_id"])
ALERT_LOG = T.StructType(
    [
        T.StructField("drive_id", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("threat_level", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("affected_files_count", T.LongType()),
        T.StructField("triggering_event", _TRIGGER),
        T.StructField("sync_paused", T.BooleanType()),
    ]
)

_PATTERN = T.StructType(
    [T.StructField("threshold", T.IntegerType()), T.StructField("window_seconds", T.IntegerType())]
)
LEARNED_CONFIG = T.StructType(
    [
        T.StructField(
            "likelihood_ratios",
            T.StructType(
                [T.StructField("high_velocity", T.DoubleType()), T.StructField("systematic_rename", T.DoubleType())]
            ),
        ),
        T.StructField(
            "micropattern_thresholds",
            T.StructType([T.StructField("high_velocity", _PATTERN), T.StructField("systematic_rename", _PATTERN)]),
        ),
        T.StructField(
            "alert_thresholds",
            T.StructType([T.StructField(n, T.DoubleType()) for n in ("alert", "pause", "critical")]),
        ),
        T.StructField(
            "hmm_parameters",
            T.StructType(
                [T.StructField(n, T.IntegerType()) for n in ("sequence_length", "n_states", "n_sequences_per_class")]
            ),
        ),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("generated_at", T.StringType()),
                    T.StructField("training_samples", T.LongType()),
                    T.StructField("user_events", T.LongType()),
                    T.StructField("optimization_method", T.StringType()),
                    T.StructField("version", T.StringType()),
                ]
            ),
        ),
    ]
)

HMM_MODEL = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("pi", T.ArrayType(T.DoubleType())),
        T.StructField("a", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("mu", T.ArrayType(T.DoubleType())),
        T.StructField("var", T.ArrayType(T.DoubleType())),
        T.StructField("malicious_state", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
    ]
)
