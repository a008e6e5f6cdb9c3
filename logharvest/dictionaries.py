"""Default dictionaries. Every operator takes its dictionary as an argument.

All of them are small by nature (tens of rows written by hand), so operators
compile them into column expressions instead of joining a table.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Results are only comparable when these are exactly as below.
# ---------------------------------------------------------------------------

# Modules whose import makes a file interesting. The doubled "n" in the last
# entry is part of the published data set; see ``libraries(fix_warnings=True)``.
LIBRARIES = [
    "comet_ml",
    "whylogs",
    "wandb",
    "tensorboard",
    "mlflow",
    "tensorflow",
    "neptune",
    "dowel",
    "sacred",
    "ml_logger",
    "logging",
    "warnnings",
]

# Which of them are general purpose; the rest are ML-specific.
GENERAL_LIBRARIES = ["logging", "warnnings"]

# A call whose text starts with one of these configures logging, it does not log.
CONFIG_PREFIXES = {
    "logging": [
        "logging.basicConfig",
        "logging.getLogger",
        "logging.config.fileConfig",
        "logging.Formatter",
        "logging.config.dictConfig",
        "logging.disable",
        "logging.getLevelName",
        "log.getLogger",
        "logging.shutdown",
        "logger.setLevel",
        "logger.addHandler",
        "logger.removeHandler",
        "logger.propagate",
        "logging.FileHandler",
        "logger.handlers",
        "logging.addLevelName",
        "logging.StreamHandler",
        "basicConfig",
        "inference_logger",
        "logging.getLogRecordFactory",
        "logging.log",
        "logging.Logger",
        "logging.LogRecord",
        "test_util",
        "util",
        "logging.captureWarnings",
    ],
    "wandb": [
        "wandb.init",
        "wandb.login",
        "wandb.setup",
        "wandb.require",
        "wandb.config.update",
        "wandb.finish",
        "wandb.Api()",
    ],
    "mlflow": [
        "mlflow.set_tracking_uri",
        "mlflow.set_experiment",
        "mlflow.start_run",
        "mlflow.end_run",
        "mlflow.create_experiment",
        "mlflow.set_registry_uri",
        "mlflow.set_tag",
        "mlflow.delete_tag",
        "mlflow.set_tags",
        "mlflow.get_tag",
        "mlflow.get_run",
        "mlflow.get_experiment",
        "mlflow.get_tracking_uri",
        "mlflow.active_run",
        "mlflow.last_active_run",
    ],
    "tensorboard": [
        "tensorboard.program.TensorBoard",
        "tensorboard.summary.create_file_writer",
        "tensorboard.summary.experimental_setup",
        "tensorboard.summary.experimental_run",
        "tensorboard.default.get_logger",
        "plugin_util",
        "context.RequestContext",
        "default.get_assets_zip_provider",
        "db.Connection",
        "db.Schema",
        "data_compat.migrate_value",
        "util.encode_png",
        "expand_dims",
        "random.categorical",
    ],
    "neptune": [
        "neptune.init",
        "neptune.init_run",
        "neptune.init_project",
        "neptune.new.init_run",
        "neptune.new.init_project",
        "neptune.login",
    ],
    "comet_ml": [
        "comet_ml.API",
        "comet_ml.config.get_config",
        "comet_ml.Experiment",
        "comet_ml.start",
        "comet_ml.init",
        "comet_ml.login",
    ],
    "whylogs": [
        "whylogs.init",
        "whylogs.get_or_create_session",
        "whylogs.logger.init",
        "whylogs.container.init_logger",
    ],
    "tensorflow": ["tf.summary"],
    "dowel": ["dowel.set_logger", "tabular.prefix"],
    "sacred": ["sacred.initialize"],
    "ml_logger": [
        "ml_logger.logger.configure",
        "ml_logger.logger.set_directory",
        "logger.Prefix",
        "logger.Sync",
        "logger.configure",
        "logger.SyncContext",
        "logger.job_completed",
        "logger.job_errored",
        "logger.job_started",
        "logger.job_created",
        "logger.job_running",
    ],
    "warnings": [
        "warnings.filterwarnings",
        "warnings.simplefilter",
        "warnings.resetwarnings",
        "warnings.catch_warnings",
    ],
}

# Levels recognised in ``logging.<level>(``.
LOG_LEVELS = ["info", "debug", "warning", "warn", "error", "critical", "fatal", "exception", "log"]

# Levels recognised in ``tf.compat.v1.logging.<level>(``.
TF_LOG_LEVELS = [
    "debug", "error", "fatal", "flush", "info", "log", "log_every_n",
    "log_first_n", "log_if", "vlog", "warn", "warning",
]

# TensorFlow and Keras calls that are not logging.
TF_OTHER_PREFIXES = ["tf.", "tf_", "tf_module.", "keras.", "tensorflow."]

# (framework, term) in search order.
FRAMEWORK_TERMS = [
    ("comet_ml", "comet_ml"),
    ("whylogs", "whylogs"),
    ("wandb", "wandb"),
    ("tensorboard", "tensorboard"),
    ("tensorboard", "tensorboardX"),
    ("mlflow", "mlflow"),
    ("neptune", "neptune"),
    ("neptune", "neptune.new"),
    ("dowel", "dowel"),
    ("sacred", "sacred"),
    ("ml_logger", "ml_logger"),
    ("logging", "logging"),
    ("warnings", "warnings"),
]

# (library, log level, quota). "warn" shares the quota of "warning".
SAMPLE_PLAN = [
    ("wandb", None, 237),
    ("neptune", None, 114),
    ("tensorflow", None, 26),
    ("mlflow", None, 215),
    ("comet_ml", None, 76),
    ("dowel", None, 179),
    ("ml_logger", None, 106),
    ("tensorboard", None, 141),
    ("whylogs", None, 3),
    ("sacred", None, 2),
    ("logging", "warning", 293),
    ("logging", "info", 477),
    ("logging", "exception", 92),
    ("logging", "debug", 227),
    ("logging", "error", 232),
    ("logging", "fatal", 10),
    ("logging", "critical", 18),
]

# How many snippets are labelled by default.
LABEL_SAMPLE_SIZE = 1410

# Logging smells, in matching order.
SMELLS = [
    "Ambiguous Logging",
    "Misleading Logging",
    "Heavy Logging",
    "Misconfigured Logging",
    "Misrouted Metric Logging",
    "Metric Overwrite",
    "Log Without Context",
    "Missing Hyperparameter Logging",
    "Print-Based Metrics",
    "Print Logging",
    "Logging Sensitive Data",
    "Incorrect Log Level",
]

# (pattern found in a survey question, short label), in matching order.
QUESTION_TYPES = [
    ("do you agree", "Agreement"),
    ("how frequently", "Frequency"),
    ("how relevant", "Relevance"),
    ("how severe", "Severity"),
    ("in your own words|explain|describe", "Justification"),
]

# Raw survey answer -> scale label.
LIKERT_NORMAL_FORMS = {
    "Not sure": "Neutral",
    "Not sure / I can’t assess": "Neutral",
    "Not sure / depends heavily on context": "Neutral",
    "Rarely (a few times per year)": "Rarely",
    "Sometimes (a few times per quarter)": "Sometimes",
    "Often (monthly)": "Often",
    "Very often (weekly or more)": "Very often",
    "Not relevant at all": "Not relevant",
    "Minor": "Slightly severe",
    "Moderate": "Moderately severe",
    "Severe": "Very severe",
    "Critical": "Extremely severe",
}

# Answer scales, in display order.
LIKERT_SCALES = {
    "Agreement": ["Strongly disagree", "Disagree", "Neutral", "Agree", "Strongly agree"],
    "Frequency": ["Never", "Rarely", "Sometimes", "Often", "Very often", "Always"],
    "Relevance": [
        "Neutral", "Not relevant", "Slightly relevant", "Moderately relevant",
        "Very relevant", "Extremely relevant",
    ],
    "Severity": [
        "Neutral", "Not severe", "Slightly severe", "Moderately severe",
        "Very severe", "Extremely severe",
    ],
}

# Cells that mean "no value" in an annotation workbook export.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


def libraries(fix_warnings: bool = False) -> list[str]:
    """Library modules; ``fix_warnings`` spells ``warnings`` correctly."""
    return [_fixed(name) if fix_warnings else name for name in LIBRARIES]


def general_libraries(fix_warnings: bool = False) -> list[str]:
    return [_fixed(name) if fix_warnings else name for name in GENERAL_LIBRARIES]


def _fixed(name: str) -> str:
    return "warnings" if name == "warnnings" else name


def config_prefixes() -> list[str]:
    """All configuration prefixes, whatever their library."""
    return sorted({p for prefixes in CONFIG_PREFIXES.values() for p in prefixes})
