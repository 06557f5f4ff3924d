"""Table schemas, as DDL strings usable with `spark.read.schema`."""

RAW_SCRAPES = (
    "host STRING, source STRING, scrape_id STRING, ts_s BIGINT, format STRING, payload STRING"
)

SAMPLES = (
    "host STRING, scrape_id STRING, seq BIGINT, name STRING, ts_s BIGINT, value DOUBLE, "
    "value_raw STRING, value_kind STRING, check_type STRING, chart_type STRING, reaction INT, "
    "tags MAP<STRING,STRING>"
)

HISTOGRAM_BUCKETS = "host STRING, scrape_id STRING, name STRING, le STRING, cumulative DOUBLE"
STATUS_ROWS = "host STRING, scrape_id STRING, ts_s BIGINT, variable STRING, value STRING"
THRESHOLDS = "metric STRING, warn DOUBLE, crit DOUBLE, emit_ok BOOLEAN, enabled BOOLEAN"
IDENTITY = "host STRING, cluster STRING, `group` STRING, location STRING"
OID_NAMES = "device STRING, oid STRING, name STRING"
CODE_LABELS = "code STRING, label STRING"
METRIC_RECIPES = (
    "source STRING, match STRING, metric STRING, style STRING, chart_type STRING, "
    "reaction INT, enabled BOOLEAN"
)
PLUGIN_RESULTS = "host STRING, ts_s BIGINT, plugin STRING, exit_code INT, output STRING"
RUN_LOG = "host STRING, scrape_id STRING, check STRING, started DOUBLE, ended DOUBLE"
BATCHES = "batch_id STRING, seq BIGINT, body STRING"
OUTCOMES = "batch_id STRING, code INT"
HEALTH_EVENTS = (
    "host STRING, module STRING, ts_s BIGINT, value INT, status STRING, message STRING, reaction INT"
)

# Columns that tell one counter from another.
SERIES = ("host", "name", "tags")
