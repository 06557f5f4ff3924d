"""Registering checks, the recipe table, and running the enabled checks over raw scrapes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checks.events import EVENT, Health, check_events
from tidemark.functions.numbers import as_int
from tidemark.operators.projections import normalise
from tidemark.operators.resume import SeriesState
from tidemark.operators.sets import union_samples
from tidemark.operators.windows import derive_styles
from tidemark.schema import METRIC_RECIPES
from tidemark.shared import stored
from tidemark.sources.opened import LINES, Opened, open_payloads

STATEFUL_STYLES = ("rate", "rate_int", "rate_tenth", "delta")

Extract = Callable[[DataFrame], DataFrame]
# Rows with several values side by side to samples, with the number of ranges and the saved state to go on from.
Derive = Callable[[DataFrame, int | None, SeriesState | None], DataFrame]


@dataclass(frozen=True)
class Recipe:
    """What becomes of one extracted name: metric, style (gauge or one of the stateful styles) and annotations."""

    match: str
    metric: str
    style: str = "gauge"
    chart_type: str | None = None
    reaction: int = 0


@dataclass(frozen=True)
class Check:
    """An extraction job for the payloads of one source.

    With recipes, only listed names pass and take their metric and style. Without,
    the job names its samples itself and may set `style` (gauge by default). `form` is how
    the job wants the payloads when they are opened for all checks at once. With `derive`,
    the extracted rows hold several values side by side and that function makes
    samples of them. `health` rules turn rows into events; rows of style `event` are there for them alone.
    """

    source: str
    extract: Extract
    recipes: Sequence[Recipe] = field(default_factory=tuple)
    check_type: str | None = None
    enabled: bool = True
    form: str = LINES
    derive: Derive | None = None
    health: Sequence[Health] = field(default_factory=tuple)


_CHECKS: dict[str, Check] = {}


def register(name: str, check: Check | Extract) -> Check:
    """Add a check; a plain function takes the name as its source."""
    if not isinstance(check, Check):
        check = Check(name, check)
    _CHECKS[name] = check
    return check


def registered() -> dict[str, Check]:
    return dict(_CHECKS)


def gauges(prefix: str, names: Iterable[str], lower: bool = True, **kw) -> list[Recipe]:
    return [Recipe(n, prefix + (n.lower() if lower else n), "gauge", **kw) for n in names]


def rates(prefix: str, names: Iterable[str], lower: bool = True, **kw) -> list[Recipe]:
    return [Recipe(n, prefix + (n.lower() if lower else n), "rate", "Rate", **kw) for n in names]


def as_samples(rows: DataFrame, metrics: dict[str, tuple[str, str | None, int]], tags: Column, keep: Sequence[str]) -> DataFrame:
    """Derived columns to samples: a map of columns to name, chart type and reaction; missing values are left out."""
    found = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(chart).cast("string").alias("chart_type"), F.lit(reaction).alias("reaction"), F.col(c).cast("double").alias("value"))
        for c, (n, chart, reaction) in metrics.items()
    ])
    out = rows.select(*keep, "seq", tags.alias("tags"), F.explode(found).alias("_m")).filter(F.col("_m.value").isNotNull())
    return out.select(
        *keep, "seq", "_m.name", "tags", F.col("_m.value").cast("string").alias("value_raw"), "_m.value", F.lit("float").alias("value_kind"),
        "_m.chart_type", "_m.reaction",
    )


def recipe_table(spark: SparkSession, checks: Iterable[Check]) -> DataFrame:
    """All recipes as a table, one row per (source, match); editable as data."""
    rows = [
        (c.source, r.match, r.metric, r.style, r.chart_type, r.reaction, c.enabled)
        for c in checks
        for r in c.recipes
    ]
    return spark.createDataFrame(rows, METRIC_RECIPES)


def enabled_recipes(recipes: DataFrame) -> DataFrame:
    return recipes.filter(F.col("enabled"))


def apply_recipes(samples: DataFrame, recipes: DataFrame) -> DataFrame:
    """Keep listed names and give them metric, style, chart type and reaction.

    The table goes to every task: joined by shuffle, all samples of one name would meet in one.
    """
    dim = enabled_recipes(recipes).select(
        "source", F.col("match").alias("name"), F.col("metric").alias("_metric"),
        F.col("style").alias("_style"), "chart_type", "reaction",
    )
    rows = samples.drop("style", "chart_type", "reaction")
    return (
        rows.join(F.broadcast(dim), ["source", "name"])
        .withColumn("name", F.col("_metric"))
        .withColumn("style", F.col("_style"))
        .drop("_metric", "_style")
    )


def apply_listed(samples: DataFrame, recipes: Sequence[Recipe]) -> DataFrame:
    """As `apply_recipes`, for a check's own short list: a literal look-up, no join."""
    found = F.create_map(
        *[
            x
            for r in recipes
            for x in (
                F.lit(r.match),
                F.struct(
                    F.lit(r.metric).alias("metric"), F.lit(r.style).alias("style"),
                    F.lit(r.chart_type).cast("string").alias("chart_type"), F.lit(r.reaction).alias("reaction"),
                ),
            )
        ]
    )
    rows = samples.drop("style", "chart_type", "reaction").filter(F.col("name").isin(*[r.match for r in recipes]))
    rows = rows.withColumn("_r", found[F.col("name")])
    return rows.withColumns({
        "name": F.col("_r.metric"), "style": F.col("_r.style"),
        "chart_type": F.col("_r.chart_type"), "reaction": F.col("_r.reaction"),
    }).drop("_r")


def derive(samples: DataFrame, ranges: int | None = None, resume: SeriesState | None = None) -> DataFrame:
    """Rates and deltas where the style asks for them; gauges pass without a shuffle.

    The result keeps one row per sample: `value` is the derived value, and `value_raw` its text, as encoders
    want it. With `resume` the counters go on from an earlier run's.
    """
    stateful = F.col("style").isin(*STATEFUL_STYLES)
    passed = samples.filter(~F.coalesce(stateful, F.lit(False)))
    counter = as_int(F.col("value_raw"), F.col("value_kind"), F.col("value"))
    moving = samples.filter(stateful).withColumn("_counter", counter)
    derived = derive_styles(moving, "_counter", "value", ("host", "source", "name", "tags"), ranges=ranges, resume=resume)
    whole = F.col("style") == "rate_int"
    derived = derived.withColumns({
        "value_raw": F.when(whole, F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string")),
        "value_kind": F.when(whole, "int").otherwise("float"),
    })
    return union_samples(passed, derived.drop("_counter"))


def _extracted(check: Check, payloads: DataFrame, recipes: DataFrame | None) -> DataFrame:
    rows = payloads.transform(check.extract)
    if check.recipes:
        rows = apply_listed(rows, check.recipes) if recipes is None else apply_recipes(rows, recipes)
    return _annotated(check, rows)


def _annotated(check: Check, rows: DataFrame) -> DataFrame:
    if "style" not in rows.columns:
        rows = rows.withColumn("style", F.lit("gauge"))
    kind = F.lit(check.check_type).cast("string")
    rows = rows.withColumn("check_type", F.coalesce("check_type", kind) if "check_type" in rows.columns else kind)
    for name, type_ in (("chart_type", "string"), ("reaction", "int")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(type_))
    return rows


def _together(parts: list[DataFrame]) -> DataFrame:
    out = union_samples(*parts).withColumn("reaction", F.coalesce("reaction", F.lit(0)))
    return normalise(out, "unknown")


def extract_all(raw: DataFrame, checks: Iterable[Check], recipes: DataFrame | None = None) -> DataFrame:
    """Samples of all enabled checks; each reads only its own source of a table laid out by source."""
    return _together([_extracted(c, raw.filter(F.col("source") == c.source), recipes) for c in checks if c.enabled])


def open_for(raw: DataFrame, checks: Iterable[Check]) -> Opened:
    """The payloads of all enabled checks, read and opened once.

    Checks of one source share what was opened; they have to agree on its form.
    """
    forms: dict[str, str] = {}
    for check in checks:
        if check.enabled and forms.setdefault(check.source, check.form) != check.form:
            raise ValueError(f"checks of {check.source!r} want its payloads in different forms")
    return open_payloads(raw, forms)


def extract_opened(opened: Opened, checks: Iterable[Check], recipes: DataFrame | None = None) -> DataFrame:
    """As `extract_all`, from payloads that have been opened."""
    return _together([_extracted(c, opened.of(c.source, c.form), recipes) for c in checks if c.enabled])


def run_opened(
    opened: Opened,
    checks: Iterable[Check],
    recipes: DataFrame | None = None,
    samples_path: str | None = None,
    ranges: int | None = None,
    resume: Callable[[str], SeriesState] | None = None,
) -> DataFrame:
    """Derived rows of all checks, those of style `event` too.

    `resume(name)` gives the saved state of one derivation: `styles` for the rates and deltas of all
    recipes, and one per check that derives on its own.
    """
    wanted = [c for c in checks if c.enabled]
    plain, own = [c for c in wanted if not c.derive], [c for c in wanted if c.derive]
    parts = []
    if plain:
        samples = extract_opened(opened, plain, recipes)
        if samples_path:
            samples.write.mode("overwrite").parquet(samples_path)
            samples = samples.sparkSession.read.schema(samples.schema).parquet(samples_path)
        else:
            samples = stored(samples, "samples")
        parts.append(derive(samples, ranges, resume("styles") if resume else None))
    for check in own:
        state = resume(f"{check.source}.{check.derive.__name__}") if resume else None
        rows = check.derive(opened.of(check.source, check.form).transform(check.extract), ranges, state)
        parts.append(_annotated(check, rows))
    return _together(parts)


def samples_of(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("style") != EVENT)


def events_of(rows: DataFrame, checks: Iterable[Check], thresholds: DataFrame) -> DataFrame:
    """Health events by the rules of all enabled checks."""
    return check_events(rows, [h for c in checks if c.enabled for h in c.health], thresholds)


def run_checks(
    raw: DataFrame,
    checks: Iterable[Check],
    recipes: DataFrame | None = None,
    samples_path: str | None = None,
    ranges: int | None = None,
    rejects_path: str | None = None,
) -> DataFrame:
    """Raw scrapes to derived samples.

    `raw` is read by one scan whatever the number of checks, and each payload is parsed once:
    opened payloads, and then the extracted samples, are stored on the way (below
    `samples_path` where it is given, on shared storage). Payloads and lines that
    cannot be used go to `rejects_path` with their reason and position.
    """
    wanted = list(checks)
    opened = open_for(raw, wanted)
    if rejects_path:
        opened.rejects.write.mode("overwrite").parquet(rejects_path)
    return samples_of(run_opened(opened, wanted, recipes, samples_path, ranges))


def run_with_events(
    raw: DataFrame, checks: Iterable[Check], thresholds: DataFrame, recipes: DataFrame | None = None, ranges: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """As `run_checks`, with the health events of the checks as a second output of the same rows."""
    wanted = list(checks)
    rows = stored(run_opened(open_for(raw, wanted), wanted, recipes, None, ranges), "derived")
    return samples_of(rows), events_of(rows, wanted, thresholds)
