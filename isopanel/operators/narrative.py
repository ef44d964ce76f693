"""Summary sentences as columns over the result tables.

Every text is put together from built-in string functions, so it is written where its row is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fixed_text, significant
from ..functions.text import fill, sentences
from .compare import IN_LINE

# The wording of every text.
TREND = (
    "From {first_year} to {last_year}, {country}'s {label} has {direction} at a rate of {rate}{unit} per decade, "
    "from roughly {fitted_first}{unit} to {fitted_last}{unit} along that trend."
)
TOO_LITTLE = "Data for {label} is too limited for {country} to establish a trend."
MEDIAN_IN_LINE = "That's in line with the regional median of {median}{unit}."
MEDIAN_OFF = "That's {gap}{unit} {relation} the regional median ({median}{unit})."
COMPARE = (
    "By comparison, {compare}'s most recent value is {gap}{unit} {relation} {country}'s, "
    "and has {direction} over its own recorded period."
)
CHAPTER = "**{title}**: {text}"

NO_PRODUCTS = "Not enough product-level data is available for {country}."
NO_INDICATOR = "No {name} data is available for {country}."
RANKED = (
    "Across all recorded years, {top} has the highest median {label} in {country} at {top_value}{unit}, "
    "while {bottom} has the lowest at {bottom_value}{unit}."
)

RISK_NONE = (
    "{country} has recorded no anomalies beyond {threshold}{unit} from the historical mean ({mean}{unit}) "
    "-- no extreme {label} events stand out in this record."
)
RISK_SOME = (
    "{country} has recorded {count} extreme {label} event(s), each more than {threshold}{unit} from the historical "
    "mean ({mean}{unit}). The most extreme was {year}, at {value}{unit}."
)
RISK_COMPARE_NONE = (
    "By comparison, {compare} has recorded no anomalies beyond its own threshold of {threshold}{unit} "
    "from its historical mean ({mean}{unit})."
)
RISK_COMPARE_SOME = (
    "By comparison, {compare} has recorded {count} extreme event(s) of its own, "
    "the most extreme being {year} at {value}{unit}."
)

NO_MIX = "No power generation source data is available for {country}."
MIX = (
    "As of {year}, {country}'s power generation was led by {leader}, contributing {leader_value} GWH of {total} GWH "
    "total that year."
)
NO_FLOW = "No power generation flow data is available for {country}."
FLOW_TOTAL = "Across the recorded period, {country} generated {total} GWH in total."
FLOW_LEADER = "{leader} leads {target} supply at {value} GWH."
FLOW_TARGETS = ("On-grid", "Off-grid")

WINDOW_SHORT = "an average of {overall}{unit} throughout the period"
WINDOW_RISING = "a significant increasing trend, from {start}{unit} to {end}{unit} in recent years"
WINDOW_FALLING = "a significant decreasing trend, from {start}{unit} to {end}{unit} in recent years"
WINDOW_STABLE = "a relatively stable trend, with an average around {start}{unit}"
POSITION_HIGHER = "{country}'s recent values are notably higher than the regional median. "
POSITION_LOWER = "{country}'s recent values are notably lower than the regional median. "
POSITION_ALIGNED = "{country}'s recent values closely align with the regional median. "
OVERVIEW = """
### Dynamic Insight for {country} ({label}):

**Overview ({first_year}-{last_year}):**

Between {first_year} and {last_year}, {country} has experienced {own_trend}. Values ranged from a low
of **{min_value}{unit}** (around {min_year}) to a high of **{max_value}{unit}** (around {max_year}).

During the same period, the **regional median** has shown {regional_trend}.

**Comparison:**

{comparison}
"""
RISK_OVERVIEW = """
### Dynamic Insight for {country} (Historical Tail-Risk Analysis - {label}):

**Overview ({first_year}-{last_year}):**

Extreme events are defined as anomalies exceeding **{threshold}{unit}** above or below average
(two standard deviations from the historical mean).

**Key Observations:**

* **Number of Extreme Events:** {count}
* **Highest Anomaly:** {max_value}{unit} in {max_year}
* **Lowest Anomaly:** {min_value}{unit} in {min_year}
"""
MIX_OVERVIEW = """
### Dynamic Insight for {country} (Power Generation Mix):

Between {start_year} and {latest_year}, {country}'s power generation has shown a general {status}.
As of {latest_year}, total generation reached **{total} GWH**, led by **{leader}**
({leader_value} GWH).
"""
FLOW_OVERVIEW = """
### Dynamic Insight for {country}'s Power Generation Flow ({first_year}-{last_year}):

Total power generation across On-grid and Off-grid was **{total} GWH**.
{notes}
"""
FLOW_NOTE = "**{leader}** leads {target} supply."
FLOW_NO_NOTE = "No significant {target} generation."


def _stable(df: DataFrame, **figures: Column | str) -> DataFrame:
    """Add computed figures as columns, with the digits that don't vary with the order of the rows.

    Text names its argument several times; as columns the figures are worked out once instead of being repeated
    inside of each other.
    """
    return df.withColumns({name: significant(value) for name, value in figures.items()})


def _text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def direction(slope: Column | str) -> Column:
    """Word for the sign of a slope; zero counts as falling."""
    slope = F.col(slope) if isinstance(slope, str) else slope
    return F.when(slope.isNull(), "held steady").when(slope > 0, "risen").otherwise("fallen")


def indicator_facts(endpoints: DataFrame, latest: DataFrame, labels: DataFrame, requests: DataFrame) -> DataFrame:
    """What :func:`insight_indicator` needs, one row per request and indicator.

    ``requests`` holds ``country`` and ``compare`` (empty for none), ``endpoints`` the trends with their fitted ends
    and ``latest`` the latest values with the regional median, one row per country and indicator.
    """
    keys = ["country", "indicator"]
    own = endpoints.join(latest, keys).join(labels, "indicator")
    other = endpoints.join(latest.select(*keys, "value"), keys).select(
        F.col("country").alias("compare"),
        "indicator",
        F.col("value").alias("compare_value"),
        F.col("slope_per_decade").alias("compare_slope"),
    )
    return requests.join(own, "country").join(other, ["compare", "indicator"], "left")


def insight_indicator(facts: DataFrame, text: str = "text") -> DataFrame:
    """Trend of a series, its latest value against the regional median and, if asked for, another country."""
    unit, label, country = F.col("unit"), F.lower("label"), F.col("country")
    value, median, other = F.col("value"), F.col("regional_median"), F.col("compare_value")
    own = fill(
        TREND, first_year=_text("first_year"), last_year=_text("last_year"), country=country, label=label,
        direction=direction("slope_per_decade"), rate=fixed_text("_rate", 2), unit=unit,
        fitted_first=fixed_text("_fitted_first", 2), fitted_last=fixed_text("_fitted_last", 2),
    )
    in_line = fill(MEDIAN_IN_LINE, median=fixed_text(median, 2), unit=unit)
    off = fill(
        MEDIAN_OFF, gap=fixed_text("_median_gap", 2), unit=unit, median=fixed_text(median, 2),
        relation=F.when(value > median, "above").otherwise("below"),
    )
    versus = fill(
        COMPARE, compare="compare", gap=fixed_text("_other_gap", 2), unit=unit, country=country,
        relation=F.when(value > other, "higher than").when(value < other, "lower than").otherwise("the same as"),
        direction=direction("compare_slope"),
    )
    full = sentences(own, F.when(F.abs(value - median) < IN_LINE, in_line).otherwise(off), F.when(other.isNotNull(), versus))
    short = fill(TOO_LITTLE, label=label, country=country)
    stable = _stable(
        facts,
        _rate=F.abs(F.col("slope_per_decade")),
        _fitted_first="fitted_first",
        _fitted_last="fitted_last",
        _median_gap=F.abs(value - median),
        _other_gap=F.abs(value - other),
    )
    return stable.withColumn(text, F.when(F.col("slope_per_decade").isNull(), short).otherwise(full))


def insight_summary(insights: DataFrame) -> DataFrame:
    """One paragraph per chapter, in chapter and indicator order; indicators without a trend are left out.

    A country has as many sentences as the catalogue has indicators, so the lists are short.
    """
    usable = insights.where(F.col("slope_per_decade").isNotNull())
    chapters = usable.groupBy("country", "compare", "chapter_order", "chapter_title").agg(
        F.array_sort(F.collect_list(F.struct("indicator_order", "text"))).alias("_lines")
    )
    paragraph = fill(CHAPTER, title="chapter_title", text=F.array_join(F.col("_lines.text"), " "))
    paragraphs = chapters.select("country", "compare", "chapter_order", paragraph.alias("_paragraph"))
    ordered = F.array_sort(F.collect_list(F.struct("chapter_order", "_paragraph")))
    return paragraphs.groupBy("country", "compare").agg(
        F.array_join(ordered.getField("_paragraph"), "\n\n").alias("text")
    )


def insight_ranked(countries: DataFrame, labels: DataFrame, top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Highest and lowest member of each country and indicator.

    ``countries`` holds every country and indicator to write about with ``has_series``, which tells whether the
    country has that indicator at all; ``top`` and ``bottom`` are rankings.
    """
    keys = ["country", "indicator"]

    def first(ranked: DataFrame, side: str) -> DataFrame:
        return ranked.where(F.col("rank") == 1).select(
            *keys, F.col("member").alias(side), F.col("median").alias(f"{side}_value")
        )

    joined = (
        countries.join(labels, "indicator")
        .join(first(top, "top"), keys, "left")
        .join(first(bottom, "bottom"), keys, "left")
    )
    ranked = fill(
        RANKED, top=F.lower("top"), label=F.lower("label"), country="country", top_value=fixed_text("top_value", 2),
        unit="unit", bottom=F.lower("bottom"), bottom_value=fixed_text("bottom_value", 2),
    )
    missing = fill(NO_INDICATOR, name=F.replace(F.col("indicator"), F.lit("_"), F.lit(" ")), country="country")
    text = (
        F.when(~F.col("has_series"), missing)
        .when(F.col("top").isNull(), fill(NO_PRODUCTS, country="country"))
        .otherwise(ranked)
    )
    return joined.select(*keys, text.alias("text"))


def insight_tail_risk(summary: DataFrame, labels: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Number of extreme events and the most extreme one, optionally beside another country's."""
    keys = ["country", "indicator"]
    own = summary.join(labels, "indicator")
    if requests is not None:
        other = summary.select(
            F.col("country").alias("compare"),
            "indicator",
            *[F.col(c).alias(f"compare_{c}") for c in summary.columns if c not in keys],
        )
        own = requests.join(own, "country").join(other, ["compare", "indicator"], "left")

    def figures(prefix: str = "") -> dict[str, Column | str]:
        return {
            "threshold": fixed_text(prefix + "threshold", 2),
            "mean": fixed_text(prefix + "mean", 2),
            "count": _text(prefix + "n_extremes"),
            "year": _text(prefix + "extreme_year"),
            "value": fixed_text(prefix + "extreme_value", 2),
            "unit": "unit",
        }

    names = {"country": "country", "label": F.lower("label")}
    text = F.when(F.col("n_extremes") == 0, fill(RISK_NONE, **names, **figures())).otherwise(
        fill(RISK_SOME, **names, **figures())
    )
    if requests is None:
        return own.select(*keys, text.alias("text"))
    beside = F.when(
        F.col("compare_n_extremes") == 0, fill(RISK_COMPARE_NONE, compare="compare", **figures("compare_"))
    ).when(F.col("compare_n_extremes") > 0, fill(RISK_COMPARE_SOME, compare="compare", **figures("compare_")))
    return own.select("country", "compare", "indicator", sentences(text, beside).alias("text"))


def insight_power_mix(countries: DataFrame, mix: DataFrame) -> DataFrame:
    """Leading source and total of the latest year."""
    text = fill(
        MIX, year=_text("latest_year"), country="country", leader=F.lower("leader"),
        leader_value=fixed_text("leader_value", 1), total=fixed_text("total", 1),
    )
    missing = fill(NO_MIX, country="country")
    joined = _stable(countries.join(mix, "country", "left"), total="total")
    return joined.select("country", F.coalesce(text, missing).alias("text"))


def _by_target(leaders: DataFrame, targets: Sequence[str]) -> DataFrame:
    picked = [
        F.max(F.when(F.col("target") == t, F.struct("leader", "leader_value"))).alias(f"_t{n}")
        for n, t in enumerate(targets)
    ]
    return leaders.groupBy("country").agg(F.sum("target_total").alias("total"), *picked)


def insight_flow(countries: DataFrame, leaders: DataFrame, targets: Sequence[str] = FLOW_TARGETS) -> DataFrame:
    """Total flow and the leading source of each named target."""
    joined = _stable(countries.join(_by_target(leaders, targets), "country", "left"), total="total")
    notes = [
        fill(
            FLOW_LEADER, leader=F.col(f"_t{n}.leader"), target=F.lit(t),
            value=fixed_text(F.col(f"_t{n}.leader_value"), 1),
        )
        for n, t in enumerate(targets)
    ]
    total = fill(FLOW_TOTAL, country="country", total=fixed_text("total", 1))
    text = F.when(F.col("total").isNull(), fill(NO_FLOW, country="country")).otherwise(sentences(total, *notes))
    return joined.select("country", text.alias("text"))


def window_phrase(prefix: str = "") -> Column:
    """Phrase for the result of ``window_trend``, whose columns may carry a prefix."""
    figures = {
        "overall": fixed_text(prefix + "overall", 2),
        "start": fixed_text(prefix + "start_figure", 2),
        "end": fixed_text(prefix + "end_figure", 2),
        "unit": "unit",
    }
    trend = F.col(prefix + "trend")
    return (
        F.when(trend == "short", fill(WINDOW_SHORT, **figures))
        .when(trend == "rising", fill(WINDOW_RISING, **figures))
        .when(trend == "falling", fill(WINDOW_FALLING, **figures))
        .otherwise(fill(WINDOW_STABLE, **figures))
    )


def insight_comparison(
    extent: DataFrame, own_trend: DataFrame, regional_trend: DataFrame, position: DataFrame, labels: DataFrame
) -> DataFrame:
    """Overview of a series and of its region, by windowed trends."""
    keys = ["country", "indicator"]
    regional = regional_trend.select(
        "indicator", *[F.col(c).alias(f"regional_{c}") for c in ("trend", "overall", "start_figure", "end_figure")]
    )
    joined = (
        extent.join(own_trend, keys)
        .join(position.select(*keys, "position"), keys)
        .join(regional, "indicator")
        .join(labels, "indicator")
    )
    comparison = (
        F.when(F.col("position") == "higher", fill(POSITION_HIGHER, country="country"))
        .when(F.col("position") == "lower", fill(POSITION_LOWER, country="country"))
        .otherwise(fill(POSITION_ALIGNED, country="country"))
    )
    text = fill(
        OVERVIEW, country="country", label="label", first_year=_text("first_year"), last_year=_text("last_year"),
        own_trend=window_phrase(), min_value=fixed_text("min_value", 2), unit="unit", min_year=_text("min_year"),
        max_value=fixed_text("max_value", 2), max_year=_text("max_year"), regional_trend=window_phrase("regional_"),
        comparison=comparison,
    )
    windows = [p + name for p in ("", "regional_") for name in ("overall", "start_figure", "end_figure")]
    return _stable(joined, **{name: name for name in windows}).select(*keys, text.alias("text"))


def insight_tail_risk_overview(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Number of zero-centred extreme events, highest and lowest value; facts: of ``zero_centred_overview``."""
    keys = ["country", "indicator"]
    text = fill(
        RISK_OVERVIEW, country="country", label="label", first_year=_text("first_year"),
        last_year=_text("last_year"), threshold=fixed_text("threshold", 2), unit="unit", count=_text("n_extremes"),
        max_value=fixed_text("max_value", 2), max_year=_text("max_year"), min_value=fixed_text("min_value", 2),
        min_year=_text("min_year"),
    )
    joined = facts.join(labels, "indicator")
    return _stable(joined, threshold="threshold").select(*keys, text.alias("text"))


def insight_mix_growth(growth: DataFrame, mix: DataFrame) -> DataFrame:
    """Growth or contraction between first and last year, and the leading source."""
    text = fill(
        MIX_OVERVIEW, country="country", start_year=_text("start_year"), latest_year=_text("latest_year"),
        status="status", total=fixed_text("total", 1), leader="leader", leader_value=fixed_text("leader_value", 1),
    )
    leaders = mix.select("country", "leader", "leader_value", "total")
    joined = _stable(growth.join(leaders, "country"), total="total")
    return joined.select("country", text.alias("text"))


def insight_flow_overview(
    leaders: DataFrame, years: DataFrame, targets: Sequence[str] = FLOW_TARGETS
) -> DataFrame:
    """Total flow over the recorded years (``first_year``, ``last_year``) with a note per target."""
    notes = [
        F.coalesce(
            fill(FLOW_NOTE, leader=F.col(f"_t{n}.leader"), target=F.lit(t)), F.lit(FLOW_NO_NOTE.format(target=t))
        )
        for n, t in enumerate(targets)
    ]
    text = fill(
        FLOW_OVERVIEW, country="country", first_year=_text("first_year"), last_year=_text("last_year"),
        total=fixed_text("total", 1), notes=sentences(*notes),
    )
    joined = _stable(_by_target(leaders, targets).join(years, "country"), total="total")
    return joined.select("country", text.alias("text"))
