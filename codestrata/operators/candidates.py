"""Choice of the repositories to analyse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.instants import elapsed_days, iso_instant
from codestrata.functions.names import non_empty
from codestrata.operators.ranking import first_per_key, top_per_key
from codestrata.schemas import columns
from codestrata.sources.trees import first_available

# The search predicate, the sizes of the selection, and the
# repositories used when the search yields too few.
LANGUAGE = "java"
MIN_STARS = 5000
MIN_FORKS = 1000
MAX_INACTIVE_DAYS = 365
CANDIDATES = 30
SELECTION = 10
FALLBACK_REPOSITORIES = (
    "spring-projects/spring-boot",
    "spring-projects/spring-framework",
    "apache/kafka",
    "apache/cassandra",
    "apache/dubbo",
    "elastic/elasticsearch",
    "ReactiveX/RxJava",
    "google/guava",
    "square/retrofit",
    "alibaba/nacos",
)


def _written_in(language: str) -> Column:
    return F.lower(F.coalesce("language", F.lit(""))) == language


def _not_archived() -> Column:
    return ~F.coalesce("archived", F.lit(False))


def search_predicate(
    language: str = LANGUAGE, min_stars: int = MIN_STARS, min_forks: int = MIN_FORKS
) -> Column:
    return (
        _written_in(language)
        & (F.col("stars") > min_stars)
        & (F.col("forks") > min_forks)
        & _not_archived()
    )


def recently_pushed(as_of: str, max_days: int = MAX_INACTIVE_DAYS) -> Column:
    """Last push at most ``max_days`` whole days before ``as_of``; later dates pass."""
    age = elapsed_days(iso_instant(F.col("pushed_at")), iso_instant(F.lit(as_of)))
    return F.coalesce(age <= max_days, F.lit(False))


def search(repositories: DataFrame, limit: int = CANDIDATES, **predicate) -> DataFrame:
    """Most starred repositories that satisfy the search; ``seq`` becomes their place."""
    order = [F.desc("stars"), F.asc("full_name"), F.asc("seq")]
    found = repositories.filter(search_predicate(**predicate)).orderBy(*order).limit(limit)
    # One task numbers at most ``limit`` rows.
    return found.withColumn("seq", F.row_number().over(Window.orderBy(*order)).cast("long"))


def is_usable(as_of: str, language: str = LANGUAGE) -> Column:
    return (
        non_empty(F.col("full_name")).isNotNull()
        & _not_archived()
        & _written_in(language)
        & recently_pushed(as_of)
    )


def valid(repositories: DataFrame, as_of: str, language: str = LANGUAGE) -> DataFrame:
    """Usable repositories; of several rows with one name, the first usable one.

    Filters come before de-duplication: an unusable row must not hide a later one.
    """
    usable = repositories.filter(is_usable(as_of, language))
    return top_per_key(usable, ["full_name"], [F.col("seq")], 1).drop("rank")


def fallback_rows(
    spark: SparkSession, names: Sequence[str] = FALLBACK_REPOSITORIES
) -> DataFrame:
    """Placeholder metadata for repositories that could not be looked up."""
    listed = spark.createDataFrame(list(enumerate(names)), "seq long, full_name string")
    known = {
        "full_name": F.col("full_name"),
        "url": F.concat(F.lit("https://github.com/"), "full_name"),
        "language": F.lit("Java"),
        "archived": F.lit(False),
    }
    counters = {name: F.lit(0).cast("long") for name in ("stars", "forks", "open_issues")}
    fields = known | counters
    return listed.select(
        *(fields.get(name, F.lit("")).alias(name) for name in columns("repositories")), "seq"
    )


def fallback_metadata(listed: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Placeholders in their order, with the first listed metadata of their name if any."""
    wanted = listed.join(placeholders.select("full_name"), "full_name", "left_semi")
    places = placeholders.select("full_name", "seq")
    known = first_per_key(wanted, "full_name", "seq").join(places, "full_name")
    return first_available(known.select(*placeholders.columns), placeholders, key="full_name")


def select_repositories(
    found: DataFrame, fallback: DataFrame, as_of: str, n: int = SELECTION
) -> DataFrame:
    """First ``n`` usable repositories in ``seq`` order.

    With fewer than ``n``, the usable fallback rows take their place, and with none
    of those, the fallback as it is. Both inputs are read once: every row is tagged with
    the sets it belongs to, each set is cut to ``n`` rows, and the choice is made among
    those at most ``3 * n`` rows.
    """
    rows = found.withColumn("spare", F.lit(False)).unionByName(
        fallback.withColumn("spare", F.lit(True))
    )
    usable = F.coalesce(is_usable(as_of), F.lit(False))
    # Unusable rows are never compared, so they need not meet under their name.
    name = F.when(usable, F.col("full_name"))
    apart = F.when(~usable, F.col("seq"))
    first = F.row_number().over(Window.partitionBy("spare", name, apart).orderBy("seq")) == 1
    sets = F.array(
        F.when(usable & F.col("first") & ~F.col("spare"), F.lit(0)),
        F.when(usable & F.col("first") & F.col("spare"), F.lit(1)),
        F.when(F.col("spare"), F.lit(2)),
    )
    tagged = rows.withColumn("first", first).withColumn("tier", F.explode(F.array_compact(sets)))
    cut = top_per_key(tagged, ["tier"], [F.col("seq")], n).drop("first", "spare", "rank")
    every = Window.partitionBy(F.lit(0))
    chosen = (
        F.when(F.count_if(F.col("tier") == 0).over(every) >= n, F.lit(0))
        .when(F.count_if(F.col("tier") == 1).over(every) > 0, F.lit(1))
        .otherwise(F.lit(2))
    )
    kept = cut.withColumn("chosen", chosen).where(F.col("tier") == F.col("chosen"))
    return kept.drop("tier", "chosen").orderBy("seq")
