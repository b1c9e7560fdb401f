"""End-to-end batch job: landed facts in, published tables and report views out.

    python -m codestrata.plans.job --landed <dir> --published <dir> [--csv]
    python -m codestrata.plans.job --choose <responses> --as-of <instant> --published <dir>

Every table is written before the next stage reads it. That keeps each plan short,
computes each fact once, and lets a lost executor be recovered from the written table.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from codestrata.operators import candidates, code, history
from codestrata.operators.pull_requests import pull_request_facts
from codestrata.operators.ranking import first_per_key
from codestrata.plans import hotspots, indicators, report
from codestrata.session import configured
from codestrata.sinks.tables import consolidate, write_parquet, write_repository_list
from codestrata.sources.hosting import scan_repository_json
from codestrata.sources.landed import scan_csv, scan_parquet
from codestrata.sources.trees import first_available, parse_line_counts


def run(
    spark: SparkSession, landed: str, published: str, database: str | None = None,
    csv: bool = False,
) -> dict:
    """Build everything and return the published tables by name.

    Facts are read from ``<landed>/<table>`` as Parquet, or from ``<landed>/<table>.csv``.
    """
    tables: dict[str, DataFrame] = {}

    def fact(name: str, sequence: str | None = None) -> DataFrame:
        scan = scan_csv if csv else scan_parquet
        return scan(spark, f"{landed}/{name}" + ".csv" * csv, name, sequence)

    def publish(name: str, rows: DataFrame) -> None:
        write_parquet(rows, f"{published}/{name}", name)
        tables[name] = scan_parquet(spark, f"{published}/{name}", name)

    # Tables that arrive in their published form are read where they are.
    tables |= {name: fact(name) for name in ("repositories", "structure", "complexity")}
    commits = fact("commit")
    publish("commits", history.commit_summary(commits))
    publish("developers", history.developer_commits(commits))
    publish("files", history.changed_files(history.file_churn(fact("file_change"))))
    publish("pull_requests", pull_request_facts(fact("raw_pull_request")))

    # Sources are by far the largest input and feed two tables: read them once.
    profile_path = f"{published}/_source_profile"
    code.source_profile(fact("source_file")).write.mode("overwrite").parquet(profile_path)
    profile = spark.read.parquet(profile_path)
    reports = fact("line_count_report", indicators.SEQUENCE)
    reported = first_per_key(parse_line_counts(reports, (indicators.SEQUENCE,)), "repository")
    publish("loc", first_available(reported, code.line_classes(profile)))
    publish("tests", code.tests_summary(profile))

    # Metadata may hold a repository twice: the mart keeps the first row as it was landed.
    looked_up = tables | {"repositories": fact("repositories", indicators.SEQUENCE)}
    mart = indicators.in_key_order(indicators.quality_indicators(looked_up))
    publish("quality_indicators", mart)
    scores = hotspots.hotspot_scores(tables["files"], tables["complexity"])
    publish("hotspots", hotspots.top_hotspots(scores))

    for name, view in report_views(tables).items():
        view.write.mode("overwrite").parquet(f"{published}/report/{name}")
    if database is not None:
        consolidate(spark, tables, database)
    return tables


def choose_repositories(spark: SparkSession, responses: str, published: str, as_of: str) -> None:
    """Select the repositories to land facts of, from landed search responses.

    Writes their metadata and the list of their names.
    """
    listed = scan_repository_json(spark, responses, "seq")
    fallback = candidates.fallback_metadata(listed, candidates.fallback_rows(spark))
    chosen = candidates.select_repositories(candidates.search(listed), fallback, as_of)
    write_parquet(chosen, f"{published}/repositories", "repositories")
    write_repository_list(chosen, f"{published}/repository_list")


def report_views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    mart = tables["quality_indicators"]
    views = {
        "scope_size": report.scope_size(mart),
        "activity_ranking": report.activity_ranking(mart),
        "metric_series": report.metric_series(mart),
        "concentration_ranking": report.concentration_ranking(mart),
        "maintainability": report.maintainability_view(mart),
        "modularity": report.modularity_view(mart),
        "pull_request_health": report.pull_request_view(mart),
        "hotspots": hotspots.reported_hotspots(tables["hotspots"]),
    }
    return {name: view for name, view in views.items() if view is not None}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--published", required=True)
    parser.add_argument("--landed", help="folder of the base facts")
    parser.add_argument("--csv", action="store_true", help="the facts are CSV files")
    parser.add_argument("--database")
    parser.add_argument("--choose", metavar="RESPONSES", help="select repositories instead")
    parser.add_argument("--as-of", help="instant that pushes are dated from, for --choose")
    options = parser.parse_args()
    if options.choose:
        if not options.as_of:
            parser.error("--choose needs --as-of")
        choose_repositories(configured(), options.choose, options.published, options.as_of)
    elif options.landed:
        run(configured(), options.landed, options.published, options.database, options.csv)
    else:
        parser.error("--landed or --choose is needed")


if __name__ == "__main__":
    main()
