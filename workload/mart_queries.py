"""The indicator mart and the report tables made from it."""

from __future__ import annotations

from codestrata.operators import history
from codestrata.plans import indicators, report
from workload.code_queries import STRUCTURE, TESTS, line_classes_sql, profile
from workload.history_queries import COMMIT_SUMMARY, COMPLEXITY, DEVELOPERS, RISK, SHARE
from workload.pull_request_queries import HEALTH, facts
from workload.registry import query, rounded
from workload.views import load

_VIEWS = (
    "v_repository", "v_commit", "v_source", "v_structure", "v_method", "v_pull_request",
)

_KEYS = f"""
    select distinct repository from (
      select full_name as repository from v_repository
      union all select repository from v_commit
      union all select repository from v_source
      union all select repository from v_structure) k"""

_COLLAPSED = f"""
    select k.repository, coalesce(r.stars, 0) as stars, coalesce(r.forks, 0) as forks,
      coalesce(c.total_commits, 0) as total_commits,
      coalesce(c.distinct_active_days, 0) as active_days,
      coalesce(d.contributors, 0) as contributors,
      coalesce(d.top5_commit_share_pct, 0.0) as top5_commit_share_pct,
      coalesce(l.code, 0) as total_loc, coalesce(m.avg_ccn, 0.0) as avg_ccn,
      coalesce(m.max_ccn, 0) as max_ccn, coalesce(m.avg_method_nloc, 0.0) as avg_method_nloc,
      coalesce(m.avg_method_params, 0.0) as avg_method_params,
      coalesce(s.classes, 0) as classes, coalesce(s.interfaces, 0) as interfaces,
      coalesce(s.methods, 0) as methods, coalesce(s.inheritance_links, 0) as inheritance_links,
      coalesce(t.test_methods, 0) as test_methods,
      coalesce(p.pr_open, 0) as pr_open, coalesce(p.pr_closed, 0) as pr_closed,
      case when p.repository is null then 0.0 else p.avg_commits_per_pr
        end as avg_commits_per_pr,
      case when p.repository is null then 0.0 else p.avg_pr_close_hours
        end as avg_pr_close_hours
    from ({_KEYS}) k
    left join (select * from (
        select full_name, stars, forks,
          row_number() over (partition by full_name order by seq) as place
        from v_repository) o where place = 1) r on k.repository = r.full_name
    left join ({COMMIT_SUMMARY}) c on k.repository = c.repository
    left join ({SHARE}) d on k.repository = d.repository
    left join ({line_classes_sql("v_source")}) l on k.repository = l.repository
    left join ({COMPLEXITY}) m on k.repository = m.repository
    left join ({STRUCTURE}) s on k.repository = s.repository
    left join ({TESTS}) t on k.repository = t.repository
    left join ({HEALTH}) p on k.repository = p.repository"""

MART = f"""
    select repository, stars, forks, total_commits, active_days, contributors,
      top5_commit_share_pct, {RISK} as concentration_risk, total_loc, avg_ccn, max_ccn,
      avg_method_nloc, avg_method_params, classes, interfaces, methods, inheritance_links,
      test_methods,
      case when methods = 0 then 0.0
        else {rounded("cast(test_methods as double) / methods", 4)} end as testability,
      pr_open, pr_closed, avg_commits_per_pr, avg_pr_close_hours,
      total_commits + 5 * active_days + pr_open + pr_closed as activity_score
    from ({_COLLAPSED}) c"""


def tables(spark, sf_dir):
    commits = load(spark, sf_dir, "v_commit")
    return {
        "repositories": load(spark, sf_dir, "v_repository").withColumnRenamed(
            "seq", "ingest_seq"
        ),
        "commits": history.commit_summary(commits),
        "developers": history.developer_commits(commits),
        "profile": profile(spark, sf_dir),
        "structure": load(spark, sf_dir, "v_structure"),
        "complexity": load(spark, sf_dir, "v_method"),
        "pull_requests": facts(spark, sf_dir),
    }


def mart(spark, sf_dir):
    return indicators.quality_indicators(tables(spark, sf_dir))


@query(_KEYS, *_VIEWS)
def repository_keys(spark, sf_dir):
    landed = tables(spark, sf_dir)
    return indicators.known_repositories(*(landed[name] for name in indicators.KEY_TABLES if name in landed))


@query(MART + " order by repository", *_VIEWS)
def quality_indicators(spark, sf_dir):
    return indicators.in_key_order(mart(spark, sf_dir))


def _view(names: str, order: str = "") -> str:
    return f"select {names} from ({MART}) m {order}"


@query(
    _view(
        "repository, stars, forks, total_commits, contributors, avg_ccn, testability,"
        " activity_score",
        "order by activity_score desc, repository",
    ),
    *_VIEWS,
)
def activity_ranking(spark, sf_dir):
    return report.activity_ranking(mart(spark, sf_dir))


@query(
    _view(
        "repository, contributors, top5_commit_share_pct, concentration_risk",
        "order by top5_commit_share_pct desc, repository",
    ),
    *_VIEWS,
)
def concentration_ranking(spark, sf_dir):
    return report.concentration_ranking(mart(spark, sf_dir))


@query(
    _view(
        "repository, total_loc, avg_ccn, avg_method_nloc, avg_method_params, test_methods,"
        " testability"
    ),
    *_VIEWS,
)
def maintainability_view(spark, sf_dir):
    return report.maintainability_view(mart(spark, sf_dir))


@query(_view("repository, classes, interfaces, methods, inheritance_links"), *_VIEWS)
def modularity_view(spark, sf_dir):
    return report.modularity_view(mart(spark, sf_dir))


@query(
    _view("repository, pr_open, pr_closed, avg_commits_per_pr, avg_pr_close_hours"),
    *_VIEWS,
)
def pr_health_view(spark, sf_dir):
    return report.pull_request_view(mart(spark, sf_dir))


_SERIES = " union all ".join(
    f"""select '{metric}' as metric, repository, split_part(repository, '/', -1) as short_name,
        cast({metric} as double) as value from m"""
    for metric in ("stars", "activity_score", "avg_ccn", "testability", "top5_commit_share_pct")
)


@query(f"select * from (with m as ({MART}) {_SERIES}) s order by metric, value, repository", *_VIEWS)
def metric_series(spark, sf_dir):
    return report.metric_series(mart(spark, sf_dir))


@query(f"select count(*) as repositories from ({_KEYS}) k", *_VIEWS)
def scope_size(spark, sf_dir):
    return report.scope_size(mart(spark, sf_dir))
