"""Commit, author, file and hotspot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import commit_state, history, people, reachability
from codestrata.operators.code import complexity_summary, file_complexity
from codestrata.plans import hotspots as plan
from codestrata.session import staged
from codestrata.sources.history_text import parse_author_mapping
from workload.registry import query
from workload.views import load

# Files of each repository in the report of the most changed ones.
FILES_KEPT = 100

_CHURN = """
    select repository, file, count(*) as commits,
      cast(coalesce(sum(added), 0) as bigint) as lines_added,
      cast(coalesce(sum(removed), 0) as bigint) as lines_removed,
      min(log_seq) as first_seen
    from v_file_change group by repository, file"""
_FILES = f"""
    select repository, file, commits, lines_added, lines_removed from (
      select *, row_number() over (
        partition by repository order by commits desc, first_seen, file) as place
      from ({_CHURN}) churn) ranked
    where place <= {FILES_KEPT}"""
_SCORES = f"""
    select f.repository, f.file, f.commits, coalesce(m.avg_ccn, 0.0) as avg_ccn,
      f.commits * coalesce(m.avg_ccn, 0.0) as hotspot_score
    from ({_CHURN}) f left join (
      select repository, file, avg(ccn) as avg_ccn from v_method
      group by repository, file) m
    on f.repository = m.repository and f.file = m.file"""


def _top(n: int) -> str:
    return f"select * from ({_SCORES}) s order by hotspot_score desc, repository, file limit {n}"


def _scores(spark, sf_dir):
    files = history.changed_files(history.file_churn(load(spark, sf_dir, "v_file_change")))
    return plan.hotspot_scores(files, load(spark, sf_dir, "v_method"))


@query(_top(500), "v_file_change", "v_method")
def hotspots(spark, sf_dir):
    return plan.top_hotspots(_scores(spark, sf_dir))


@query(_top(20), "v_file_change", "v_method")
def report_hotspots(spark, sf_dir):
    return plan.reported_hotspots(plan.top_hotspots(_scores(spark, sf_dir)))


@query(_SCORES, "v_file_change", "v_method")
def hotspot_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(_CHURN, "v_file_change")
def file_churn(spark, sf_dir):
    return history.file_churn(load(spark, sf_dir, "v_file_change"))


@query(_FILES, "v_file_change")
def file_churn_topk(spark, sf_dir):
    churn = history.file_churn(load(spark, sf_dir, "v_file_change"))
    return history.most_changed_files(churn, FILES_KEPT)


COMMIT_SUMMARY = """
    select repository, total_commits, coalesce(first_commit, '') as first_commit,
      coalesce(last_commit, '') as last_commit,
      coalesce(cast(floor((epoch(try_cast(last_commit as timestamptz))
        - epoch(try_cast(first_commit as timestamptz))) / 86400) as int), 0) as span_days,
      distinct_active_days
    from (
      select repository, count(*) filter (where on_head) as total_commits,
        arg_min(committed_at_iso, concat(
          lpad(cast(cast(epoch(try_cast(committed_at_iso as timestamptz)) as bigint) as varchar),
               12, '0'), committed_at_iso))
          filter (where on_head and parent_count = 0
            and try_cast(committed_at_iso as timestamptz) is not null) as first_commit,
        max(committed_at_iso) filter (where is_head) as last_commit,
        cast(count(distinct substring(committed_at_iso, 1, 10))
          filter (where on_head) as int) as distinct_active_days
      from v_commit group by repository) s"""


@query(COMMIT_SUMMARY, "v_commit")
def commit_summary(spark, sf_dir):
    return history.commit_summary(load(spark, sf_dir, "v_commit"))


@query(
    f"""select repository, first_commit, last_commit, span_days from ({COMMIT_SUMMARY}) s""",
    "v_commit",
)
def commit_span(spark, sf_dir):
    summary = history.commit_summary(load(spark, sf_dir, "v_commit"))
    return summary.select("repository", "first_commit", "last_commit", "span_days")


DEVELOPERS = """
    select repository, author_name as developer, author_email as email,
      count(*) as commits
    from v_commit where parent_count < 2
    group by repository, author_name, author_email"""


def developers(spark, sf_dir):
    return history.developer_commits(load(spark, sf_dir, "v_commit"))


@query(DEVELOPERS, "v_commit")
def developer_commits(spark, sf_dir):
    return developers(spark, sf_dir)


SHARE = f"""
    select repository, cast(count(*) as bigint) as contributors,
      coalesce(round_even(100 * cast(sum(commits) filter (where place <= 5) as double)
        / nullif(sum(commits), 0), 2), 0.0) as top5_commit_share_pct
    from (select *, row_number() over (
            partition by repository order by commits desc, email) as place
          from ({DEVELOPERS}) d) ranked
    group by repository"""

RISK = """case when top5_commit_share_pct >= 80 then 'high'
    when top5_commit_share_pct >= 60 then 'medium' else 'low' end"""


@query(SHARE, "v_commit")
def top5_share(spark, sf_dir):
    return people.contribution_share(developers(spark, sf_dir))


@query(
    f"select repository, top5_commit_share_pct, {RISK} as concentration_risk from ({SHARE}) s",
    "v_commit",
)
def concentration_risk(spark, sf_dir):
    share = people.contribution_share(developers(spark, sf_dir))
    risk = people.concentration_risk(F.col("top5_commit_share_pct"))
    return share.select("repository", "top5_commit_share_pct", risk.alias("concentration_risk"))


@query(
    """select repository, file, avg(ccn) as avg_ccn from v_method group by repository, file""",
    "v_method",
)
def file_ccn(spark, sf_dir):
    return file_complexity(load(spark, sf_dir, "v_method"))


COMPLEXITY = """
    select repository, round_even(avg(ccn), 2) as avg_ccn, max(ccn) as max_ccn,
      round_even(avg(nloc), 2) as avg_method_nloc,
      round_even(avg(parameters), 2) as avg_method_params
    from v_method group by repository"""


@query(COMPLEXITY, "v_method")
def complexity_by_repository(spark, sf_dir):
    return complexity_summary(load(spark, sf_dir, "v_method"))


REACHED = """
    select repository, sha, on_head, is_head from (
      with recursive edges as (
        select repository, sha, unnest(string_split(parents, ' ')) as parent
        from v_commit_graph where parents <> ''),
      reached as (
        select repository, sha from v_commit_graph
        where regexp_matches(refs, '(\\A|, )HEAD( ->|,|\\z)')
        union
        select e.repository, e.parent from reached r
        join edges e on e.repository = r.repository and e.sha = r.sha)
      select g.repository, g.sha, r.sha is not null as on_head,
        regexp_matches(refs, '(\\A|, )HEAD( ->|,|\\z)') as is_head
      from v_commit_graph g left join reached r
      on g.repository = r.repository and g.sha = r.sha) found"""


@query(REACHED, "v_commit_graph")
def head_reachability(spark, sf_dir):
    graph = load(spark, sf_dir, "v_commit_graph").select("repository", "sha", "parents", "refs")
    # The view is a join of several reads, and the operator reads its commits twice.
    commits = staged(graph, "graph")
    parents = F.filter(F.split("parents", " "), lambda parent: parent != "")
    found = reachability.with_head(commits.withColumn("parents", parents))
    return found.select("repository", "sha", "on_head", "is_head")


_LINE = r"'\A\s*([^<#][^<]*?)?\s*<([^<>]*)>(?:\s*([^<]*?)\s*<([^<>]*)>)?'"
MAPPED = rf"""
    with lines as (
      select repository, place, regexp_extract(value, {_LINE}, 1) as a,
        regexp_extract(value, {_LINE}, 2) as b, regexp_extract(value, {_LINE}, 3) as c,
        regexp_extract(value, {_LINE}, 4) as d, regexp_matches(value, '<.*<.*>') as two
      from v_author_mapping where regexp_matches(value, {_LINE})),
    stated as (
      select repository, lower(case when two then nullif(trim(c), '') end) as old_name,
        lower(trim(case when two then d else b end)) as old_email,
        arg_max(nullif(trim(a), ''), place) filter (where trim(a) <> '') as new_name,
        arg_max(trim(b), place) filter (where two) as new_email
      from lines group by 1, 2, 3)
    select repository, developer, email, cast(sum(commits) as bigint) as commits from (
      select d.repository, coalesce(case when x.repository is not null then x.new_name
          else y.new_name end, d.developer) as developer,
        coalesce(case when x.repository is not null then x.new_email else y.new_email end,
          d.email) as email, d.commits
      from ({DEVELOPERS}) d
      left join stated x on x.repository = d.repository and x.old_email = lower(d.email)
        and x.old_name = lower(d.developer)
      left join stated y on y.repository = d.repository and y.old_email = lower(d.email)
        and y.old_name is null) m
    group by repository, developer, email"""


@query(f"select * from ({MAPPED}) mapped", "v_commit", "v_author_mapping")
def mapped_developer_commits(spark, sf_dir):
    mapping = parse_author_mapping(load(spark, sf_dir, "v_author_mapping"))
    return history.developer_commits(load(spark, sf_dir, "v_commit"), mapping)


def _fetched(spark, sf_dir) -> commit_state.State:
    """The log as three fetches, whose states are merged."""
    commits, changes = load(spark, sf_dir, "v_commit"), load(spark, sf_dir, "v_file_change")
    return commit_state.merged(*(
        commit_state.state_of(
            commits.where(F.crc32("sha") % 3 == part), changes.where(F.crc32("sha") % 3 == part), part
        )
        for part in range(3)
    ))


@query(COMMIT_SUMMARY, "v_commit")
def merged_commit_summary(spark, sf_dir):
    return commit_state.commit_summary(_fetched(spark, sf_dir))


@query(DEVELOPERS, "v_commit")
def merged_developer_commits(spark, sf_dir):
    return _fetched(spark, sf_dir).developers


@query(_CHURN, "v_file_change")
def merged_file_churn(spark, sf_dir):
    return _fetched(spark, sf_dir).files
