"""Pull-request and candidate-selection queries."""

from __future__ import annotations

from codestrata.operators import candidates
from codestrata.operators.pull_requests import (
    derived_state,
    hours_to_close,
    pull_request_facts,
    pull_request_health,
)
from workload.registry import mean, query, rounded
from workload.views import AS_OF, load

# Limits that cut at the smallest scales; only ``pr_facts`` shows them.
NEWEST, COUNTED = 60, 40

_HOURS = rounded(
    """(epoch_us(cast(ended as timestamptz)) - epoch_us(cast(created_at as timestamptz)))
    / 1000000.0 / 3600.0""",
    2,
)
_ENDED = "coalesce(nullif(closed_at, ''), nullif(merged_at, ''))"

def _facts(newest: int | str, counted: int | str) -> str:
    return f"""
    select repository, number, state, created_at, closed_at, merged_at,
      case when ended is not null then {_HOURS} end as hours_to_close,
      case when place <= {counted} then commits end as commits, author
    from (select repository, number, created_at, closed_at, merged_at, commits, author,
            case when merged_at <> '' then 'merged' else state end as state,
            {_ENDED} as ended,
            row_number() over (partition by repository
              order by epoch_us(cast(created_at as timestamptz)) desc, number desc) as place
          from v_pull_request) ranked
    where place <= {newest}"""


FACTS = _facts("place", "place")


def facts(spark, sf_dir):
    return pull_request_facts(load(spark, sf_dir, "v_pull_request"))


@query(_facts(NEWEST, COUNTED), "v_pull_request")
def pr_facts(spark, sf_dir):
    return pull_request_facts(load(spark, sf_dir, "v_pull_request"), NEWEST, COUNTED)


@query(
    f"""select repository, number,
          case when merged_at <> '' then 'merged' else state end as state,
          case when ended is not null then {_HOURS} end as hours_to_close
        from (select *, {_ENDED} as ended from v_pull_request) p""",
    "v_pull_request",
)
def pr_state_and_hours(spark, sf_dir):
    return load(spark, sf_dir, "v_pull_request").select(
        "repository",
        "number",
        derived_state().alias("state"),
        hours_to_close().alias("hours_to_close"),
    )


HEALTH = f"""
    select repository, count(*) filter (where state = 'open') as pr_open,
      count(*) filter (where state in ('closed', 'merged')) as pr_closed,
      {mean("commits")} as avg_commits_per_pr,
      {mean("hours_to_close")} as avg_pr_close_hours
    from ({FACTS}) f group by repository"""


@query(HEALTH, "v_pull_request")
def pr_health(spark, sf_dir):
    return pull_request_health(facts(spark, sf_dir))


_FOUND = """lower(language) = 'java' and stars > 5000 and forks > 1000 and not archived"""
_PUSHED = """epoch(try_cast(replace(nullif(pushed_at, ''), 'Z', '') as timestamp))"""
_RECENT = f"floor((epoch(timestamp '2026-06-01 00:00:00') - {_PUSHED}) / 86400) <= 365"
_USABLE = f"full_name <> '' and not archived and lower(language) = 'java' and {_RECENT}"
_FIELDS = """full_name, url, stars, forks, open_issues, language, license, pushed_at, archived,
    description"""


def _valid(source: str) -> str:
    return f"""
        select {_FIELDS}, seq from (
          select *, row_number() over (partition by full_name order by seq) as place
          from ({source}) s where {_USABLE}) v
        where place = 1"""


@query(f"select {_FIELDS}, seq from v_repository where {_FOUND}", "v_repository")
def search_matches(spark, sf_dir):
    return load(spark, sf_dir, "v_repository").filter(candidates.search_predicate())


@query(_valid("select * from v_repository"), "v_repository")
def valid_repositories(spark, sf_dir):
    return candidates.valid(load(spark, sf_dir, "v_repository"), AS_OF)


_SEARCH = f"""
    select {_FIELDS}, row_number() over (order by stars desc, full_name, seq) as seq from (
      select * from v_repository where {_FOUND}
      order by stars desc, full_name, seq limit 30) top"""


@query(_SEARCH, "v_repository")
def search_candidates(spark, sf_dir):
    return candidates.search(load(spark, sf_dir, "v_repository"))


def _selected(found: str, fallback: str, n: int) -> str:
    return f"""
      select {_FIELDS}, seq from (
        select 0 as tier, * from ({_valid(found)}) a
        union all select 1, * from ({_valid(fallback)}) b
        union all select 2, {_FIELDS}, seq from ({fallback}) c) tiers
      where tier = case when (select count(*) from ({_valid(found)}) a) >= {n} then 0
        when (select count(*) from ({_valid(fallback)}) b) > 0 then 1 else 2 end
      order by seq limit {n}"""


_SPARE = f"select {_FIELDS}, seq from v_repository"


def _spare(spark, sf_dir):
    return load(spark, sf_dir, "v_repository")


@query(_selected(_SEARCH, _SPARE, 5), "v_repository")
def candidate_repositories(spark, sf_dir):
    found = candidates.search(load(spark, sf_dir, "v_repository"))
    return candidates.select_repositories(found, _spare(spark, sf_dir), AS_OF, 5)


@query(
    _selected(f"select * from ({_SEARCH}) s where stars > 1000000", _SPARE, 10),
    "v_repository",
)
def candidate_fallback(spark, sf_dir):
    found = candidates.search(load(spark, sf_dir, "v_repository"), min_stars=1_000_000)
    return candidates.select_repositories(found, _spare(spark, sf_dir), AS_OF)
