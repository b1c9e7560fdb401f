"""Methods and members of types, from source texts."""

from __future__ import annotations

from codestrata.operators import blocks
from workload.code_queries import _BREAK, _NOT_CODE
from workload.registry import query
from workload.views import load

_TOKEN = r"[\w$\x{80}-\x{10FFFF}]+|&&|\|\||[-+*/%&|^!=<>]=|\+\+|--|->|::|[^\s]"
_DECISION = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?"
_METHOD = (
    r"([A-Za-z_$][\w$]*)\s*\(((?:[^()]|\([^()]*\))*)\)\s*(?:throws\s[^(){}=;]*)?[{;]\z"
)
_TYPE = (
    r"((?:\b(?:public|protected|private|abstract|static|final) )*)"
    r"(@interface|\b(?:class|interface|enum)) ([A-Za-z_$][\w$]*) ?"
    r"(?:extends (.+?))?(?: ?\bimplements (.+))?\{\z"
)
_NOT_A_NAME = ", ".join(f"'{word}'" for word in blocks.NOT_A_NAME)
_NOT_BEFORE = ", ".join(f"'{word}'" for word in blocks.NOT_BEFORE)


def _without(column: str, pattern: str, times: int = 1) -> str:
    for _ in range(times):
        column = f"regexp_replace({column}, '{pattern}', ' ', 'g')"
    return column


def _without_type_arguments(column: str) -> str:
    bare = _without(column, "<[^<>]*>", 5)
    return f"case when contains({bare}, '<') then '' else replace({bare}, '>', ' ') end"


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


def _marks(column: str, mark: str) -> str:
    return f"(length({column}) - length(replace({column}, {mark}, '')))"


def _written(column: str) -> str:
    return rf"len(list_filter(string_split({column}, chr(10)), lambda l: regexp_matches(l, '\S')))"


_ANNOTATION = r"@(?:[^i\s(]|i[^n(]|in[^t(])[\w$.]*(?:\s*\([^()]*\))?"
_SUMS = ("tokens", "decisions", "lines", "feeds")


def _declarations(view: str) -> str:
    clean = f"""list_aggregate(list_transform(range(1, len(parts) + 1), lambda i: parts[i] ||
          case when i > len(found) then '' else
            case when found[i][1] in ('"', chr(39)) then '"' else ' ' end
            || repeat(chr(10), {_marks("found[i]", "chr(10)")}) end), 'string_agg', '')"""
    so_far = ", ".join(f"sum({name}) over so_far as {name}_s" for name in _SUMS)
    ends = ", ".join(
        f"coalesce(lead({name}_s) over by_level, {name}_all) as {name}_e" for name in _SUMS)
    alls = ", ".join(f"max({name}_s) over (partition by repository, file) as {name}_all"
                     for name in _SUMS)
    stripped = _without(_without("header", _ANNOTATION), r"\([^()]*\)", 3)
    stripped = _without(f"({_without_type_arguments(stripped)})", r"\[[^\[\]]*\]")
    return rf"""
      code as (
        select repository, file, {clean} as code from (
          select repository, file, regexp_extract_all(text, '{_NOT_CODE}') as found,
            string_split_regex(text, '{_NOT_CODE}') as parts
          from (select repository, file,
                  regexp_replace(text, '{_BREAK}', chr(10), 'g') as text from {view}) u)),
      piece as (
        select repository, file, unnest(pieces) as piece,
          unnest(range(len(pieces))) as position
        from (select repository, file, list_append(regexp_extract_all(code, '[^{{}};]*[{{}};]'),
                regexp_extract(code, '[^{{}};]*\z')) as pieces from code) c),
      counted as (
        select repository, file, position, piece,
          case when regexp_matches(piece, '[{{}};]\z') then right(piece, 1) end as mark,
          case when regexp_matches(piece, '[{{;]\z') then piece end as header,
          {_count("piece", _TOKEN)} as tokens,
          {_count("piece", _DECISION)} - {_count("piece", r"[<,]\s*\?")} as decisions,
          {_written("piece")} - case when position > 0
            and regexp_matches(string_split(piece, chr(10))[1], '\S') then 1 else 0 end as lines,
          {_marks("piece", "chr(10)")} as feeds
        from piece),
      told as (
        select *, regexp_extract(header, '{_METHOD}') as signature,
          regexp_extract(header, '{_METHOD}', 1) as name,
          regexp_extract(header, '{_METHOD}', 2) as listed,
          case when mark = '{{' then regexp_replace({_without_type_arguments("header")},
            '\s+', ' ', 'g') end as plain,
          trim(regexp_replace({stripped}, '\s+', ' ', 'g')) as stripped
        from counted),
      judged as (
        select *, coalesce(regexp_matches(plain, '{_TYPE}'), false) as is_type,
          left(header, length(header) - length(signature)) as before
        from told),
      typed as (
        select *, coalesce(regexp_matches(before, '[\w$>\]]\s*\z')
            and regexp_extract(before, '([\w$]+)\s*\z', 1) not in ({_NOT_BEFORE}), false) as typed
        from judged),
      methods as (
        select *, coalesce(not is_type and signature <> '' and name not in ({_NOT_A_NAME})
            and (typed or trim(before, ' ' || chr(9) || chr(10)) = ''
                 or regexp_matches(before, '\)\s*\z')), false) as is_method
        from typed),
      declaring as (
        select *, case when is_type or is_method or header is null then 0
            when mark = '{{' and not contains(stripped, '=') then 0
            when regexp_matches(stripped, '\A(?:[\w$.]+ )+[\w$]+ ?[=,;]')
              then {_marks("stripped", "','")} + 1
            when starts_with(stripped, ',') then {_marks("stripped", "','")} else 0
            end as declared,
          case mark when '{{' then 1 when '}}' then -1 else 0 end as step
        from methods),
      placed as (
        select *, sum(step) over so_far as depth, {so_far} from declaring
        window so_far as (partition by repository, file order by position)),
      leveled as (
        select *, case mark when '{{' then depth when '}}' then depth + 1 end as level, {alls}
        from placed),
      ended as (
        select *, {ends} from leveled
        window by_level as (partition by repository, file, level order by position)),
      roles as (
        select *, level as key, true as opens from ended where mark = '{{'
        union all
        select *, depth - step, false from ended where is_type or is_method or declared > 0),
      located as (
        select *, last_value(case when opens then {{'is_type': is_type, 'position': position,
            'name': regexp_extract(plain, '{_TYPE}', 3)}} end ignore nulls)
          over (partition by repository, file, key order by position, opens desc
                rows between unbounded preceding and current row) as own
        from roles),
      found as (
        select *, own.is_type and own is not null as in_type,
          case when own.is_type then own.name end as around,
          case when own.is_type then own.position end as around_position
        from located where not opens)"""


def method_metrics_sql(view: str) -> str:
    listed = _without(_without("listed", _ANNOTATION), r"\([^()]*\)")
    return rf"""select repository, file,
          concat(case when around is not null then around || '::' else '' end, name) as method,
          cast({_written("signature")} + lines_e - lines_s as int) as nloc,
          cast(1 + decisions_e - decisions_s as int) as ccn,
          cast({_count("signature", _TOKEN)} + tokens_e - tokens_s as int) as tokens,
          cast(case when listed = '' then 0 else 1 + {_marks("listed", "','")} end as int)
            as parameters,
          cast(feeds_e - feeds_s + {_marks("signature", "chr(10)")} + 1 as int) as length
        from (select * exclude (listed), trim({_without_type_arguments(listed)}) as listed
              from found) f
        where is_method and mark = '{{' and (typed or coalesce(name = around, false))"""


def type_structure_sql(view: str) -> str:
    def names(group: int) -> str:
        return rf"regexp_replace(trim(regexp_extract(header, '{_TYPE}', {group})), ' ?, ?', ';', 'g')"

    return rf"""select repository, file, regexp_extract(header, '{_TYPE}', 3) as type_name,
          case when word in ('interface', 'enum') then word else 'class' end as kind,
          contains(regexp_extract(header, '{_TYPE}', 1), 'abstract ') as is_abstract,
          word = 'interface' as is_interface, cast(methods as int) as methods,
          cast(attributes as int) as attributes, {names(4)} as extends, {names(5)} as implements
        from (
          select repository, file, max(case when is_type then plain end) as header,
            regexp_extract(max(case when is_type then plain end), '{_TYPE}', 2) as word,
            count(*) filter (where is_method and typed and around is not null
              and name <> around) as methods,
            sum(case when around is not null then declared else 0 end) as attributes
          from found where is_type or around is not null
          group by repository, file, case when is_type then position else around_position end) t"""


def _with(view: str, select: str) -> str:
    return f"select * from (with {_declarations(view)} {select}) result"


def _register(name: str, view: str, operator, sql) -> None:
    def run(spark, sf_dir):
        return operator(load(spark, sf_dir, view))

    run.__name__ = name
    query(_with(view, sql(view)), view)(run)


_register("method_metrics", "v_java", blocks.method_metrics, method_metrics_sql)
_register("source_method_metrics", "v_source", blocks.method_metrics, method_metrics_sql)
_register("document_method_metrics", "v_coded_document", blocks.method_metrics, method_metrics_sql)
_register("type_structure", "v_java", blocks.type_structure, type_structure_sql)
_register("source_type_structure", "v_source", blocks.type_structure, type_structure_sql)
_register("document_type_structure", "v_coded_document", blocks.type_structure, type_structure_sql)
