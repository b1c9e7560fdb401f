"""Line, test, type and decision queries over source texts."""

from __future__ import annotations

from codestrata.operators import code
from workload.registry import query, rounded
from workload.views import load

_BREAKS = r"\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}"
_BREAK = rf"\r\n|[{_BREAKS}]"
_SPACE = (
    _BREAKS + r"\t\x1f \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
)

_TEST_FILE = """(contains(concat('/', file), '/src/test/') or ends_with(file, 'Test.java')
    or ends_with(file, 'Tests.java'))"""


def _lines(view: str) -> str:
    return rf"""
      select repository, file, {_TEST_FILE} as is_test,
        regexp_matches(line, '\A[{_SPACE}]*\z') as is_blank,
        regexp_matches(line, '\A[{_SPACE}]*(//|/\*|\*)') as is_comment
      from (select repository, file, unnest(string_split_regex(
              regexp_replace(text, '(?:{_BREAK})\z', ''), '{_BREAK}')) as line
            from {view} where text <> '') l"""


def line_classes_sql(view: str) -> str:
    return f"""
      select s.repository, s.files, coalesce(blank, 0) as blank, coalesce(comment, 0) as comment,
        coalesce(code, 0) as code, s.files as java_files, coalesce(code, 0) as java_code,
        coalesce(comment, 0) as java_comment, coalesce(blank, 0) as java_blank
      from (select repository, count(*) as files from {view} group by repository) s
      left join (
        select repository, count(*) filter (where is_blank) as blank,
          count(*) filter (where is_comment and not is_blank) as comment,
          count(*) filter (where not is_blank and not is_comment) as code
        from ({_lines(view)}) classed group by repository) c
      on s.repository = c.repository"""


def profile(spark, sf_dir, view="v_source"):
    return code.source_profile(load(spark, sf_dir, view))


@query(line_classes_sql("v_source"), "v_source")
def line_classes(spark, sf_dir):
    return code.line_classes(profile(spark, sf_dir))


@query(line_classes_sql("v_document"), "v_document")
def document_line_classes(spark, sf_dir):
    return code.line_classes(profile(spark, sf_dir, "v_document"))


FRAMEWORKS = {
    "assertj": r"org\.assertj",
    "junit": r"org\.junit|junit\.framework",
    "mockito": r"org\.mockito",
    "spock": r"spock\.lang",
    "testng": r"org\.testng",
}
_FOUND = " ".join(
    f"""select repository, '{name}' as framework from v_source
        where {_TEST_FILE} and regexp_matches(text, '{pattern}', 'i') union all"""
    for name, pattern in FRAMEWORKS.items()
).removesuffix("union all")

FRAMEWORKS_SQL = f"""
    select k.repository, coalesce(f.frameworks, '') as frameworks
    from (select distinct repository from v_source) k left join (
      select repository, string_agg(framework, ';' order by framework) as frameworks
      from (select distinct repository, framework from ({_FOUND}) hits) d
      group by repository) f
    on k.repository = f.repository"""

TESTS = rf"""
    select t.repository, t.test_files, cast(t.test_methods as bigint) as test_methods,
      coalesce(l.main_loc, 0) as main_loc, coalesce(l.test_loc, 0) as test_loc,
      case when coalesce(l.main_loc, 0) = 0 then 0.0
        else {rounded("cast(l.test_loc as double) / l.main_loc", 4)} end as test_to_main_ratio,
      f.frameworks
    from (
      select repository, count(*) filter (where {_TEST_FILE}) as test_files,
        coalesce(sum(len(regexp_extract_all(text, '@Test\b')))
          filter (where {_TEST_FILE}), 0) as test_methods
      from v_source group by repository) t
    join ({FRAMEWORKS_SQL}) f on t.repository = f.repository
    left join (
      select repository, count(*) filter (where is_test) as test_loc,
        count(*) filter (where not is_test) as main_loc
      from ({_lines("v_source")}) l where not is_blank group by repository) l
    on t.repository = l.repository"""


@query(TESTS, "v_source")
def test_metrics(spark, sf_dir):
    return code.tests_summary(profile(spark, sf_dir))


@query(FRAMEWORKS_SQL, "v_source")
def test_frameworks(spark, sf_dir):
    return code.tests_summary(profile(spark, sf_dir)).select("repository", "frameworks")


STRUCTURE = """
    select repository, count(*) filter (where kind = 'class') as classes,
      count(*) filter (where kind = 'interface') as interfaces,
      cast(sum(methods) as bigint) as methods,
      count(*) filter (where extends <> '') as inheritance_links
    from v_structure group by repository"""


@query(STRUCTURE, "v_structure")
def structure_summary(spark, sf_dir):
    return code.structure_summary(load(spark, sf_dir, "v_structure"))


@query(
    f"""select s.repository, coalesce(t.test_methods, 0) as test_methods, s.methods,
          case when s.methods = 0 then 0.0 else
            {rounded("cast(coalesce(t.test_methods, 0) as double) / s.methods", 4)}
          end as testability
        from ({STRUCTURE}) s left join ({TESTS}) t on s.repository = t.repository""",
    "v_structure",
    "v_source",
)
def testability(spark, sf_dir):
    tests = code.tests_summary(profile(spark, sf_dir)).select("repository", "test_methods")
    return code.testability(tests, structure_summary(spark, sf_dir))


_NOT_CODE = (
    r'"""(?s:.*?)(?:"""|\z)|"(?:[^"\\\n]|\\.)*"'
    r"|''(?:[^''\\\n]|\\.)*''"
    r"|/\*(?s:.*?)(?:\*/|\z)|//[^\n]*"
)
_CODE = f"regexp_replace(text, '{_NOT_CODE}', ' ', 'g')"
_PARAMETERS = r"<(?:[^<>{]|<(?:[^<>{]|<[^<>{]*>)*>)*>"
_TYPE = (
    r"((?:\b(?:public|protected|private|abstract|static|final)\s+)*)"
    r"(@interface|\b(?:class|interface|enum))\s+([A-Za-z_$][\w$]*)"
    rf"(?:\s*{_PARAMETERS})?"
    r"(?:\s+extends\s+([^{]+?))?(?:\s+implements\s+([^{]+?))?\s*\{"
)


def _group(number: int) -> str:
    return f"regexp_extract_all({_CODE}, '{_TYPE}', {number})"


def _names(column: str) -> str:
    column = f"coalesce({column}, '')"
    for _ in range(4):
        column = rf"regexp_replace({column}, '\s*<[^<>]*>', '', 'g')"
    return rf"regexp_replace(trim({column}), '\s*,\s*', ';', 'g')"


@query(
    rf"""select repository, file, cast(position - 1 as int) as position, type_name,
          case when word in ('interface', 'enum') then word else 'class' end as kind,
          regexp_matches(coalesce(modifiers, ''), '\babstract\b') as is_abstract,
          word = 'interface' as is_interface,
          {_names("extended")} as extends, {_names("implemented")} as implements
        from (
          select repository, file, unnest(range(1, len({_group(0)}) + 1)) as position,
            unnest({_group(1)}) as modifiers, unnest({_group(2)}) as word,
            unnest({_group(3)}) as type_name, unnest({_group(4)}) as extended,
            unnest({_group(5)}) as implemented
          from v_source) d""",
    "v_source",
)
def type_declarations(spark, sf_dir):
    return code.type_declarations(load(spark, sf_dir, "v_source"))


@query(
    """select repository, file, cast(0 as int) as position,
          replace(replace(file, '.java', ''), 'doc', 'D') as type_name, 'class' as kind,
          true as is_abstract, false as is_interface, 'Base' as extends, 'I;J' as implements
        from v_declaring_document""",
    "v_declaring_document",
)
def document_type_declarations(spark, sf_dir):
    return code.type_declarations(load(spark, sf_dir, "v_declaring_document"))


def _decisions(view: str) -> str:
    decision = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?"
    return f"""
      select s.repository, s.file,
        cast(len(regexp_extract_all({_CODE}, '{decision}')) as bigint) as decisions,
        coalesce(n.nloc, 0) as nloc
      from {view} s left join (
        select repository, file, count(*) as nloc from ({_lines(view)}) l
        where not is_blank group by repository, file) n
      on s.repository = n.repository and s.file = n.file"""


@query(_decisions("v_source"), "v_source")
def file_decision_points(spark, sf_dir):
    return code.file_decision_points(load(spark, sf_dir, "v_source"))


@query(_decisions("v_document"), "v_document")
def document_decision_points(spark, sf_dir):
    return code.file_decision_points(load(spark, sf_dir, "v_document"))
