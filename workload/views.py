"""Repository facts derived from the driver's tables.

There is no version-control data among the tables, so each fact is a view on them. The
text runs unchanged in Spark and in the SQL oracle; ``{name}`` stands for a table or
for another view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_OWNED = "concat(c_nationkey, '/', c_mktsegment)"
_PART_OWNED = """concat(p_partkey % 30, '/',
    case cast(floor(p_partkey / 30.0) as bigint) % 5
      when 0 then 'AUTOMOBILE' when 1 then 'BUILDING' when 2 then 'FURNITURE'
      when 3 then 'HOUSEHOLD' else 'MACHINERY' end)"""

AS_OF = "2026-06-01T00:00:00Z"

VIEWS = {
    # Every order is a commit of its customer. Offsets vary so that local days and
    # instants disagree, and some dates cannot be read.
    "v_order_commit": f"""
        select {_OWNED} as repository, o_orderkey, c_custkey, o_orderpriority,
          cast(cast(o_orderdate as date) as string) as day,
          cast(replace(cast(cast(o_orderdate as date) as string), '-', '') as bigint)
            * 10000000000 + o_orderkey as moment,
          o_orderkey % 10 <> 3 as on_head
        from {{orders}} join {{customer}} on o_custkey = c_custkey""",
    "v_commit": """
        select c.repository, cast(c.o_orderkey as string) as sha,
          case when c.o_orderpriority = '5-LOW' then 2
               when c.o_orderkey % 50 = 0 then 0 else 1 end as parent_count,
          concat('dev ', c.c_custkey) as author_name,
          concat('dev', c.c_custkey, '@example.org') as author_email,
          case when c.o_orderkey % 400 = 0 then concat(c.day, ' undated') else
            concat(c.day, 'T23:00:00', case c.o_orderkey % 3 when 0 then '-05:00'
              when 1 then '+08:00' else '+00:00' end) end as committed_at_iso,
          c.on_head, h.moment is not null as is_head
        from {v_order_commit} c left join (
          select repository, max(moment) as moment from {v_order_commit}
          where on_head group by repository) h
        on c.repository = h.repository and c.moment = h.moment""",
    # Lines of author mapping files: all forms, other cases, comments, and later lines.
    "v_author_mapping": f"""
        select {_OWNED} as repository, c_custkey * 2 as place,
          case c_custkey % 8
            when 0 then concat('Team ', c_custkey % 3, ' <team', c_custkey % 3,
              '@example.org> <DEV', c_custkey, '@example.org>')
            when 1 then concat('  Renamed ', c_custkey % 5, '  <dev', c_custkey, '@Example.org> # x')
            when 2 then concat('<team1@example.org> <dev', c_custkey, '@example.org>')
            when 3 then concat('Team 1 <team1@example.org> DEV ', c_custkey, ' <dev', c_custkey,
              '@example.org>')
            when 4 then concat('Nobody <no@example.org> other name <dev', c_custkey, '@example.org>')
            when 5 then concat('# Hidden <team1@example.org> <dev', c_custkey, '@example.org>')
            when 6 then 'no address here' else '' end as value
        from {{customer}}
        union all
        select {_OWNED}, c_custkey * 2 + 1, case c_custkey % 3
          when 0 then concat('Later ', c_custkey % 4, ' <dev', c_custkey, '@example.org>')
          when 1 then concat('<team2@example.org> <dev', c_custkey, '@example.org>')
          else concat('Team 2 <dev', c_custkey, '@example.net>') end
        from {{customer}}""",
    # The same commits as a graph: side branches, some of them merged, and a second root.
    "v_commit_graph": """
        select repository, sha, author_name, author_email, committed_at_iso,
          case when r in (1, 30) then '' when r = 31 then concat(p1, ' ', p2)
            when r % 10 = 7 then coalesce(p3, '') when r % 10 = 8 then coalesce(p2, '')
            when r % 20 = 9 then concat(p1, ' ', p2) else p1 end as parents,
          case when r = head then 'HEAD -> main, tag: v1' when r % 10 = 7 then 'AHEAD' else ''
            end as refs
        from (
          select *, max(case when r % 10 <> 7 then r end) over (partition by repository) as head
          from (
            select c.repository, c.sha, author_name, author_email, committed_at_iso,
              row_number() over w as r, lag(c.sha, 1) over w as p1, lag(c.sha, 2) over w as p2,
              lag(c.sha, 3) over w as p3
            from {v_commit} c join {v_order_commit} o
              on c.repository = o.repository and c.sha = cast(o.o_orderkey as string)
            window w as (partition by c.repository order by o.moment)) numbered) headed""",
    "v_file_change": f"""
        select {_OWNED} as repository, cast(l_orderkey as string) as sha,
          l_orderkey as log_seq, concat('src/P', l_partkey, '.java') as file,
          case when l_returnflag <> 'R' then cast(l_quantity as bigint) end as added,
          case when l_returnflag <> 'R' then cast(l_linenumber as bigint) end as removed
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey
          join {{customer}} on o_custkey = c_custkey""",
    "v_method": f"""
        select {_OWNED} as repository, concat('src/P', l_partkey, '.java') as file,
          concat('m', l_linenumber) as method, cast(l_quantity as int) as nloc,
          l_linenumber as ccn, cast(l_quantity as int) * 7 as tokens,
          l_linenumber % 4 as parameters, cast(l_quantity as int) + 2 as length
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey
          join {{customer}} on o_custkey = c_custkey""",
    # One repository has no commit counts at all, some counts are very large, and closing
    # times are sometimes only known as merge times.
    "v_pull_request": f"""
        select repository, number, state, created_at,
          case when state = 'open' or number % 4 = 2 then '' else ended_at end as closed_at,
          case when merged then ended_at else '' end as merged_at, author,
          case when repository <> '3/BUILDING' then commits end as commits
        from (
          select {_OWNED} as repository, o_orderkey as number,
            case when o_orderstatus = 'O' then 'open' else 'closed' end as state,
            o_orderstatus = 'P' as merged,
            concat(cast(cast(o_orderdate as date) as string), 'T08:',
              lpad(cast(o_orderkey % 60 as string), 2, '0'), ':',
              lpad(cast(o_orderkey % 47 as string), 2, '0'), 'Z') as created_at,
            case when shipped is null then '' else
              concat(cast(cast(shipped as date) as string), 'T16:30:',
                lpad(cast(o_orderkey % 53 as string), 2, '0'), '+02:00') end as ended_at,
            concat('dev', c_custkey) as author,
            case when o_orderkey % 1500 = 0 then 3000000000000 else lines end as commits
          from {{orders}} join {{customer}} on o_custkey = c_custkey
            left join (select l_orderkey, count(*) as lines, max(l_shipdate) as shipped
                       from {{lineitem}} group by l_orderkey) l on o_orderkey = l_orderkey
        ) pr""",
    "v_structure": f"""
        select {_PART_OWNED} as repository, concat('T', p_partkey, '.java') as file,
          concat('T', p_partkey) as type_name,
          case when p_type in ('PROMO', 'LARGE') then 'interface'
               when p_type = 'SMALL' then 'enum' else 'class' end as kind,
          p_size % 2 = 0 as is_abstract, p_type in ('PROMO', 'LARGE') as is_interface,
          p_size as methods, p_size % 5 as attributes,
          case when p_brand in ('Brand#1', 'Brand#2', 'Brand#3') then ''
               when p_brand = 'Brand#4' then null else p_brand end as extends,
          '' as implements
        from {{part}}""",
    # Several rows per name, some of them unusable, so the order of filtering shows.
    "v_repository": """
        select case when c_custkey % 97 = 0 then '' else
            concat(c_nationkey, '/', c_mktsegment) end as full_name,
          concat('https://example.org/', c_custkey) as url,
          4000 + (c_custkey * 37) % 9000 as stars, 900 + (c_custkey * 13) % 2000 as forks,
          c_custkey % 50 as open_issues,
          case c_custkey % 4 when 0 then 'Java' when 1 then 'java' when 2 then 'JAVA'
            else 'Kotlin' end as language,
          case when c_custkey % 3 = 0 then 'MIT' else '' end as license,
          case when c_custkey % 11 = 0 then '' when c_custkey % 13 = 0 then 'soon'
               when c_custkey % 17 = 0 then '2025-05-31T00:00:01Z'
               when c_custkey % 19 = 0 then '2025-05-31T00:00:00Z'
               else concat('202', 4 + c_custkey % 3, '-0', 1 + c_custkey % 9,
                           '-15T10:00:00Z') end as pushed_at,
          c_custkey % 6 = 0 as archived, c_name as description, c_custkey as seq
        from {customer}""",
    "v_source": "select " + _PART_OWNED + """ as repository,
          concat(case when p_partkey % 8 = 0 then 'src/test/'
              when p_partkey % 4 = 0 then 'a/src/test/'
              when p_partkey % 16 = 1 then 'src/testing/' else 'a/src/main/' end,
            'C', p_partkey, case when p_partkey % 6 = 0 then 'Test.java'
              when p_partkey % 10 = 0 then 'Tests.java' else '.java' end) as file,
          case when p_partkey % 101 = 0 then '' else concat('package p;', chr(10),
            case when p_partkey % 2 = 0 then '// note' else 'int a = b ? 1 : 2;' end, chr(10),
            case when p_partkey % 3 = 0 then '  ' else ' * doc' end, chr(13), chr(10),
            case when p_partkey % 5 = 0 then '@Test void t(){{ if (a && b) {{}} }}'
                 else '/* if (x) class Gone {{ */' end, chr(10),
            case when p_partkey % 7 = 0 then 'import org.junit.Test;'
                 when p_partkey % 11 = 0 then 'import ORG.MOCKITO.Mock;'
                 when p_partkey % 13 = 0 then 'import org.testng.X; import spock.lang.Y;'
                 else 'x = y;' end, chr(12), chr(9), chr(10),
            case p_partkey % 8
              when 0 then concat('public abstract class C', p_partkey,
                '<T extends Comparable<T>> extends Base<T, U> implements A, B<T> {{')
              when 1 then concat('interface I', p_partkey, ' extends A, B {{')
              when 2 then concat('enum E', p_partkey, ' {{ X; static class In {{ }} }}')
              when 3 then 'String s = "http://x class Fake {{"; // class Hidden {{'
              when 4 then concat('@interface N', p_partkey, ' {{')
              when 5 then concat('final class F', p_partkey, ' implements A {{ /* open')
              else '@Tests @TestFactory @Test' end,
            case when p_partkey % 9 = 0 then '' else chr(10) end) end as text
        from {part}""",
    # Classes with members of every kind, nested types, and blocks that are no methods.
    "v_java": "select " + _PART_OWNED + """ as repository,
          concat('src/', p_size, '/J', p_partkey, '.java') as file, concat(
            'package p;', chr(10), '/* class Gone {{ */ import a.b.C;', chr(10),
            case when p_partkey % 5 = 0 then '@Deprecated(since = "1")' else '// {{ note' end,
            chr(10), case when p_partkey % 3 = 0 then 'public abstract ' else '' end,
            'class J', p_partkey, '<T extends Comparable<T>> extends Base<T, U> ',
            case when p_partkey % 4 = 0 then 'implements A, B<T> ' else '' end, '{{', chr(10),
            '  private static final int X = 1, Y = f(2, 3);', chr(10),
            case when p_partkey % 2 = 0 then
              '  Map<String, List<Integer>> m = new HashMap<>(), n;' else '  int[] a = {{1, 2}}, b[];'
              end, chr(10), '  Runnable r = () -> {{ int z = 1; }};', chr(10),
            '  static {{ X = ', p_size, '; }}', chr(10),
            '  J', p_partkey, '(int a, @Ann(x = 1) Map<K, V> b) {{ super(a); }}', chr(13), chr(10),
            case when p_partkey % 7 = 0 then concat('  @Override', chr(10)) else chr(10) end,
            '  public <R> List<R> go', p_size, '(final int n,', chr(10), chr(9),
            '  String... s) throws IOException, E {{', chr(10),
            '    for (int i = 0; i < n; i++) {{', chr(10),
            repeat(concat('      if (a && b || c) {{ x("}}"); }} // }}', chr(10)),
              cast(p_size % 6 as int)), '    }}', chr(10), chr(10),
            '    List<?> q = null; int w = a ? 1 : 2; do {{ x(); }} while (y);', chr(10),
            case when p_partkey % 6 = 0 then concat('    new Thread(new Runnable() {{ public void',
              ' run() {{ int l; try {{ }} catch (E e) {{ }} }} }});', chr(10)) else '' end,
            '    return "{{;";', chr(10), '  }}', chr(10),
            case when p_partkey % 3 = 0 then '  abstract void sig(int k);' else
              '  int one() {{ return 1; }} int two(char c) {{ return c == ''{{'' ? 2 : 3; }}' end, chr(10),
            case p_partkey % 4
              when 0 then '  class In {{ int f; void g() {{}} enum E {{ A, B(1) {{ void h() {{}} }}; int v; E() {{}} }} }}'
              when 1 then '  interface Q extends A, B {{ int C = 1; void a(); default void d() {{ while (x) ; }} }}'
              when 2 then '  enum P {{ ONE, TWO; final int v = 1; P() {{}} int v() {{ return v; }} }}'
              else '  @interface N {{ String v() default ""; }}' end, chr(10),
            case when p_partkey % 11 = 0 then '  void open() {{ if (x) {{' else concat('}}', chr(10)) end)
          as text
        from {part}""",
    # Whole documents with a class around them, whose last method holds the text.
    "v_coded_document": """
        select repository, file, concat('class ', replace(file, '.java', ''), ' {{ int a, b; ',
          'void f(int i) {{ g(i); }}', chr(10), 'String held(List<A, B> l, int k) {{', chr(10),
          replace(text, chr(39), ' '), chr(10), '}} }}') as text
        from {v_document}""",
    # Whole documents with a type declaration after them.
    "v_declaring_document": """
        select repository, file, concat(replace(text, chr(39), ' '), chr(10), ';abstract class ',
          replace(replace(file, '.java', ''), 'doc', 'D'), '<T> extends Base<', repository,
          '> implements I, J<K> {{') as text
        from {v_document}""",
    # The same sources, some under names that listings tend to hide.
    "v_tree_source": """
        select repository, case length(file) % 3 when 0 then concat('.h/', file)
          when 1 then concat('src/_', replace(file, '/', '_')) else file end as file, text
        from {v_source}""",
    # The same sources under the names that line-count reports use.
    "v_part_source": """
        select concat('o/', split_part(repository, '/', 1)) as repository, file, text
        from {v_source}""",
    # Whole documents as source files: much text, several languages, no mercy.
    "v_document": """
        select source as repository, concat('doc', doc_id, '.java') as file, text
        from {documents}""",
}


_SCHEMAS: dict[str, StructType] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view built on the driver tables."""
    if name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = spark.read.parquet(path).schema
        # With a known schema no job has to open the file's footer first.
        return spark.read.schema(_SCHEMAS[path]).parquet(path)
    text = VIEWS[name]
    inputs = {used: load(spark, sf_dir, used) for used in _inputs(text)}
    return spark.sql(text, **inputs)


def _inputs(text: str) -> list[str]:
    return [name for name in (*TABLES, *VIEWS) if f"{{{name}}}" in text]


def with_views(query: str, *names: str) -> str:
    """The query preceded by the definitions of the views it uses."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for used in _inputs(VIEWS[name]):
            if used in VIEWS:
                visit(used)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    plain = {name: name for name in (*TABLES, *VIEWS)}
    parts = [f"{name} as ({VIEWS[name].format(**plain)})" for name in ordered]
    return f"with {', '.join(parts)} {query}" if parts else query
