"""Readers and writers, on raw text that Spark derives from the driver's tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from codestrata.functions.names import folder_of, repository_of, short_name
from codestrata.operators import candidates, code, history
from codestrata.operators.ranking import first_per_key
from codestrata.plans.indicators import align_key, stack
from codestrata.session import remove_at_exit, shared_folder
from codestrata.sinks.tables import (
    consolidate,
    normalise_key,
    replace_repositories,
    scan_replaced,
    write_csv,
    write_nothing,
    write_repository_list,
)
from codestrata.sources import history_text, hosting, landed, listing, trees
from workload.code_queries import STRUCTURE, line_classes_sql
from workload.history_queries import DEVELOPERS
from workload.registry import query
from workload.views import load


@query(
    """select concat('owner/', c_custkey, case when c_custkey % 3 = 0 then ' # kept' else '' end)
          as repository, c_custkey as seq
        from customer where c_custkey % 5 <> 0 and c_custkey % 7 <> 0"""
)
def repository_list(spark, sf_dir):
    key = F.col("c_custkey")
    name = F.concat(F.lit("owner/"), key)
    line = (
        F.when(key % 5 == 0, F.lit(" \t "))
        .when(key % 7 == 0, F.concat(F.lit("# "), name))
        .when(key % 3 == 0, F.concat(F.lit(" "), name, F.lit(" # kept ")))
        .otherwise(F.concat(name, F.lit(" ")))
    )
    lines = load(spark, sf_dir, "customer").select(line.alias("value"), key.alias("seq"))
    return landed.parse_repository_list(lines)


@query(
    """select concat('o/', c_custkey) as full_name, concat('https://x/', c_custkey) as url,
          case when c_custkey % 5 = 0 then 0 else c_custkey * 3 end as stars,
          c_custkey * 2 as forks,
          case when c_custkey % 2 = 0 then c_custkey % 9 else 0 end as open_issues,
          case when c_custkey % 11 = 0 then '' else 'Java' end as language,
          case when c_custkey % 2 = 0 then 'MIT' when c_custkey % 3 = 0 then 'GPL' else ''
            end as license,
          '2026-01-01T00:00:00Z' as pushed_at, c_custkey % 7 = 0 as archived,
          case when c_custkey % 13 = 0 then '' else concat(c_name, ' x') end as description
        from customer"""
)
def repository_json(spark, sf_dir):
    key = F.col("c_custkey")
    described = F.when(key % 13 != 0, F.concat("c_name", F.lit("\nx"))).alias("description")
    stars = F.when(key % 5 != 0, key * 3)
    language = F.when(key % 11 != 0, F.lit("Java")).alias("language")
    pushed = F.lit("2026-01-01T00:00:00Z")
    name = F.concat(F.lit("o/"), key)
    url = F.concat(F.lit("https://x/"), key)
    snake = F.to_json(
        F.struct(
            name.alias("full_name"), url.alias("html_url"), stars.alias("stargazers_count"),
            (key * 2).alias("forks_count"), (key % 9).alias("open_issues_count"), language,
            F.struct(F.lit("MIT").alias("spdx_id")).alias("license"),
            pushed.alias("pushed_at"), (key % 7 == 0).alias("archived"), described,
        )
    )
    camel = F.to_json(
        F.struct(
            name.alias("fullName"), url.alias("url"), stars.alias("stargazersCount"),
            (key * 2).alias("forksCount"), language,
            F.when(key % 3 == 0, F.lit("GPL")).alias("license"),
            pushed.alias("pushedAt"), (key % 7 == 0).alias("isArchived"), described,
        )
    )
    lines = load(spark, sf_dir, "customer").select(
        F.when(key % 2 == 0, snake).otherwise(camel).alias("value")
    )
    return hosting.parse_repository_json(lines)


@query(
    """select 'o/r' as repository, o_orderkey as number, lower(o_orderstatus) as state,
          cast(cast(o_orderdate as date) as varchar) as created_at,
          case when o_orderkey % 2 = 0 then 'c' else '' end as closed_at, '' as merged_at,
          case when o_orderkey % 3 = 0 then '' else concat('u', o_custkey) end as author,
          case when o_orderkey % 7 = 0 then o_orderkey % 90 when o_orderkey % 5 <> 0 then 1
            end as commits
        from orders"""
)
def pull_request_json(spark, sf_dir):
    key = F.col("o_orderkey")
    link = F.concat(
        F.lit('<https://x/c?per_page=1&page=2>; rel="next", <https://x/c?per_page=1&page='),
        key % 90, F.lit('>; rel="last"'),
    )
    author = F.struct(F.concat(F.lit("u"), "o_custkey").alias("login"))
    record = F.struct(
        F.lit("o/r").alias("repository"), key.alias("number"),
        F.lower("o_orderstatus").alias("state"),
        F.col("o_orderdate").cast("date").cast("string").alias("created_at"),
        F.when(key % 2 == 0, F.lit("c")).alias("closed_at"),
        F.when(key % 3 != 0, author).alias("user"),
        F.when(key % 7 == 0, link).alias("link"),
        F.when((key % 7 == 0) | (key % 5 != 0), F.lit(1)).alias("items"),
    )
    lines = load(spark, sf_dir, "orders").select(F.to_json(record).alias("value"))
    return hosting.parse_pull_request_json(lines)


@query(
    """select o_orderkey as number,
          case when o_orderkey % 3 = 0 then o_orderkey % 500 else 1 end as results
        from orders"""
)
def result_counts(spark, sf_dir):
    key = F.col("o_orderkey")
    link = F.concat(F.lit("<https://x/c?page="), key % 500, F.lit('>; rel="last"'))
    first_page = F.lit('<https://x/c?page=2>; rel="next"')
    header = F.when(key % 3 == 0, link).when(key % 3 == 1, first_page)
    return load(spark, sf_dir, "orders").select(
        key.alias("number"), hosting.result_count(header, F.lit(1).cast("long")).alias("results")
    )


@query(
    """select concat('o/', l_suppkey % 10) as repository,
          concat('d/', l_partkey, case when l_linenumber = 7 then '.bin' else '.java' end) as file,
          count(*) as commits,
          cast(coalesce(sum(case when l_linenumber <> 7 then cast(l_quantity as bigint) end), 0)
            as bigint) as lines_added,
          cast(coalesce(sum(case when l_linenumber <> 7 then l_linenumber end), 0)
            as bigint) as lines_removed
        from lineitem group by 1, 2
        union all
        select concat('o/', l_suppkey % 10), 'a/{x => y}/C.java', count(*), count(*), 0
        from lineitem group by 1"""
)
def change_log(spark, sf_dir):
    binary = F.col("l_linenumber") == 7
    counts = F.concat_ws("\t", F.col("l_quantity").cast("long"), F.col("l_linenumber"))
    path = F.concat(F.lit("d/"), "l_partkey", F.when(binary, ".bin").otherwise(".java"))
    record = F.concat(
        F.when(F.col("l_linenumber") == 1, F.lit("C")).otherwise(F.lit("")),
        F.sha1(F.col("l_orderkey").cast("string")), F.lit("\n\n"),
        F.when(binary, F.lit("-\t-")).otherwise(counts), F.lit("\t"), path,
        F.lit("\n1\t0\ta/{x => y}/C.java\nnot a change\n"),
    )
    records = load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o/"), F.col("l_suppkey") % 10).alias("repository"),
        F.col("l_orderkey").alias("log_seq"),
        record.alias("value"),
    )
    return history.file_churn(history_text.parse_change_log(records)).drop("first_seen")


@query(DEVELOPERS, "v_commit")
def author_summary(spark, sf_dir):
    developers = history.developer_commits(load(spark, sf_dir, "v_commit"))
    line = F.concat(
        F.lit("   "), "commits", F.lit("\t"), "developer", F.lit(" <"), "email", F.lit(">")
    )
    lines = developers.select("repository", F.explode(F.array(line, F.lit("junk"))).alias("value"))
    return history_text.parse_author_summary(lines)


_REPORTED = """
    select concat('o/', c_custkey) as repository, c_custkey as files, c_custkey * 2 as blank,
      c_custkey * 3 as comment, c_custkey * 4 as code,
      case when c_custkey % 3 = 0 then 0 else c_custkey end as java_files,
      case when c_custkey % 3 = 0 then 0 else c_custkey * 4 end as java_code,
      cast(0 as bigint) as java_comment, cast(0 as bigint) as java_blank
    from customer where c_custkey % 5 <> 0"""


def _reports(spark, sf_dir, name):
    key = F.col("c_custkey")
    java = F.struct(key.alias("nFiles"), (key * 4).alias("code"))
    total = F.struct(
        key.alias("nFiles"), (key * 2).alias("blank"), (key * 3).alias("comment"),
        (key * 4).alias("code"),
    )
    report = F.to_json(F.struct(F.when(key % 3 != 0, java).alias("Java"), total.alias("SUM")))
    return load(spark, sf_dir, "customer").select(
        name.alias("repository"),
        F.when(key % 5 == 0, F.lit("{broken")).otherwise(report).alias("value"),
    )


@query(_REPORTED)
def line_count_reports(spark, sf_dir):
    name = F.concat(F.lit("o/"), "c_custkey")
    return trees.parse_line_counts(_reports(spark, sf_dir, name))


@query(
    f"""select coalesce(r.repository, s.repository) as repository,
          {", ".join(
              f"case when r.repository is null then s.{name} else r.{name} end as {name}"
              for name in ("files", "blank", "comment", "code", "java_files", "java_code",
                           "java_comment", "java_blank")
          )}
        from ({_REPORTED}) r full join (
          select *
          from ({line_classes_sql("v_part_source")}) l) s
        on r.repository = s.repository""",
    "v_part_source",
)
def line_count_choice(spark, sf_dir):
    name = F.concat(F.lit("o/"), "c_custkey")
    reported = trees.parse_line_counts(_reports(spark, sf_dir, name))
    counted = code.line_classes(code.source_profile(load(spark, sf_dir, "v_part_source")))
    return trees.first_available(reported, counted)


@query(
    """select c_custkey, concat('owner', c_custkey, '__', c_name) as folder,
          concat('owner', c_custkey, '/', c_name) as repository, c_name as short_name
        from customer"""
)
def key_codec(spark, sf_dir):
    name = F.concat(F.lit("owner"), "c_custkey", F.lit("/"), "c_name")
    folders = load(spark, sf_dir, "customer").select("c_custkey", folder_of(name).alias("folder"))
    key = repository_of(F.col("folder"))
    return folders.select(
        "c_custkey", "folder", key.alias("repository"), short_name(key).alias("short_name")
    )


@query(
    """select distinct concat('o/', l_partkey) as repository from lineitem
        where l_partkey % 3 = 0"""
)
def repository_discovery(spark, sf_dir):
    part = F.col("l_partkey")
    inside = F.when(part % 3 == 0, F.lit("/.git/HEAD")).otherwise(F.lit("/src/.git/x"))
    path = F.concat(F.lit("file:/data/repos/o__"), part, inside)
    listing = load(spark, sf_dir, "lineitem").select(path.alias("path"))
    return trees.discover_repositories(listing, "/data/repos")


@query("select repository, file, text from v_source", "v_source")
def source_files(spark, sf_dir):
    rows = load(spark, sf_dir, "v_source")
    invalid = F.unhex(F.lit("C3FF"))
    content = F.when(
        F.length("text") % 2 == 0, F.concat(invalid, F.encode("text", "utf-8"), invalid)
    ).otherwise(F.encode("text", "utf-8"))
    path = F.concat(F.lit("file:/data/repos/"), folder_of(F.col("repository")), F.lit("/"), "file")
    tree = rows.select(path.alias("path"), content.alias("content"))
    hidden = rows.select(
        F.concat(F.lit("file:/data/repos/x/.git/"), "file").alias("path"),
        F.encode("text", "utf-8").alias("content"),
    )
    return trees.parse_source_files(stack(tree, hidden), "/data/repos")


def temporary_folder(spark, name):
    """A folder of its own in the shared one, removed when the process ends."""
    path = f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


@query(
    """select 'header only' as sink, cast(0 as bigint) as rows, count(*) as landed
        from v_structure union all
        select 'with rows', count(*), count(*) from v_structure""",
    "v_structure",
)
def header_only_output(spark, sf_dir):
    rows = load(spark, sf_dir, "v_structure")
    empty, full = (temporary_folder(spark, "header_only") for _ in range(2))
    write_nothing(spark, empty, "structure")
    write_csv(rows, full, "structure")
    landed_rows = rows.agg(F.count(F.lit(1)).alias("landed"))
    counts = stack(*(
        landed.scan_csv(spark, path, "structure")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(sink).alias("sink"), "rows")
        for sink, path in (("header only", empty), ("with rows", full))
    ))
    return counts.withColumn("landed", landed_rows.scalar())


@query(
    """select full_name as repository from v_repository
        where lower(language) = 'java' and stars > 5000 and forks > 1000 and not archived
          and trim(full_name) <> ''
        order by stars desc, full_name, seq limit 30""",
    "v_repository",
)
def name_list(spark, sf_dir):
    path = temporary_folder(spark, "name_list")
    rows = load(spark, sf_dir, "v_repository").filter(F.col("full_name") != "")
    write_repository_list(candidates.search(rows).orderBy("seq"), path)
    return landed.scan_repository_list(spark, path).select("repository")


@query(
    """select repository, number, state, created_at, closed_at, merged_at, author, commits
        from v_pull_request""",
    "v_pull_request",
)
def pull_request_files(spark, sf_dir):
    """Raw pull requests written as JSON lines and read back by their reader."""
    path = temporary_folder(spark, "pull_request_files")
    rows = load(spark, sf_dir, "v_pull_request")
    rows.select(
        "repository", "number", "state", "created_at", "closed_at", "merged_at",
        F.struct(F.col("author").alias("login")).alias("user"), F.col("commits").alias("items"),
    ).write.json(path)
    return hosting.scan_pull_request_json(spark, path).select(
        "repository", "number", "state", "created_at", "closed_at", "merged_at", "author",
        "commits",
    )


def search_pages(rows):
    """Search responses of at most 100 results each, from rows numbered by ``seq``."""
    item = F.struct(
        "full_name", F.col("stars").alias("stargazers_count"), F.col("forks").alias("forks_count"),
        "archived",
    )
    return rows.groupBy(F.floor(F.col("seq") / 100).alias("page")).agg(
        F.count(F.lit(1)).alias("total_count"), F.collect_list(item).alias("items")
    )


@query(
    """select full_name, stars, forks, archived from v_repository where full_name <> ''""",
    "v_repository",
)
def search_envelopes(spark, sf_dir):
    """Search responses with many results each, written as JSON and read back."""
    path = temporary_folder(spark, "search_envelopes")
    rows = load(spark, sf_dir, "v_repository").filter(F.col("full_name") != "")
    search_pages(rows).drop("page").write.json(path)
    found = hosting.scan_repository_json(spark, path, "seq")
    return found.select("full_name", "stars", "forks", "archived")


@query(
    """select repository, sha, parent_count, author_name, author_email, committed_at_iso,
          on_head, is_head from v_commit""",
    "v_commit",
)
def commit_log(spark, sf_dir):
    """Commit logs written as text and read back as commit facts."""
    every, head = (temporary_folder(spark, "commit_log") for _ in range(2))
    commits = load(spark, sf_dir, "v_commit")
    parents = F.array_join(F.array_repeat(F.lit("p"), F.col("parent_count")), " ")
    refs = F.when(F.col("is_head"), F.lit("HEAD -> main")).otherwise(F.lit(""))
    line = F.concat_ws("\x1f", "repository", "sha", parents, "author_name", "author_email",
                       "committed_at_iso", refs)
    commits.select(line).write.text(every)
    commits.filter("on_head").select(F.concat_ws("\x1f", "repository", "sha")).write.text(head)
    return history_text.scan_commit_log(spark, every, head)


@query(STRUCTURE, "v_structure")
def csv_round_trip(spark, sf_dir):
    path = temporary_folder(spark, "csv_round_trip")
    write_csv(load(spark, sf_dir, "v_structure"), path, "structure")
    return code.structure_summary(landed.scan_csv(spark, path, "structure"))


@query(STRUCTURE, "v_structure")
def consolidated_structure(spark, sf_dir):
    database = f"consolidated_{uuid.uuid4().hex}"
    place = temporary_folder(spark, database)
    spark.sql(f"create database {database} location '{place}'")
    padded = F.concat(F.lit("\t"), "repository", F.lit(" "))
    rows = load(spark, sf_dir, "v_structure").withColumn("repository", padded)
    (table,) = consolidate(spark, {"structure": rows}, database)
    return code.structure_summary(spark.table(table))


@query(
    """select repository, arg_min(stars, seq) as stars, arg_min(forks, seq) as forks from (
          select full_name as repository, * from v_repository) r
        group by repository""",
    "v_repository",
)
def first_row_per_key(spark, sf_dir):
    rows = align_key(load(spark, sf_dir, "v_repository"))
    return first_per_key(rows.select("repository", "stars", "forks", "seq"), "repository", "seq")


@query(
    """select repository, count(*) as rows, count(file) as files from (
          select repository, file from v_structure
          union all select repository, file from v_source
          union all select repository, null from v_commit) s
        group by repository""",
    "v_structure",
    "v_source",
    "v_commit",
)
def stacked_landings(spark, sf_dir):
    landings = [
        load(spark, sf_dir, "v_structure").select("repository", "file"),
        load(spark, sf_dir, "v_source").select("file", "repository"),
        load(spark, sf_dir, "v_commit").select("repository"),
    ]
    return stack(*landings).groupBy("repository").agg(
        F.count(F.lit(1)).alias("rows"), F.count("file").alias("files")
    )


@query("select distinct concat('o/', c_custkey) as repository from customer")
def stripped_keys(spark, sf_dir):
    padded = F.concat(F.lit(" \t"), F.lit("o/"), "c_custkey", F.lit(" \n"))
    rows = load(spark, sf_dir, "customer").select(padded.alias("repository"))
    return normalise_key(rows).distinct()


def write_tree(spark, sf_dir):
    """Files of every source, and what marks a checkout in every second repository."""
    root = temporary_folder(spark, "tree").removeprefix("file:")
    rows = load(spark, sf_dir, "v_tree_source")
    below = F.concat(folder_of(F.col("repository")), F.lit("/"), F.col("file"))
    marked = rows.where(F.length("repository") % 2 == 0).select("repository").distinct()
    head = F.concat(folder_of(F.col("repository")), F.lit("/.git/HEAD"))
    inner = F.concat(folder_of(F.col("repository")), F.lit("/.git/objects/Hidden.java"))
    files = (
        rows.select(below.alias("file"), "text")
        .unionByName(marked.select(head.alias("file"), F.lit("ref").alias("text")))
        .unionByName(marked.select(inner.alias("file"), F.lit("class X {}").alias("text")))
    )

    def written(batches):
        for batch in batches:
            for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{root}/{file}"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w", newline="") as target:
                    target.write(text)
            yield batch

    files.mapInArrow(written, files.schema).write.format("noop").mode("overwrite").save()
    return root


@query("select repository, file, text from v_tree_source", "v_tree_source")
def tree_sources(spark, sf_dir):
    return listing.scan_tree_sources(spark, write_tree(spark, sf_dir))


@query(
    """select distinct repository from v_tree_source where length(repository) % 2 = 0""",
    "v_tree_source",
)
def tree_repositories(spark, sf_dir):
    root = write_tree(spark, sf_dir)
    return trees.discover_repositories(listing.list_tree(spark, root), root)


@query(
    """select repository, file, type_name, kind, is_abstract, is_interface,
          case when repository like '1%' then methods else -1 end as methods, attributes,
          extends, implements from v_structure""",
    "v_structure",
)
def repository_replacement(spark, sf_dir):
    """A landing of all repositories, and then one of some, with other values."""
    path = temporary_folder(spark, "replacement")
    rows = load(spark, sf_dir, "v_structure")
    replace_repositories(rows.withColumn("methods", F.lit(-1)), path, "structure")
    again = rows.where(F.startswith("repository", F.lit("1")))
    replace_repositories(again, path, "structure")
    return scan_replaced(spark, path, "structure")
