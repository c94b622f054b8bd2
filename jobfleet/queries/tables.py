"""The engine's input tables, derived by Spark from the benchmark tables.

``jobs`` and the bundle metadata stand for exported snapshots. They are derived
once per session and input folder, written to the staging folder and then
scanned like any stored snapshot. All other inputs are derived in the query.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobfleet.schemas import EVENT_FIELDS, HOST, JOBS, SETTINGS, WEBHOOK
from jobfleet.staging import qualified, spread, staging_path, write_staged

ROOT_FILE = "bundle.yml"
PARTS_OF_A_TASK = 5000
LINES_OF_A_TASK = 300_000

_staged: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _once(spark: SparkSession, sf_dir: str, name: str, build, **options) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        derived = build(spark, sf_dir)
        _staged[key] = write_staged(derived, name, **options), derived.schema
    path, schema = _staged[key]
    return spark.read.schema(schema).parquet(path)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "jobs", _dealt_jobs, partition_by=HOST, dealt=True)


def derive_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with customer and nation as jobs; their line items as webhook lists."""
    return _written_out(_job_facts(spark, sf_dir))


def _dealt_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, dealt and sorted by workspace while a job is a few numbers; settings are built where they are written."""
    # a null workspace and an empty one are the same partition, and only a column without nulls keeps its order
    facts = _job_facts(spark, sf_dir).withColumn(HOST, F.coalesce(HOST, F.lit("")))
    return _written_out(spread(facts, HOST).sortWithinPartitions(HOST))


def _job_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job is made of: its order, the customer's segment, and a small number for each line item."""
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    host = nation.select("n_nationkey", F.concat(F.lit("ws-"), F.col("n_regionkey")).alias(HOST))
    placed = customer.join(host, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", HOST)
    lists = _line_codes(read(spark, sf_dir, "lineitem"))
    return (
        orders.join(placed, F.col("o_custkey") == F.col("c_custkey"))
        .drop("c_custkey")
        .join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .drop("l_orderkey")
    )


def _written_out(facts: DataFrame) -> DataFrame:
    key, cust, priority = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")

    name = (
        F.when(key % 17 == 0, F.lit(None).cast("string"))
        .when(key % 19 == 0, "")
        .otherwise(F.concat(F.lower(priority), F.lit("-"), key))
    )
    creator = F.when(
        cust % 23 != 0, F.concat(F.lit("user"), cust % 50, F.lit("@example.com"))
    )
    team = F.create_map(F.lit("team"), F.col("c_mktsegment"))
    tags = F.when(
        key % 13 != 0,
        F.when(key % 2 == 0, F.map_concat(team, F.create_map(F.lit("tier"), priority))).otherwise(team),
    )
    kind = (
        F.when(F.col("o_orderstatus") == "F", "BUNDLE")
        .when(key % 2 == 0, "bundle")
        .otherwise("MANUAL")
    )
    deployment = F.when(
        F.col("o_orderstatus") != "O",
        F.struct(kind.alias("kind"), _bundle_path(cust % 40).alias("metadata_file_path")),
    )
    settings = F.struct(
        name.alias("name"),
        tags.alias("tags"),
        deployment.alias("deployment"),
        _webhook_lists(F.col("codes")).alias("webhook_notifications"),
    )
    return facts.select(
        HOST,
        key.alias("scan_ordinal"),
        key.alias("job_id"),
        creator.alias("creator_user_name"),
        settings.cast(SETTINGS).alias("settings"),
    ).select(*JOBS.names)


def _bundle_path(number: Column) -> Column:
    return F.concat(F.lit("/Workspace/bundles/"), number, F.lit("/metadata.json"))


def _line_codes(lineitem: DataFrame) -> DataFrame:
    """``(l_orderkey, codes)``: a number from 0 to 61 for every line item, of its event (the high bits) and its hook."""
    # Line items go to their order once, as three numbers. Equal ones are counted before they are collected.
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    event = F.when(flag == "A", 0).when(flag == "N", 1).when(status == "O", 2).otherwise(3)
    hook = F.coalesce((F.col("l_suppkey") % 7).cast("int") + 7, F.lit(0))
    code = (F.shiftleft(event, 4) + hook).cast("tinyint")
    narrow = _dealt_lines(lineitem.select("l_orderkey", "l_linenumber", code.alias("code")), lineitem.count())
    counted = narrow.groupBy("l_orderkey", "l_linenumber", "code").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    item = F.struct(F.shiftright(F.col("code").cast("int"), 4).alias("event"), "l_linenumber", "code", "copies")
    items = F.array_sort(F.collect_list(item))
    written_out = F.flatten(F.transform(items, lambda i: F.array_repeat(i["code"], i["copies"])))
    return counted.groupBy("l_orderkey").agg(written_out.alias("codes"))


def _dealt_lines(lines: DataFrame, count: int) -> DataFrame:
    """``lines`` by order; many of them in a fixed number of tasks, as Spark merges small compressed ones into a few large ones."""
    spark = lines.sparkSession
    tasks = math.ceil(count / LINES_OF_A_TASK)
    if tasks <= spark.sparkContext.defaultParallelism:
        return lines.repartition("l_orderkey")
    return lines.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "l_orderkey")


def _webhook_lists(codes: Column) -> Column:
    """The list of each event, in line order; null where it has no entry, and null as a whole without line items."""

    def entry(code: Column) -> Column:
        hook = F.nullif(code.cast("int").bitwiseAND(15), F.lit(0)) - 7
        return F.struct(F.concat(F.lit("wh-"), hook).alias("id"))

    def webhooks(number: int, event: str) -> Column:
        mine = F.filter(codes, lambda c: F.shiftright(c.cast("int"), 4) == number)
        return F.when(F.size(mine) > 0, F.transform(mine, entry)).alias(event)

    return F.when(codes.isNotNull(), F.struct(*[webhooks(i, event) for i, event in enumerate(EVENT_FIELDS)]))


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region")
    return region.select(F.concat(F.lit("ws-"), F.col("r_regionkey")).alias(HOST))


def hosts(spark: SparkSession, sf_dir: str) -> list[str]:
    """The workspace list a user would give: one name per region."""
    return [row[HOST] for row in workspaces(spark, sf_dir).orderBy(HOST).collect()]


def update_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("job_id") % 29 != 0
    return jobs(spark, sf_dir).select(HOST, "job_id", ok.alias("ok"))


def retried_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in which each sixth job was sent twice: it failed, then went through."""
    again = F.col("job_id") % 6 == 0
    once = update_results(spark, sf_dir)
    failed = once.filter(again).withColumn("ok", F.lit(False))
    return failed.unionByName(once.withColumn("ok", again | F.col("ok")))


def _whole_listings(pages: DataFrame) -> DataFrame:
    """``(workspace_host, page, items)`` with a page for every number up to a workspace's last one, and its tokens."""
    last = pages.groupBy(HOST).agg(F.max("page").alias("last"))
    every = last.select(HOST, "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("page"))
    token = F.concat(F.lit("page-"), F.col("page"))
    after = F.concat(F.lit("page-"), F.col("page") + 1)
    tokens = {
        "page_token": F.when(F.col("page") > 0, token),
        "next_page_token": F.when(F.col("page") < F.col("last"), after),
    }
    return every.join(pages, [HOST, "page"], "left").withColumns(tokens).drop("last")


def destination_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as destinations: listing pages of five keys per workspace; some have no results."""
    suppliers = read(spark, sf_dir, "supplier").join(
        read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    item = F.struct(
        F.col("s_suppkey"),
        F.concat(F.lit("dst-"), F.col("s_suppkey")).alias("id"),
        F.concat(F.lit("hook-"), F.col("s_suppkey") % 10).alias("display_name"),
        F.lit("WEBHOOK").alias("destination_type"),
    )
    pages = suppliers.groupBy(
        F.concat(F.lit("ws-"), F.col("n_regionkey")).alias(HOST),
        F.floor(F.col("s_suppkey") / 5).alias("page"),
    ).agg(F.array_sort(F.collect_list(item)).alias("items"))
    results = F.transform(
        "items", lambda i: F.struct(i["id"], i["display_name"], i["destination_type"])
    )
    return _whole_listings(pages).select(HOST, "page", "page_token", results.alias("results"), "next_page_token")


PAGE_KEYS = 250


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(workspace_host, page, page_token, next_page_token, jobs)``: the jobs of ``PAGE_KEYS`` order keys a page."""
    item = F.struct("job_id", "creator_user_name", "settings")
    pages = jobs(spark, sf_dir).groupBy(HOST, F.floor(F.col("scan_ordinal") / PAGE_KEYS).alias("page")).agg(
        F.collect_list(item).alias("jobs")
    )
    by_id = F.array_sort("jobs", lambda a, b: (a["job_id"] - b["job_id"]).cast("int"))
    return _whole_listings(pages.withColumn("jobs", by_id))


def write_job_pages(pages: DataFrame, path: str) -> None:
    """Pages as JSON lines, a folder per workspace; a page with ``cut`` ends after so many characters."""
    line = F.to_json(F.struct("page_token", "next_page_token", "jobs"))
    cut = F.expr("substring(line, 1, cut)") if "cut" in pages.columns else F.col("line")
    lines = pages.withColumn("line", line).select(HOST, F.coalesce(cut, "line").alias("value"))
    lines.write.partitionBy(HOST).text(path)


def metadata_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)`` for each bundle number; the variants cover the odd documents."""
    numbers = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("k")).distinct()
    k = F.col("k")
    name, target = F.concat(F.lit("bundle-"), k), F.when(k % 2 == 0, "prod").otherwise("dev")
    url, branch = F.concat(F.lit("https://git.example.com/"), k), F.concat(F.lit("branch-"), k)
    commit = F.concat(F.lit("commit-"), k)
    root = F.concat(F.lit("/Workspace/bundles/"), k)
    files = F.concat(root, F.lit("/files"))

    def config(git: Column) -> Column:
        bundle = F.struct(name.alias("name"), target.alias("target"), git.alias("git"))
        workspace = F.struct(root.alias("root_path"), files.alias("file_path"))
        return F.struct(bundle.alias("bundle"), workspace.alias("workspace"))

    plain = config(F.struct(url.alias("origin_url"), branch.alias("branch"), commit.alias("commit")))
    cased = config(F.struct(url.alias("OriginURL"), branch.alias("Branch"), commit.alias("Commit")))
    wrapped = F.to_json(F.struct(plain.alias("config")))
    variant = k % 8
    content = (
        F.when(
            variant == 6,
            F.concat(wrapped, F.element_at(F.array(F.lit(" trailing text"), F.lit("]"), F.lit("}")), (k % 3 + 1).cast("int"))),
        )
        .when(variant == 5, F.to_json(plain))
        .when(variant == 4, F.to_json(F.struct(cased.alias("config"))))
        .when(
            variant == 3,
            F.to_json(
                F.struct(
                    F.lit("see bundle").alias("config"),
                    plain["bundle"].alias("bundle"),
                    plain["workspace"].alias("workspace"),
                )
            ),
        )
        .when(variant == 2, F.concat(F.lit("["), wrapped, F.lit("]")))
        .otherwise(wrapped)
    )
    return numbers.filter(variant != 7).select(_bundle_path(k).alias("path"), content.alias("content"))


def write_files(documents: DataFrame, folder: str, below: str) -> None:
    """Write ``(path, content)`` rows as files under ``folder``, by their paths below ``below``."""
    root = qualified(documents.sparkSession, folder)

    def write(rows) -> None:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root)
        made = set()
        for row in rows:
            path = f"{top}/{row.path.removeprefix(below)}"
            parent = path.rpartition("/")[0]
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            with system.open_output_stream(path) as out:
                out.write(row.content.encode())

    documents.select("path", "content").foreachPartition(write)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobfleet.sources.snapshots import bundle_metadata

    return _once(
        spark, sf_dir, "metadata", lambda s, d: bundle_metadata(metadata_documents(s, d))
    )


def job_id_file(spark: SparkSession, sf_dir: str) -> str:
    """The path of the id file, written once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "id-file")
    if key not in _staged:
        _staged[key] = _write_job_id_file(spark, sf_dir), StructType()
    return _staged[key][0]


def _write_job_id_file(spark: SparkSession, sf_dir: str) -> str:
    """An id file of all order keys: byte-order mark, header, padding, extra columns,
    blank rows, and every seventh key a second time at the end."""
    key = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("  "), key, F.lit(" ")))
        .when(key % 4 == 1, F.concat(key, F.lit(",job-"), key))
        .otherwise(key.cast("string"))
    )
    rows = F.when(key % 10 == 9, F.array(text, F.lit(""))).otherwise(F.array(text))
    first = orders.select(F.lit(0).alias("part"), "o_orderkey", F.posexplode(rows).alias("sub", "line"))
    again = orders.filter(key % 7 == 0).select(
        F.lit(1).alias("part"), "o_orderkey", F.lit(0).alias("sub"), key.cast("string").alias("line")
    )
    header = spark.createDataFrame([(-1, -1, 0, "﻿job_id")], "part int, o_orderkey long, sub int, line string")
    path = staging_path(spark, "id-file")
    lines = header.unionByName(first).unionByName(again)
    lines.orderBy("part", "o_orderkey", "sub").select("line").write.text(path)
    return path


def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as job files of one bundle per brand, plus each bundle's root file.

    Half of the files are JSON text, half block-style YAML. One folder of the
    three is not included by the root. Parts are few bytes and files much work, so they are dealt
    to tasks by their number.
    """
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    part = part.repartition(math.ceil(part.count() / PARTS_OF_A_TASK) or 1, *part.columns)
    key, size = F.col("p_partkey"), F.col("p_size")
    file = F.concat(F.lit("job_"), key, F.lit(".yml"))
    path = (
        F.when(size % 5 == 0, F.concat(F.lit("drafts/"), file))
        .when(size % 5 < 3, F.concat(F.lit("resources/"), file))
        .otherwise(F.concat(F.lit("jobs/"), F.lower("p_type"), F.lit("/"), file))
    )
    as_yaml = F.floor(key / 2) % 2 == 1
    jobs = part.select(
        F.col("p_brand").alias("bundle"),
        path.alias("path"),
        F.when(as_yaml, _yaml_text()).otherwise(_json_text()).alias("content"),
    )
    roots = part.select("p_brand").distinct().select(
        F.col("p_brand").alias("bundle"),
        F.lit(ROOT_FILE).alias("path"),
        F.concat(
            F.lit("bundle:\n  name: "),
            F.col("p_brand"),
            F.lit("\ninclude:\n  - resources/*.yml\n  - jobs/**/*.yml\n"),
        ).alias("content"),
    )
    return roots.unionByName(jobs)


def _part_columns() -> dict[str, Column]:
    key, size = F.col("p_partkey"), F.col("p_size")
    return {
        "job_key": F.concat(F.lit("job_"), key),
        "level": F.when(size % 4 == 0, "IS_OWNER").when(size % 4 == 1, "CAN_MANAGE").when(size % 4 == 2, "CAN_VIEW"),
        "principal": F.when(key % 3 == 0, "user_name")
        .when(key % 3 == 1, "service_principal_name")
        .otherwise("group_name"),
        "user": F.concat(F.lit("user"), size),
        "failure": F.when(key % 5 == 0, "${var.webhook_id}").otherwise(F.concat(F.lit("wh-"), key % 7)),
        "duration": F.when(key % 2 == 1, "wh-3"),
        "override": F.when(key % 12 == 0, "wh-3").when(key % 4 == 0, "wh-9"),
    }


def _json_text() -> Column:
    c = _part_columns()

    def hooks(webhook_id: Column) -> Column:
        return F.when(webhook_id.isNotNull(), F.array(F.struct(webhook_id.alias("id")).cast(WEBHOOK)))

    node = F.struct(
        F.col("p_name").alias("name"),
        F.struct(F.col("p_type").alias("type")).alias("tags"),
        F.when(
            c["level"].isNotNull(),
            F.array(F.create_map(F.lit("level"), c["level"], c["principal"], c["user"])),
        ).alias("permissions"),
        F.struct(
            hooks(c["failure"]).alias("on_failure"),
            hooks(c["duration"]).alias("on_duration_warning_threshold_exceeded"),
        ).alias("webhook_notifications"),
    )
    override = F.struct(
        F.struct(hooks(c["override"]).alias("on_failure")).alias("webhook_notifications")
    )
    prod = F.struct(
        F.struct(F.create_map(c["job_key"], override).alias("jobs")).alias("resources")
    )
    return F.to_json(
        F.struct(
            F.struct(F.create_map(c["job_key"], node).alias("jobs")).alias("resources"),
            F.when(c["override"].isNotNull(), F.struct(prod.alias("prod"))).alias("targets"),
        )
    )


def _yaml_text() -> Column:
    c = _part_columns()

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    permissions = text(
        "      permissions:\n        - level: ", c["level"], "\n          ", c["principal"], ": ", c["user"], "\n"
    )
    duration = text("        on_duration_warning_threshold_exceeded:\n          - id: ", c["duration"], "\n")
    targets = text(
        "targets:\n  prod:\n    resources:\n      jobs:\n        ",
        c["job_key"],
        ":\n          webhook_notifications:\n            on_failure:\n              - id: ",
        c["override"],
        "\n",
    )
    return text(
        "resources:\n  jobs:\n    ",
        c["job_key"],
        ":\n      name: ",
        F.col("p_name"),
        "\n      tags:\n        type: ",
        F.col("p_type"),
        "\n",
        F.coalesce(permissions, F.lit("")),
        "      webhook_notifications:\n        on_failure:\n          - id: ",
        c["failure"],
        "\n",
        F.coalesce(duration, F.lit("")),
        F.coalesce(targets, F.lit("")),
    )


def bundle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed nodes of the included files, kept like a snapshot."""
    return _once(spark, sf_dir, "bundle-nodes", derive_bundle_nodes)


def derive_bundle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobfleet.sources.bundles import discover_files, job_nodes, parse_documents

    return job_nodes(parse_documents(discover_files(bundle_files(spark, sf_dir), ROOT_FILE)))
