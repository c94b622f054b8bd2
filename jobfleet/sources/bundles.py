"""Bundle definition files: discovery, parsing, and the job nodes inside them."""

from collections.abc import Iterator
import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfleet.functions.variants import strict_json, text_at, value_at
from jobfleet.schemas import EVENT_FIELDS
from jobfleet.staging import qualified, stage

ROOT_POSITION = -1
FILES_OF_A_TASK, BYTES_OF_A_TASK = 5000, 64 << 20
BATCH_BYTES = 8 << 20  # of file contents that a reader holds at a time
_PLACES = "\u0003"  # stands between a path and the numbers of its bundle's patterns

# Plain scalars of the YAML 1.2 core schema.
YAML_SCALARS = {
    "tag:yaml.org,2002:bool": (r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    "tag:yaml.org,2002:int": (r"^[-+]?(?:0o[0-7_]+|0x[0-9a-fA-F_]+|[0-9][0-9_]*)$", "-+0123456789"),
    "tag:yaml.org,2002:float": (
        r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$",
        "-+0123456789.",
    ),
    "tag:yaml.org,2002:null": (r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    "tag:yaml.org,2002:timestamp": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[Tt ].*)?$", "0123456789"),
    "tag:yaml.org,2002:merge": (r"^(?:<<)$", "<"),
}


def read_bundle_files(
    spark: SparkSession, root: str, bundle: str | None = None, files: str = "*.{yml,yaml,json}"
) -> DataFrame:
    """``(bundle, path, content)`` of the definition files below a folder.

    Each folder directly below ``root`` is one bundle, unless ``bundle`` names
    ``root`` itself. ``path`` is relative to the bundle's folder. Names that start with a dot or an
    underscore and empty files are left out, as in Spark's own listing.

    Definition files are small and many: Spark's text reader would take one task for every 32 of them, and the driver would
    hold the list of all. Here folders are listed level by level and files dealt to tasks by number and bytes, each
    read once; the result is staged.
    """
    name_pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(files).compiled().pattern()
    top = qualified(spark, root.rstrip("/") or "/")
    listed = _list_files(spark, top).filter(F.rlike(F.substring_index("path", "/", -1), F.lit(f"^(?:{name_pattern})$")))
    count, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, math.ceil(count / FILES_OF_A_TASK), math.ceil(size / BYTES_OF_A_TASK))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(top)
        for batch in batches:
            held, rows = 0, []
            for path in batch["path"]:
                with system.open_input_stream(f"{folder}/{path}") as file:
                    rows.append((path, file.read()))
                held += len(rows[-1][1])
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    held, rows = 0, []
            yield pd.DataFrame(rows, columns=["path", "content"])

    inside = F.col("path")
    if bundle is not None:
        name, path = F.lit(bundle), inside
    else:
        name, path = F.substring_index(inside, "/", 1), F.regexp_replace(inside, "^[^/]+/", "")
    whole = listed.select("path").repartition(tasks, "path").mapInPandas(read, "path string, content binary")
    return stage(whole.select(name.alias("bundle"), path.alias("path"), F.col("content").cast("string").alias("content")), "bundle-files")


def _list_files(spark: SparkSession, top: str) -> DataFrame:
    """``(path, size)`` of the files below a folder, by their paths below it; one step for each level of folders."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(top)
        for batch in batches:
            for folder in batch["path"]:
                rows = []
                for info in system.get_file_info(fs.FileSelector(f"{root}/{folder}")):
                    name = info.base_name
                    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name)
                    is_folder = info.type == fs.FileType.Directory
                    if not hidden and (is_folder or info.size):
                        rows.append((f"{folder}/{name}".lstrip("/"), 0 if is_folder else info.size, is_folder))
                yield pd.DataFrame(rows, columns=["path", "size", "is_folder"])

    folders, files = spark.createDataFrame([("",)], "path string"), None
    while not folders.isEmpty():
        level = stage(folders.repartition("path").mapInPandas(entries, "path string, size long, is_folder boolean"), "listing")
        found = level.filter("not is_folder").select("path", "size")
        files = found if files is None else files.unionByName(found)
        folders = level.filter("is_folder").select("path")
    return files


def glob_regex(glob: Column) -> Column:
    """A path pattern as a regular expression: ``*``, ``?``, ``[...]`` and ``**``."""
    # The order matters: escape literals, protect the double stars, expand the rest.
    steps = [
        (r"^(?:\./)+", ""),
        (r"([\\.+^$(){}|])", r"\\$1"),
        (r"\[!", "[^"),
        (r"\*\*/", "\u0001"),
        (r"\*\*", "\u0002"),
        (r"\*", "[^/]*"),
        (r"\?", "[^/]"),
        ("\u0001", "(?:[^/]+/)*"),
        ("\u0002", ".*"),
    ]
    pattern = glob
    for search, replacement in steps:
        pattern = F.regexp_replace(pattern, search, replacement)
    return F.concat(F.lit("^"), pattern, F.lit("$"))


def glob_set(globs: Column) -> Column:
    """All patterns of a bundle as one expression, which Java compiles once for all files of the bundle.

    It is held against a path followed by the numbers of the patterns (``with_places``). Its alternatives are
    tried in order, and each one ends at its own number, so that the match tells which pattern came first.
    """
    parts = F.transform(
        F.transform(globs, glob_regex),
        lambda regex, i: F.concat(F.regexp_replace(regex, r"\$$", ""), F.lit(f"{_PLACES}(?:[0-9]+,)*?"), i.cast("string"), F.lit("(?=,)")),
    )
    return F.struct(F.array_join(parts, "|").alias("regex"), F.size(globs).alias("count"))


def first_match(path: Column, patterns: Column) -> Column:
    """The place of the first pattern of a ``glob_set`` that matches ``path``; null without one."""
    numbers = F.array_join(F.sequence(F.lit(0), F.greatest(patterns["count"] - 1, F.lit(0))), ",")
    subject = F.concat(path, F.lit(_PLACES), numbers, F.lit(","))
    matched = F.call_function("regexp_extract", subject, patterns["regex"], F.lit(0))
    place = F.regexp_extract(matched, "([0-9]+)$", 1).try_cast("int")
    return F.when(patterns["count"] > 0, place)


def yaml_to_json():
    """A vectorized function from YAML text to JSON text, or to what is wrong with it.

    A null document gives nulls. The helpers are
    local so that executors need nothing but PyYAML. Declared nondeterministic,
    or the optimizer would copy the call into every filter on its result.
    """
    scalars = YAML_SCALARS

    def plain(value):
        if isinstance(value, dict):
            return {k if isinstance(k, str) else str(k): plain(v) for k, v in value.items()}
        if isinstance(value, (list, tuple, set)):
            return [plain(item) for item in value]
        if isinstance(value, float) and not math.isfinite(value):
            return None
        if value is None or isinstance(value, (str, bool, int, float)):
            return value
        return {"value": str(value)}  # dates and other tagged scalars are not strings

    def make_loader(yaml):
        class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            yaml_implicit_resolvers = {}

        def whole_number(loader, node):
            digits = loader.construct_scalar(node).replace("_", "")
            based = digits.lower().lstrip("+-")[:2] in ("0o", "0x")
            return int(digits, 0) if based else int(digits)

        for tag, (pattern, first) in scalars.items():
            Loader.add_implicit_resolver(tag, re.compile(pattern), list(first))
        Loader.add_constructor("tag:yaml.org,2002:int", whole_number)
        return Loader

    def convert(content: pd.Series) -> pd.DataFrame:
        if content.isna().all():
            return pd.DataFrame({"json": [None] * len(content), "error": None}, dtype=object)
        try:
            import yaml
        except ImportError as error:
            raise ImportError("bundle files that are not JSON need PyYAML") from error
        loader = make_loader(yaml)
        rows = []
        for text in content:
            document, problem = None, None
            try:
                document = None if text is None else plain(yaml.load(text, loader))
            except (yaml.YAMLError, ValueError, RecursionError) as error:
                problem = str(error) or type(error).__name__
            rows.append((None if document is None else json.dumps(document), problem))
        return pd.DataFrame(rows, columns=["json", "error"], dtype=object)

    return F.pandas_udf(convert, "json string, error string").asNondeterministic()


def read_documents(files: DataFrame) -> DataFrame:
    """``(bundle, path, doc, error)``: each file's document as a variant, or why there is none.

    An empty file has neither. JSON text is read in the JVM. Only other text
    goes through the YAML parser.
    """
    as_json = files.withColumn("json_doc", strict_json(F.col("content")))
    as_yaml = F.when(F.col("json_doc").isNull(), F.col("content"))
    converted = as_json.withColumn("converted", yaml_to_json()(as_yaml))
    has_document = F.coalesce(
        F.schema_of_variant("json_doc") != "VOID", F.col("converted.json").isNotNull()
    )
    doc = F.coalesce(F.col("json_doc"), F.parse_json(F.col("converted.json")))
    kept = [c for c in files.columns if c != "content"]
    return converted.select(
        *kept, F.when(has_document, doc).alias("doc"), F.col("converted.error").alias("error")
    )


def parse_documents(files: DataFrame) -> DataFrame:
    """The documents there are; what cannot be read is left to ``document_errors``."""
    return read_documents(files).filter("doc IS NOT NULL").drop("error")


def document_errors(read: DataFrame) -> DataFrame:
    """``(bundle, path, error)`` of the files that cannot be read."""
    return read.filter("error IS NOT NULL").select("bundle", "path", "error")


def bundle_targets(docs: DataFrame) -> DataFrame:
    """``(bundle, target)`` of every target a bundle's documents name."""
    named = F.map_keys(value_at(F.col("doc"), "$.targets", "map<string,variant>"))
    return docs.select("bundle", F.explode(named).alias("target")).distinct()


def discover_files(files: DataFrame, root_file: str) -> DataFrame:
    """The files that belong to each bundle: its root file and whatever the root includes.

    ``pattern_pos`` is the place of the first include pattern that matches (-1
    for the root). A bundle without a root file contributes nothing; see
    ``require_roots``. A bundle's patterns travel as one expression, so every file is
    tested once and no file-by-pattern pairs are built. The patterns are staged:
    the files themselves need no shuffle while the patterns are small.
    """
    roots = parse_documents(files.filter(F.col("path") == root_file))
    includes = F.coalesce(
        value_at(F.col("doc"), "$.include", "array<string>"), F.array().cast("array<string>")
    )
    patterns = stage(roots.select("bundle", glob_set(includes).alias("patterns")), "patterns")
    is_root = F.col("path") == root_file
    place = F.when(is_root, F.lit(ROOT_POSITION)).otherwise(first_match(F.col("path"), F.col("patterns")))
    return (
        files.join(patterns, "bundle", "left")
        .withColumn("pattern_pos", place)
        .filter(F.col("pattern_pos").isNotNull())
        .drop("patterns")
    )


class MissingRoots(ValueError):
    """Some bundles have no root file."""


def missing_roots(files: DataFrame, root_file: str) -> DataFrame:
    """All bundles without a root file."""
    has_root = F.bool_or(F.col("path") == root_file)
    return files.groupBy("bundle").agg(has_root.alias("has_root")).filter("NOT has_root").select("bundle")


def require_roots(files: DataFrame, root_file: str) -> None:
    """Abort before planning when any bundle lacks its root file."""
    missing = missing_roots(files, root_file)
    count = missing.count()
    if count:
        some = [row["bundle"] for row in missing.orderBy("bundle").limit(20).collect()]
        raise MissingRoots(f"{count} bundle(s) lack {root_file}, such as {some}")


def file_order() -> list[Column]:
    """Sort keys of discovered files: root, then by pattern, then by path parts."""
    return [F.col("pattern_pos"), F.split("path", "/")]


def job_nodes(docs: DataFrame) -> DataFrame:
    """Base job nodes and per-target overrides of parsed documents, in one pass.

    Columns: ``bundle, path, label, target`` (null for base nodes)``, job_key,
    node`` and the typed ``notifications``. Only mappings count as nodes.
    """
    as_map = "map<string,variant>"
    no_target = F.lit(None).cast("string")

    def listed(jobs: Column, target: Column) -> Column:
        entries = F.map_entries(F.coalesce(jobs, F.create_map().cast(as_map)))
        return F.transform(
            entries,
            lambda e: F.struct(
                target.alias("target"), e["key"].alias("job_key"), e["value"].alias("node")
            ),
        )

    doc = F.col("doc")
    base = listed(value_at(doc, "$.resources.jobs", as_map), no_target)
    targets = F.map_entries(
        F.coalesce(value_at(doc, "$.targets", as_map), F.create_map().cast(as_map))
    )
    overrides = F.flatten(
        F.transform(
            targets, lambda t: listed(value_at(t["value"], "$.resources.jobs", as_map), t["key"])
        )
    )
    base_label = F.concat(F.lit("resources.jobs."), F.col("job_key"))
    label = F.when(F.col("target").isNull(), base_label).otherwise(
        F.concat(F.lit("targets."), F.col("target"), F.lit("."), base_label)
    )
    return (
        docs.select("bundle", "path", F.inline(F.concat(base, overrides)))
        .filter(F.schema_of_variant("node").startswith("OBJECT"))
        .withColumns({"label": label, "notifications": _notifications(F.col("node"))})
    )


def _notifications(node: Column) -> Column:
    lists = []
    for event in EVENT_FIELDS:
        entries = value_at(node, f"$.webhook_notifications.{event}", "array<variant>")
        webhooks = F.transform(entries, lambda item: F.struct(text_at(item, "$.id").alias("id")))
        lists.append(webhooks.alias(event))
    return F.struct(*lists)
