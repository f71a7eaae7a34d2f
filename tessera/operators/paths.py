"""Scopes, routing and filters over paths and kinds: predicates as Columns, tables of rules as joins."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import in_or_under
from . import intervals

#: Keywords offered in each context. Fixed values.
KEYWORDS = {
    "top_level": ("package", "import", "public", "class", "interface", "enum", "record"),
    "class_body": ("public", "protected", "private", "static", "final", "abstract", "class", "interface", "enum", "record", "void"),
    "code_block": ("if", "for", "while", "do", "switch", "try", "return", "throw", "break", "continue", "new", "this", "super", "null", "true", "false", "final", "var"),
}


#: What a length counts in a rank, more than there are whole numbers of 64 bits; lengths are at most 2**62, so ranks have 38 digits.
_WORD, _HALF = "cast('20000000000000000000' as decimal(20,0))", f"cast('{(1 << 63) + 1}' as decimal(20,0))"


def everything() -> Column:
    return F.lit(True)


def any_of(*scopes: Column) -> Column:
    """Rows in any of the scopes; none for no scopes."""
    return reduce(or_, scopes, F.lit(False))


def under_roots(path, roots: list[str]) -> Column:
    """Project sources or libraries: path lies at or below one of a short list of roots."""
    return any_of(*[in_or_under(path, r) for r in roots])


def semi_under_roots(df: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """Rows of df at or below a root of a table of any size, as they are and as often as they are there.

    Distinct paths meet the roots by an equi-join on all their ancestors; rows then only meet the paths that passed.
    """
    parts = F.split("_path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ids = df.select(F.col(path).alias("_path")).distinct().select("_path", F.explode(F.array_distinct(up)).alias("_up"))
    hit = roots.select(F.regexp_replace("root", r"/+\z", "").alias("_up")).distinct()
    inside = ids.join(hit, "_up", "left_semi").select("_path").distinct()
    return df.join(inside, df[path] == inside["_path"], "left_semi")


def supports(extension, extensions: list[str]) -> Column:
    return F.lower(extension if isinstance(extension, Column) else F.col(extension)).isin(*[e.lower() for e in extensions])


def kind_matches(kind, kinds: list[str]) -> Column:
    return (kind if isinstance(kind, Column) else F.col(kind)).isin(*kinds)


def path_fits_kind(path, kind) -> Column:
    """Suffix test: class kinds are .class files, source kinds .java files, other kinds take anything."""
    p, k = (x if isinstance(x, Column) else F.col(x) for x in (path, kind))
    return F.when(k == "CLASS", p.endswith(".class")).when(k == "SOURCE", p.endswith(".java")).otherwise(True)


def exported(files: DataFrame, exports: DataFrame) -> DataFrame:
    """Files of module images that are visible: exported packages, unknown modules; not module-info or package-info.

    files has path; exports has module, package. Paths not of the form jrt:/modules/<module>/<dirs>/<file> stay.
    """
    p = F.col("path")
    module = F.regexp_extract(p, r"\Ajrt:/.*?modules/([^/]+)/", 1)
    inside = F.regexp_extract(p, r"\Ajrt:/.*?modules/[^/]+/(.*)\z", 1)
    name = F.substring_index(inside, "/", -1)
    package = F.translate(F.regexp_extract(inside, r"\A(.*)/[^/]*\z", 1), "/", ".")
    f = files.withColumn("_m", module).withColumn("_k", package)
    known = exports.select(F.col("module").alias("_m")).distinct().withColumn("_known", F.lit(True))
    open_ = exports.select(F.col("module").alias("_m"), F.col("package").alias("_k")).distinct().withColumn("_open", F.lit(True))
    f = f.join(known, "_m", "left").join(open_, ["_m", "_k"], "left")
    is_class = (F.col("_m") != "") & name.endswith(".class")
    info = name.isin("module-info.class", "package-info.class")
    keep = F.when((F.col("_m") != "") & info, False).when(~is_class, True).when(F.col("_k") == "", False).otherwise(F.col("_known").isNull() | F.col("_open").isNotNull())
    return f.where(keep).select(*files.columns)


def keywords(spark, context: str | None = None) -> DataFrame:
    """(context, keyword) as a constant relation."""
    rows = [(c, k) for c, ks in KEYWORDS.items() for k in ks if context in (None, c)]
    return spark.createDataFrame(rows, "context string, keyword string")


def context_of(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (file_id, offset) with context: in a code block, else in a class body, else top level.

    spans: file_id, kind ("class" or "block"), start, end; ends count as inside.
    """
    kinds = F.max(F.when(F.col("kind") == "block", 2).when(F.col("kind") == "class", 1))
    around = intervals.best_inside(points, spans.where("kind in ('block', 'class')").select("file_id", "kind", "start", "end"), kinds)
    keys = points.columns
    most = points.select(*keys, F.lit(0).alias("_best")).unionByName(around).groupBy(*keys).agg(F.max("_best").alias("_m"))
    return most.select(*keys, F.when(F.col("_m") == 2, "code_block").when(F.col("_m") == 1, "class_body").otherwise("top_level").alias("context"))


def innermost(points: DataFrame, spans: DataFrame, number: str | None = None) -> DataFrame:
    """points (file_id, offset) with node_id of the shortest span around each (then the least id); none: no row. number: a column
    for how many spans are around it, added up over the rows of a point that is there more than once.

    Bins of spans keep their least (length, node) and their number before points meet them, so a point meets one row a level.
    """
    of = spans.schema["node_id"].dataType
    length = F.col("end").cast("long") - F.col("start").cast("long")
    whole = isinstance(of, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    # Length and whole number of the node (null: 0) as one number: its least is kept in place, by hashing, where a struct's takes
    # a sort.
    word, half = F.expr(_WORD), F.expr(_HALF)
    rank = length.cast("decimal(19,0)") * word + F.coalesce(F.col("node_id").cast("decimal(20,0)") + half, F.lit(0)) if whole else F.struct(length.alias("w"), "node_id")
    ranked = spans.where(F.col("start") <= F.col("end")).select("file_id", rank.alias("rank"), "start", "end")
    around = intervals.best_inside(points, ranked, F.struct(F.min("rank").alias("rank"), F.count("*").alias("n")))
    best = around.groupBy(*points.columns).agg(F.min("_best.rank").alias("_b"), F.sum("_best.n").alias("_n"))
    node = F.when(F.col("_b") % word > 0, (F.col("_b") % word - half).cast(of)) if whole else F.col("_b.node_id")
    return best.select(*points.columns, node.alias("node_id"), *([F.col("_n").alias(number)] if number else []))


def first_language(files: DataFrame, languages: list[tuple[str, list[str]]]) -> DataFrame:
    """files with language: the first one whose extensions hold the file's; null if none."""
    col = F.lit(None).cast("string")
    for name, exts in reversed(languages):
        col = F.when(supports("ext", exts), F.lit(name)).otherwise(col)
    return files.withColumn("language", col)


def shown(items: DataFrame, typed: str, column: str = "lookup") -> DataFrame:
    """What a list still shows while more is typed: names that begin with it, letter case counted; all for nothing typed."""
    return items.where(F.col(column).startswith(typed)) if typed else items


#: Where the classes of a runtime image are. Fixed value.
RUNTIME_ROOT = "jrt:/modules"


def runtime_roots(spark) -> DataFrame:
    """(root, origin) of the runtime image, for collectors beside root_rows."""
    return root_rows(spark, [RUNTIME_ROOT], "runtime")


def top_level_names(declarations: DataFrame) -> DataFrame:
    """(file_id, name): classes declared at the top of each file. declarations: file_id, name, kind, depth."""
    return declarations.where((F.col("kind") == "class") & (F.col("depth") == 0)).select("file_id", "name")


#: Of scope_members. Points and members of a type that meet in one cell, about, and parts at least of a type's points unless they
#: are under _FEW; points and members of a block; tasks for a core at least. Fixed values.
_POINTS, _MEMBERS, _PARTS, _FEW, _BLOCK_POINTS, _BLOCK_MEMBERS, _TASKS = 4096, 2048, 16, 256, 32, 128, 32


def _blocks(rows: DataFrame, keys: list[str], column: str, size: int) -> DataFrame:
    """rows as blocks: keys with a list (column + s) of as many of the column as size, as often as it is there, nulls too; a last
    block may hold fewer. Rows of the same keys have to be few enough for a list."""
    listed = rows.groupBy(*keys).agg(F.collect_list(F.struct(column)).alias("_all"))
    every = F.transform("_all", lambda x: x[column])
    cut = F.transform(F.sequence(F.lit(1), F.size("_all"), F.lit(size)), lambda i: F.slice(every, i, F.lit(size)))
    return listed.select(*keys, F.explode(cut).alias(f"{column}s"))


def scope_members(scopes: DataFrame, locals_: DataFrame, members: DataFrame) -> DataFrame:
    """(point, depth, name): what can be named at each point: locals and accessible members of all scopes around it.

    scopes: point, depth (0 innermost), type (nullable), static_method, static_type. locals_: point, depth, name. members:
    type, name, accessible, static. From a static method outwards, and outside of a static type, there are no `this` and
    `super` and only static members. A name that several scopes have is given for each.

    The answer is as long as points and members of their types multiplied. Points and members of a type are dealt by hash into
    parts, and each part of points meets each part of members in a cell of its own, so a cell makes some millions of rows however
    large its type is, cells go to tasks by hash and no task and no executor holds all points or members; executors hold a row of
    counts a type. In a cell, blocks of points meet blocks of members and are unfolded last, so its rows come as runs of a point
    beside the same names over and over, which columnar files keep in a fraction of the bytes of rows in any order. Blocks are
    small, as Spark keeps what a pair of them makes, and of one length, as names that are packed into bits repeat in bytes only
    then. Types of many members come first in a task: by its first rows a file's writer decides whether a column gets a dictionary.
    """
    w = Window.partitionBy("point").orderBy("depth")  # a point's scopes: as many as code is nested
    until = F.max("static_method").over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = F.max("static_type").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = scopes.withColumn("_static", F.coalesce(until, F.lit(False)) | F.coalesce(inside, F.lit(False))).select("point", "depth", "type", "_static")
    own = locals_.hint("merge").join(s.select("point", "depth", "_static"), ["point", "depth"]).where(~(F.col("_static") & F.col("name").isin("this", "super")))
    spark = scopes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _TASKS * spark.sparkContext.defaultParallelism)
    open_ = members.where("accessible").select("type", "name", "static")
    n = s.groupBy("type").agg(F.count("*").alias("_n")).join(open_.groupBy("type").agg(F.count("*").alias("_m")), "type")
    parts = F.greatest(F.ceil(F.col("_n") / _POINTS), F.least(F.lit(_PARTS), F.ceil(F.col("_n") / _FEW)))
    kind = F.struct((-F.col("_m")).alias("turn"), "type").alias("_kind")  # not two keys, of which a constant type would be lost
    n = n.select("type", kind, parts.alias("_rows"), F.ceil(F.col("_m") / _MEMBERS).alias("_columns"))
    part = lambda column, of: F.pmod(F.xxhash64(column), of)
    each_ = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    cell = ["_kind", "_row", "_column"]
    seen = s.join(F.broadcast(n), "type").select("_kind", part("point", "_rows").alias("_row"), each_("_columns").alias("_column"), "depth", "_static", "point")
    seen = _blocks(seen.repartition(tasks, *cell), [*cell, "depth", "_static"], "point", _BLOCK_POINTS)
    named = open_.join(F.broadcast(n), "type").select("_kind", "_rows", part("name", "_columns").alias("_column"), "static", "name")
    named = _blocks(named, ["_kind", "_rows", "_column", "static"], "name", _BLOCK_MEMBERS)
    named = named.select("_kind", each_("_rows").alias("_row"), "_column", "static", "names").repartition(tasks, *cell)
    met = seen.join(named.hint("merge"), cell).where(F.col("static") | ~F.col("_static"))
    theirs = met.select("depth", "names", F.explode("points").alias("point")).select("point", "depth", F.explode("names").alias("name"))
    return own.select("point", "depth", "name").unionByName(theirs)


def root_rows(spark, roots: list[str], origin: str = "source") -> DataFrame:
    """(root, origin): roots given by configuration or by a constant, as a relation for semi_under_roots and collectors."""
    return spark.createDataFrame([(r, origin) for r in dict.fromkeys(roots)], "root string, origin string")
