"""Queries on names: fuzzy measures, weights and orders, scopes, members, signatures, incomplete text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import graph, paths, ranking
from ..operators.registry import Extensions, each
from ..sources import jvm
from .queries import QUERIES, SQL, _files, query, table

_PROBE = "blue bolts"


def _lcs_sql(pairs: str) -> str:
    """SQL: rows of pairs (k, a, b) with the length of a longest common subsequence, a character of a at a time."""
    after = "list_transform(range(1, length(b) + 1), lambda j: greatest(line[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda i: substr(b, i, 1) = substr(a, spot, 1)), lambda i: CASE WHEN i = 1 THEN 1 ELSE line[i - 1] + 1 END)), 0)))"
    return f"WITH RECURSIVE p AS ({pairs}), l AS (SELECT k, a, b, 1 AS spot, list_transform(range(1, length(b) + 1), lambda j: 0::BIGINT) AS line FROM p UNION ALL SELECT k, a, b, spot + 1, {after} FROM l WHERE spot <= length(a)), s AS (SELECT k, a, b, line[-1] AS lcs FROM l WHERE spot = length(a) + 1), r AS (SELECT k, a, b, floor(200.0 * lcs / (length(a) + length(b)) + 0.5)::INT AS ratio FROM s)"


_NAMES = f"SELECT DISTINCT p_name AS k, p_name AS a, '{_PROBE}' AS b FROM part"


@query(f"{_lcs_sql(_NAMES)} SELECT p_partkey, p_name, ratio AS score FROM part JOIN r ON k = p_name WHERE ratio > 70")
def fuzzy_filter(spark, d):
    """Names whose ratio with what was typed is above the minimum."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    near = p.where(t.ratio_bound("p_name", _PROBE) > t.MINIMUM_SCORE)
    return near.withColumn("score", t.fuzzy_ratio("p_name", F.lit(_PROBE))).where(F.col("score") > t.MINIMUM_SCORE)


@query(f"{_lcs_sql(_NAMES.replace(_PROBE, 'Blue bo'))} SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 'blue bo') THEN 2 WHEN ratio > 70 THEN 1 ELSE 0 END AS level FROM part JOIN r ON k = p_name")
def match_level_fuzzy(spark, d):
    """All levels of a match, the fuzzy one included."""
    return table(spark, d, "part").select("p_partkey", t.match_level("p_name", "Blue bo").alias("level"))


_WINDOWS = "SELECT k, unnest(CASE WHEN length(k) <= 8 THEN [k] ELSE list_transform(range(0, length(k) - 7), lambda i: substr(k, i + 1, 8)) END) AS a, unnest(CASE WHEN length(k) >= 8 THEN list_transform(range(0, length(k) - 7), lambda i: 'bolt new') ELSE list_transform(range(0, 9 - length(k)), lambda i: substr('bolt new', i + 1, length(k))) END) AS b FROM (SELECT DISTINCT list_aggregate(list_sort(string_split(p_name, ' ')), 'string_agg', ' ') AS k FROM part WHERE len(list_intersect(string_split(p_name, ' '), ['new', 'bolt'])) = 0)"


@query(f"{_lcs_sql(_WINDOWS)}, best AS (SELECT k, max(ratio) AS ratio FROM r GROUP BY k) SELECT p_partkey, coalesce(ratio, 100) AS score FROM part LEFT JOIN best ON k = list_aggregate(list_sort(string_split(p_name, ' ')), 'string_agg', ' ')")
def fuzzy_token_set(spark, d):
    """The measure for members of a scope: words in any order; the best stretch of the longer side."""
    p = table(spark, d, "part")
    return p.select("p_partkey", t.fuzzy_token_set("p_name", F.lit("new bolt")).alias("score"))


@query("SELECT doc_id, 'shop.' || source || '.' || lang || '.C' || doc_id AS display, 'C' || doc_id AS simple, 'shop' AS first, 'shop.' || source AS trimmed FROM documents")
def display_names(spark, d):
    docs = table(spark, d, "documents")
    binary = F.concat(F.lit("shop/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("$C"), F.col("doc_id").cast("string"))
    n = docs.select("doc_id", binary.alias("b"), F.concat(F.lit("shop."), F.col("source"), F.lit(".")).alias("p"))
    return n.select("doc_id", t.display_name("b").alias("display"), t.simple_name("b").alias("simple"), t.first_segment("p").alias("first"), t.trim_trailing_dot("p").alias("trimmed"))


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN '' ELSE lang || '.' || source END AS package FROM documents")
def package_names(spark, d):
    """The package a source declares, behind comments; none where it is only in a comment or there is other code first."""
    head = F.when(F.col("lang") == "fr", F.concat(F.lit("// package no.such;\nclass A {} package "), F.col("source"))).otherwise(F.concat(F.lit("/* package wrong; */ // x\n package "), F.col("lang"), F.lit(" . /* in */ "), F.col("source"), F.lit(" ;\nclass A {}\n")))
    return table(spark, d, "documents").select("doc_id", t.package_of(F.concat(head, F.lit("\n// "), F.regexp_replace("text", r"[*/\n]", " "))).alias("package"))


_HOST = "split_part(split_part(url, '://', 2), '/', 1)"


@query(f"SELECT page_id, split_part(url, '://', 1) || '://' || {_HOST} || regexp_replace(substr(split_part(url, '://', 2), length({_HOST}) + 1), '#.*$', '') AS uri FROM pages")
def normalised_uris(spark, d):
    """Scheme and host in lower case, no doubled or /./ segments, no fragment."""
    scheme, rest = F.upper(F.split_part("url", F.lit("://"), F.lit(1))), F.split_part("url", F.lit("://"), F.lit(2))
    host = F.substring_index(rest, "/", 1)
    odd = F.concat(scheme, F.lit("://"), F.upper(host), F.regexp_replace(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A/", "//./"))
    return table(spark, d, "pages").select("page_id", t.normalize_uri(odd).alias("uri"))


@query("SELECT doc_id, source || '/' || doc_id || '.txt' AS inside, '/' || source AS absolute, NULL::VARCHAR AS blank FROM documents")
def resolved_paths(spark, d):
    docs = table(spark, d, "documents").withColumn("i", F.col("doc_id").cast("string"))
    odd = F.concat(F.lit(" ./"), F.col("lang"), F.lit("/../"), F.col("source"), F.lit("\\.\\"), F.col("i"), F.lit(".txt"))
    return docs.select("doc_id", t.resolve_path(odd).alias("inside"), t.resolve_path(F.concat(F.lit("/"), F.col("source"))).alias("absolute"), t.resolve_path(F.lit("  ")).alias("blank"))


@query("SELECT doc_id, true AS same_in_any_order, false AS same_with_other_value FROM documents")
def options_hashes(spark, d):
    """A hash of options that doesn't depend on their order, but on their values."""
    docs = table(spark, d, "documents")
    one = F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.col("source"))
    two = F.create_map(F.lit("b"), F.col("source"), F.lit("a"), F.col("lang"))
    other = F.create_map(F.lit("a"), F.concat(F.col("lang"), F.lit("x")), F.lit("b"), F.col("source"))
    return docs.select("doc_id", (t.options_hash(one) == t.options_hash(two)).alias("same_in_any_order"), (t.options_hash(one) == t.options_hash(other)).alias("same_with_other_value"))


@query("SELECT conv_id, turn, role = 'assistant' OR turn % 2 = 0 AS opens, false AS inside_word FROM conversations")
def pop_up_triggers(spark, d):
    """What was typed opens a list: a dot, a colon, a bracket, or a blank behind the word new."""
    c = table(spark, d, "conversations")
    typed = F.when(F.col("role") == "assistant", ".").otherwise(" ")
    before = F.concat(F.regexp_replace("text", r"\s+", " "), F.when(F.col("turn") % 2 == 0, " = new ").otherwise(" = renew "))
    return c.select("conv_id", "turn", t.pop_up_trigger(typed, before, F.length(before)).alias("opens"), t.pop_up_trigger(F.lit("w"), before, F.length(before)).alias("inside_word"))


def _methods():
    """Per part: constructors and members as a stub has them."""
    m = lambda name, desc, flags: F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), desc.alias("descriptor"), flags.cast("int").alias("access_flags"))
    public, no, one = F.lit(1), F.lit("()V"), F.lit("(I)V")
    ctor = m("<init>", F.when(F.col("p_size") > 25, one).otherwise(no), F.when(F.col("p_type") == "SMALL", F.lit(2)).otherwise(public))
    more = m("<init>", F.when(F.col("p_brand") == "Brand#11", no).otherwise(one), public)
    own = m(F.translate("p_name", " ", "_"), F.concat(F.lit("(L"), F.col("p_type"), F.lit(";)V")), F.when(F.col("p_size") % 2 == 0, F.lit(9)).otherwise(F.when(F.col("p_type") == "PROMO", F.lit(2)).otherwise(public)))
    return F.array(ctor, more, own, m("<clinit>", no, F.lit(8)))


@query("SELECT p_partkey, NOT (p_brand = 'Brand#11' OR (p_type <> 'SMALL' AND p_size <= 25)) AS needs FROM part")
def constructor_arguments(spark, d):
    """Whether making one needs arguments: there are public constructors, and none of them is without."""
    return table(spark, d, "part").select("p_partkey", ranking.constructor_needs_arguments(_methods()).alias("needs"))


@query("SELECT p_partkey AS name, replace(p_name, ' ', '_') AS member, '(L' || p_type || ';)V' AS descriptor, p_size % 2 = 0 AS is_static FROM part WHERE p_size % 2 = 0 OR p_type <> 'PROMO'")
def member_filter(spark, d):
    """Accessible members, static ones and others; no constructors."""
    stubs = table(spark, d, "part").select(F.col("p_partkey").alias("name"), _methods().alias("methods"))
    both = [ranking.members(stubs, "", static).withColumn("is_static", F.lit(static)) for static in (True, False)]
    return both[0].unionByName(both[1])


@query("SELECT p_partkey AS name, replace(p_name, ' ', '_') AS member FROM part WHERE p_size % 2 = 0 AND p_name = 'blue bolt'")
def member_filter_typed(spark, d):
    """Members near what was typed."""
    stubs = table(spark, d, "part").where("p_name in ('blue bolt', 'old anvil')").select(F.col("p_partkey").alias("name"), _methods().alias("methods"))
    return ranking.members(stubs, "blue_bolt", True).select("name", "member")


@query("SELECT p_partkey AS ordinal, p_name AS lookup, p_size AS priority FROM part ORDER BY p_size DESC, lower(p_name), p_partkey LIMIT 50")
def default_order(spark, d):
    """The order without weights: priority, then name, then order of arrival; the first 50 (a report)."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("lookup"), F.col("p_size").alias("priority"))
    return items.orderBy(*ranking.order()).limit(50)


@query("SELECT p_partkey AS ordinal, p_name AS lookup, 100 * (p_brand = 'Brand#22')::INT + p_size AS w FROM part ORDER BY (p_name = 'red')::INT * 100 + starts_with(p_name, 'red')::INT * 100 DESC, p_size % 3 DESC, w DESC, lower(p_name), p_partkey LIMIT 40")
def extra_weigher(spark, d):
    """A weight of the user's own beside the two built in; the first 40 (a report)."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("lookup"), (F.col("p_size") % 3).alias("priority"), F.lit("none").alias("kind"), "p_brand", "p_size")
    mine = F.when(F.col("p_brand") == "Brand#22", 100).otherwise(0) + F.col("p_size")
    return ranking.rank(items, "red", 40, {"w": mine}).select("ordinal", "lookup", "w")


@query("SELECT p_partkey, 110 - CASE WHEN p_size < 10 THEN 30 WHEN p_size < 20 THEN 20 WHEN p_size < 30 THEN 15 ELSE 0 END AS made, CASE WHEN p_size < 10 THEN -10 WHEN p_size < 30 THEN 0 ELSE 10 END AS plain FROM part")
def priorities(spark, d):
    """Priorities by what the flags say: interface, abstract, unknown, concrete."""
    flags = F.when(F.col("p_size") < 10, 0x200).when(F.col("p_size") < 20, 0x400).when(F.col("p_size") >= 30, 1)
    return table(spark, d, "part").select("p_partkey", ranking.construction_priority(flags, F.lit(True)).alias("made"), ranking.plain_priority(flags).alias("plain"))


@query("SELECT o_orderkey AS path, o_orderkey AS ordinal FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders) ORDER BY o_orderkey LIMIT 10")
def queue_head(spark, d):
    """The next ten of a queue, without the one being worked on (the limit is the feature)."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderkey").alias("ordinal"))
    return ranking.queue_head(o, 10, o.agg(F.min("path")).first()[0])


@query(SQL["descendants"] + " HAVING node LIKE 'c%' ORDER BY depth, node LIMIT 50")
def limited_descendants(spark, d):
    """The first 50 of a kind that can be reached; others are walked through (the limit is the feature)."""
    return graph.limited(QUERIES["descendants"](spark, d), 50, F.col("node").startswith("c"))


_EXT = "CASE lang WHEN 'en' THEN 'java' WHEN 'de' THEN 'CLASS' WHEN 'fr' THEN 'kt' ELSE '' END"


def _typed(spark, d):
    ext = F.when(F.col("lang") == "en", "java").when(F.col("lang") == "de", "CLASS").when(F.col("lang") == "fr", "kt").otherwise("")
    kind = F.when(F.col("source") == "src1", "SOURCE").when(F.col("source") == "src2", "CLASS").otherwise("ANY")
    return _files(spark, d).withColumns({"ext": ext, "kind": kind}).withColumn("path", F.concat("path", F.when(F.col("ext") != "", F.concat(F.lit("."), F.lower("ext"))).otherwise("")))


@query(f"SELECT doc_id AS file_id, {_EXT} AS ext, source IN ('src1', 'src2') AS kind_fits, CASE source WHEN 'src1' THEN lang = 'en' WHEN 'src2' THEN lang = 'de' ELSE true END AS path_fits FROM documents WHERE lang IN ('en', 'de')")
def supported_files(spark, d):
    """Files a definition takes, by extension whatever its case; kinds that match; paths that fit their kind."""
    f = _typed(spark, d).where(paths.supports("ext", ["Java", "class"]) & paths.everything())
    return f.select("file_id", "ext", paths.kind_matches("kind", ["SOURCE", "CLASS"]).alias("kind_fits"), paths.path_fits_kind("path", "kind").alias("path_fits"))


@query("SELECT doc_id AS file_id, CASE lang WHEN 'en' THEN 'java' WHEN 'de' THEN 'java' WHEN 'fr' THEN 'kotlin' END AS language FROM documents")
def languages(spark, d):
    """The first language that takes a file's extension."""
    return paths.first_language(_typed(spark, d), [("java", ["java", "class"]), ("kotlin", ["kt", "java"])]).select("file_id", "language")


@query("SELECT DISTINCT p_name AS lookup FROM part WHERE starts_with(p_name, 'red b')")
def shown_items(spark, d):
    """What a list still shows when more was typed."""
    return paths.shown(table(spark, d, "part").select(F.col("p_name").alias("lookup")).distinct(), "red b")


@query("""
WITH m AS (SELECT DISTINCT 'm' || n_regionkey AS m, 'p.x' || n_nationkey AS k FROM nation),
f AS (SELECT c_custkey AS file_id, 'm' || (c_nationkey % 7) AS m, 'p.x' || c_nationkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 'module-info.class' WHEN 'MACHINERY' THEN 'notes.txt' ELSE 'C' || c_custkey || '.class' END AS name FROM customer)
SELECT file_id FROM f WHERE name <> 'module-info.class' AND (name = 'notes.txt' OR m NOT IN (SELECT m FROM m) OR EXISTS (SELECT 1 FROM m WHERE m.m = f.m AND m.k = f.k))
UNION ALL SELECT -1 - s_suppkey FROM supplier""")
def exported_classes(spark, d):
    """Classes of module images that are visible: of exported packages and unknown modules; other files stay."""
    n = table(spark, d, "nation").select(F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("module"), F.concat(F.lit("p.x"), F.col("n_nationkey").cast("string")).alias("package"))
    c = table(spark, d, "customer")
    name = F.when(F.col("c_mktsegment") == "BUILDING", "module-info.class").when(F.col("c_mktsegment") == "MACHINERY", "notes.txt").otherwise(F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit(".class")))
    f = c.select(F.col("c_custkey").alias("file_id"), F.concat(F.lit("jrt:/modules/m"), (F.col("c_nationkey") % 7).cast("string"), F.lit("/p/x"), F.col("c_nationkey").cast("string"), F.lit("/"), name).alias("path"))
    other = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("file_id"), F.concat(F.lit("/lib/"), F.col("s_name"), F.lit(".class")).alias("path"))
    return paths.exported(f.unionByName(other), n).select("file_id")


@query("""
SELECT c.c_custkey AS point, 0 AS depth, unnest(['this', 'l' || c_custkey]) AS name FROM customer c WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT c_custkey, 0, 'l' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, 0, 'n' || n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment <> 'BUILDING' OR n_nationkey % 2 = 0
UNION ALL SELECT c_custkey, 1, 's' || s_suppkey FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE s_acctbal >= 0 AND (s_suppkey % 2 = 0 OR NOT (c_mktsegment = 'BUILDING' OR c_nationkey >= 20))""")
def scope_names(spark, d):
    """What can be named at each of many points: two scopes around each, some static."""
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "point")
    tag = lambda k, x: F.concat(F.lit(k), F.col(x).cast("string"))
    inner = c.select("point", F.lit(0).alias("depth"), tag("N", "c_nationkey").alias("type"), (F.col("c_mktsegment") == "BUILDING").alias("static_method"), (F.col("c_nationkey") >= 20).alias("static_type"))
    outer = c.select("point", F.lit(1).alias("depth"), tag("S", "c_nationkey").alias("type"), F.lit(False).alias("static_method"), F.lit(False).alias("static_type"))
    names = c.select("point", F.lit(0).alias("depth"), F.explode(F.array(F.lit("this"), tag("l", "point"))).alias("name"))
    m = table(spark, d, "nation").select(tag("N", "n_nationkey").alias("type"), tag("n", "n_nationkey").alias("name"), F.lit(True).alias("accessible"), (F.col("n_nationkey") % 2 == 0).alias("static"))
    m = m.unionByName(table(spark, d, "supplier").select(tag("S", "s_nationkey").alias("type"), tag("s", "s_suppkey").alias("name"), (F.col("s_acctbal") >= 0).alias("accessible"), (F.col("s_suppkey") % 2 == 0).alias("static")))
    return paths.scope_members(inner.unionByName(outer), names, m)


@query("SELECT o_orderkey AS file_id, l_partkey || '-' || l_linenumber AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
def top_level_names(spark, d):
    """Classes declared at the top of each file."""
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"), F.when(F.col("l_returnflag") == "A", "class").otherwise("interface").alias("kind"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("depth"))
    return paths.top_level_names(i)


@query("SELECT doc_id, 'class C { void m() { ' || source || '.anyName; ' || chr(10) || lang || '::' || source || '; new anyName() } } // ' || source || '.' AS patched FROM documents")
def patched_texts(spark, d):
    """Text with names still missing, as a parser can take it."""
    head = F.concat(F.lit("class C { void m() { "), F.col("source"), F.lit("."), F.lit(" \n"), F.col("lang"), F.lit("::"), F.col("source"), F.lit("; new "))
    docs = table(spark, d, "documents").withColumns({"head": head, "all": F.concat(head, F.lit(" } } // "), F.col("source"), F.lit("."))})
    return docs.select("doc_id", t.patched("all", F.length("head")).alias("patched"))


@query("SELECT p_partkey, '(int, java.util.Map<T, ? extends shop.' || replace(p_name, ' ', '_') || '.Part<?>>[], T[][]) shop.' || p_type AS method, 'shop.Base, shop.With<' || p_type || '>' AS supers, 'long[]' AS field, NULL::VARCHAR AS broken FROM part")
def signatures(spark, d):
    """Generic signatures as trees of types, shown as in source."""
    name, kind = F.translate("p_name", " ", "_"), F.col("p_type")
    method = F.concat(F.lit("<T::Ljava/lang/Comparable<-TT;>;>(I[Ljava/util/Map<TT;+Lshop/"), name, F.lit(".Part<*>;>;[[TT;)Lshop/"), kind, F.lit(";"))
    supers = F.concat(F.lit("<K:Ljava/lang/Object;>Lshop/Base;Lshop/With<L"), kind, F.lit(";>;"))
    p = table(spark, d, "part")
    return p.select("p_partkey", jvm.shown_types(method).alias("method"), jvm.shown_types(supers, of_class=True).alias("supers"), jvm.shown_types(F.lit("[J")).alias("field"), jvm.shown_types(F.lit("(Lno")).alias("broken"))


@query("SELECT * FROM (SELECT 'ready' AS state, count(*) AS n FROM part UNION ALL SELECT 'not ready', count(*) FROM nation UNION ALL SELECT 'called', count(*) FROM nation UNION ALL SELECT 'called until told to stop', 7) UNION ALL SELECT 'ready too', count(*) FROM nation")
def extension_points(spark, d):
    """Providers plugged in by name: all of them when indexes are ready, before that only those that work early; row callbacks
    that may end a walk."""
    x = Extensions()
    early = lambda: table(spark, d, "nation").select(F.lit("early").alias("provider"), F.col("n_name").alias("name"))
    early.works_early = True
    x.providers.register("early", early)
    x.providers.register(" late ", lambda: table(spark, d, "part").select(F.lit("late").alias("provider"), F.col("p_name").alias("name")))
    x.scopes.register("all", paths.everything())
    x.matchers.register("plain", t.plain_match)
    x.inputs.register("nations", early)
    x.plugins.register("inputs", lambda name: x.inputs.find(name)())
    rows = x.complete().where(x.scopes.find("all")).groupBy("provider").count()
    ready = rows.select(F.when(F.col("provider") == "late", "ready").otherwise("ready too").alias("state"), F.col("count").alias("n"))
    waiting = x.complete(ready=False).agg(F.lit("not ready").alias("state"), F.count("*").alias("n"))
    plugged = x.load_plugin("inputs", "nations").where(x.matchers.find("plain")("name", "NATION"))
    seen = [("called", each(plugged, lambda r: None)), ("called until told to stop", each(plugged.orderBy("name"), lambda r, left=[7]: left.__setitem__(0, left[0] - 1) or left[0] > 0))]
    return ready.unionByName(waiting).unionByName(spark.createDataFrame(seen, "state string, n long"))
