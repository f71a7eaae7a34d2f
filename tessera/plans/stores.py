"""Queries on what an index store does beside plain lookups: values, fallbacks, packages, versions, several indexes at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, index, lookup, store as stores
from ..storage import fresh_path
from .queries import WORDS, _files, _parts, _words, parts_store, query, table, words_store

_COUNTS = "SELECT key, doc_id AS file_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS key FROM documents) WHERE key <> '' GROUP BY ALL"


@query("SELECT p_brand AS value FROM part WHERE p_name = 'blue bolt'")
def exact_values(spark, d):
    """All values under one key, as often as they are there."""
    return lookup.values(_parts(spark, d), "parts", "blue bolt")


@query("SELECT p_name AS key, p_partkey AS file_id, p_brand AS value FROM part WHERE starts_with(p_name, 's') ORDER BY p_name, p_partkey LIMIT 20")
def first_hits(spark, d):
    """The first 20 of a prefix lookup (the limit is the feature)."""
    return lookup.first_n(lookup.prefix(_parts(spark, d), "parts", "s"), 20, "key", "file_id")


@query("SELECT 0 AS unknown, count(*) AS known, true AS has_known, false AS has_unknown FROM part WHERE p_name = 'blue bolt'")
def unknown_index(spark, d):
    """A lookup in an index that isn't there is empty, not an error."""
    e = _parts(spark, d)
    n = lookup.exact(e, "none", "blue bolt").agg(F.count("*").cast("int").alias("unknown")).crossJoin(lookup.exact(e, "parts", "blue bolt").agg(F.count("*").alias("known")))  # one row each
    return n.withColumns({"has_known": F.lit(lookup.has_data(e, "parts")), "has_unknown": F.lit(lookup.has_data(e, "none"))})


@query(f"SELECT key FROM ({_COUNTS}) WHERE file_id = (SELECT max(doc_id) FROM documents)")
def keys_of_file(spark, d):
    """The forward direction: what one file is indexed under."""
    last = table(spark, d, "documents").agg(F.max("doc_id")).first()[0]
    return words_store(spark, d).keys_of("words", last)


@query(f"SELECT key, file_id, '/' || source || '/' || doc_id AS path FROM ({_COUNTS}) JOIN documents ON doc_id = file_id WHERE starts_with(key, 'wh')")
def located_hits(spark, d):
    """Hits with the paths of their files."""
    hits = lookup.prefix(_words(spark, d), "words", "wh").select("key", "file_id")
    return catalog.locate(hits, _files(spark, d)).select("key", "file_id", "path")


_TYPES = "SELECT p_partkey AS file_id, CASE p_type WHEN 'SMALL' THEN 'shop/' || p_brand || '/' || p_name WHEN 'MEDIUM' THEN 'shop/' || p_brand || '$' || p_name ELSE 'shop$' || p_brand || '$' || p_name END AS key, p_size::VARCHAR AS value FROM part"


def _types(spark, d):
    a, b = F.when(F.col("p_type").isin("SMALL", "MEDIUM"), "/").otherwise("$"), F.when(F.col("p_type") == "SMALL", "/").otherwise("$")
    key = F.concat(F.lit("shop"), a, F.col("p_brand"), b, F.col("p_name"))
    return table(spark, d, "part").select(F.lit("types").alias("index_id"), key.alias("key"), F.col("p_partkey").alias("file_id"), F.col("p_size").cast("string").alias("value"))


@query(f"""
WITH n AS (SELECT DISTINCT 'shop/' || p_brand || '/' || p_name AS name, p_brand AS b, p_name AS p FROM part),
c AS (SELECT name, unnest([0, 1, 2]) AS place, unnest([name, 'shop/' || b || '$' || p, 'shop$' || b || '$' || p]) AS key FROM n),
e AS (SELECT key, min({{'f': file_id, 'v': value}}) AS v FROM ({_TYPES}) GROUP BY key)
SELECT name, arg_min(key, place) AS key, arg_min(v.v, place) AS value FROM c JOIN e USING (key) GROUP BY name""")
def nested_fallback(spark, d):
    """A name is looked up as it is, then as a nested type of its parent, then of its parent's parent."""
    names = table(spark, d, "part").select(F.concat(F.lit("shop/"), F.col("p_brand"), F.lit("/"), F.col("p_name")).alias("name"))
    return lookup.with_fallback(names, _types(spark, d), "types")


@query(f"SELECT file_id, value FROM ({_TYPES}) WHERE replace(key, '/', '.') = (SELECT min('shop.' || p_brand || '.' || p_name) FROM part WHERE p_type = 'SMALL') AND contains(key, '/') AND NOT contains(key, '$') ORDER BY file_id LIMIT 1")
def dotted_lookup(spark, d):
    """A dotted name finds the key written with slashes; the first file's value."""
    name = table(spark, d, "part").where("p_type = 'SMALL'").agg(F.min(F.concat(F.lit("shop."), F.col("p_brand"), F.lit("."), F.col("p_name")))).first()[0]
    return lookup.first_value(_types(spark, d), "types", name)


_KINDS = "CASE lang WHEN 'en' THEN 'CLASS' WHEN 'de' THEN 'SOURCE' ELSE 'OTHER' END"
_SUFFIX = "CASE lang WHEN 'en' THEN '.class' WHEN 'de' THEN '.java' ELSE '.txt' END"


def _typed_files(spark, d):
    kind = F.when(F.col("lang") == "en", "CLASS").when(F.col("lang") == "de", "SOURCE").otherwise("OTHER")
    suffix = F.when(F.col("lang") == "en", ".class").when(F.col("lang") == "de", ".java").otherwise(".txt")
    f = _files(spark, d)
    return f.select("file_id", F.concat("path", suffix).alias("path"), kind.alias("kind"), "source", "lang")


@query(f"SELECT file_id, n::VARCHAR AS value, '/' || source || '/' || doc_id || {_SUFFIX} AS path FROM ({_COUNTS}) JOIN documents ON doc_id = file_id WHERE key = 'der' AND lang = 'de' ORDER BY file_id LIMIT 1")
def first_compatible(spark, d):
    """The least file under a key whose path fits the kind that is asked for."""
    return lookup.first_compatible(_words(spark, d), _typed_files(spark, d), "words", "der", "SOURCE").select("file_id", "value", "path")


@query(f"SELECT doc_id AS file_id, '/' || source || '/' || doc_id || {_SUFFIX} AS path, 'T' || doc_id AS simple_name, {_KINDS} AS kind FROM documents WHERE n_chars < 2000 AND lang IN ('en', 'de') AND source IN ('src1', 'src2')")
def package_members(spark, d):
    """Types of a package, of some kinds and within a scope; values are JSON."""
    f = _typed_files(spark, d)
    size = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.when(F.col("n_chars") < 2000, "short").otherwise("long").alias("key"))
    value = F.to_json(F.struct(F.concat(F.lit("T"), F.col("file_id").cast("string")).alias("simple_name"), "kind"))
    e = f.join(size, "file_id").select(F.lit("packages").alias("index_id"), "key", "file_id", value.alias("value"))
    scope = F.col("path").startswith("/src1/") | F.col("path").startswith("/src2/")
    return lookup.package_listing(e, f.select("file_id", "path"), "packages", "short", ["CLASS", "SOURCE"], scope)


@query("SELECT p_partkey AS file_id, 2147483648 + 16777216 * (1 + p_size) + p_partkey AS packed, 1 + p_size AS store, p_partkey AS file FROM part")
def global_ids(spark, d):
    """Ids of files in many stores as one number, and back."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), lookup.global_id(F.col("p_size") + 1, F.col("p_partkey")).alias("packed"))
    s, f = lookup.local_id("packed")
    return p.withColumns({"store": s, "file": f})


@query("SELECT store_id, key, count(*) AS n FROM (SELECT 0 AS store_id, p_name AS key FROM part UNION ALL SELECT 1, c_mktsegment FROM customer) GROUP BY ALL")
def mounted_stores(spark, d):
    """Stores that others built, mounted read-only: a repeated one counts once, one that isn't there not at all."""
    shared = fresh_path(spark, "shared")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), "c_mktsegment", "c_name", F.lit(0).cast("long").alias("last_modified"), F.lit(0).cast("long").alias("length"))
    stores.build_shared(c, [index.IndexDefinition("segments", 1, index.column_key("c_mktsegment", "c_name"))], shared)
    own = parts_store(spark, d).root
    got = stores.mount(spark, [own, shared, own + "/", shared + "-none"])
    return lookup.union_stores(*got).groupBy("store_id", "key").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS file_id FROM documents WHERE source = 'src2'")
def stale_files(spark, d):
    """Files whose stamp isn't the one that was stored; a null time equals only a null time."""
    f = _files(spark, d).select("file_id", "source", "length", F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.lit(5)).cast("long").alias("last_modified"))
    s = stores.IndexStore(spark, fresh_path(spark, "store"))
    s.register(index.IndexDefinition("sources", 1, index.column_key("source", "source")))
    s.refresh(f)
    later = F.when(F.col("source") == "src2", F.coalesce("last_modified", F.lit(0)) + 1).otherwise(F.col("last_modified"))
    return s.stale(f.withColumn("last_modified", later)).select("file_id")


@query("""
SELECT * FROM (SELECT '1 built' AS step, count(*) AS entries, count(DISTINCT source) AS keys, true AS ready FROM documents
UNION ALL SELECT '2 other version', 0, 0, false
UNION ALL SELECT '3 rebuilt', count(*), count(DISTINCT lang), true FROM documents
UNION ALL SELECT '4 retracted', count(*) FILTER (WHERE lang <> 'fr'), count(DISTINCT lang) FILTER (WHERE lang <> 'fr'), true FROM documents
UNION ALL SELECT '5 compacted', count(*) FILTER (WHERE lang <> 'fr'), count(DISTINCT lang) FILTER (WHERE lang <> 'fr'), true FROM documents
UNION ALL SELECT '6 invalidated', 0, 0, false)""")
def index_versions(spark, d):
    """What a store shows as a definition changes its version, files go, layers are compacted and all is invalidated. Readers
    that opened it earlier keep what they saw."""
    f = _files(spark, d).select("file_id", "source", "lang", "length", F.lit(1).cast("long").alias("last_modified"))
    s = stores.IndexStore(spark, fresh_path(spark, "store"))
    steps = []

    def note(step):
        e = s.entries()
        seen = e.agg(F.count("*").alias("entries"), F.count_distinct("key").alias("keys"))
        steps.append(seen.select(F.lit(step).alias("step"), "entries", "keys", F.lit(s.ready()).alias("ready")))

    s.register(index.IndexDefinition("where", 1, index.column_key("source", "source")))
    s.refresh(f)
    note("1 built")
    s.register(index.IndexDefinition("where", 2, index.column_key("lang", "lang")))
    note("2 other version")
    s.refresh(f)
    note("3 rebuilt")
    s.refresh(f.where("lang <> 'fr'"))
    note("4 retracted")
    s.compact()
    note("5 compacted")
    s.invalidate()
    note("6 invalidated")
    out = steps[0]
    for x in steps[1:]:
        out = out.unionByName(x)
    return out


def _counted(row: dict) -> list[str]:
    """The helper two indexes share: a text's words."""
    if row["lang"] == "fr":
        raise ValueError("not read")
    return row["text"].split()


_WORDS_OF = "list_filter(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


@query(f"""
SELECT 'first' AS index_id, doc_id AS file_id, {_WORDS_OF}[1] AS key, len({_WORDS_OF})::VARCHAR AS value, NULL AS message FROM documents WHERE lang <> 'fr' AND len({_WORDS_OF}) > 0
UNION ALL SELECT 'last', doc_id, {_WORDS_OF}[-1], len({_WORDS_OF})::VARCHAR, NULL FROM documents WHERE lang = 'de' AND len({_WORDS_OF}) > 0
UNION ALL SELECT 'errors', doc_id, NULL, NULL, 'ValueError: not read' FROM documents WHERE lang = 'fr'""")
def shared_extraction(spark, d):
    """Two indexes from one pass over the files and one helper that both read; files it fails on are set aside."""
    f = _files(spark, d)
    first = index.python_extractor(lambda r, w: [(w[0], str(len(w)))] if w else [], ["text", "lang"], _counted)
    last = index.python_extractor(lambda r, w: [(w[-1], str(len(w)))] if w else [], ["text", "lang"], _counted)
    defs = [index.IndexDefinition("first", 1, first), index.IndexDefinition("last", 1, last, F.col("lang") == "de")]
    rows = index.run_all(f, defs).select("index_id", "file_id", "key", "value", F.lit(None).cast("string").alias("message"))
    bad = index.errors_of(defs[0], f).select(F.lit("errors").alias("index_id"), "file_id", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), "message")
    return rows.unionByName(bad)


@query(f"SELECT key, file_id, n AS occurrences FROM ({_COUNTS}) JOIN documents ON doc_id = file_id WHERE key = 'the' AND lang = 'en'")
def scoped_exact(spark, d):
    """An exact lookup over everything, then only in files that pass a filter; the key reaches the store's scan."""
    f = _files(spark, d).where("lang = 'en'").select("file_id")
    hits = words_store(spark, d).find(WORDS.id, "the")
    return hits.join(f, "file_id", "left_semi").select("key", "file_id", F.col("value").cast("long").alias("occurrences"))
