"""One registered query per operator family, each over whole tables, with the SQL that gives the same rows in DuckDB.

Tables stand in for what the operators are about: documents are files with text, pages.url holds paths, part names are
keys, region to customer is a hierarchy, events are a change feed, conversations have revisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as t
from ..operators import catalog, graph, index, intervals, lookup, paths, ranking
from ..operators.store import IndexStore
from ..storage import fresh_path
from ..streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark, d) -> DataFrame:
    """documents as files: path /<source>/<doc_id>."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text", "source", "lang", F.col("n_chars").alias("length"))


WORDS = index.IndexDefinition("words", 1, index.words())
PARTS = index.IndexDefinition("parts", 1, index.column_key("p_name", "p_brand"))


_stores: dict[tuple, tuple[IndexStore, tuple]] = {}


def _listing(spark, path: str) -> tuple:
    """Names, lengths and times of a table's files: a lookup compares it to see whether its store is behind."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def stored(spark, d, definition: index.IndexDefinition, name: str, files: Callable[[], DataFrame]) -> IndexStore:
    """The store of a definition over a whole table: built when first asked for, then read, as an index is there for. When
    the table's files are others than the store was brought up with, it is refreshed first."""
    key = (spark.sparkContext.applicationId, d, definition.id)
    now = _listing(spark, f"{d}/{name}.parquet")
    s, then = _stores.get(key, (None, None))
    if now != then:
        if s is None:
            s = IndexStore(spark, fresh_path(spark, "store"))
            s.register(definition)
        s.refresh(files())
        _stores[key] = s, now
    return s


def words_store(spark, d) -> IndexStore:
    # Tables have no times of change; a hash of what is indexed tells a changed row.
    return stored(spark, d, WORDS, "documents", lambda: _files(spark, d).withColumn("last_modified", F.xxhash64("text", "source")))


def _words(spark, d) -> DataFrame:
    return words_store(spark, d).entries()


def parts_store(spark, d) -> IndexStore:
    p = lambda: table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), "p_name", "p_brand", F.xxhash64("p_name", "p_brand").alias("last_modified"), F.col("p_size").cast("long").alias("length"))
    return stored(spark, d, PARTS, "part", p)


def _parts(spark, d) -> DataFrame:
    return parts_store(spark, d).entries()


_WORDS_SQL = "SELECT doc_id, unnest(string_split(lower(text), ' ')) AS key, source FROM documents"
_ENTRIES = f"SELECT key, doc_id AS file_id, count(*) AS n, any_value(source) AS source FROM ({_WORDS_SQL}) WHERE key <> '' GROUP BY key, doc_id"


@query(f"SELECT key, sum(n)::BIGINT AS occurrences, count(*) AS files FROM ({_ENTRIES}) WHERE starts_with(key, 'th') AND source IN ('src1', 'src2') GROUP BY key ORDER BY (key = 'th')::INT * 100 DESC, occurrences DESC, key LIMIT 50")
def ranked_prefix(spark, d):
    """Prefix lookup in the word index within two roots, ranked; the top 50 (a report)."""
    files = _files(spark, d).where(paths.under_roots("path", ["/src1", "/src2"])).select("file_id")
    hits = lookup.prefix(_words(spark, d), "words", "th").join(files, "file_id", "left_semi")
    items = hits.groupBy("key").agg(F.sum(F.col("value").cast("long")).alias("occurrences"), F.count("*").alias("files"))
    # equal beats prefix; among prefixes the weight is the same
    w = F.when(F.col("key") == "th", 100).otherwise(0)
    return items.orderBy(w.desc(), F.col("occurrences").desc(), F.col("key")).limit(50)


@query(f"SELECT key, file_id, n AS occurrences FROM ({_ENTRIES})")
def index_words(spark, d):
    """The whole word index, as the store has it."""
    return _words(spark, d).select("key", "file_id", F.col("value").cast("long").alias("occurrences"))


@query("SELECT p_partkey AS file_id, p_brand AS value FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def exact_key(spark, d):
    least = table(spark, d, "part").agg(F.min("p_name")).first()[0]
    return parts_store(spark, d).find("parts", least).select("file_id", "value")


@query("SELECT p_name AS key, p_partkey AS file_id, p_brand AS value FROM part WHERE starts_with(p_name, 'b')")
def prefix_scan(spark, d):
    return parts_store(spark, d).under("parts", "b").select("key", "file_id", "value")


@query("SELECT p_name AS key, p_partkey >> 16 AS block, string_agg(p_brand, ',' ORDER BY p_brand) AS joined FROM part WHERE starts_with(p_name, 'b') GROUP BY ALL")
def prefix_grouped(spark, d):
    """Values of keys with a prefix, in blocks of bounded size."""
    return lookup.grouped(parts_store(spark, d).under("parts", "b"), "parts", "b").select("key", "block", F.array_join("values", ",").alias("joined"))


_PAIR = "SELECT any_value(w[1]) AS a, any_value(w[2]) AS b FROM (SELECT list(key ORDER BY n DESC, key) AS w FROM (SELECT key, count(*) AS n FROM ({}) GROUP BY key ORDER BY n DESC, key LIMIT 2))"


@query(f"WITH e AS MATERIALIZED ({_ENTRIES}), p AS ({_PAIR.format(_ENTRIES)}) SELECT file_id FROM e, p WHERE key = a AND file_id IN (SELECT file_id FROM e, p WHERE key = b)")
def files_under_both(spark, d):
    """Files under both of the two words that most files have: the longest posting lists, met block by block."""
    s = words_store(spark, d)
    top = s.entries().groupBy("key").count().orderBy(F.desc("count"), "key").limit(2).collect()
    return lookup.all_of(s, "words", [r["key"] for r in top])


@query(f"SELECT key, file_id, n AS occurrences FROM ({_ENTRIES}) WHERE starts_with(key, 'an') AND source IN ('src1', 'src3')")
def scoped_prefix(spark, d):
    """Boundary-safe roots: /src1 doesn't admit /src10. The prefix reaches the scan of the store."""
    scope = paths.any_of(t.in_or_under("path", "/src1"), t.in_or_under("path", "/src3"))
    hits = catalog.locate(lookup.prefix(_words(spark, d), "words", "an"), _files(spark, d))
    return hits.where(scope).select("key", "file_id", F.col("value").cast("long").alias("occurrences"))


@query(f"SELECT file_id, count(*) AS n_keys, min(key) AS first_key, max(key) AS last_key FROM ({_ENTRIES}) GROUP BY file_id")
def forward_map(spark, d):
    f = index.forward(_words(spark, d))
    return f.select("file_id", F.size("keys").cast("long").alias("n_keys"), F.element_at("keys", 1).alias("first_key"), F.element_at("keys", -1).alias("last_key"))


@query("SELECT 'words' AS index_id, count(DISTINCT file_id) AS files, count(*) AS entries, count(DISTINCT key) AS keys FROM (" + _ENTRIES + ")")
def index_counters(spark, d):
    return index.counters(_files(spark, d), _words(spark, d))


@query("SELECT 'words' AS index_id, count(*) AS entries, true AS keys, true AS files, true AS p50, true AS p90 FROM (" + _ENTRIES + ")")
def index_estimates(spark, d):
    """Counts from the store's sketches: entries exact, the others within a twentieth of what counting everything gives."""
    s = words_store(spark, d)
    of_file = s.entries().groupBy("index_id", "file_id").agg(F.count_distinct("key").alias("n")).groupBy("index_id").agg(F.percentile_approx("n", [0.45, 0.55, 0.85, 0.95], 100_000).alias("q"))
    exact = index.counters(_files(spark, d), s.entries()).select("index_id", F.col("keys").alias("k"), F.col("files").alias("f")).join(of_file, "index_id")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.col(b) / 20, F.lit(2))
    e = s.estimates().join(exact, "index_id")
    return e.select("index_id", "entries", near("keys", "k").alias("keys"), near("files", "f").alias("files"), F.col("p50").between(F.col("q")[0], F.col("q")[1]).alias("p50"), F.col("p90").between(F.col("q")[2], F.col("q")[3]).alias("p90"))


@query("SELECT p_partkey AS file_id, p_name AS key, 1 AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def indexed_files(spark, d):
    """Existence probe: parts that have an entry in an index over large orders."""
    big = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.lit("big").alias("index_id"), F.col("l_partkey").alias("file_id"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_name").alias("key"))
    return lookup.indexed(p, big, "big").withColumn("n", F.lit(1))


@query("SELECT 'labels' AS index_id, doc_id AS file_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'sources', doc_id FROM documents")
def missing_index(spark, d):
    """What a store that saw the labelled documents only lacks, for its own index and for one registered since."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "source", F.lit(0).cast("long").alias("last_modified"), F.col("n_chars").alias("length"))
    have = files.join(table(spark, d, "labels").select(F.col("doc_id").alias("file_id")), "file_id", "left_semi")
    s = IndexStore(spark, fresh_path(spark, "store"))
    s.register(index.IndexDefinition("labels", 1, index.column_key("source", "length")))
    s.refresh(have)
    s.register(index.IndexDefinition("sources", 1, index.column_key("source", "source")))
    return s.missing(files)


@query("SELECT doc_id AS name, coalesce(quality * 512 + toxic * 1024, -1) AS flags, CASE WHEN quality IS NULL THEN 0 WHEN quality = 1 THEN -10 WHEN toxic = 1 THEN 0 ELSE 10 END AS priority FROM documents LEFT JOIN labels USING (doc_id)")
def stub_enrich(spark, d):
    """Optional enrichment: labels as access flags, priority from the flag bits."""
    stubs = table(spark, d, "labels").select(F.col("doc_id").alias("name"), (F.col("quality") * 0x200 + F.col("toxic") * 0x400).alias("flags"))
    out = ranking.enrich(table(spark, d, "documents").select(F.col("doc_id").alias("name")), stubs)
    return out.select("name", F.coalesce("flags", F.lit(-1)).alias("flags"), "priority")


@query("SELECT p_partkey, CASE WHEN p_name = 'Blue' THEN 5 WHEN starts_with(p_name, 'Blue') THEN 3 WHEN lower(p_name) = 'blue' THEN 4 WHEN starts_with(lower(p_name), 'blue') THEN 2 ELSE 0 END AS level FROM part")
def match_level(spark, d):
    return table(spark, d, "part").select("p_partkey", t.match_level("p_name", "Blue", fuzzy=False).alias("level"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'bl')")
def plain_match(spark, d):
    return table(spark, d, "part").where(t.plain_match("p_name", "BL")).select("p_partkey", "p_name")


_KIND = "CASE WHEN p_size % 4 = 0 THEN 'local' WHEN p_size % 4 = 1 THEN 'field' WHEN p_size % 4 = 2 THEN 'method' ELSE 'other' END"


@query(f"""
SELECT p_partkey AS ordinal, p_name AS lookup, priority, exact_prefix, kind_weight FROM (
  SELECT *, CASE WHEN p_name = 'blue' THEN 200 WHEN starts_with(p_name, 'blue') THEN 100 WHEN starts_with(lower(p_name), 'blue') THEN 50 ELSE 0 END AS exact_prefix,
         p_size % 10 AS priority, CASE {_KIND} WHEN 'local' THEN 1000 WHEN 'field' THEN 800 WHEN 'method' THEN 700 ELSE 0 END AS kind_weight FROM part)
ORDER BY exact_prefix DESC, priority DESC, kind_weight DESC, lower(p_name), p_partkey LIMIT 50""")
def rank_topk(spark, d):
    """The 50 best items (a report): first weight, priority, other weights, name, order of arrival."""
    kind = F.when(F.col("p_size") % 4 == 0, "local").when(F.col("p_size") % 4 == 1, "field").when(F.col("p_size") % 4 == 2, "method").otherwise("other")
    items = table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("lookup"), (F.col("p_size") % 10).alias("priority"), kind.alias("kind"))
    return ranking.rank(items, "blue", 50).select("ordinal", "lookup", "priority", "exact_prefix", "kind_weight")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 110 WHEN o_orderpriority = '2-HIGH' THEN 90 WHEN o_orderpriority = '3-MEDIUM' THEN 80 ELSE 95 END - CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 10 END AS priority FROM orders")
def construction_priority(spark, d):
    p = F.col("o_orderpriority")
    flags = F.when(p == "1-URGENT", 1).when(p == "2-HIGH", 0x400).when(p == "3-MEDIUM", 0x200)
    return table(spark, d, "orders").select("o_orderkey", ranking.construction_priority(flags, F.col("o_orderstatus") == "F").alias("priority"))


_OLD = "SELECT doc_id, n_chars FROM documents WHERE lang <> 'es' UNION ALL SELECT -1 - item_id, length(text) FROM benchmark"
_NEW = "SELECT doc_id, CASE WHEN source = 'src1' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents"


def _two_snapshots(spark, d):
    """Before: documents not in Spanish, and the benchmark. After: all documents, some longer."""
    docs = table(spark, d, "documents")
    n = F.when(F.col("source") == "src1", F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    gone = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("uri"), F.length("text").cast("long").alias("length"))
    old = docs.where("lang <> 'es'").select(F.col("doc_id").alias("uri"), F.col("n_chars").alias("length")).unionByName(gone)
    return old, docs.select(F.col("doc_id").alias("uri"), n.alias("length"))


@query(f"SELECT coalesce(n.doc_id, o.doc_id) AS uri, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'changed' END AS op FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.n_chars <> n.n_chars")
def snapshot_diff(spark, d):
    """Two states of the catalogue, and what changed between them."""
    old, new = _two_snapshots(spark, d)
    return catalog.difference(old, new, stamp=["length"]).select("uri", "op")


@query("""
WITH o AS (SELECT source || '/' || doc_id AS uri, doc_id AS k FROM documents WHERE lang <> 'es' UNION ALL SELECT 'items/' || item_id, -1 - item_id FROM benchmark),
n AS (SELECT CASE WHEN lang = 'fr' THEN 'moved/' ELSE source || '/' END || doc_id AS uri, doc_id AS k FROM documents),
c AS (SELECT n.uri, n.k FROM n WHERE uri NOT IN (SELECT uri FROM o)), x AS (SELECT o.uri, o.k FROM o WHERE uri NOT IN (SELECT uri FROM n))
SELECT CASE WHEN x.k IS NULL THEN 'created' WHEN c.k IS NULL THEN 'deleted' ELSE 'renamed' END AS op, coalesce(c.uri, x.uri) AS uri, CASE WHEN c.k IS NOT NULL THEN x.uri END AS old_uri
FROM c FULL JOIN x ON c.k = x.k""")
def rename_diff(spark, d):
    """French documents move, Spanish ones appear, the benchmark goes."""
    docs, item = table(spark, d, "documents"), table(spark, d, "benchmark")
    name = F.col("doc_id").cast("string")
    uri = F.concat(F.col("source"), F.lit("/"), name)
    moved = F.when(F.col("lang") == "fr", F.concat(F.lit("moved/"), name)).otherwise(uri)
    old = docs.where("lang <> 'es'").select(uri.alias("uri"), F.col("doc_id").alias("file_key"), "n_chars")
    old = old.unionByName(item.select(F.concat(F.lit("items/"), F.col("item_id").cast("string")).alias("uri"), (-1 - F.col("item_id")).alias("file_key"), F.length("text").cast("long").alias("n_chars")))
    new = docs.select(moved.alias("uri"), F.col("doc_id").alias("file_key"), "n_chars")
    return catalog.difference(old, new, stamp=["n_chars"], file_key="file_key")


@query("SELECT doc_id, sha256(text) AS hash, source <> 'src3' AS up_to_date FROM documents")
def fingerprint(spark, d):
    """Content hashes against stored ones, from before the texts of one source changed."""
    docs = table(spark, d, "documents").select("doc_id", "source", t.content_hash("text").alias("hash"))
    stored_ = docs.select("doc_id", F.when(F.col("source") == "src3", F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("hash")).alias("was"))
    return docs.join(stored_, "doc_id").select("doc_id", "hash", F.col("hash").eqNullSafe(F.col("was")).alias("up_to_date"))


_HOST = "split_part(split_part(url, '://', 2), '/', 1)"


@query(f"SELECT DISTINCT split_part(substr(url, instr(url, '.example.') + 9), '/', 1) AS segment FROM pages WHERE instr(url, '.example.') > 0")
def hierarchy_segments(spark, d):
    """Distinct next segments below a base in reversed host names."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    keys = table(spark, d, "pages").select(F.concat(F.lit("example."), F.substring_index(host, ".example.", -1)).alias("key")).where(F.col("url").contains(".example."))
    return graph.child_segments(keys, "example")


@query(f"SELECT DISTINCT split_part(url, '/', 5) AS name FROM pages WHERE split_part(url, '/', 4) = 'en' AND starts_with(lower(split_part(url, '/', 5)), '1')")
def package_types(spark, d):
    p = table(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(4)).alias("parent"), F.split_part("url", F.lit("/"), F.lit(5)).alias("name"))
    return graph.names_in(p, "en", "1")


_EDGES = "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"


def _hierarchy(spark, d) -> DataFrame:
    tag = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    e = table(spark, d, "nation").select(tag("r", "n_regionkey").alias("src"), tag("n", "n_nationkey").alias("dst"))
    e = e.unionByName(table(spark, d, "customer").select(tag("n", "c_nationkey").alias("src"), tag("c", "c_custkey").alias("dst")))
    e = e.unionByName(table(spark, d, "supplier").select(tag("n", "s_nationkey").alias("src"), tag("s", "s_suppkey").alias("dst")))
    return e


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT dst AS node, 1 AS depth FROM e WHERE src = 'r1' UNION ALL SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 10) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def descendants(spark, d):
    return graph.descendants(_hierarchy(spark, d), spark.createDataFrame([("r1",)], "node string"))


_KEPT_EDGES = f"SELECT * FROM ({_EDGES}) WHERE NOT (dst LIKE 'n%' AND src = 'r2') AND dst NOT LIKE 'c%7'"


@query(f"WITH RECURSIVE e AS ({_KEPT_EDGES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, count(*) AS n, min(dst) AS first, max(dst) AS last FROM r GROUP BY src")
def maintained_closure(spark, d):
    """What every node of the hierarchy reaches, kept up: nations and suppliers first, customers added, some edges removed."""
    e = _hierarchy(spark, d)
    c = graph.Closure(e.where("dst not like 'c%'"))
    c.add(e.where("dst like 'c%'"))
    c.remove(e.where("(dst like 'n%' and src = 'r2') or dst like 'c%7'"))
    return c.pairs.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("first"), F.max("dst").alias("last"))


@query("SELECT o_orderkey AS file_id, (o_custkey % 50) AS \"offset\", arg_min(l_linenumber, (l_quantity::INT * 100 + l_linenumber)) AS node_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND o_custkey % 50 BETWEEN l_linenumber AND l_linenumber + l_quantity::INT GROUP BY ALL")
def point_in_interval(spark, d):
    """The shortest line span around an offset of each order."""
    points = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 50).alias("offset"))
    spans = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("node_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("end"))
    return paths.innermost(points, spans)


_LINES = "SELECT l_orderkey * 8 + l_linenumber AS node_id, l_orderkey AS s, l_orderkey + l_quantity::INT AS e FROM lineitem"


def _lines_of_one_file(spark, d) -> DataFrame:
    q = F.col("l_orderkey") + F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select(F.lit(0).alias("file_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node_id"), F.col("l_orderkey").alias("start"), q.alias("end"))


@query(f"SELECT o_orderkey AS \"offset\", arg_min(node_id, (e - s, node_id)) AS node_id, count(*) AS spans FROM orders JOIN ({_LINES}) ON o_orderkey BETWEEN s AND e GROUP BY o_orderkey")
def intervals_of_one_file(spark, d):
    """All lines as spans of one file: the shortest around each order's number, and how many are."""
    points = table(spark, d, "orders").select(F.lit(0).alias("file_id"), F.col("o_orderkey").alias("offset"))
    spans = _lines_of_one_file(spark, d)
    return paths.innermost(points, spans, "spans").select("offset", "node_id", "spans")


@query(f"SELECT a.node_id AS a, count(*) AS n, sum(b.node_id)::BIGINT AS ids FROM ({_LINES}) a JOIN ({_LINES}) b ON a.s <= b.e AND b.s <= a.e WHERE a.node_id % 8 = 1 AND b.node_id % 8 = 2 GROUP BY a.node_id")
def overlapping_spans(spark, d):
    """For each first line of an order, the second lines whose spans share a number with its own."""
    spans = _lines_of_one_file(spark, d)
    pairs = intervals.overlapping(spans.where("node_id % 8 = 1"), spans.where("node_id % 8 = 2"))
    return pairs.groupBy(F.col("a_node_id").alias("a")).agg(F.count("*").alias("n"), F.sum("b_node_id").alias("ids"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_only(spark, d):
    return feeds.latest(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, length(arg_max(text, turn)) AS n_chars FROM conversations GROUP BY conv_id")
def latest_revision(spark, d):
    r = feeds.latest(table(spark, d, "conversations"), ["conv_id"], ["turn"])
    return r.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query("SELECT (p_partkey % 2)::INT AS store_id, p_partkey AS file_id, p_name AS key, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE 2147483648 + 16777216 + p_partkey END AS gid FROM part WHERE starts_with(p_name, 'b')")
def store_union(spark, d):
    """Two stores looked up as one; ids are composite, and packed for those who need one number."""
    e = _parts(spark, d)
    u = lookup.union_stores(e.where("file_id % 2 = 0"), e.where("file_id % 2 = 1"))
    return u.where((F.col("index_id") == "parts") & F.col("key").startswith("b")).select("store_id", "file_id", "key", lookup.global_id("store_id", "file_id").alias("gid"))


@query("SELECT doc_id AS file_id, 'text' AS path FROM documents UNION ALL SELECT 0 AS file_id, '/items/' || item_id FROM benchmark")
def root_dedup(spark, d):
    """Roots from two providers that give the same files: one row a file_id, and one a path where there is no id yet."""
    f = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit("text").alias("path")).where("file_id > 0")
    first = table(spark, d, "documents").where("doc_id <= 0").select(F.col("doc_id").alias("file_id"), F.lit("text").alias("path"))
    new = table(spark, d, "benchmark").select(F.lit(0).cast("long").alias("file_id"), F.concat(F.lit("/items/"), F.col("item_id").cast("string")).alias("path"))
    return catalog.distinct_roots(f.unionByName(first).unionByName(new).unionByName(f).unionByName(new))


@query("SELECT doc_id AS file_id, '/' || source || '/' || doc_id AS path FROM documents WHERE source NOT IN ('src2')")
def input_collector(spark, d):
    """Files of two overlapping providers without those of the build directory."""
    f = _files(spark, d).select("file_id", "path")
    return catalog.collect_inputs([f.where("file_id % 2 = 0 or file_id % 3 = 0"), f.where("file_id % 2 = 1 or file_id % 5 = 0")], "/src2")


@query("SELECT key, file_id, n AS occurrences FROM (SELECT key, doc_id AS file_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(CASE WHEN source = 'src3' THEN 'fresh words here' ELSE lower(text) END, ' ')) AS key FROM documents WHERE source <> 'src7') WHERE key <> '' GROUP BY ALL)")
def incremental_equals_full(spark, d):
    """The word index after a batch of changes and deletes went through the store as one layer; the SQL rebuilds it."""
    files = _files(spark, d).withColumn("last_modified", F.lit(0).cast("long"))
    s = IndexStore(spark, fresh_path(spark, "store"))
    s.register(WORDS)
    s.refresh(files)
    changed = files.where("source = 'src3'").withColumns({"text": F.lit("Fresh words here"), "last_modified": F.lit(1).cast("long")})
    s.apply(changed, files.where("source = 'src7'").select("file_id"))
    return s.entries().select("key", "file_id", F.col("value").cast("long").alias("occurrences"))


@query("SELECT doc_id AS file_id, CASE WHEN doc_id % 6 = 0 THEN 'edited ' || lang ELSE text END AS text FROM documents")
def overlay_read(spark, d):
    f = _files(spark, d)
    over = f.where("file_id % 6 = 0").select("path", F.concat(F.lit("edited "), F.col("lang")).alias("text"), F.lit(2).alias("stamp"))
    over = over.unionByName(over.withColumns({"text": F.lit("older"), "stamp": F.lit(1)}))
    return catalog.with_overlay(f, over).select("file_id", "text")


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN doc_id::VARCHAR END AS below, '' AS itself FROM documents")
def relative_paths(spark, d):
    """Paths relative to a root: null outside of it, also where its name only begins alike (/src1 and /src10)."""
    f = _files(spark, d)
    return f.select(F.col("file_id").alias("doc_id"), t.relative_path("path", "/src1/").alias("below"), t.relative_path("path", F.col("path")).alias("itself"))


@query(r"SELECT doc_id, length(regexp_extract(substr(text, 1, k), '[\p{L}\p{N}_$]*$', 0)) AS n_partial, k - length(regexp_extract(substr(text, 1, k), '[\p{L}\p{N}_$.]*$', 0)) AS chain_start FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text, n_chars // 2 AS k FROM documents)")
def partial_identifiers(spark, d):
    """What is being typed in the middle of each text."""
    docs = table(spark, d, "documents").select("doc_id", F.translate("text", "\n", " ").alias("text"), F.floor(F.col("n_chars") / 2).cast("int").alias("k"))
    return docs.select("doc_id", F.length(t.partial_identifier("text", F.col("k"))).cast("long").alias("n_partial"), t.chain_start("text", F.col("k")).cast("long").alias("chain_start"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), -1) AS k, event_type IN ('click', 'view') AS flag, event_type = 'click' AS on_ FROM events")
def typed_options(spark, d):
    said = F.when(F.col("event_type") == "click", " Yes ").when(F.col("event_type") == "view", "ON").when(F.col("event_type") == "error", "no")
    e = table(spark, d, "events").withColumn("o", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("b"), F.when(F.col("event_type") == "click", " TRUE ").otherwise("1"))))
    return e.select("event_id", t.option_int("o", "k", -1).alias("k"), t.truthy(said).alias("flag"), t.option_bool("o", "b").alias("on_"))


@query("SELECT doc_id, least(greatest(CASE WHEN n_chars % 7 < n_chars % 5 THEN doc_id ELSE n_chars % 5 END, 0), n_chars) AS start_, CASE WHEN least(CASE WHEN n_chars % 7 < n_chars % 5 THEN doc_id ELSE n_chars % 5 END, n_chars) = least(CASE WHEN n_chars % 7 < n_chars % 5 THEN doc_id + 1 ELSE n_chars % 7 END, n_chars) AND least(CASE WHEN n_chars % 7 < n_chars % 5 THEN doc_id ELSE n_chars % 5 END, n_chars) < n_chars THEN least(CASE WHEN n_chars % 7 < n_chars % 5 THEN doc_id ELSE n_chars % 5 END, n_chars) + 1 ELSE least(CASE WHEN n_chars % 7 < n_chars % 5 THEN doc_id + 1 ELSE n_chars % 7 END, n_chars) END AS end_ FROM documents")
def diagnostic_ranges(spark, d):
    docs = table(spark, d, "documents").withColumn("r", t.clamp_range(F.col("n_chars") % 5, F.col("n_chars") % 7, F.col("doc_id"), F.col("n_chars")))
    return docs.select("doc_id", F.col("r.start").alias("start_"), F.col("r.end").alias("end_"))


@query("SELECT min(l_extendedprice) AS least, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.99) AS p99, max(l_extendedprice) AS largest FROM lineitem")
def percentiles(spark, d):
    return index.percentiles(table(spark, d, "lineitem"), "l_extendedprice").select(*[F.round(c, 6).alias(c) for c in ("least", "p50", "p90", "p99", "largest")])


_KEYWORDS = "(VALUES " + ", ".join(f"('{c}', '{k}')" for c, ks in paths.KEYWORDS.items() for k in ks) + ") k(context, keyword)"


@query(f"SELECT conv_id, turn, context, count(keyword) AS n, min(keyword) AS first_keyword FROM (SELECT *, CASE WHEN role = 'assistant' THEN 'code_block' WHEN turn = 0 THEN 'top_level' ELSE 'class_body' END AS context FROM conversations) LEFT JOIN {_KEYWORDS} USING (context) GROUP BY ALL")
def keyword_table(spark, d):
    """The keywords offered in the context of each turn."""
    at = F.when(F.col("role") == "assistant", "code_block").when(F.col("turn") == 0, "top_level").otherwise("class_body")
    c = table(spark, d, "conversations").select("conv_id", "turn", at.alias("context"))
    return c.join(paths.keywords(spark), "context", "left").groupBy("conv_id", "turn", "context").agg(F.count("keyword").alias("n"), F.min("keyword").alias("first_keyword"))


@query("SELECT (conv_id * 1000 + turn) AS point, CASE WHEN role = 'assistant' THEN 'code_block' WHEN turn < 3 THEN 'class_body' ELSE 'top_level' END AS context FROM conversations")
def contexts(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), "turn", "role")
    points = c.select("file_id", F.col("turn").alias("offset"))
    spans = c.where("role = 'assistant'").select("file_id", F.lit("block").alias("kind"), F.col("turn").alias("start"), F.col("turn").alias("end"))
    spans = spans.unionByName(c.select("file_id").distinct().select("file_id", F.lit("class").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(2).cast("long").alias("end")))
    return paths.context_of(points, spans).select((F.col("file_id") * 1000 + F.col("offset")).alias("point"), "context")


@query("SELECT p_name, count(*) AS n, string_agg(p_type, ',' ORDER BY p_type) AS descriptors FROM (SELECT DISTINCT p_name, p_type FROM part) GROUP BY p_name")
def overload_groups(spark, d):
    p = table(spark, d, "part").select(F.lit("part").alias("name"), F.col("p_name").alias("member"), F.col("p_type").alias("descriptor")).distinct()
    g = ranking.overloads(p)
    return g.select(F.col("member").alias("p_name"), F.size("descriptors").cast("long").alias("n"), F.array_join("descriptors", ",").alias("descriptors"))
