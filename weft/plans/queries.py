"""The engine's own queries over the test tables, and the SQL that gives the same rows.

Word tokens are lower-case texts split at single spaces, a rule that Spark and DuckDB share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import urls as U
from weft.functions import values as V
from weft.operators import blocking as B
from weft.operators import clusters as C
from weft.operators import partition as P
from weft.operators import rows as R
from weft.sources import lists as L
from weft.sources.tables import written
from weft.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words() -> F.Column:
    return F.split(F.lower("text"), " ")


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the blocking operators want them. The test pages have no stylesheets; the site's own sheet and one of its section stand in."""
    pages = B.with_url_parts(read(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), "url", "html"))
    sheet = lambda *p: F.concat(F.lit("http://"), "host", F.lit("/"), *p)
    return pages.withColumn("stylesheetHrefs", F.array(sheet(F.lit("site.css")), sheet(F.col("paths")[0], F.lit(".css"))))


URL_SQL = r"""
parts AS (
  SELECT page_id AS idx, url, html, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)) AS host,
         string_split(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/', ''), '/') AS paths
  FROM pages
)"""


@query("WITH " + URL_SQL + " SELECT 'path:' || coalesce(list_filter(paths, lambda p: p <> '')[1], '') AS block_key, count(*) AS pages FROM parts GROUP BY 1")
def path_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.with_url_parts(read(spark, sf_dir, "pages"))
    return pages.groupBy(F.concat(F.lit("path:"), B.path_key(F.col("paths"))).alias("block_key")).agg(F.count("*").alias("pages"))


@query("WITH " + URL_SQL + ", d AS (SELECT unnest([1, 2, 3, 4, 5]) AS depth) SELECT CAST(depth AS INTEGER) AS depth, count(DISTINCT array_to_string(list_filter(paths, lambda p: p <> '')[1:depth], '/')) AS keys FROM parts, d GROUP BY 1")
def path_depth_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.with_url_parts(read(spark, sf_dir, "pages"))
    counts = pages.agg(*[F.countDistinct(B.path_key(F.col("paths"), d)).alias(f"d{d}") for d in range(1, 6)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"d{d}").alias("keys")) for d in range(1, 6)])).alias("x")).select("x.*")


@query("WITH " + URL_SQL + ", h AS (SELECT host, count(DISTINCT idx) AS n, min(idx) AS first FROM parts WHERE host <> '' GROUP BY 1) SELECT host AS dominant FROM h ORDER BY n DESC, first LIMIT 1")
def dominant_stylesheet_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.dominant_host(page_rows(spark, sf_dir))


@query(
    "WITH "
    + URL_SQL
    + """, hrefs AS (SELECT idx, unnest(list_distinct(['http://' || host || '/site.css', 'http://' || host || '/' || paths[1] || '.css'])) AS href FROM parts),
df AS (SELECT href, count(*) AS n FROM hrefs GROUP BY 1 HAVING count(*) < 0.9 * (SELECT count(*) FROM parts) - 1e-9),
own AS (SELECT idx, list_sort(list(href)) AS hs FROM hrefs JOIN df USING (href) GROUP BY 1),
css AS (SELECT idx, substr(sha256('["' || array_to_string(hs, '","') || '"]'), 1, 16) AS k FROM own),
n AS (SELECT k, count(*) AS n FROM css GROUP BY 1)
SELECT p.idx, CASE WHEN n.n >= 2 THEN 'css:' || css.k ELSE 'path:' || coalesce(list_filter(p.paths, lambda x: x <> '')[1], '') END AS block_key
FROM parts p LEFT JOIN css USING (idx) LEFT JOIN n USING (k)"""
)
def stylesheet_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resolve_blocks(page_rows(spark, sf_dir)).select("idx", "block_key")


@query(
    "WITH "
    + URL_SQL
    + r""", q AS (SELECT idx, url, paths, paths[len(paths)] AS name, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS raw FROM parts)
SELECT idx, nullif(regexp_extract(name, '^.+(\.[^.]*)$', 1), '') AS extname, nullif(regexp_replace(name, '^(.+)\.[^.]*$', '\1'), '') AS basename,
       CAST(len(paths) AS INTEGER) AS depth,
       nullif(array_to_string(list_sort(list_filter(string_split(raw, '&'), lambda p: p <> '' AND NOT starts_with(p, 'PHPSESSID='))), '&'), '') AS query
FROM q"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), U.extension(u).alias("extname"), U.base_name(u).alias("basename"), F.size(U.path_segments(u)).alias("depth"), U.query_string(u).alias("query"))


@query(
    "WITH "
    + URL_SQL
    + r""", r AS (SELECT idx, '/' || array_to_string(paths, '/') AS path, paths[len(paths)] AS name FROM parts)
SELECT idx, CASE WHEN contains(name, '.') THEN path ELSE path || ':::text/html' END AS encoded, path AS pathname, CASE WHEN contains(name, '.') THEN NULL ELSE 'text/html' END AS mime,
       CASE WHEN path = '/' OR path LIKE '%/' THEN substr(path, 2) || 'index.html' WHEN contains(name, '.') THEN substr(path, 2) ELSE substr(path, 2) || '.html' END AS local_path
FROM r"""
)
def resource_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), "url", U.encode_resource(u, F.lit("text/html")).alias("encoded"))
    back = U.decode_resource(F.col("encoded"))
    return rows.select("idx", "encoded", back["pathname"].alias("pathname"), back["mimeType"].alias("mime"), U.local_path(u, U.mime_extension(F.lit("text/html; charset=utf-8"))).alias("local_path"))


@query(
    "WITH "
    + URL_SQL
    + """, s AS (SELECT DISTINCT list_filter(paths, lambda p: p <> '') AS parts FROM parts),
n AS (SELECT parts, unnest(range(0, len(parts) + 1)) AS k FROM s),
t AS (SELECT '/' || array_to_string(parts[1:k], '/') AS stem, bool_or(k = len(parts)) AS own, min(k) AS depth FROM n GROUP BY 1)
SELECT stem, CASE WHEN depth > 0 THEN CASE WHEN depth = 1 THEN '/' ELSE regexp_replace(stem, '/[^/]*$', '') END END AS parent_stem, CAST(depth AS INTEGER) AS depth, NOT own AS virtual FROM t"""
)
def url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.path_tree(read(spark, sf_dir, "pages").select(U.pathname(F.col("url")).alias("stem")))


@query("SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM documents) GROUP BY 1")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.document_frequency(read(spark, sf_dir, "documents"), words())


@query(
    """WITH t AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM documents),
f AS (SELECT token FROM t GROUP BY 1 HAVING count(*) >= 0.4 * (SELECT count(*) FROM documents) - 1e-9)
SELECT doc_id, count(f.token) AS template, count(*) - count(f.token) AS content FROM t LEFT JOIN f USING (token) GROUP BY 1"""
)
def template_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_by_frequency(read(spark, sf_dir, "documents"), "doc_id", words(), 0.4)


@query(
    """WITH d AS (SELECT DISTINCT CAST(n AS DOUBLE) / (SELECT count(*) FROM documents) AS v FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)),
g AS (SELECT v, lead(v) OVER (ORDER BY v DESC) AS nxt FROM d)
SELECT coalesce(least((SELECT (v + nxt) / 2 FROM g WHERE nxt IS NOT NULL ORDER BY v - nxt DESC, v DESC LIMIT 1), 0.8), 0.8) AS cut"""
)
def source_share_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    shares = docs.groupBy("source").count().crossJoin(F.broadcast(docs.agg(F.count("*").alias("total")))).select((F.col("count") / F.col("total")).alias("share"))
    return R.auto_cut(shares, "share", 0.8)


@query(
    """SELECT sha256(array_to_string(list_sort(list_distinct(string_split(lower(text), ' '))), chr(1))) AS signature, count(*) AS members, min(doc_id) AS first
FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"""
)
def equal_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.equal_sets(read(spark, sf_dir, "documents"), "doc_id", words())


@query(
    """WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS s FROM conversations)
SELECT a.conv_id, a.turn, CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))) AS similarity
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
)
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of each turn with the next of its conversation: one neighbour each, not all pairs."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", words().alias("t"))
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("n"))
    return rows.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", P.set_similarity(F.col("t"), F.col("n")).alias("similarity"))


@query("SELECT source, count(*) AS members, median(n_chars) AS median, CAST(quantile_disc(n_chars, 0.1) AS BIGINT) AS p10, min(n_chars) AS least FROM documents GROUP BY 1")
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("members"), F.expr("percentile(n_chars, 0.5)").alias("median"), F.expr("percentile_disc(0.1) within group (order by n_chars)").cast("long").alias("p10"), F.min("n_chars").alias("least"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line FROM l), x AS (SELECT doc_id, line, ls[line] AS t FROM n)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(length(t) - length(ltrim(t, ' ')) + 1 AS INTEGER) AS col, trim(t, ' ') AS value FROM x WHERE trim(t, ' ') <> '' AND NOT starts_with(trim(t, ' '), '#')"""
)
def lines_with_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(L.list_lines(F.col("text"))).alias("x"))
    return rows.select("doc_id", F.col("x.line").cast("int").alias("line"), F.col("x.column").cast("int").alias("col"), F.col("x.value").alias("value"))


@query(
    r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS v FROM documents), k AS (SELECT doc_id, v, regexp_extract(v, '^(\S+)', 1) AS key FROM l WHERE v <> '' AND NOT starts_with(v, '#'))
SELECT key, count(*) AS n, count(DISTINCT regexp_replace(substr(v, length(key) + 1), '^\s+', '')) AS n_values FROM k GROUP BY 1"""
)
def key_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.explode(L.key_values(F.col("text"))).alias("x"))
    return rows.groupBy(F.col("x.key").alias("key")).agg(F.count("*").alias("n"), F.countDistinct("x.value").alias("n_values"))


@query("""SELECT page_id, CASE WHEN contains(html, '<table') THEN '<table' WHEN regexp_matches(html, '(?i)class="AD"') THEN '/class="AD"/i' WHEN contains(html, '<nav') THEN '<nav' END AS keyword FROM pages""")
def page_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", V.keyword_check(F.col("html"), ["<table", '/class="AD"/i', "<nav"]).alias("keyword"))


@query(r"SELECT doc_id, substr(sha256(trim(regexp_replace(text, '[\s\x{a0}\x{2028}\x{3000}\x{85}\x{0b}]+', ' ', 'g'), ' ')), 1, 16) AS hash FROM documents")
def normalized_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", V.normalized_hash(F.col("text")).alias("hash"))


@query(
    """WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), b AS (SELECT o_orderkey, d, CASE dayofweek(d) WHEN 0 THEN d + 1 WHEN 6 THEN d + 2 ELSE d END AS start FROM s),
e AS (SELECT o_orderkey, start, start + 5 AS due, list_sum(list_transform(range(0, 6), lambda i: CASE WHEN dayofweek(start + CAST(i AS INTEGER)) IN (0, 6) THEN 1 ELSE 0 END)) AS w FROM b),
f AS (SELECT o_orderkey, start, due + CAST(w AS INTEGER) AS due FROM e)
SELECT o_orderkey, CAST(CAST(start AS DATE) AS VARCHAR) AS start, CAST(CAST(CASE dayofweek(due) WHEN 0 THEN due + 1 WHEN 6 THEN due + 2 ELSE due END AS DATE) AS VARCHAR) AS due FROM f"""
)
def task_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, due = V.holiday_period(F.to_date("o_orderdate"), 5)
    return read(spark, sf_dir, "orders").select("o_orderkey", start.cast("string").alias("start"), due.cast("string").alias("due"))


@query("SELECT doc_id, CASE WHEN round(n_chars / 1024) < 1024 THEN CAST(CAST(round(n_chars / 1024) AS BIGINT) AS VARCHAR) || 'KB' ELSE CAST(CAST(round(n_chars / 1048576) AS BIGINT) AS VARCHAR) || 'MB' END AS size FROM documents")
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", V.size_text(F.col("n_chars")).alias("size"))


@query(
    """WITH c AS (SELECT p_partkey, p_partkey % 256 AS r, (p_partkey * 7) % 256 AS g, p_size * 5 AS b FROM part),
l AS (SELECT p_partkey, r, g, b, list_transform([r, g, b], lambda c: CASE WHEN c / 255 <= 0.03928 THEN c / 255 / 12.92 ELSE pow((c / 255 + 0.055) / 1.055, 2.4) END) AS v FROM c),
x AS (SELECT p_partkey, r, g, b, 1.05 / (0.2126 * v[1] + 0.7152 * v[2] + 0.0722 * v[3] + 0.05) AS ratio FROM l)
SELECT p_partkey, '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') AS hex, round(ratio, 6) AS ratio, CASE WHEN ratio >= 7 THEN 'AAA' WHEN ratio >= 4.5 THEN 'AA' ELSE 'fail' END AS level FROM x"""
)
def color_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.col("p_partkey") % 256, (F.col("p_partkey") * 7) % 256, F.col("p_size") * 5
    ratio = V.contrast(V.luminance(F.lit(255), F.lit(255), F.lit(255)), V.luminance(r, g, b))
    color = V.rgb_hex(F.format_string("rgb(%d, %d, %d)", r, g, b.cast("long")))
    return read(spark, sf_dir, "part").select("p_partkey", color["hex"].alias("hex"), F.round(ratio, 6).alias("ratio"), V.contrast_level(ratio).alias("level"))


@query(
    """WITH a AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT user_id, min(first) AS first, string_agg(event_type, chr(10) ORDER BY first) AS environments FROM a GROUP BY 1"""
)
def cleaned_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))  # bounded by the types
    return R.cleaned_findings(once, ["user_id"], "event_type", "event_id")


@query("SELECT p_partkey, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 10) AS BIGINT) AS chunk FROM part")
def part_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunks(read(spark, sf_dir, "part"), 10, ["p_brand"], "p_partkey").select("p_partkey", "chunk")


@query("SELECT CAST(p_size AS INTEGER) AS n, CASE WHEN p_size <= 26 THEN chr(64 + p_size) ELSE chr(CAST(65 + floor((p_size - 27) / 26) AS INTEGER)) || chr(65 + (p_size - 27) % 26) END AS letters FROM (SELECT DISTINCT p_size FROM part)")
def sheet_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_size").distinct().select(F.col("p_size").alias("n"), V.column_letters(F.col("p_size")).alias("letters"))


@query("SELECT event_id, TRY_CAST(props->>'$.k' AS DOUBLE) AS number, CASE event_type WHEN 'click' THEN 'high' WHEN 'view' THEN 'medium' WHEN 'error' THEN 'low' END AS severity FROM events")
def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    impact = F.create_map(*[F.lit(x) for x in ("click", "serious", "view", "minor", "error", "moderate")])[F.col("event_type")]
    return read(spark, sf_dir, "events").select("event_id", V.cell_value(F.get_json_object("props", "$.k"), "number").alias("number"), V.severity(impact).alias("severity"))


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
)
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.windowed_counts(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flows.sessions(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


# --- Spark's own relational operators, as a baseline over the star schema -----------------------------------------------------


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2"""
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp'2000-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"""
)
def local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 3"""
)
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return read(spark, sf_dir, "orders").withColumn("rn", rn).where("rn <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "rn")


@query("SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) AS gid, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def order_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "orders").createOrReplaceTempView("weft_orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, grouping_id() AS gid, count(*) AS n FROM weft_orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# --- HTML and clusters: Python over Arrow batches, checked by tests -----------------------------------------------------------


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prepared(read(spark, sf_dir, "pages"), id_col="page_id")


@query()
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select(F.col("idx").alias("page_id"), F.size("tokens").alias("n_tokens"), R.token_signature(F.col("tokens")).alias("signature"))


@query()
def page_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select(F.col("idx").alias("page_id"), F.explode("instances").alias("x")).select("page_id", "x.type", "x.signature", "x.startLine", "x.startColumn", "x.endLine", "x.endColumn")


@query()
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    import pyarrow as pa

    def run(batches):
        from weft.functions.head import classify, collect, main_content

        for batch in batches:
            out = []
            for html in batch.column(1).to_pylist():
                entries, anchors, images = collect(html or "")
                main = main_content(html or "")
                out.append((json.dumps(classify(entries), ensure_ascii=False, sort_keys=True), len(anchors), len(images), main and main["characters"]))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))]], ["page_id", "meta", "anchors", "images", "main_characters"])

    return read(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "page_id long, meta string, anchors long, images long, main_characters long")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = B.resolve_blocks(page_rows(spark, sf_dir).drop("html"))
    return C.cluster_pages(_tokens(spark, sf_dir), keyed)


@query()
def template_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).select(F.col("idx").alias("page_id"), "block_key", "cluster_key")


@query()
def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(_clusters(spark, sf_dir), "found-clusters")
    reasons = P.cluster_reason_counts(found).select("cluster_key", F.size("core_tokens").alias("core_tokens"), F.col("n_siblings").cast("int").alias("siblings"))
    return P.cohesion(found).join(reasons, "cluster_key")


@query()
def cluster_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_rows(spark, sf_dir).select("idx", "paths", "stylesheetHrefs")
    found = written(_clusters(spark, sf_dir), "found-clusters").join(pages, "idx")
    return P.cross_duplicates(found, P.mirror_axis(pages))


@query()
def landmark_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.landmark_variants(written(_tokens(spark, sf_dir), "pages-prepared"), "nav").select(F.col("idx").alias("page_id"), "variant")


from weft.plans import cases, functions  # noqa: E402, F401  (functions registers its queries)

QUERIES["function_cases"], SQL["function_cases"] = cases.function_cases, cases.SQL
