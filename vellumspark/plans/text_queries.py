"""Queries on sources, sentences, chunkers and chunk rows, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.config import ChunkerConfig
from vellumspark.functions import text as T
from vellumspark.operators import chunking, rows, tables
from vellumspark.plans.base import oracle, query, table
from vellumspark.sources import files, markdown, plain
from vellumspark.tokenizers import Tokenizer


@query
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain.text_sections(table(spark, sf_dir, "documents")).select("doc_id", "section_ord", "text")


oracle(
    "text_sections",
    r"""SELECT doc_id, (generate_subscripts(b, 1) - 1)::INTEGER AS section_ord, unnest(b) AS text FROM (
        SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{2,}'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM documents)""",
)


@query
def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", plain.html_plain_text(F.col("html")).alias("text"))


oracle("html_plain_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")


@query
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("source"), F.col("html").alias("text"))
    found = files.html_sections(pages)
    return found.select("doc_id", "section_ord", "content_type", "heading", "level", F.array_join("parent_headings", " → ").alias("parents"), "text")


def _atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document for each region: a preamble, the region, its nations, and a deeper heading now and then."""
    nation = table(spark, sf_dir, "nation").withColumn("part", F.concat(F.lit("## "), F.col("n_name"), F.lit("\n\nNation "), F.col("n_nationkey").cast("string"), F.lit(".\n\n"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("#### Detail ##\nDeep "), F.col("n_name"), F.lit("\n\n"))).otherwise("")))
    parts = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "part"))), lambda x: x["part"]), "").alias("body"))
    text = F.concat(F.lit("Preamble\r\n\r\n# "), F.col("r_name"), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return table(spark, sf_dir, "region").join(parts, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lower("r_name").alias("source"), text.alias("text"))


@query
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.markdown_sections(_atlas(spark, sf_dir))
    return found.select("doc_id", "section_ord", "heading", "level", F.array_join("parent_headings", " → ").alias("parents"), chunking.parent_context(F.col("parent_headings"), F.col("heading")).alias("context"), "text")


oracle(
    "markdown_sections",
    """WITH s AS (
        SELECT r_regionkey::BIGINT AS doc_id, -2 AS k, 0 AS j, NULL AS heading, 0 AS level, '' AS parents, '' AS context, 'Preamble' AS text FROM region
        UNION ALL SELECT r_regionkey, -1, 0, r_name, 1, '', r_name, r_name FROM region
        UNION ALL SELECT n_regionkey, n_nationkey, 0, n_name, 2, r_name, concat(r_name, ' → ', n_name), concat('Nation ', n_nationkey, '.') FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT n_regionkey, n_nationkey, 1, 'Detail', 4, concat(r_name, ' → ', n_name), concat(r_name, ' → ', n_name, ' → Detail'), concat('Deep ', n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1)::INTEGER AS section_ord, heading, level::INTEGER AS level, parents, context, text FROM s""",
)


@query
def heading_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a heading of its user's document, of a level between 1 and 6."""
    events = table(spark, sf_dir, "events").withColumn("level", (F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(6)) + 1).cast("int"))
    listed = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "level", F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("title")))).alias("hs"))
    stacks = listed.withColumn("above", markdown.heading_stacks(F.transform("hs", lambda h: F.struct(h["level"].alias("level"), h["title"].alias("title"))), include_self=True))
    return stacks.select("user_id", F.explode(F.arrays_zip("hs", "above")).alias("z")).select("user_id", F.col("z.hs.event_id").alias("event_id"), F.col("z.hs.level").alias("level"), F.array_join("z.above", " → ").alias("breadcrumb"))


oracle(
    "heading_hierarchy",
    """WITH h AS (SELECT user_id, event_id, (((event_id * 7 + user_id) % 6) + 1)::INTEGER AS level, concat(event_type, '-', event_id) AS title FROM events),
    n AS (SELECT *, lead(event_id) OVER w AS x FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    ends AS (SELECT a.user_id, a.event_id, a.level, a.title, (SELECT min(b.event_id) FROM h b WHERE b.user_id = a.user_id AND b.event_id > a.event_id AND b.level <= a.level) AS until FROM h a)
    SELECT i.user_id, i.event_id, i.level, string_agg(a.title, ' → ' ORDER BY a.event_id) AS breadcrumb
    FROM h i JOIN ends a ON a.user_id = i.user_id AND (a.event_id = i.event_id OR (a.event_id < i.event_id AND a.level < i.level AND (a.until IS NULL OR a.until > i.event_id))) GROUP BY ALL""",
)


def _region_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each region: key and name of its nations; one cell short in every other row."""
    cells = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.col("n_nationkey").cast("string"), "n_name")).otherwise(F.array(F.col("n_nationkey").cast("string")))
    grouped = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("c")))), lambda x: x["c"]).alias("rows"))
    return grouped.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").cast("long").alias("doc_id"), F.struct(F.array(F.lit("key"), F.lit("name")).alias("headers"), "rows", F.col("r_name").alias("caption")).alias("t"))


@query
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region_tables(spark, sf_dir).select("doc_id", tables.to_markdown(F.col("t")).alias("text"))


oracle(
    "table_markdown",
    """SELECT r_regionkey::BIGINT AS doc_id, concat('**Table: ', r_name, '**', chr(10), chr(10), '| key | name |', chr(10), '| --- | --- |', chr(10),
        string_agg(concat('| ', n_nationkey, ' | ', CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END, ' |'), chr(10) ORDER BY n_nationkey)) AS text
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
)


@query
def table_linearized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region_tables(spark, sf_dir).select("doc_id", tables.to_text(F.col("t")).alias("text"))


oracle(
    "table_linearized",
    """SELECT r_regionkey::BIGINT AS doc_id, concat('Table (', r_name, '): | ', string_agg(concat('key: ', n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN concat(', name: ', n_name) ELSE '' END), ' | ' ORDER BY n_nationkey)) AS text
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
)


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose and Markdown tables by turns, a document for each part brand."""
    line = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("About "), "p_name")).otherwise(F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), "p_name", F.lit(" |")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("text")).withColumnRenamed("p_brand", "doc_id")


@query
def table_block_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.table_blocks(_listing(spark, sf_dir))
    return found.select("doc_id", "block", "kind", "text", F.coalesce(F.size("table_data.rows"), F.lit(0)).alias("n_rows"))


_ISLANDS = """l AS (SELECT p_brand AS doc_id, p_partkey AS n, CASE WHEN p_size % 5 = 0 THEN concat('About ', p_name) ELSE concat('| ', p_partkey, ' | ', p_name, ' |') END AS line FROM part),
    f AS (SELECT *, line LIKE '|%' AND line LIKE '%|' AS is_row FROM l),
    c AS (SELECT *, CASE WHEN is_row <> lag(is_row) OVER (PARTITION BY doc_id ORDER BY n) THEN 1 ELSE 0 END AS change FROM f),
    b AS (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS block FROM c),
    k AS (SELECT doc_id, block::INTEGER AS block, CASE WHEN is_row AND count(*) >= 2 THEN 'table' ELSE 'text' END AS kind, string_agg(line, chr(10) ORDER BY n) AS text, (CASE WHEN is_row AND count(*) >= 2 THEN count(*) - 2 ELSE 0 END)::INTEGER AS n_rows FROM b GROUP BY doc_id, block, is_row)"""
oracle("table_block_islands", f"WITH {_ISLANDS} SELECT * FROM k")


@query
def content_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.table_blocks(_listing(spark, sf_dir)).groupBy(F.col("kind").alias("content_type")).agg(F.count("*").alias("n"))


oracle("content_type_counts", f"WITH {_ISLANDS} SELECT kind AS content_type, count(*) AS n FROM k GROUP BY kind")


# --- files ----------------------------------------------------------------------------------------------------


def _sections_of(parser, docs: DataFrame) -> DataFrame:  # noqa: ANN001
    """Sections of files whose content is in the table: doc_id, source, content."""
    found = files.parse_with(parser, docs.withColumn("content", F.encode("content", "UTF-8")))
    return found.select("doc_id", "source", "section_ord", "heading", "level", "content_type", F.array_join("parent_headings", " → ").alias("parents"), "text")


def _nation_lists(spark: SparkSession, sf_dir: str, line: Column, glue: str) -> DataFrame:
    """A file for each nation that has customers: a line for each of them, in order of their keys."""
    listed = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), glue).alias("lines"))
    return listed.withColumn("source", F.concat(F.lit("nation."), F.col("doc_id").cast("string"), F.lit(".dat")))


@query
def csv_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of quoted names and ragged rows: customers without a segment in the list lack the last cell."""
    cell = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(","), "c_mktsegment"))
    found = _nation_lists(spark, sf_dir, F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit(', Ltd"'), cell), "\n")
    return _sections_of(files.csv_file, found.withColumn("content", F.concat(F.lit("\ufeffkey,name,segment\n\n"), "lines", F.lit("\n,,\n"))))


_CUSTOMER_LINES = """SELECT c_nationkey::BIGINT AS doc_id, concat('nation.', c_nationkey, '.dat') AS source, concat('nation.', c_nationkey) AS heading, {} AS text FROM customer GROUP BY c_nationkey"""
oracle(
    "csv_sections",
    f"""WITH t AS ({_CUSTOMER_LINES.format("""concat('**Table: nation.', c_nationkey, '.dat**', chr(10), chr(10), '| key | name | segment |', chr(10), '| --- | --- | --- |', chr(10),
        string_agg(concat('| ', c_custkey, ' | ', c_name, ', Ltd | ', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ' |'), chr(10) ORDER BY c_custkey))""")})
    SELECT doc_id, source, 0::INTEGER AS section_ord, heading, 1::INTEGER AS level, 'table' AS content_type, '' AS parents, text FROM t""",
)


@query
def json_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer, shown with an indent. The table's file is small for the work in it, so its rows are dealt out."""
    content = F.concat(F.lit('{"key":'), F.col("c_custkey").cast("string"), F.lit(',"name":"'), "c_name", F.lit('", "tags":["'), "c_mktsegment", F.lit('",null],"none":{}}'))
    customers = table(spark, sf_dir, "customer").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return _sections_of(files.json_file, customers.select(F.col("c_custkey").alias("doc_id"), F.concat("c_name", F.lit(".json")).alias("source"), content.alias("content")))


oracle(
    "json_sections",
    """SELECT c_custkey AS doc_id, concat(c_name, '.json') AS source, 0::INTEGER AS section_ord, c_name AS heading, 1::INTEGER AS level, 'text' AS content_type, '' AS parents,
        concat('{', chr(10), '  "key": ', c_custkey, ',', chr(10), '  "name": "', c_name, '",', chr(10), '  "tags": [', chr(10), '    "', c_mktsegment, '",', chr(10), '    null', chr(10), '  ],', chr(10), '  "none": {}', chr(10), '}') AS text FROM customer""",
)


@query
def xml_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, with text behind elements and entities in it."""
    found = _nation_lists(spark, sf_dir, F.concat(F.lit("<c><k>"), F.col("c_custkey").cast("string"), F.lit("</k> tail <n>"), "c_name", F.lit(" &amp; sons</n></c>")), "\n")
    return _sections_of(files.xml_file, found.withColumn("content", F.concat(F.lit("<list> lead "), "lines", F.lit("</list>"))))


_XML_TEXT = "concat('lead', chr(10), string_agg(concat(c_custkey, chr(10), 'tail', chr(10), c_name, ' & sons'), chr(10) ORDER BY c_custkey))"
oracle("xml_sections", f"WITH t AS ({_CUSTOMER_LINES.format(_XML_TEXT)}) SELECT doc_id, source, 0::INTEGER AS section_ord, heading, 1::INTEGER AS level, 'text' AS content_type, '' AS parents, text FROM t")


@query
def html_table_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation: a heading, a paragraph (inline text is joined without blanks), and its customers as a table under a second heading."""
    found = _nation_lists(spark, sf_dir, F.concat(F.lit("<tr><td>"), F.col("c_custkey").cast("string"), F.lit("</td><td>"), "c_name", F.lit("</td></tr>")), "")
    head = F.concat(F.lit("<html><body><h1>Nation "), F.col("doc_id").cast("string"), F.lit("</h1><p>Some <b>bold</b> &amp; plain<h2>List</h2><table><tr><th>Key</th><th>Name</th></tr>"))
    return _sections_of(files.html_file, found.withColumn("content", F.concat(head, "lines", F.lit("</table></body></html>"))))


oracle(
    "html_table_sections",
    f"""WITH t AS ({_CUSTOMER_LINES.format("concat('| Key | Name |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', c_custkey, ' | ', c_name, ' |'), chr(10) ORDER BY c_custkey))")})
    SELECT doc_id, source, 0::INTEGER AS section_ord, concat('Nation ', doc_id) AS heading, 1::INTEGER AS level, 'text' AS content_type, concat('Nation ', doc_id) AS parents, 'Somebold& plain' AS text FROM t
    UNION ALL SELECT doc_id, source, 1, 'List', 2, 'table', concat('Nation ', doc_id, ' → List'), text FROM t""",
)


@query
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are set apart by blank lines: a section for each line that isn't blank."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", "\n", "\r\n\r\n"))
    return plain.text_sections(docs).select("doc_id", "section_ord", "text")


oracle("text_blocks", r"SELECT doc_id, (generate_subscripts(b, 1) - 1)::INTEGER AS section_ord, unnest(b) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM documents)")


# --- sentences ------------------------------------------------------------------------------------------------

_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_COUNT = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'))"


@query
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ord", "sentence"))


oracle("sentences", f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INTEGER AS ord, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")


def _packed(spark: SparkSession, sf_dir: str, size: int, overlap: int) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.pack_sentences(T.sentences(F.col("text")), size, overlap)).alias("chunk_ord", "text"))


def _packing_sql(size: int, overlap: int) -> str:
    n = _COUNT.format("x")
    tail = f"list_filter(range(1, len(held) + 1), lambda i: list_sum(list_transform(held[i:], lambda x: {n})) <= {overlap})"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_SENTENCES} AS s FROM documents),
    f(doc_id, s, i, held, total, done) AS (
        SELECT doc_id, s, 1, []::VARCHAR[], 0::BIGINT, NULL::VARCHAR FROM d WHERE len(s) > 0
        UNION ALL
        SELECT doc_id, s, i + 1, CASE WHEN is_full THEN list_append(kept, s[i]) ELSE list_append(held, s[i]) END,
            (CASE WHEN is_full THEN coalesce(list_sum(list_transform(kept, lambda x: {n})), 0) ELSE total END + c)::BIGINT, CASE WHEN is_full THEN array_to_string(held, ' ') END
        FROM (SELECT *, {_COUNT.format("s[i]")} AS c, total + {_COUNT.format("s[i]")} > {size} AND len(held) > 0 AS is_full, held[coalesce({tail}[1], len(held) + 1):] AS kept FROM f WHERE i <= len(s))
    ), o AS (SELECT doc_id, i, done AS text FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, array_to_string(held, ' ') FROM f WHERE i = len(s) + 1)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_ord, text FROM o"""


@query
def sentence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, 64, 0)


@query
def sentence_packing_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, 64, 16)


oracle("sentence_packing", _packing_sql(64, 0))
oracle("sentence_packing_overlap", _packing_sql(64, 16))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as the sentences of a document for each label."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("ord"), "embedding", F.concat(F.lit("Vector "), F.col("vec_id").cast("string"), F.lit(".")).alias("sentence"))


@query
def semantic_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.boundaries(_units(spark, sf_dir), 0.0, ("doc_id",))
    return found.select("doc_id", F.col("ord").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "segment")


_SEGMENTS = """u AS (SELECT label::BIGINT AS doc_id, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
    s AS (SELECT doc_id, vec_id, round(list_inner_product(p, e) / (sqrt(list_inner_product(p, p)) * sqrt(list_inner_product(e, e)) + 1e-10), 10) AS sim FROM u),
    b AS (SELECT doc_id, vec_id, round(sim, 6) AS similarity, (sum(CASE WHEN sim IS NULL OR sim < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY vec_id ROWS UNBOUNDED PRECEDING) - 1)::INTEGER AS segment FROM s)"""
oracle("semantic_boundaries", f"WITH {_SEGMENTS} SELECT * FROM b")


@query
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.boundaries(_units(spark, sf_dir), 0.0, ("doc_id",))
    return chunking.merge_segments(found, ChunkerConfig(), ("doc_id",)).select("doc_id", "segment", "part", "text")


oracle("semantic_chunks", f"WITH {_SEGMENTS} SELECT doc_id, segment, 0::INTEGER AS part, string_agg(concat('Vector ', vec_id, '.'), ' ' ORDER BY vec_id) AS text FROM b GROUP BY doc_id, segment")


@query
def semantic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The semantic chunker from end to end, with a vector of a sentence's words: cut where their number changes much."""
    sections = plain.text_sections(table(spark, sf_dir, "documents"))
    embed = lambda s: F.array(T.word_count(s).cast("float"), F.lit(8.0).cast("float"))
    found = chunking.semantic(sections, ChunkerConfig(strategy="semantic", chunk_size=1_000_000, chunk_overlap=0, similarity_threshold=0.9), embed)
    return found.select("doc_id", "section_ord", "chunk_ord", "text")


oracle(
    "semantic_documents",
    rf"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents), l AS (SELECT doc_id, text, {_SENTENCES} AS s FROM d WHERE text <> ''),
    u AS (SELECT doc_id, generate_subscripts(s, 1) AS ord, unnest(s) AS sentence FROM l WHERE len(s) > 2), n AS (SELECT *, {_COUNT.format('sentence')}::DOUBLE AS n FROM u),
    p AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY ord) AS m FROM n),
    c AS (SELECT *, round((n * m + 64::DOUBLE) / (sqrt(m * m + 64::DOUBLE) * sqrt(n * n + 64::DOUBLE) + 1e-10), 10) AS sim FROM p),
    g AS (SELECT *, sum(CASE WHEN sim IS NULL OR sim < 0.9::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - 1 AS segment FROM c)
    SELECT doc_id, 0::INTEGER AS section_ord, segment::INTEGER AS chunk_ord, string_agg(sentence, ' ' ORDER BY ord) AS text FROM g GROUP BY doc_id, segment
    UNION ALL SELECT doc_id, 0, 0, text FROM l WHERE len(s) <= 2""",
)


# --- chunkers and rows ----------------------------------------------------------------------------------------


@query
def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a size that every section fits: a chunk for each."""
    sections = plain.text_sections(table(spark, sf_dir, "documents"))
    return chunking.structural(sections, ChunkerConfig(chunk_size=1_000_000, chunk_overlap=0)).select("doc_id", "section_ord", "chunk_ord", "text")


oracle("structural_chunks", r"SELECT doc_id, 0::INTEGER AS section_ord, 0::INTEGER AS chunk_ord, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''")


@query
def structural_chunks_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the default size: sections beyond it are split, which SQL can't say."""
    sections = plain.text_sections(table(spark, sf_dir, "documents"))
    return chunking.structural(sections, ChunkerConfig()).select("doc_id", "section_ord", "chunk_ord", "text")


@query
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = plain.text_sections(table(spark, sf_dir, "documents"))
    return rows.build_chunks(chunking.recursive(sections, ChunkerConfig()), "recursive").select("doc_id", "chunk_index", "total_chunks", "chunk_id", "token_count", "char_count", "text")


#: A byte-pair rank file that all workers can read.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query
def recursive_chunks_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = Tokenizer("bpe", RANKS)
    sections = plain.text_sections(table(spark, sf_dir, "documents"))
    return rows.build_chunks(chunking.recursive(sections, ChunkerConfig(), bpe), "recursive", bpe).select("doc_id", "chunk_index", "total_chunks", "token_count", "text")


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", Tokenizer().count(F.col("text")).cast("int").alias("n_words"), F.length("text").cast("long").alias("n_chars"))


oracle("token_counts", f"SELECT doc_id, {_COUNT.format('text')}::INTEGER AS n_words, length(text)::BIGINT AS n_chars FROM documents")


@query
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the file names that urls end in."""
    return table(spark, sf_dir, "pages").select("page_id", T.file_name(F.col("url")).alias("name"), T.file_stem(F.col("url")).alias("stem"))


oracle("source_files", r"SELECT page_id, string_split(url, '/')[-1] AS name, regexp_replace(string_split(url, '/')[-1], '^(.+)\.[^.]*$', '\1') AS stem FROM pages")


def dialogue_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as chunks under a section for each role."""
    raw = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source"), F.lit(0).alias("section_ord"), F.col("turn").cast("int").alias("chunk_ord"), "text", F.concat(F.lit("Dialogue → "), "role").alias("parent_context"), F.lit(None).cast("int").alias("page"), F.lit("text").alias("content_type"), F.lit(None).cast("string").alias("table_data"), F.array().cast("array<string>").alias("figures"))
    return rows.build_chunks(raw, "structural")


#: The same in SQL: c(doc_id, source, chunk_index, total_chunks, chunk_id, text, parent_context, section_id).
DIALOGUE = """c0 AS (SELECT conv_id AS doc_id, concat('conv-', conv_id) AS source, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS chunk_index, (count(*) OVER (PARTITION BY conv_id))::INTEGER AS total_chunks, text, concat('Dialogue → ', role) AS parent_context FROM conversations),
    c AS (SELECT *, concat('chunk_', substr(sha256(concat(doc_id, chr(31), chunk_index, chr(31), text)), 1, 12)) AS chunk_id, concat('sec_', substr(md5(parent_context), 1, 10)) AS section_id FROM c0)"""


@query
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_chunks(spark, sf_dir).select("doc_id", "source", "chunk_index", "total_chunks", "chunk_id", "section_id", "depth", "char_count", "token_count", "cache_status", "text")


oracle("chunk_rows", f"WITH {DIALOGUE} SELECT doc_id, source, chunk_index, total_chunks, chunk_id, section_id, 2::INTEGER AS depth, length(text)::INTEGER AS char_count, {_COUNT.format('text')}::INTEGER AS token_count, 'DISABLED' AS cache_status, text FROM c")

FIRST_SENTENCE = r"coalesce({}[1], '')"


def summarised(chunks: DataFrame) -> DataFrame:
    """chunks with their first sentence as summary, for every other one."""
    first = F.coalesce(F.get(T.sentences(F.col("text")), F.lit(0)), F.lit(""))
    return chunks.withColumn("summary", F.when(F.col("chunk_index") % 2 == 0, first).otherwise(""))


SUMMARY = f"CASE WHEN chunk_index % 2 = 0 THEN {FIRST_SENTENCE.format(_SENTENCES)} ELSE '' END"


@query
def contextual_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows.with_context(summarised(dialogue_chunks(spark, sf_dir)))
    return found.select("chunk_id", "contextual_text", rows.embed_text(F.col("contextual_text"), F.col("text")).alias("embed_text"))


oracle("contextual_text", f"WITH {DIALOGUE}, s AS (SELECT *, {SUMMARY} AS summary FROM c), t AS (SELECT chunk_id, concat_ws(chr(10), concat('Document: ', source), concat('Section: ', parent_context), CASE WHEN summary <> '' THEN concat('Summary: ', summary) END, text) AS contextual_text FROM s) SELECT chunk_id, contextual_text, contextual_text AS embed_text FROM t")


@query
def documents_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each document with the share of the document's words, in the document's order."""
    sections = plain.text_sections(table(spark, sf_dir, "documents"))
    doc = Window.partitionBy("doc_id")
    n = T.word_count(F.col("text"))
    return sections.select("doc_id", "section_ord", n.cast("int").alias("n_words"), F.count("*").over(doc).cast("int").alias("n_sections"))


oracle("documents_overview", rf"SELECT doc_id, 0::INTEGER AS section_ord, {_COUNT.format('text')}::INTEGER AS n_words, 1::INTEGER AS n_sections FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''")
