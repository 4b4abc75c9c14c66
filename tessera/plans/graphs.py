"""Queries over the graph of pages and their links, and over terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, qa
from ..operators.communities import hierarchy as levels_of
from ..operators.lexical import best, bm25_topk
from ..operators.sizes import materialized
from ..operators.text import chunk, pages_text
from ..operators.vector import knn
from ..sources import load
from .retrieval import BARE, BM25, DOT, QUESTIONS, WORDS, bm25

EDGES = r"""edges AS (SELECT DISTINCT 'p' || page_id AS src, 'l' || link AS dst FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*"([^"]*)"', 1)) AS link FROM pages)),
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""
TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
#: Walks start from the English pages.
SEEDS = "url LIKE '%://%/en/%'"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_pages(load(spark, sf_dir, "pages"))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").where(SEEDS).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("node"))


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return graph.edges_knn(vectors.where("vec_id % 50 = 0"), vectors, 3)


def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_cooccur(load(spark, sf_dir, "documents"))


def chunk_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_chunk_cooccur(load(spark, sf_dir, "documents"))


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(_edges(spark, sf_dir))


def two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.khop(_edges(spark, sf_dir), _seeds(spark, sf_dir), 2)


def two_hops_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.khop_recursive(_edges(spark, sf_dir), _seeds(spark, sf_dir), 2)


def connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_edges(spark, sf_dir))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(_edges(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(_edges(spark, sf_dir))


def triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles among terms at most two words apart in any turn of a conversation."""
    return graph.triangles(graph.edges_cooccur(load(spark, sf_dir, "conversations")))


def chunk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entities(load(spark, sf_dir, "documents"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    texts = pages_text(load(spark, sf_dir, "pages")).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("node"), F.col("page_id").alias("doc_id"), "text")
    return graph.community_summary(graph.communities(edges), edges, texts)


def hit_edges(vectors: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """Edges from the vectors of what was retrieved (doc_id) to their nearest ones."""
    asked = vectors.join(hits.select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    return graph.edges_knn(asked, vectors, k)


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's BM25 hits and their neighbours among the vectors of the same numbers."""
    hits = materialized(bm25(spark, sf_dir))
    return qa.graph_expand(hits.select("question_id", F.col("doc_id").alias("node")), hit_edges(load(spark, sf_dir, "embeddings"), hits), 1)


def hybrid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question answering from end to end: BM25, vector neighbours of the best hit and graph
    expansion of all hits, fused, packed into a context, and answered by its best sentence.

    No model gives questions a vector here, so that of the best document stands for it; documents and
    vectors meet by number."""
    docs, vectors = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings")
    questions = qa.first_questions(load(spark, sf_dir, "conversations"))
    words = materialized(bm25_topk(questions, docs, 5))
    heads = words.where("rank = 1").select("question_id", F.col("doc_id").alias("head"))
    asked = vectors.join(heads.select(F.col("head").alias("vec_id")).distinct(), "vec_id", "left_semi")
    near = knn(asked, vectors, 5).join(heads, F.col("query_id") == F.col("head")).select("question_id", "rank", F.col("vec_id").alias("doc_id"))
    hits = materialized(words.select("question_id", "rank", "doc_id").unionByName(near))
    walked = qa.graph_expand(hits.select("question_id", F.col("doc_id").alias("node")), hit_edges(vectors, hits), 1)
    order = Window.partitionBy("question_id").orderBy("hop", "node")
    around = walked.select("question_id", F.row_number().over(order).alias("rank"), F.col("node").alias("doc_id"))
    fused = qa.fuse([words, near, around])
    packed = qa.pack_context(qa.best_chunks(best(fused, 20), questions, docs), 6000)
    context = packed.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"), F.count("*").alias("sources"))
    answered = qa.answer(context.join(questions.withColumnRenamed("text", "question"), "question_id"))
    return answered.select("question_id", "sources", F.md5("context").alias("context_digest"), "answer")


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of pages and links, and communities of these, level by level."""
    return levels_of(_edges(spark, sf_dir))


def _entity_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities of all chunks, the edges between them, and the chunks' texts."""
    docs = load(spark, sf_dir, "documents")
    found = materialized(graph.entities(docs))
    pieces = chunk(docs).select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk"), "text")
    return found, materialized(graph.entity_edges(found)), pieces


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("question_id"), "text")


def _answered(spark: SparkSession, sf_dir: str, found: DataFrame, labels: DataFrame, pieces: DataFrame) -> DataFrame:
    labels = materialized(graph.with_lone(labels, found.select(F.col("term").alias("node"))))
    asked = _asked(spark, sf_dir)
    chosen = materialized(qa.chosen_communities(asked, found, labels))
    reports = qa.community_reports(found, qa.asked_labels(labels, chosen), pieces)
    answers = qa.community_answers(asked, found, labels, reports, chosen=chosen)
    return answers.select("question_id.conv_id", "question_id.turn", "communities", "community", "answer")


def community_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn answered from the communities of the entities it names: entities of chunks, their graph, label propagation, a report a community, partial answers, the best of them."""
    found, edges, pieces = _entity_graph(spark, sf_dir)
    return _answered(spark, sf_dir, found, graph.communities(edges), pieces)


def hierarchical_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the coarsest level of the hierarchy of entities."""
    found, edges, pieces = _entity_graph(spark, sf_dir)
    levels = levels_of(edges)
    last = levels.agg(F.coalesce(F.max("level"), F.lit(0)).alias("level")).first()["level"]
    coarse = materialized(levels.where(F.col("level") == last))
    return _answered(spark, sf_dir, found, coarse.select("node", "community"), pieces)


def _vote(i: int) -> str:
    return f"""l{i} AS (SELECT node, community FROM (SELECT b.src AS node, community, row_number() OVER (PARTITION BY b.src ORDER BY count(*) DESC, community) AS r
  FROM both_ways b JOIN l{i - 1} l ON b.dst = l.node GROUP BY b.src, community) WHERE r = 1)"""


LABELS = f"l0 AS (SELECT DISTINCT src AS node, src AS community FROM both_ways), {_vote(1)}, {_vote(2)}, {_vote(3)}"


def _step(i: int) -> str:
    return f"""r{i} AS (SELECT n.node, (1 - 0.85::DOUBLE) / c.n + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE node NOT IN (SELECT src FROM edges)) / c.n + 0.85::DOUBLE * coalesce(g.got, 0) AS rank
  FROM nodes n CROSS JOIN c LEFT JOIN (SELECT dst, sum(rank / o.k) AS got FROM edges JOIN r{i - 1} ON src = node JOIN (SELECT src, count(*) AS k FROM edges GROUP BY src) o USING (src) GROUP BY dst) g ON n.node = g.dst)"""


PAGERANK = "nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), c AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT node, 1::DOUBLE / n AS rank FROM nodes, c), " + ", ".join(map(_step, range(1, 6)))


def _cooccur(table: str) -> str:
    return f"""words AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {TERMS} AS t FROM {table})),
near AS (SELECT term, unnest([lead(term, 1) OVER w, lead(term, 2) OVER w]) AS other FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cooccur AS (SELECT least(term, other) AS src, greatest(term, other) AS dst, count(*) AS weight FROM near WHERE other IS NOT NULL AND term <> other GROUP BY 1, 2)"""


ENTITIES = f"""WITH pieces AS (SELECT doc_id || '#' || c AS chunk, substr(text, c * 400 + 1, 500) AS text FROM (SELECT doc_id, text, unnest(range(greatest(0, ceil((length(text) - 500) / 400.0))::BIGINT + 1)) AS c FROM documents WHERE length(text) > 0)),
post AS (SELECT chunk, term, count(*) AS tf FROM (SELECT chunk, unnest({TERMS}) AS term FROM pieces) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), n AS (SELECT count(DISTINCT chunk) AS n FROM post),
r AS (SELECT chunk, term, round(tf * ln(n / df::DOUBLE), 6) AS weight FROM post JOIN df USING (term), n)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY weight DESC, term)::INTEGER AS rank FROM r) WHERE rank <= 3"""

CHUNK_COOCCUR = f"""WITH pieces AS (SELECT doc_id || '#' || c AS chunk, substr(text, c * 400 + 1, 500) AS text FROM (SELECT doc_id, text, unnest(range(greatest(0, ceil((length(text) - 500) / 400.0))::BIGINT + 1)) AS c FROM documents WHERE length(text) > 0)),
t AS (SELECT DISTINCT chunk, unnest({TERMS}) AS term FROM pieces)
SELECT a.term AS src, b.term AS dst, count(*) AS weight FROM t a JOIN t b ON a.chunk = b.chunk AND a.term < b.term GROUP BY ALL"""

TRIANGLES = f"WITH docs AS (SELECT conv_id || '#' || turn AS doc_id, text FROM conversations), {_cooccur('docs')} SELECT count(*) AS triangles FROM cooccur x JOIN cooccur y ON x.dst = y.src JOIN cooccur z ON z.src = x.src AND z.dst = y.dst"

SUMMARIES = f"""WITH {EDGES}, {LABELS}, d AS (SELECT src AS node, count(*) AS degree FROM both_ways GROUP BY src),
r AS (SELECT community, node, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS r FROM l3 JOIN d USING (node)),
heads AS (SELECT community, count(*) AS size, string_agg(CASE WHEN r <= 3 THEN node END, ',' ORDER BY r) AS top_nodes FROM r GROUP BY community),
told AS (SELECT community, page_id, text FROM (SELECT page_id, {BARE} AS text FROM pages) JOIN l3 ON node = 'p' || page_id),
counts AS (SELECT community, term, count(*) AS n FROM (SELECT community, unnest({TERMS}) AS term FROM told) GROUP BY ALL),
common AS (SELECT community, list(term ORDER BY n DESC, term) AS common FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, term) AS k FROM counts) WHERE k <= 5 GROUP BY community),
pieces AS (SELECT community, page_id, c, substr(text, c * 400 + 1, 500) AS text FROM (SELECT *, unnest(range(greatest(0, ceil((length(text) - 500) / 400.0))::BIGINT + 1)) AS c FROM told WHERE length(text) > 0)),
first AS (SELECT community, arg_min(text, (-len(list_intersect(common, {TERMS})), page_id, c)) AS representative FROM pieces JOIN common USING (community) GROUP BY community)
SELECT community, size, top_nodes, array_to_string(common, ',') AS top_terms, representative FROM heads LEFT JOIN common USING (community) LEFT JOIN first USING (community)"""


def _hit_edges(hits: str) -> str:
    return f"""sims AS (SELECT q.vec_id AS src, d.vec_id AS dst, round({DOT}, 9) AS score FROM embeddings q JOIN embeddings d ON q.vec_id IN ({hits}) AND q.vec_id <> d.vec_id),
arcs AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM sims) WHERE r <= 3),
around AS (SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs)"""


LETTERS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
CHUNKED = "pieces AS (SELECT doc_id, doc_id || '#' || c AS chunk, c, substr(text, c * 400 + 1, 500) AS text FROM (SELECT doc_id, text, unnest(range(greatest(0, ceil((length(text) - 500) / 400.0))::BIGINT + 1)) AS c FROM documents WHERE length(text) > 0))"
HYBRID = rf"""WITH {QUESTIONS}, docs AS (SELECT * FROM documents), {BM25}, words AS (SELECT question_id, rank, doc_id FROM ranked WHERE rank <= 5),
near AS (SELECT question_id, rank, doc_id FROM (SELECT h.question_id, d.vec_id AS doc_id, row_number() OVER (PARTITION BY h.question_id ORDER BY round({DOT}, 9) DESC, d.vec_id) AS rank
  FROM words h JOIN embeddings q ON h.rank = 1 AND h.doc_id = q.vec_id JOIN embeddings d ON d.vec_id <> q.vec_id) WHERE rank <= 5),
hits AS (SELECT * FROM words UNION ALL SELECT * FROM near), h0 AS (SELECT DISTINCT question_id, doc_id AS node FROM hits), {_hit_edges('SELECT node FROM h0')},
walked AS (SELECT question_id, node, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT question_id, dst, 1 FROM h0 JOIN around ON src = node) GROUP BY ALL),
rankings AS (SELECT * FROM hits UNION ALL SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY hop, node), node FROM walked),
fused AS (SELECT question_id, doc_id, round(sum(1::DOUBLE / (60 + rank)), 9) AS score FROM rankings GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM fused),
{CHUNKED},
scored AS (SELECT question_id, t.rank, doc_id, c, p.text, len(list_intersect(list_distinct({LETTERS.format('q.text')}), {LETTERS.format('p.text')})) AS shared FROM top t JOIN questions q USING (question_id) JOIN pieces p USING (doc_id) WHERE t.rank <= 20),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, rank, doc_id ORDER BY shared DESC, c) AS r FROM scored) WHERE r <= 3),
placed AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank, doc_id, r) AS rank, text FROM few),
packed AS (SELECT * FROM (SELECT question_id, rank, text, sum(length(text)) OVER (PARTITION BY question_id ORDER BY rank) AS used FROM placed) WHERE used <= 6000),
context AS (SELECT question_id, string_agg(text, chr(10) ORDER BY rank) AS context, count(*) AS sources FROM packed GROUP BY question_id),
sentences AS (SELECT question_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT question_id, string_split(context, '.') AS s FROM context)),
judged AS (SELECT question_id, i, s, len(list_intersect({WORDS.format('q.text')}, {WORDS.format('s')})) AS n FROM sentences JOIN questions q USING (question_id))
SELECT question_id, any_value(sources) AS sources, md5(any_value(context)) AS context_digest, regexp_replace(arg_min(s, (-n, i)), '^\s+|\s+$', '', 'g') AS answer FROM judged JOIN context USING (question_id) GROUP BY question_id"""

COMMUNITY_ANSWERS = rf"""WITH {CHUNKED},
post AS (SELECT chunk, term, count(*) AS tf FROM (SELECT chunk, unnest({TERMS}) AS term FROM pieces) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), n AS (SELECT count(DISTINCT chunk) AS n FROM post),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY weight DESC, term) AS rank FROM (SELECT chunk, term, round(tf * ln(n / df::DOUBLE), 6) AS weight FROM post JOIN df USING (term), n)) WHERE rank <= 3),
both_ways AS (SELECT a.term AS src, b.term AS dst FROM found a JOIN found b ON a.chunk = b.chunk AND a.term <> b.term GROUP BY ALL), {LABELS},
labels AS (SELECT * FROM l3 UNION ALL SELECT DISTINCT term, term FROM found WHERE term NOT IN (SELECT node FROM l3)),
held AS (SELECT community, chunk, round(sum(weight), 6) AS weight FROM found JOIN labels ON term = node GROUP BY ALL),
reports AS (SELECT community, string_agg(text, chr(10) ORDER BY r) AS report FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY weight DESC, chunk) AS r FROM held) JOIN pieces USING (chunk) WHERE r <= 3 GROUP BY community),
questions AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
named AS (SELECT DISTINCT conv_id, turn, unnest({TERMS}) AS term FROM questions),
met AS (SELECT conv_id, turn, community, round(sum(weight), 6) AS weight FROM named JOIN (SELECT term, max(weight) AS weight FROM found GROUP BY term) USING (term) JOIN labels ON term = node GROUP BY ALL),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY weight DESC, community) AS r FROM met) WHERE r <= 5),
sentences AS (SELECT conv_id, turn, community, r, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT conv_id, turn, community, r, string_split(report, '.') AS s FROM chosen JOIN reports USING (community))),
judged AS (SELECT conv_id, turn, community, r, s, row_number() OVER (PARTITION BY conv_id, turn ORDER BY len(list_intersect(list_distinct({WORDS.format('q.text')}), {WORDS.format('s')})) DESC, r, i) AS best FROM sentences JOIN questions q USING (conv_id, turn)),
told AS (SELECT conv_id, turn, count(*) AS communities FROM chosen GROUP BY ALL)
SELECT q.conv_id, q.turn, coalesce(communities, 0) AS communities, community, regexp_replace(s, '^\s+|\s+$', '', 'g') AS answer
FROM questions q LEFT JOIN told USING (conv_id, turn) LEFT JOIN judged j ON j.conv_id = q.conv_id AND j.turn = q.turn AND best = 1"""

TWO_HOPS = f"WITH {EDGES}, h0 AS (SELECT 'p' || page_id AS node FROM pages WHERE {SEEDS}), h1 AS (SELECT dst AS node FROM both_ways WHERE src IN (SELECT node FROM h0)), h2 AS (SELECT dst AS node FROM both_ways WHERE src IN (SELECT node FROM h1)) SELECT node, min(hop)::INTEGER AS hop FROM (SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node"

QUERIES = {
    "g1_page_edges": (page_edges, f"WITH {EDGES} SELECT * FROM edges"),
    "g2_knn_edges": (knn_edges, "WITH s AS (SELECT q.vec_id AS src, d.vec_id AS dst, round(list_sum([a[1]::DOUBLE * a[2]::DOUBLE FOR a IN list_zip(q.embedding, d.embedding)]), 9) AS weight FROM embeddings q JOIN embeddings d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id) SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM s) WHERE r <= 3"),
    "g3_cooccurrence": (cooccurrence, f"WITH {_cooccur('documents')} SELECT * FROM cooccur"),
    "g3_chunk_cooccurrence": (chunk_cooccurrence, CHUNK_COOCCUR),
    "g4_degree": (degrees, f"WITH {EDGES} SELECT src AS node, count(*) AS degree FROM both_ways GROUP BY src"),
    "g5_khop": (two_hops, TWO_HOPS),
    "g5_khop_recursive": (two_hops_recursive, TWO_HOPS),
    "g6_components": (connected, f"WITH RECURSIVE {EDGES}, reach(node, seen) AS (SELECT src, src FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON r.seen = b.src) SELECT node, min(seen) AS component FROM reach GROUP BY node"),
    "g7_pagerank": (ranks, f"WITH {EDGES}, {PAGERANK} SELECT node, round(rank, 9) AS rank FROM r5"),
    "g8_communities": (labels, f"WITH {EDGES}, {LABELS} SELECT * FROM l3"),
    "g8_hierarchy": (hierarchy, None),
    "g9_triangles": (triangle_count, TRIANGLES),
    "g10_entities": (chunk_entities, ENTITIES),
    "g11_community_summary": (summaries, SUMMARIES),
    "q4_graph_expand": (expanded, f"WITH {QUESTIONS}, docs AS (SELECT * FROM documents), {BM25}, h0 AS (SELECT question_id, doc_id AS node FROM ranked WHERE rank <= 5), {_hit_edges('SELECT node AS doc_id FROM h0')}, h1 AS (SELECT question_id, dst AS node FROM h0 JOIN around ON src = node) SELECT question_id, node, min(hop)::INTEGER AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1) GROUP BY ALL"),
    "q8_hybrid_answers": (hybrid_answers, HYBRID),
    "q9_community_answers": (community_answers, COMMUNITY_ANSWERS),
    "q9_hierarchical_answers": (hierarchical_answers, None),
}
